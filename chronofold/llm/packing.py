"""Best-fit packing of token pieces into sequences by linear grouping.

Lengths are whole numbers from 1 to the capacity, so a corpus is a histogram of at most ``capacity`` counts, and
the whole plan is made from that histogram alone, whatever the number of documents:

1. Large pieces (more than ``small`` tokens) in descending order are cut into groups of equal cardinality; each
   length counts as the largest of its group.
2. Over these few sizes the configuration linear program is solved by column generation; configurations are
   taken a whole number of times, what is left over is placed best fit, largest first.
3. Actual lengths take the place of the rounded ones, in order, which leaves room in most sequences.
4. Small pieces go, largest first, into the sequence with the least room that holds them.

A plan is a table of rank intervals by length: the pieces of a length, ranked, fill their intervals. Ranks come
from a count of each task's pieces by length, so there is no global sort and no group in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.encoding import encoder
from chronofold.llm.shared import arrow_rows, stored, text_of

CAPACITY = 1024
#: Lengths up to this share of the capacity are small.
SMALL_SHARE = 1 / 16
GROUPS = 96
END_ID = 2
#: Texts that are split into words at once, and those of a batch from the JVM: they stand in memory beside the encoder's cache.
ROWS, BATCH_ROWS = 256, 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


@dataclass
class Plan:
    """Where the pieces of each length go: interval i holds ranks low[i] up to the next interval of its length."""

    capacity: int
    length: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    every: list[int] = field(default_factory=list)
    n_sequences: int = 0


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Column generation (revised simplex with a knapsack as pricing) for min sum x, A x >= counts."""
    k = len(sizes)
    columns = [[capacity // s if i == j else 0 for j in range(k)] for i, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    x = np.linalg.solve(basis, np.array(counts, float))
    desc, least = np.array(sizes), sizes[-1]  # sizes descend, so those that fit are the last ones
    fits = [int(np.searchsorted(-desc, -c)) for c in range(capacity + 1)]
    for _ in range(60 * k):
        duals = np.linalg.solve(basis.T, np.ones(k))
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(least, capacity + 1):  # unbounded knapsack over the few sizes
            fit = fits[c]
            with_one = best[c - desc[fit:]] + duals[fit:]
            j = int(with_one.argmax())
            best[c], choice[c] = (with_one[j], fit + j) if with_one[j] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = [0] * k, capacity
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                new[choice[c]] += 1
                c -= sizes[choice[c]]
        direction = np.linalg.solve(basis, np.array(new, float))
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        x = np.maximum(x - ratios[out] * direction, 0)
        x[out] = ratios[out]
        basis[:, out] = new
        columns[out] = new
    return list(zip(columns, x.tolist()))


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> Plan:
    """The plan for so many pieces of each length; takes the same time for any number of pieces."""
    small = int(capacity * SMALL_SHARE) if small is None else small
    plan, used = Plan(capacity), defaultdict(int)

    def place(length: int, n: int, sequence: int, offset: int, every: int = 1) -> None:
        plan.length.append(length)
        plan.low.append(used[length])
        plan.sequence.append(sequence)
        plan.offset.append(offset)
        plan.every.append(every)
        used[length] += n

    if n := histogram.get(capacity, 0):  # full pieces need no plan
        place(capacity, n, 0, 0)
        plan.n_sequences = n
    large = [(s, n) for s, n in sorted(histogram.items(), reverse=True) if small < s < capacity and n]
    total = sum(n for _, n in large)
    # Groups of equal cardinality: (size, count) runs of each, the largest first.
    runs: list[list[list[int]]] = []
    per = max(1, -(-total // groups))
    room = 0
    for s, n in large:
        while n:
            if not room:
                runs.append([])
                room = per
            take = min(n, room)
            runs[-1].append([s, take])
            n, room = n - take, room - take
    sizes, left = [g[0][0] for g in runs], [sum(n for _, n in g) for g in runs]
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, number of sequences)

    def fill(pattern: list[int], times: int) -> None:
        """Takes the pieces of a configuration from the groups; cuts it where an actual length changes."""
        while times:
            heads, m = defaultdict(int), times
            slots = [g for g, a in enumerate(pattern) for _ in range(a)]
            taken: list[tuple[int, int]] = []
            for g in slots:  # several slots of a group take from the same run: m of each
                heads[g] += 1
            for g, a in heads.items():
                m = min(m, max(1, runs[g][-1][1] // a))
            for g in slots:
                taken.append((g, runs[g][-1][0]))
                if runs[g][-1][1] < m:  # the run ends within this sequence (m is 1)
                    raise AssertionError("a run ended early")
                runs[g][-1][1] -= m
                if not runs[g][-1][1]:
                    runs[g].pop()
            at = 0
            for _, s in taken:
                place(s, m, plan.n_sequences, at)
                at += s
            for g in slots:
                left[g] -= m
            rooms[capacity - at].append((plan.n_sequences, m))
            plan.n_sequences += m
            times -= m

    for g in runs:
        g.reverse()  # runs are taken from the end
    if sizes:
        for pattern, x in _configurations(sizes, left, capacity):
            times = int(x + 1e-6)
            for g, a in enumerate(pattern):
                if a:
                    times = min(times, left[g] // a)
            if times > 0:
                fill(pattern, times)
    # What whole numbers left over: best fit over actual lengths, largest first, then the small ones likewise.
    rest: dict[int, int] = defaultdict(int)
    for g in runs:
        for s, n in g:
            rest[s] += n
    for s, n in histogram.items():
        if 0 < s <= small and n:
            rest[s] += n
    open_rooms = sorted(rooms)
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            i = bisect.bisect_left(open_rooms, s)
            if i == len(open_rooms):
                k = capacity // s
                times = n // k or 1
                rooms_new, first = capacity, plan.n_sequences
                plan.n_sequences += times
                spans = [(first, times)]
            else:
                rooms_new = open_rooms[i]
                first, times = rooms[rooms_new].pop()
                if not rooms[rooms_new]:
                    open_rooms.pop(i)
                k = rooms_new // s
                if n < k * times:
                    full = max(1, n // k)
                    if full < times:
                        if not rooms[rooms_new]:
                            bisect.insort(open_rooms, rooms_new)
                        rooms[rooms_new].append((first + full, times - full))
                    times = full
                spans = [(first, times)]
            for first, times in spans:
                k = min(k, -(-n // times))
                for j in range(k):
                    m = min(times, n)
                    place(s, m, first, capacity - rooms_new + j * s)
                    n -= m
                after = rooms_new - k * s
                if not rooms[after]:
                    bisect.insort(open_rooms, after)
                rooms[after].append((first, times))
    assert dict(used) == {s: n for s, n in histogram.items() if n}, "every piece has a place"
    return plan


def _pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces with the part (task) that made them and their number by length within it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer_path, True), TaskContext.get().partitionId(), [0] * (capacity + 1)
        last = end_id.to_bytes(4, "little")
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some, rows = batch.slice(a, ROWS), []
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode_bytes(some.column(1).to_pylist())):
                    ids += last
                    total = len(ids) // 4
                    start, end, piece = 0, (total - 1) % capacity + 1, 0
                    while start < total:
                        n = end - start
                        rows.append((doc_id, piece, start, n, zlib.crc32(ids[4 * start : 4 * end]), part, seen[n]))
                        seen[n] += 1
                        piece, start, end = piece + 1, end, end + capacity
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """Packs all docs (doc_id, text): a row per piece with its sequence_id and offset.

    A document's ids end with ``end_id``; only longer ones are cut, into full pieces behind a first piece that may be
    shorter. A missing text is the empty one (a piece of one id), a missing doc_id stays missing; equal rows are packed
    each for itself. An empty table gives no rows.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        pieces = stored(_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    parts = pieces.groupBy("part", "length").count()
    # At most ``capacity`` rows reach the driver.
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_packing(histogram, capacity, groups)
    base = parts.select("part", "length", F.expr("sum(count) over (partition by length order by part rows between unbounded preceding and 1 preceding)").alias("before"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("nth"))
    order = np.lexsort((plan.low, plan.length))
    width = 1 << 50
    key, sequence, offset, low = (np.array(v, np.int64)[order] for v in ([s * width + x for s, x in zip(plan.length, plan.low)], plan.sequence, plan.offset, plan.low))
    held = docs.sparkSession.sparkContext.broadcast((key, sequence, offset, low))  # bounded by the plan's size, not by the corpus

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset, low = held.value
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(key, length * width + rank, side="right") - 1
            cols = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(sequence[at] + rank - low[at]), "offset": pa.array(offset[at])})

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
