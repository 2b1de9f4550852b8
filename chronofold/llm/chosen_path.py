"""N-gram Jaccard join by chosen paths: texts are sets of five-word shingles, linked at a similarity of 0.8 or more.

1. Texts with equal shingle sets are one class, counted and represented once, however many copies there are.
2. Every class has COORDINATES samples of its set (the shingle of least hash under each of as many hash functions; two
   sets share a sample with a probability equal to their similarity). In every run, classes are split recursively by a
   sampled coordinate, which the path so far chooses, in a quarter of cases by two; sets stay together where they
   share the sampled token. Buckets of up to LIMIT classes are done, and so are those that several runs have alike; other
   larger ones are split again, up to DEPTH times.
3. In each bucket all sets are compared exactly and a spanning forest of the links found goes out, not all pairs. What
   is larger after the last split holds near copies mostly; it is dealt to blocks of LIMIT classes, every run another way,
   and each block has two leaders of the bucket too, so links across blocks are found through them.
4. The first runs' links make components. Of the other runs' buckets, only those in which components meet are compared, in the same way.
   Where components still meet in a bucket of more than LIMIT classes, cells of LIMIT members outside its main component
   are compared with LIMIT of it, and with each other, so no link between components is lost; a main component meets its outsiders
   once, not in every run. Where more than DENSE members are outside (texts of one template, too far apart for a link), the bucket is
   first split by prefixes: of sets at the threshold each has one of the other's rarest shingles among its own rarest (all but ``threshold`` of
   them, and one), whatever order of rarity is used; here it comes from some 32 members. Components of all links are the groups.
5. Links are counted exactly within components, in pairs of blocks that give a sum for each class: rows grow with a
   component's size times its blocks, never with its pairs. (Counting exactly is quadratic work in a component's
   different texts; copies cost nothing.)

Runs are repeated until a pair at the threshold is missed with a probability of at most 1 - recall, from the survival of
DEPTH splits. Shingles are 64-bit hashes for samples and class keys, 32-bit ones for the exact comparison (a chance match of two
shingles changes a pair's similarity by less than one shingle, with probability |A| |B| / 2 ** 32).

Nulls: a missing text has no shingles and, like an empty one, no links. A missing doc_id stays missing; the group's id is
its least doc_id. Texts of fewer than five words are one shingle. Rows that are equal are copies. Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.line_rules import MIX, WHITE, span_hashes
from chronofold.llm.shared import stored, text_of

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 64
LIMIT = 128
DEPTH = 3
#: Members outside a bucket's main component beyond which the bucket is split by prefixes.
DENSE = 1024
#: Runs whose buckets are all compared.
FIRST_RUNS = 2
#: Links are counted in pairs of blocks of so many classes; in larger groups FEW_BLOCKS wider blocks, up to WIDE_BLOCK, keep the rows few.
COUNT_BLOCK, WIDE_BLOCK, FEW_BLOCKS = 256, 1024, 16
BATCH_BYTES = 1 << 19
BROADCAST_ROWS = 1_000_000
#: Bytes of shared shingles, over all dense buckets, that are broadcast; beyond it both sides shuffle.
COMMON_BYTES = 16 << 20

_rng = np.random.default_rng(11)
_A = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def n_runs(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs that miss a pair at the threshold with probability 1 - recall at most, if it goes through ``depth`` splits."""
    alive = 1.0
    for _ in range(depth):  # one branch, or two for a quarter of the nodes
        alive = 0.75 * threshold * alive + 0.25 * (1 - (1 - threshold * alive) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted different 64-bit shingles of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    white = WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    h = span_hashes(data, starts, np.flatnonzero(white & np.concatenate([[False], ~white[:-1]])))
    cut = np.searchsorted(starts, ends).tolist()
    out, a = [], 0
    joined = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        joined = (joined ^ (joined >> np.uint64(30))) * MIX[0] + h[k : k + len(joined)] * MIX[1]
    for b in cut:
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = (one ^ (one >> np.uint64(30))) * MIX[0] + h[i : i + 1] * MIX[1]
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def samples(s: np.ndarray) -> np.ndarray:
    """The least hash of a set under each function, as 32-bit integers."""
    out = np.full(COORDINATES, (1 << 32) - 1, np.uint64)
    for a in range(0, len(s), 4096):
        x = s[None, a : a + 4096] * _A[:, None] + _B[:, None]
        out = np.minimum(out, (x >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32).view(np.int32)


def linked_pairs(sets: list[np.ndarray], threshold: float = THRESHOLD, split: int | None = None) -> np.ndarray:
    """Matrix of exact comparisons: which sets have a similarity of threshold or more (with split: first part by second)."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set alone is in no intersection
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    split = 0 if split is None else split
    rows = slice(0, split or len(sets))
    cols = slice(split, len(sets))
    common = np.zeros((len(sizes[rows]), len(sizes[cols])), np.float32)
    width = 2048
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, width):
        i, j = np.searchsorted(column, [a, a + width])
        block = np.zeros((len(sets), min(width, total - a)), np.float32)
        block[owner[i:j], column[i:j] - a] = 1
        common += block[rows] @ block[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    return (common >= threshold * union - 1e-6) & (union > 0)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    n, seen, out = len(linked), np.zeros(len(linked), bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            stack += new.tolist()
    return out


DIGEST = "doc_id long, h long, n int, key binary, sig array<int>, sh binary"


def _digest(docs: DataFrame) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            sizes = np.cumsum([len(x.as_buffer()) + 1 for x in texts])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                sets = shingle_sets(texts.slice(at, end - at).to_pylist())
                cols = [
                    batch.column(0).slice(at, end - at),
                    batch.column(1).slice(at, end - at),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([samples(s) for s in sets], pa.list_(pa.int32())),
                    pa.array([np.unique(s.astype(np.uint32)).tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in DIGEST.split(", ")])
                at = end
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("h"), text_of().alias("text")).mapInArrow(of, DIGEST).withColumn("row_id", F.monotonically_increasing_id())


def _split(rows: DataFrame) -> DataFrame:
    """(run, cls, sig, path) one level down: (run, path, cls)."""
    path = F.col("path")

    def step(salt: int) -> Column:
        at = F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(path, at, F.get("sig", at))

    two = F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0
    return rows.select("run", "cls", F.explode(F.when(two, F.array_distinct(F.array(step(1), step(2)))).otherwise(F.array(step(1)))).alias("path"))


def _buckets(classes: DataFrame, runs: int) -> DataFrame:
    """Members (run, path, cls, n) of the final buckets: those of up to LIMIT classes, those that several runs have, and those that stay larger."""
    out, rows = None, classes.select("cls", "sig", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).withColumn("path", F.xxhash64("run"))
    for level in range(DEPTH):
        members = stored(_split(rows), f"level{level}")
        mark = F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("mark")
        counts = stored(members.groupBy("path", "run").agg(F.count(F.lit(1)).alias("n"), mark).where("n > 1"), f"counts{level}")
        # The fingerprint of a bucket's members: the same bucket of several runs is compared once, and as a whole (see 4), so it is split no more.
        last = level == DEPTH - 1
        alike = counts.groupBy("n", "mark").agg(F.min(F.struct("run", "path")).path.alias("path"), F.count(F.lit(1)).alias("times")).select("path", "n", "times")
        alike = stored(alike, f"alike{level}")
        ends = F.lit(last) | (F.col("n") <= LIMIT) | (F.col("times") > 1)
        done = members.join(alike.where(ends).select("path", "n"), "path").select("run", "path", "cls", "n")
        out = done if out is None else out.unionByName(done)
        if not last:
            rows = members.join(alike.where(~ends).select("path"), "path").join(classes.select("cls", "sig"), "cls").select("run", "cls", "sig", "path")
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows with equal keys; the input is sorted by them."""
    have: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if have and any(have[0][k] != row[k] for k in keys):
                yield have
                have = []
            have.append(row)
        pa.default_memory_pool().release_unused()
    if have:
        yield have


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block (path, block): a spanning forest over the roots, so what is linked already is not told again."""
    for rows in _grouped(batches, ("path", "block")):
        rows = list({r["cls"]: r for r in rows}.values())
        roots, at = np.unique([r["root"] for r in rows], return_inverse=True)
        k = len(roots)
        if k < 2:
            continue
        i, j = np.nonzero(np.triu(linked_pairs([np.frombuffer(r["sh"], "<u4") for r in rows]), 1))
        apart = at[i] != at[j]
        i, j = i[apart], j[apart]
        pairs, first = np.unique(np.minimum(at[i], at[j]) * k + np.maximum(at[i], at[j]), return_index=True)
        if not len(pairs):
            continue
        told = dict(zip(pairs.tolist(), first.tolist()))
        linked = np.zeros((k, k), bool)
        linked[pairs // k, pairs % k] = linked[pairs % k, pairs // k] = True
        of = [told[min(x, y) * k + max(x, y)] for x, y in forest(linked)]
        a, b = np.array([(rows[i[e]]["cls"], rows[j[e]]["cls"]) for e in of]).T
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _edges(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a < b) found in blocks (path, block, cls, root)."""
    rows = blocks.join(sets, "cls").select("path", "block", "cls", "root", "sh")
    return rows.repartition("path", "block").sortWithinPartitions("path", "block").mapInArrow(_compare, "a long, b long").distinct()


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(path, cls, root) of rows (path, cls): the component, or the class itself."""
    return rows.join(found, rows["cls"] == found["v"], "left").select("path", "cls", F.coalesce(found["root"], rows["cls"]).alias("root"))


def _blocks(rows: DataFrame) -> DataFrame:
    """(path, block, cls, root) of buckets (path, cls, root, n): one block up to LIMIT members; blocks of larger buckets share two leaders."""
    n_blocks = F.ceil(F.col("n") / LIMIT).cast("long")
    order = F.struct(F.xxhash64("path", "cls").alias("lead"), "cls", "root")
    leaders = rows.where(F.col("n") > LIMIT).groupBy("path", "n").agg(F.array(F.min(order), F.max(order)).alias("heads"))
    leaders = leaders.select("path", "heads", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block")).select("path", "block", F.explode("heads").alias("h"))
    return rows.select("path", F.pmod(F.xxhash64("cls", "path"), n_blocks).alias("block"), "cls", "root").unionByName(leaders.select("path", "block", "h.cls", "h.root"))


def _cells(rows: DataFrame) -> DataFrame:
    """(path, block, cls, root) of rows (path, cls, root, main, m, o): cells in which every member outside ``main`` meets all others.

    m members are in the main component and o are not; a cell has about LIMIT of either.
    """
    k_main, k_other = (F.ceil(F.col(c) / LIMIT).cast("long") for c in ("m", "o"))
    is_main = F.col("root") == F.col("main")
    at = F.pmod(F.xxhash64("cls", "path"), F.when(is_main, k_main).otherwise(k_other))
    wide = 1 << 31
    with_others = F.transform(F.sequence(F.lit(0).cast("long"), k_other - 1), lambda c: c * wide + at)
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), k_main - 1), lambda j: at * wide + j)
    # Others of one part meet in their cells with the main ones; parts meet in cells below zero.
    apart = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), k_other - 1), lambda x: x != at), lambda x: -1 - F.least(at, x) * wide - F.greatest(at, x))
    return rows.select("path", "cls", "root", F.explode(F.when(is_main, with_others).otherwise(F.concat(with_main, apart))).alias("block")).select("path", "block", "cls", "root")


def _mains(counts: DataFrame, *more: Column) -> DataFrame:
    """(path, main, m, o) of counts (path, root, c) where components meet: the largest one, its members and the others."""
    return counts.groupBy("path").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("m"), (F.sum("c") - F.max("c")).alias("o"), *more).where("o > 0")


def _with_main(rows: DataFrame) -> DataFrame:
    """rows (path, cls, root) of the paths where components meet, with the largest one (main), its members (m) and the others (o)."""
    main = _mains(rows.groupBy("path", "root").agg(F.count(F.lit(1)).alias("c")))
    return rows.join(main, "path").select("path", "cls", "root", "main", "m", "o")


def _by_main(rows: DataFrame, small: int = 0) -> DataFrame:
    """Buckets (of ``_with_main``) of more than ``small`` members put together by main component, so that it meets its outsiders once, not in
    every run or list. Buckets of more than DENSE outsiders stay as they are."""
    rows = stored(rows, "apart")  # read three times
    stay = (F.col("m") + F.col("o") <= small) | (F.col("o") > DENSE)
    joined = stored(rows.where(~stay).select(F.xxhash64("main", F.lit("main")).alias("path"), "cls", "root").distinct(), "joined")
    return rows.where(stay).unionByName(_with_main(joined))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, common): the shingles that two or more of a path's sampled sets have, the rarest first."""
    for rows in _grouped(batches, ("path",)):
        values, n = np.unique(np.concatenate([np.frombuffer(r["sh"], "<u4") for r in rows]), return_counts=True)
        values, n = values[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([rows[0]["path"]], pa.int64()), pa.array([values[np.argsort(n, kind="stable")].tobytes()], pa.binary())], names=["path", "common"])


def prefix(x: np.ndarray, common: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The rarest of a set's shingles, one of which any set at the threshold has among its own: those that are not common, then the common ones in their order."""
    order = np.argsort(common, kind="stable")
    at = np.searchsorted(common, x, sorter=order)
    rank = np.full(len(x), -1)
    if len(common):
        where = order[np.minimum(at, len(common) - 1)]
        rank = np.where(common[where] == x, where, -1)
    keep = len(x) - math.ceil(threshold * len(x) - 1e-6) + 1
    return x[np.lexsort((x, rank))][:keep]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            some = batch.slice(a, 1024)
            tokens = [prefix(np.frombuffer(r["sh"], "<u4"), np.frombuffer(r["common"] or b"", "<u4")).view(np.int32) for r in some.select(["sh", "common"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("path", "cls", "root")), pa.array(tokens, pa.list_(pa.int32()))], names=["path", "cls", "root", "tokens"])
        pa.default_memory_pool().release_unused()


def _prefix_lists(dense: DataFrame, sets: DataFrame) -> DataFrame:
    """dense (path, cls, root, m, o) dealt to the lists of its prefixes in which components meet: (path, cls, root, main, m, o), a path for each list.

    Lists with the same members are one. The main component comes from the counts that choose the lists, so members are joined once.
    """
    some = dense.where(F.pmod(F.xxhash64("path", "cls"), F.greatest(F.lit(1), F.floor((F.col("m") + F.col("o")) / 32))) == 0).select("path", "cls")
    common = stored(some.join(sets, "cls").select("path", "sh").repartition("path").sortWithinPartitions("path").mapInArrow(_common, "path long, common binary"), "common")
    size = common.agg(F.sum(F.length("common") + 16)).first()[0] or 0
    rows = dense.join(sets, "cls").join(F.broadcast(common) if size <= COMMON_BYTES else common, "path", "left")
    told = rows.select("path", "cls", "root", "sh", "common").mapInArrow(_prefixes, "path long, cls long, root long, tokens array<int>")
    told = stored(told.select(F.explode("tokens").alias("token"), "path", "cls", "root").select(F.xxhash64("path", "token").alias("path"), "cls", "root"), "prefixes")
    counts = told.groupBy("path", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("mark"))
    lists = _mains(counts, F.sum("mark").alias("mark")).groupBy("m", "o", "mark").agg(F.min(F.struct("path", "main")).alias("list"))
    return told.join(lists.select("list.path", "list.main", "m", "o"), "path").select("path", "cls", "root", "main", "m", "o")



def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (a, b): root is the least vertex of its component.

    Large-star and small-star steps alternate until nothing changes; each step is written out, and no list of neighbours is built.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("v"), F.col("v").alias("root"))).groupBy("v").agg(F.min("root").alias("root"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, links): weights of the sets linked to each, within a pair of blocks."""
    for rows in _grouped(batches, ("root", "i", "j")):
        sets, weight = [np.frombuffer(r["sh"], "<u4") for r in rows], np.array([r["size"] for r in rows], np.int64)
        cls = np.array([r["cls"] for r in rows])
        block = np.array([r["block"] for r in rows])
        if rows[0]["i"] == rows[0]["j"]:
            linked = linked_pairs(sets)
            np.fill_diagonal(linked, False)
            links = linked @ weight
        else:
            order = np.argsort(block, kind="stable")
            sets, weight, cls = [sets[k] for k in order], weight[order], cls[order]
            cut = int((block == block.min()).sum())
            if cut == len(sets):
                continue
            linked = linked_pairs(sets, split=cut)
            links = np.concatenate([linked @ weight[cut:], weight[:cut] @ linked])
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(links.astype(np.int64))], names=["cls", "links"])


def _some_sets(digest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, sh) of the wanted classes: a few ids are broadcast, many are joined by shuffle."""
    ids = stored(wanted.select("cls").distinct(), "wanted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return stored(digest.select(F.col("row_id").alias("cls"), "sh").join(side, "cls", "left_semi"), "sets")


def similar_groups(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, class_id (least doc_id of its group), group_size, n_links, kept, h (hash of the text)."""
    digest = stored(_digest(docs), "shingles")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    classes = digest.where("n > 0").groupBy("key").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig"))
    classes = stored(classes.select("key", F.col("best.row_id").alias("cls"), "best", "size", "sig"), "classes")
    buckets = stored(_buckets(classes, n_runs(THRESHOLD, recall)), "buckets")
    sets = _some_sets(digest, buckets)
    # The first runs find most links.
    early = buckets.where(F.col("run") <= FIRST_RUNS).withColumn("root", F.col("cls"))
    edges = stored(_edges(_blocks(early), sets), "links")
    found = stored(components(edges), "components")
    # After them, only buckets in which different components meet can tell anything new.
    rest = buckets.where((F.col("run") > FIRST_RUNS) | (F.col("n") > LIMIT)).select("path", "cls", "n")
    meet = stored(_with_main(_labelled(rest, found)).select("path", "cls", "root", (F.col("m") + F.col("o")).alias("n")), "meet")
    edges = stored(edges.unionByName(_edges(_blocks(meet), sets)), "links")
    found = stored(components(edges), "components")
    # What then still meets in a bucket of more than one block is compared across its blocks.
    split = stored(_by_main(_with_main(_labelled(meet.where(F.col("n") > LIMIT), found)), LIMIT), "split")
    if not split.isEmpty():
        dense = split.where(F.col("o") > DENSE)
        cells = _cells(split.where(F.col("o") <= DENSE))
        if not dense.isEmpty():
            cells = cells.unionByName(_cells(_by_main(_prefix_lists(dense, sets))))
        found = stored(components(edges.unionByName(_edges(cells, sets))), "components")
    members = found.join(classes.select("cls", "best", "size"), found["v"] == F.col("cls")).select("root", "cls", "best", "size")
    members = stored(members, "members")
    groups = stored(members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("group_size"), F.min("best").alias("first")), "groups")
    # Links, by pairs of blocks within a component.
    k = F.least(F.ceil(F.col("m") / COUNT_BLOCK), F.greatest(F.ceil(F.col("m") / WIDE_BLOCK), F.lit(FEW_BLOCKS))).cast("int")
    dealt = members.join(groups.select("root", "m"), "root").withColumn("block", F.pmod(F.xxhash64("cls"), k).cast("int"))
    dealt = dealt.select("root", "cls", "size", "block", F.explode(F.sequence(F.lit(0), k - 1)).alias("o"))
    dealt = dealt.select("root", "cls", "size", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    counted = dealt.join(sets, "cls").select("root", "i", "j", "block", "cls", "size", "sh")
    counted = counted.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_count, "cls long, links long")
    links = counted.groupBy("cls").agg(F.sum("links").alias("links"))
    known = members.join(groups.select("root", "group_size", "first"), "root").join(links, "cls", "left").select("cls", "group_size", "first", "links")
    info = classes.select("key", "cls", "size", "best").join(known, "cls", "left").select(
        "key", F.coalesce("first", "best").alias("first"), F.coalesce("group_size", "size").alias("group_size"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    info = stored(info, "classes")
    rows = digest.select("doc_id", "row_id", "n", "h", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(info, "key", "left")
    alone = F.col("n") == 0
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("row_id") == F.col("first.row_id"))).alias("kept"),
        "h",
    )


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """docs with one document of each group, all columns: that of the least doc_id (rows equal in doc_id and text stay together)."""
    rows = similar_groups(docs, recall).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    gone = stored(rows.agg(F.bool_or("kept").alias("kept")).where("not kept").drop("kept"), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.join(side, docs["doc_id"].eqNullSafe(side["_d"]) & (F.xxhash64(text) == side["_h"]), "left_anti")
