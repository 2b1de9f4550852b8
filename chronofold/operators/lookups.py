"""Point lookups, pages, interval joins, ancestry and search."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import columns as C
from chronofold.functions import fixed as V


def commit_page(commits: DataFrame, size: int, after: tuple[int, int] | None = None) -> DataFrame:
    """Newest first; one row more than the page tells whether there is another. ``after`` is the last row's (committed_at, commit_id).

    The redundant condition on committed_at reaches the scan; the pair itself decides.
    """
    rows = commits
    if after:
        at, commit_id = after
        rows = rows.where((F.col("committed_at") <= at) & (F.struct("committed_at", "commit_id") < F.struct(F.lit(at).cast("long"), F.lit(commit_id).cast("long"))))
    return rows.orderBy(F.col("committed_at").desc(), F.col("commit_id").desc()).limit(C.page_size(size) + 1)


def commit_summaries(commits: DataFrame, changes: DataFrame, parents: DataFrame) -> DataFrame:
    """Commits with lines, files and parents in order."""
    lines = changes.groupBy("commit_id").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("files"))
    up = parents.groupBy(F.col("child_id").alias("commit_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "parent_id"))).alias("p"))
    out = commits.join(lines, "commit_id", "left").join(up, "commit_id", "left")
    return out.withColumn("parents", F.coalesce(F.transform("p", lambda x: x["parent_id"]), F.array().cast("array<bigint>"))).drop("p").fillna(0, ["insertions", "deletions", "files"])


def path_as_of(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path, commit_id) with the file that lived there then: from <= commit < to."""
    a = aliases.select("file_id", F.col("path").alias("_path"), "from_commit", "to_commit")
    fits = (F.col("path") == F.col("_path")) & (F.col("from_commit") <= F.col("commit_id")) & (F.col("to_commit").isNull() | (F.col("to_commit") > F.col("commit_id")))
    return asked.join(a, fits, "left").groupBy("path", "commit_id").agg(F.min("file_id").alias("file_id"))


def commits_touching(hunks: DataFrame, commits: DataFrame, file_id: int, start: int, end: int) -> DataFrame:
    """Commits with a hunk that overlaps lines [start, end) of the file, newest first."""
    if not 1 <= start < end:
        raise ValueError("INVALID_TARGET: empty line range")
    hit = hunks.where((F.col("file_id") == file_id) & (F.col("new_start") <= end - 1) & (F.col("new_start") + F.col("new_len") > start))
    return hit.select("commit_id").distinct().join(commits.select("commit_id", "committed_at"), "commit_id").orderBy(F.col("committed_at").desc(), F.col("commit_id").desc())


def overlapping_hunks(hunks: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Range join: ranges (file_id, start, end) with the hunks of the file that overlap.

    Both sides are cut into bins of ``width`` lines, so one file with many hunks is spread; a pair counts in its first common bin only.
    """
    last = F.col("new_start") + F.greatest(F.col("new_len"), F.lit(1)) - 1
    h = hunks.where("new_len > 0").select("commit_id", "file_id", "new_start", "new_len", F.explode(F.sequence(F.floor(F.col("new_start") / width), F.floor(last / width))).alias("bin"))
    r = ranges.where("start < end").select("file_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin"))
    both = h.join(r, ["file_id", "bin"])
    first = F.floor(F.greatest("new_start", "start") / width)
    return both.where((F.col("new_start") < F.col("end")) & (F.col("new_start") + F.col("new_len") > F.col("start")) & (F.col("bin") == first)).select("file_id", "start", "end", "commit_id", "new_start", "new_len")


def ancestors(parents: DataFrame, of: DataFrame, checkpoint_every: int = 10, least: int | None = None) -> DataFrame:
    """All ancestors (commit_id) of the given commits, themselves included.

    A frontier moves up by one join a step and never visits a commit twice; ``least`` prunes by generation (parents have smaller ids).
    Lineage is cut by checkpoint() into the shared folder.
    """
    up = parents.select("child_id", "parent_id")
    if least is not None:
        up = up.where(F.col("parent_id") >= least)
    seen = of.select("commit_id").distinct().checkpoint()
    frontier = seen
    while True:
        frontier = frontier.join(up, frontier["commit_id"] == up["child_id"]).select(F.col("parent_id").alias("commit_id")).distinct().join(seen, "commit_id", "left_anti").checkpoint()
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier).checkpoint()


#: A task that walks up a history holds the commits of 2 ** PART_BITS ids at a time.
PART_BITS = 16


def ancestors_by_repository(parents: DataFrame, of: DataFrame, bits: int = PART_BITS) -> DataFrame:
    """Ancestors (repo_id, commit_id) of the given commits (repo_id, commit_id), by one walk a repository.

    Histories are mostly long chains, where a frontier needs as many joins as there are commits. Where parents have smaller ids than
    children (looked up once), edges are packed by parts of the ids, all parts at once; one task a repository goes through the packed parts
    from the newest to the oldest, holding one part and marks of what is asked of older ones; what it marks is unpacked by all tasks.
    """
    if parents.where("parent_id >= child_id").limit(1).count():
        return _walk_whole(parents, of)
    width = 1 << bits

    def pack(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values("child_id", ascending=False)
        child, parent = edges["child_id"].to_numpy(np.int64), edges["parent_id"].to_numpy(np.int64)
        part = int(child[0]) >> bits
        body = zlib.compress(np.stack([child - (part << bits), child - parent]).astype("<i8").tobytes(), 1)
        return pd.DataFrame({"repo_id": [edges["repo_id"].iloc[0]], "part": [part], "edges": [body]})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, asked = None, {}  # marks of commits that are known to be ancestors, by part

        def out(parts: list[int]) -> Iterator[pa.RecordBatch]:
            for p in sorted(parts, reverse=True):
                marks = np.packbits(np.frombuffer(asked.pop(p), np.uint8)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([repo], pa.string()), pa.array([p], pa.int64()), pa.array([marks], pa.binary())], names=["repo_id", "part", "marks"])

        for batch in batches:
            for r, part, body in zip(*(batch.column(i) for i in range(3))):
                r, part = r.as_py(), part.as_py()
                yield from out([p for p in asked if r != repo or p > part])
                repo = r
                child, up = np.frombuffer(zlib.decompress(body.as_py()), "<i8").reshape(2, -1)
                if part not in asked and (up > 0).all():
                    continue
                marks = asked.setdefault(part, bytearray(width))
                for c in child[up == 0].tolist():  # the commits that are asked for
                    marks[c] = 1
                for c, p in zip(child.tolist(), (child - up).tolist()):  # newest first, so children come before their parents
                    if marks[c]:
                        if p >= 0:
                            marks[p] = 1
                        else:
                            asked.setdefault(part + (p >> bits), bytearray(width))[p & (width - 1)] = 1
        yield from out(list(asked))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, part, marks in zip(*(batch.column(i) for i in range(3))):
                ids = np.flatnonzero(np.unpackbits(np.frombuffer(marks.as_py(), np.uint8), count=width)) + (part.as_py() << bits)
                yield pa.RecordBatch.from_arrays([pa.array([r.as_py()] * len(ids), pa.string()), pa.array(ids, pa.int64())], names=["repo_id", "commit_id"])

    # A commit that is asked for is an edge to itself.
    edges = parents.select("repo_id", "child_id", "parent_id").unionByName(of.select("repo_id", F.col("commit_id").alias("child_id"), F.col("commit_id").alias("parent_id")))
    packed = edges.withColumn("part", F.shiftright("child_id", bits)).groupBy("repo_id", "part").applyInPandas(pack, "repo_id string, part long, edges binary")
    walked = packed.repartition("repo_id").sortWithinPartitions("repo_id", F.col("part").desc()).mapInArrow(walk, "repo_id string, part long, marks binary")
    tasks = int(parents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return walked.repartition(tasks, "repo_id", "part").mapInArrow(unpack, "repo_id string, commit_id long")


def _walk_whole(parents: DataFrame, of: DataFrame) -> DataFrame:
    """``ancestors_by_repository`` for ids in any order: a repository's edges are held by one task."""

    def walk(edges: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if start.empty:
            return pd.DataFrame({"repo_id": pd.Series(dtype=str), "commit_id": pd.Series(dtype="int64")})
        up: dict[int, list[int]] = {}
        for c, p in zip(edges["child_id"].tolist(), edges["parent_id"].tolist()):
            up.setdefault(c, []).append(p)
        seen, stack = set(start["commit_id"].tolist()), start["commit_id"].tolist()
        while stack:
            for p in up.get(stack.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    stack.append(p)
        return pd.DataFrame({"repo_id": start["repo_id"].iloc[0], "commit_id": sorted(seen)})

    return parents.groupBy("repo_id").cogroup(of.groupBy("repo_id")).applyInPandas(walk, "repo_id string, commit_id long")


def is_ancestor(parents: DataFrame, spark, a: int, b: int) -> bool:
    """Whether a is b or above it."""
    if a == b:
        return True
    if a > b:
        return False
    start = spark.createDataFrame([(b,)], "commit_id long")
    return bool(ancestors(parents, start, least=a).where(F.col("commit_id") == a).limit(1).count())


def update_kind(tip: int | None, head: int | None, parents: DataFrame, spark) -> str:
    """How a stored tip relates to the head: up-to-date, fast-forward or rewritten."""
    if tip is None or head is None:
        return "rewritten"
    if tip == head:
        return "up-to-date"
    return "fast-forward" if is_ancestor(parents, spark, tip, head) else "rewritten"


def search_commits(texts: DataFrame, query: str, k: int) -> DataFrame:
    """BM25 over texts (id, text): every word of the query, the last as a prefix. (id, score), best first; no words: no rows.

    Document frequencies and the mean length cover all texts; only the matching ones keep their counts.
    """
    words = [w.lower() for w in re.findall(r"\w+", query)]
    tokens = texts.select("id", C.search_tokens(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    if not words:
        return tokens.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = [F.size(F.filter("t", _matcher(w, i == len(words) - 1))) for i, w in enumerate(words)]
    counted = tokens.select("id", "n", *[h.alias(f"f{i}") for i, h in enumerate(hits)])
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.sum(F.when(F.col(f"f{i}") > 0, 1).otherwise(0)).alias(f"d{i}") for i in range(len(words))])
    score = F.lit(0.0)
    every = F.lit(True)
    for i in range(len(words)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        f = F.col(f"f{i}")
        score = score + idf * f * (V.BM25_K1 + 1) / (f + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("n") / F.col("mean")))
        every = every & (f > 0)
    return counted.where(every).crossJoin(F.broadcast(totals)).select("id", score.alias("score")).orderBy(F.round("score", 9).desc(), F.col("id").desc()).limit(k)


def _matcher(word: str, prefix: bool):
    return (lambda x: F.startswith(x, F.lit(word))) if prefix else (lambda x: x == word)


def reciprocal_rank_fusion(rankings: list[DataFrame]) -> DataFrame:
    """(id, score) from rankings (id, rank): the sum of 1 / (60 + rank)."""
    rows = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("id", "rank"))
    return rows.groupBy("id").agg(F.sum(1 / (V.RRF_K + F.col("rank"))).alias("score"))


def people_by_commits(people: DataFrame, commits: DataFrame, bots: bool = False) -> DataFrame:
    counts = commits.groupBy(F.col("author_id").alias("person_id")).agg(F.count(F.lit(1)).alias("commit_count"))
    rows = people if bots else people.where(~F.col("is_bot"))
    return rows.join(counts, "person_id", "left").fillna(0, ["commit_count"]).orderBy(F.col("commit_count").desc(), "name", "person_id")


def missing_parents(parents: DataFrame, commits: DataFrame) -> DataFrame:
    """Integrity: edges whose parent or child is not stored."""
    ids = commits.select("commit_id")
    return parents.join(ids, parents["parent_id"] == ids["commit_id"], "left_anti").unionByName(parents.join(ids, parents["child_id"] == ids["commit_id"], "left_anti")).distinct()


def distinct_summaries(scored: DataFrame, k: int) -> DataFrame:
    """The k best commits of different (author, subject): of the best 4 k, the first of each."""
    best = scored.orderBy(F.col("significance").desc(), F.col("commit_id").desc()).limit(4 * k)
    nth = F.row_number().over(Window.partitionBy("author_id", F.lower(F.trim("subject"))).orderBy(F.col("significance").desc(), F.col("commit_id").desc()))
    return best.withColumn("nth", nth).where("nth = 1").drop("nth").orderBy(F.col("significance").desc(), F.col("commit_id").desc()).limit(k)


def window_contains(at: Column, start: int, end: int) -> Column:
    return (at >= start) & (at < end)


def search_paths(files: DataFrame, query: str, k: int) -> DataFrame:
    """Files whose path holds every word of the query (case aside): names before directories, short before long."""
    words = re.findall(r"\w+", query.lower())
    path, name = F.lower("path"), F.lower(C.basename(F.col("path")))
    every, rank = F.lit(bool(words)), F.lit(0)
    for w in words:
        every = every & path.contains(w)
        rank = rank + F.when(name == w, 3).when(F.startswith(name, F.lit(w)), 2).when(name.contains(w), 1).otherwise(0)
    return files.where(every).select("file_id", "path", rank.alias("rank")).orderBy(F.col("rank").desc(), F.length("path"), "path").limit(k)


def introducing_commits(fixes: DataFrame, hunks: DataFrame, width: int = 64) -> DataFrame:
    """(fix_id, file_id, introduced_by): for the lines that a fix takes away, the last commit before it that wrote into them.

    fixes (commit_id); hunks with old and new sides, in each commit's own lines (a pre-filter as for line questions, not blame).
    Line ranges meet in bins, as in ``overlapping_hunks``.
    """
    gone = hunks.join(fixes.select("commit_id"), "commit_id", "left_semi").where("old_len > 0")
    gone = gone.select(F.col("commit_id").alias("fix_id"), "file_id", F.col("old_start").alias("start"), (F.col("old_start") + F.col("old_len")).alias("end"))
    met = overlapping_hunks(hunks, gone.select("file_id", "start", "end").distinct(), width)
    pairs = gone.join(met.select("file_id", "start", "end", "commit_id"), ["file_id", "start", "end"]).where(F.col("commit_id") < F.col("fix_id"))
    return pairs.groupBy("fix_id", "file_id").agg(F.max("commit_id").alias("introduced_by"))
