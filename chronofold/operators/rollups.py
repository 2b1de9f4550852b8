"""Rollups over the history model. Tables are DataFrames with these columns (others are ignored):

commits (commit_id, author_id, authored_at, committed_at, subject, has_body, n_trailers), changes (commit_id, file_id, insertions,
deletions, is_binary), files (file_id, path, alive), people (person_id, name, is_bot), parents (child_id, parent_id, ordinal).

Rollups aggregate on the file, the person or the commit with partial aggregation before every shuffle. Windows run over one
file's contributors or one commit's files only. Global numbers (maxima, totals) are single aggregated rows that Spark broadcasts.
Times are epoch seconds, ``now`` is a parameter and never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import columns as C
from chronofold.functions import fixed as V


def churn() -> Column:
    """Lines of a change; none for binary files."""
    return F.when(F.col("is_binary"), 0).otherwise(F.col("insertions") + F.col("deletions"))


def source_changes(changes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of source files with their commit's author, time and (if commits have subjects) whether it is a fix: what all file rollups read.

    Subjects are judged once a commit and do not travel with its changes.
    """
    source = files.where(C.file_flags(F.col("path")).bitwiseAND(V.NON_SOURCE) == 0).select("file_id")
    said = commits.select("commit_id", "author_id", "authored_at", *([C.is_fix(F.col("subject")).alias("is_fix")] if "subject" in commits.columns else []))
    return changes.join(source, "file_id", "left_semi").join(said, "commit_id").withColumn("churn", churn())


def knowledge(source: DataFrame) -> DataFrame:
    """By file and author: sum of the roots of churn, last touch, commits. Undecayed, bots included."""
    return source.groupBy("file_id", F.col("author_id").alias("person_id")).agg(
        F.sum(F.sqrt(F.col("churn").cast("double"))).alias("accumulated"), F.max("authored_at").alias("last_at"), F.count(F.lit(1)).alias("commits")
    )


def shares(known: DataFrame) -> DataFrame:
    """Undecayed share of each contributor of a file."""
    total = F.sum("accumulated").over(Window.partitionBy("file_id"))
    return known.withColumn("share", F.when(total > 0, F.col("accumulated") / total).otherwise(0.0))


def ownership(known: DataFrame, people: DataFrame, now: Column) -> DataFrame:
    """By file: top person, share, bus factor, entropy, contributors of decayed knowledge, without bots.

    The bus factor is the least number of contributors, largest first, that hold half (with a tolerance for the order of sums).
    """
    humans = known.join(people.where("is_bot").select("person_id"), "person_id", "left_anti")
    values = humans.withColumn("v", C.decayed(F.col("accumulated"), now, F.col("last_at"))).where("v > 0")
    by_file = Window.partitionBy("file_id")
    ordered = by_file.orderBy(F.col("v").desc(), "person_id")
    ranked = values.select("file_id", "person_id", (F.col("v") / F.sum("v").over(by_file)).alias("p"), F.row_number().over(ordered).alias("rank"),
                           (F.sum("v").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("v").over(by_file)).alias("held"))
    return ranked.groupBy("file_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("person_id"))).alias("top_person"),
        F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("top_share"),
        F.min(F.when(F.col("held") >= 0.5 - 1e-12, F.col("rank"))).alias("bus_factor"),
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
        F.count(F.lit(1)).alias("contributors"),
    )


def last_seen(commits: DataFrame) -> DataFrame:
    """Last authorship of each person."""
    return commits.groupBy(F.col("author_id").alias("person_id")).agg(F.max("authored_at").alias("last_seen"))


def islands(owned: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """ownership with is_island: one person holds half, and has been away for more than half a year."""
    out = owned.join(seen.withColumnRenamed("person_id", "top_person"), "top_person", "left")
    away = C.days_between(now, F.col("last_seen")) > V.INACTIVE_DAYS
    return out.withColumn("is_island", F.coalesce((F.col("bus_factor") == 1) & away, F.lit(False)))


def hotspots(source: DataFrame, now: Column) -> DataFrame:
    """By file with two changes or more: churn share x peak share x recency x (1 + fix density)."""
    files = source.groupBy("file_id").agg(
        F.sum("churn").alias("churn"), F.count(F.lit(1)).alias("changes"), F.avg(F.when(F.col("is_fix"), 1.0).otherwise(0.0)).alias("fix_density"), F.max("authored_at").alias("last_at"), F.max("churn").alias("peak")
    )
    ranked = files.where(F.col("changes") >= V.MIN_HOTSPOT_CHANGES)
    most = ranked.agg(F.max("churn").alias("most_churn"), F.max("peak").alias("most_peak"))
    score = C.log_share(F.col("churn"), F.col("most_churn")) * C.log_share(F.col("peak"), F.col("most_peak")) * C.recency(now, F.col("last_at"))
    # One row of maxima for all.
    return ranked.crossJoin(F.broadcast(most)).withColumn("score", score * (1 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fix_density"))))).drop("most_churn", "most_peak")


def repeated_subjects(commits: DataFrame) -> DataFrame:
    """Subjects (trimmed, lower case) of three commits or more."""
    return commits.groupBy(F.lower(F.trim("subject")).alias("subject")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= V.REPEATED_SUBJECT)


def path_rarity(changes: DataFrame, files: DataFrame, n_commits: Column) -> DataFrame:
    """By commit: mean of ln(N / changes of the path) / ln(N + 1), 0 to 1."""
    paths = changes.join(files.select("file_id", "path"), "file_id").select("commit_id", "path")
    often = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    n = n_commits.cast("double")
    mean = F.avg(F.log(n / F.greatest(F.lit(1), F.col("n"))) / F.log(n + 1))
    return paths.join(often, "path").groupBy("commit_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)).alias("rarity"))


def first_touches(changes: DataFrame, files: DataFrame) -> DataFrame:
    """First commit of each top-level directory."""
    dirs = changes.join(files.select("file_id", C.top_directory(F.col("path")).alias("directory")), "file_id").where("directory is not null")
    return dirs.groupBy("directory").agg(F.min("commit_id").alias("commit_id"))


def _said(commits: DataFrame, *more: Column) -> DataFrame:
    """What flags need of subjects: texts are judged where they are and do not travel."""
    subject = F.trim("subject")
    return commits.select("commit_id", subject.rlike("(?i)" + V.REVERT_SUBJECT).alias("is_revert"), subject.rlike("(?i)" + V.RELAND_SUBJECT).alias("is_reland"), C.is_mechanical(F.col("subject")).alias("mechanical"), *more)


def _file_kinds(*more: Column) -> list[Column]:
    path = F.col("path")
    return [F.col("file_id"), C.is_lockfile(path).alias("lock"), C.is_generated(path).alias("gen"), C.is_vendored(path).alias("vend"), *more]


def commit_flags(commits: DataFrame, changes: DataFrame, files: DataFrame, parents: DataFrame, format_only: DataFrame | None = None) -> DataFrame:
    """By commit: flags (bits), n_parents, n_files, churn. A commit with a share of each kind of noise only is so marked."""
    return _flagged(_said(commits), changes, files.select(*_file_kinds()), parents, format_only).select("commit_id", "flags", "n_parents", "n_files", "churn")


def _flagged(said: DataFrame, changes: DataFrame, kinds: DataFrame, parents: DataFrame, format_only: DataFrame | None, *more: Column) -> DataFrame:
    """The columns of said (``_said``) with flags, n_parents, n_files, churn and more aggregates of a commit's changes with their files' kinds."""
    marked = changes.join(kinds, "file_id", "left")
    lines = F.when(~F.col("is_binary"), F.col("insertions") + F.col("deletions"))
    sums = marked.groupBy("commit_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(churn()).alias("churn"), F.bool_and("lock").alias("lock"), F.bool_and(F.col("lock") | F.col("gen")).alias("gen"), F.bool_and("vend").alias("vend"),
        F.count(lines).alias("n_lines"), F.avg(lines).alias("mean"), F.stddev_pop(lines).alias("deviation"), *more,
    )
    up = parents.groupBy(F.col("child_id").alias("commit_id")).agg(F.count(F.lit(1)).alias("n_parents"))
    rows = said.join(sums, "commit_id", "left").join(up, "commit_id", "left").fillna(0, ["n_files", "churn", "n_parents", "n_lines"])
    uniform = (F.col("n_lines") >= V.BULK_FILES) & ((F.col("mean") == 0) | (F.col("deviation") / F.nullif(F.col("mean"), F.lit(0.0)) < V.UNIFORMITY))
    some = F.col("n_files") > 0
    tests = {
        "merge": F.col("n_parents") > 1,
        "root": F.col("n_parents") == 0,
        "revert": F.col("is_revert"),
        "reland": F.col("is_reland"),
        "empty": ~some,
        "lockfile-only": some & F.col("lock"),
        "generated-only": some & F.col("gen") & ~F.col("lock"),
        "vendored-only": some & F.col("vend"),
        "bulk-mechanical": (F.col("n_files") >= V.BULK_FILES) & (F.coalesce(uniform, F.lit(False)) | F.col("mechanical")),
    }
    bits = F.lit(0)
    for name, is_so in tests.items():
        bits = bits + F.when(F.coalesce(is_so, F.lit(False)), V.COMMIT_FLAGS[name]).otherwise(0)
    out = rows.withColumn("flags", bits)
    if format_only is not None:
        those = format_only.select("commit_id", F.lit(V.COMMIT_FLAGS["format-only"]).alias("bit"))
        out = out.join(those, "commit_id", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("bit", F.lit(0)))).drop("bit")
    return out


def format_only_commits(hunks: DataFrame) -> DataFrame:
    """Commits all of whose hunks change white space only."""
    return hunks.groupBy("commit_id").agg(F.bool_and(F.col("kind") == 1).alias("all_white")).where("all_white").select("commit_id")


def release_commits(tags: DataFrame) -> DataFrame:
    """Commits with a version tag: v and a digit, or a digit and later a full stop."""
    name = F.col("name")
    return tags.where(name.rlike(r"^v[0-9]") | name.rlike(r"^[0-9].*\.")).select(F.col("target_id").alias("commit_id")).distinct()


def significance(commits: DataFrame, changes: DataFrame, files: DataFrame, parents: DataFrame, tags: DataFrame, format_only: DataFrame | None = None, n_commits: Column | None = None) -> DataFrame:
    """By commit: flags and score. Rewards for scale, message, rarity and meaning, penalties for noise, never below 0."""
    total = commits.agg(F.count(F.lit(1)).alias("n_commits"))
    path = F.col("path")
    # By file: changes of its path, first commit. One more pass over the changes, with their files' kinds, makes all sums of a commit.
    touched = changes.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.min("commit_id").alias("commit_id"))
    known = files.select(*_file_kinds(path, C.is_manifest(path).alias("manifest"), C.is_public_api(path).alias("api"))).join(touched, "file_id")
    often = F.sum("n").over(Window.partitionBy("path"))
    kinds = known.select("file_id", "lock", "gen", "vend", "manifest", "api", F.log(F.greatest(F.lit(1), often).cast("double")).alias("log_n"))
    fresh = known.select(C.top_directory(path).alias("directory"), "commit_id").where("directory is not null").groupBy("directory").agg(F.min("commit_id").alias("commit_id")).select("commit_id").distinct().withColumn("new_dir", F.lit(True))
    released = release_commits(tags).withColumn("release", F.lit(True))
    # Equal subjects are counted by 128 bits of their SHA-256, and quality is worked out for both outcomes, so that no text travels.
    key = F.substring(F.unhex(F.sha2(F.lower(F.trim("subject")), 256)), 1, 16)
    quality = [C.stored_quality(F.col("subject"), F.col("has_body"), F.col("n_trailers"), F.lit(again)).alias(name) for again, name in ((False, "quality"), (True, "quality_again"))]
    said = _said(commits, key.alias("_key"), *quality).withColumn("repeated", F.count("_key").over(Window.partitionBy("_key")) >= V.REPEATED_SUBJECT).drop("_key")
    rows = _flagged(said, changes, kinds, parents, format_only, F.bool_or("manifest").alias("manifest"), F.bool_or("api").alias("api"), F.avg("log_n").alias("mean_log"))
    for side in (fresh, released):
        rows = rows.join(side, "commit_id", "left")
    rows = rows.crossJoin(F.broadcast(total))
    n = F.col("n_commits").cast("double")
    # mean(ln(N / c)) = ln N - mean(ln c)
    rarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((F.log(n) - F.col("mean_log")) / F.log(n + 1), F.lit(0.0))))
    has = lambda name: F.col("flags").bitwiseAND(V.COMMIT_FLAGS[name]) != 0
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    r = V.REWARDS
    score = (
        C.saturating(F.col("n_files"), V.SATURATION_FILES) * r["files"]
        + C.saturating(F.col("churn"), V.SATURATION_CHURN) * r["churn"]
        + F.when(F.col("repeated"), F.col("quality_again")).otherwise(F.col("quality")) * r["quality"]
        + rarity * r["rarity"]
    )
    bonus = {"release": yes("release"), "revert": has("revert") | has("reland"), "manifest": yes("manifest"), "public_api": yes("api"), "new_dir": yes("new_dir"), "large_merge": (F.col("n_parents") > 1) & (F.col("n_files") >= V.LARGE_MERGE_FILES)}
    for name, is_so in bonus.items():
        score = score + F.when(is_so, r[name]).otherwise(0.0)
    for name, weight in V.PENALTIES.items():
        score = score - F.when(has(name), weight).otherwise(0.0)
    return rows.select("commit_id", "flags", F.when(has("empty"), 0.0).otherwise(F.greatest(F.lit(0.0), score)).alias("significance"))


#: Changes whose pairs a task makes and counts: those of 30 files each are some seven million pairs.
CHANGES_PER_TASK = 500_000


def coupling(changes: DataFrame, support: int = 2, most_files: int = V.COUPLING_MAX_FILES, rows: int | None = None) -> DataFrame:
    """Pairs of files (a < b) that change together in commits of at most ``most_files`` files: co_changes, two strengths.

    The cutoff bounds the pairs of a commit, so the join is linear in the number of changes. The number of tasks grows with the changes
    (``rows``: their number, or a bound that is known), as pairs are nearly all different and a task holds those that it counts.
    """
    tasks = max(int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(changes.count() if rows is None else rows) // CHANGES_PER_TASK))
    sized = changes.select("commit_id", "file_id").repartition(tasks, "commit_id").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("commit_id"))).where(F.col("n") <= most_files).drop("n")
    a, b = sized.select("commit_id", F.col("file_id").alias("file_a")), sized.select("commit_id", F.col("file_id").alias("file_b"))
    met = a.join(b, "commit_id").where("file_a < file_b").select("file_a", "file_b").repartition(tasks, "file_a", "file_b")
    pairs = met.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("co_changes")).where(F.col("co_changes") >= support)
    each = sized.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    na, nb = (each.select(F.col("file_id").alias(f"file_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = pairs.join(na, "file_a").join(nb, "file_b")
    co = F.col("co_changes").cast("double")
    return both.select("file_a", "file_b", "co_changes", (co / (F.col("n_a") + F.col("n_b") - co)).alias("strength"), (co / F.least("n_a", "n_b")).alias("strength_min"))


def coupled_with(pairs: DataFrame, k: int) -> DataFrame:
    """The k strongest partners of each file, in either direction."""
    both = pairs.select(F.col("file_a").alias("file_id"), F.col("file_b").alias("partner"), "co_changes", "strength").unionByName(pairs.select(F.col("file_b").alias("file_id"), F.col("file_a").alias("partner"), "co_changes", "strength"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("strength").desc(), F.col("co_changes").desc(), "partner"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def contributor_tail(commits: DataFrame, people: DataFrame, k: int) -> DataFrame:
    """Humans beyond the k most active: how many, and their commits."""
    counts = commits.groupBy(F.col("author_id").alias("person_id")).agg(F.count(F.lit(1)).alias("n")).join(people.where(~F.col("is_bot")), "person_id")
    top = counts.orderBy(F.col("n").desc(), "name", "person_id").limit(k).select("person_id")
    return counts.join(F.broadcast(top), "person_id", "left_anti").agg(F.count(F.lit(1)).alias("people"), F.coalesce(F.sum("n"), F.lit(0)).alias("commits"))


def timeline(commits: DataFrame, changes: DataFrame, grain: str) -> DataFrame:
    """Commits, lines and distinct authors by day, week or month (UTC)."""
    lines = changes.groupBy("commit_id").agg(F.sum("insertions").alias("ins"), F.sum("deletions").alias("del"))
    at = F.date_trunc(grain, F.timestamp_seconds("authored_at")).cast("date")
    return commits.join(lines, "commit_id", "left").groupBy(at.alias("bucket")).agg(
        F.count(F.lit(1)).alias("commits"), F.coalesce(F.sum("ins"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("del"), F.lit(0)).alias("deletions"), F.countDistinct("author_id").alias("authors")
    )


def releases(tags: DataFrame) -> DataFrame:
    """Version tags in time order with the one before, and the range of commits between. Tags are few: one row a release."""
    name = F.col("name")
    versions = tags.where(name.rlike(r"^v[0-9]") | name.rlike(r"^[0-9].*\."))
    order = Window.partitionBy(F.lit(0)).orderBy("tagged_at", "tag_id")
    return versions.select("tag_id", "name", "tagged_at", F.lag("tag_id").over(order).alias("prev_id"), (F.lag("target_id").over(order) + 1).alias("from_commit"), F.col("target_id").alias("to_commit"))


def era_series(commits: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """Weekly commit rate, authors, entropy of top directories, line balance and extension mix.

    The extension mix is how far (one minus cosine) a week's counts by extension are from those of the last week with changes.
    """
    week = F.date_trunc("week", F.timestamp_seconds("authored_at")).cast("date").alias("week")
    rows = commits.select("commit_id", "author_id", week)
    basic = rows.groupBy("week").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author_id").alias("authors"))
    named = files.select("file_id", F.coalesce(C.top_directory(F.col("path")), F.lit("")).alias("directory"), C.extension(F.col("path")).alias("extension"))
    touched = changes.join(rows.select("commit_id", "week"), "commit_id").join(named, "file_id")
    # One aggregation of the changes serves both: directories and extensions are few.
    cells = touched.groupBy("week", "directory", "extension").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("insertions") - F.col("deletions")).alias("delta"))
    by_dir = cells.groupBy("week", "directory").agg(F.sum("n").alias("n"), F.sum("delta").alias("delta"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("week"))
    spread = by_dir.withColumn("p", p).groupBy("week").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum("delta").alias("loc_delta"))
    mixes = cells.groupBy("week", "extension").agg(F.sum("n").cast("double").alias("n")).groupBy("week").agg(F.map_from_entries(F.collect_list(F.struct("extension", "n"))).alias("mix"))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x * x))
    before = F.lag("mix").over(Window.partitionBy(F.lit(0)).orderBy("week"))  # one row a week
    both = mixes.withColumn("before", before)
    dot = F.aggregate(F.map_entries("mix"), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at("before", e["key"]), F.lit(0.0)))
    apart = both.select("week", F.when(F.col("before").isNull(), 0.0).otherwise(1 - dot / (norm(F.col("mix")) * norm(F.col("before")))).alias("extension_mix"))
    return basic.join(spread, "week", "left").join(apart, "week", "left")


def robust_scores(series: DataFrame, dimensions: list[str]) -> DataFrame:
    """(x - median) / (1.4826 MAD) of each dimension of a weekly series; 0 where the MAD is 0."""
    medians = series.agg(*[F.median(d).alias(f"m_{d}") for d in dimensions])
    off = series.crossJoin(F.broadcast(medians))
    mads = off.agg(*[F.median(F.abs(F.col(d) - F.col(f"m_{d}"))).alias(f"s_{d}") for d in dimensions])
    return off.crossJoin(F.broadcast(mads)).select("week", *[F.coalesce((F.col(d) - F.col(f"m_{d}")) / F.nullif(F.col(f"s_{d}") * 1.4826, F.lit(0.0)), F.lit(0.0)).alias(d) for d in dimensions])


def lenses(files: DataFrame, source: DataFrame, owned: DataFrame, hot: DataFrame, now: Column) -> DataFrame:
    """By file: age in days, churn, top share, hotspot score and knowledge risk (share of the top person over the bus factor)."""
    seen = source.groupBy("file_id").agg(F.min("authored_at").alias("born_at"), F.sum("churn").alias("churn"))
    out = files.select("file_id").join(seen, "file_id").join(owned.select("file_id", "top_share", "bus_factor"), "file_id", "left").join(hot.select("file_id", "score"), "file_id", "left")
    return out.select("file_id", C.days_between(now, F.col("born_at")).alias("age_days"), "churn", F.coalesce("top_share", F.lit(0.0)).alias("ownership"), F.coalesce("score", F.lit(0.0)).alias("hotspot"), F.coalesce(F.col("top_share") / F.col("bus_factor"), F.lit(0.0)).alias("knowledge_risk"))


def mean_complexity(texts: DataFrame) -> DataFrame:
    """Complexity proxy of source texts (id, text)."""
    return texts.select("id", C.complexity(F.col("text")).alias("complexity"))
