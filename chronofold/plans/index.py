"""From repositories to a stored index and its report: walk, resolve, store, analyse, report."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import columns as C
from chronofold.functions import fixed as V
from chronofold.operators import lineage, lookups
from chronofold.operators import rollups as R
from chronofold.sources import gitlog
from chronofold.sources.store import Store

ANALYZER, VERSION = "history", 1
LIMITS = {"significant": 10, "hotspots": 8, "islands": 8, "people": 8}


def layers(raw: DataFrame, mailmap: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of raw commits (repo_id, walk_seq, and the log's columns). Ids follow the walk within each repository."""
    order = Window.partitionBy("repo_id").orderBy("walk_seq")
    commits = raw.withColumn("commit_id", F.row_number().over(order).cast("long")).withColumn("m", C.message_parts(F.col("message")))
    seen = lineage.sightings_of(commits.select("repo_id", "commit_id", "author", "committer", "authored_at", "committed_at", "message"), mailmap)
    who = lineage.resolve_people(seen)
    role = lambda name, column: who.where(F.col("role") == name).select("repo_id", "commit_id", F.col("person_id").alias(column))
    rows = commits.join(role("author", "author_id"), ["repo_id", "commit_id"]).join(role("committer", "committer_id"), ["repo_id", "commit_id"])
    ids = commits.select("repo_id", F.col("oid").alias("parent"), F.col("commit_id").alias("parent_id"))
    up = commits.select("repo_id", F.col("commit_id").alias("child_id"), F.posexplode("parents").alias("ordinal", "parent")).join(ids, ["repo_id", "parent"]).select("repo_id", "child_id", "parent_id", "ordinal")
    told = commits.select("repo_id", "commit_id", F.posexplode("changes").alias("ordinal", "c")).select("repo_id", "commit_id", "ordinal", "c.kind", "c.old_path", "c.new_path", "c.similarity", "c.insertions", "c.deletions", "c.is_binary")
    changes = lineage.resolve_files(told)
    spans = lineage.file_aliases(told.select("repo_id", "commit_id", "ordinal", "kind", "old_path", "new_path"))
    last = spans.groupBy("repo_id", "file_id").agg(F.max_by("path", F.struct(F.col("to_commit").isNull(), "from_commit")).alias("path"), F.max("born_commit").alias("born_commit"), F.max("died_commit").alias("died_commit"))
    files = last.select("repo_id", "file_id", "path", "born_commit", "died_commit", F.col("died_commit").isNull().alias("alive"), C.language(F.col("path")).alias("language"), C.file_flags(F.col("path")).alias("flags"))
    people = lineage.people(seen)
    return {
        "commits": rows.select("repo_id", "commit_id", "oid", "author_id", "committer_id", "authored_at", "authored_tz", "committed_at", "committed_tz", "m.subject", "m.body", "m.trailers", F.col("m.body").isNotNull().alias("has_body"), F.size("m.trailers").alias("n_trailers")),
        "parents": up,
        "changes": changes,
        "files": files,
        "file_aliases": spans,
        "people": people.groupBy("repo_id", "person_id").agg(F.first("canonical_name").alias("name"), F.first("canonical_email").alias("email"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("commit_count").alias("commit_count"), F.first("merge_source").alias("merge_source"), F.bool_or("is_bot").alias("is_bot")),
        "person_identities": people.select("repo_id", "person_id", F.col("name"), F.col("email")),
    }


def refs_of(repository: str) -> list[tuple[str, str, str]]:
    """(name, kind, target) of every ref that points to a commit."""
    form = "%(objectname) %(objecttype) %(refname) %(*objectname) %(*objecttype)"
    text = subprocess.run(["git", "-C", repository, "for-each-ref", f"--format={form}"], capture_output=True, text=True, check=True).stdout
    return gitlog.parse_refs("\n".join(x.strip() for x in text.splitlines()))


def identity_of(repository: str) -> str:
    """The repository's id: SHA-256 of its root commit and its real path, parted by NUL."""
    roots = subprocess.run(["git", "-C", repository, "rev-list", "--max-parents=0", "--first-parent", "HEAD"], capture_output=True, text=True, check=True).stdout.split()
    return hashlib.sha256(f"{roots[-1]}\0{os.path.realpath(repository)}".encode()).hexdigest()


def read_tags(spark: SparkSession, repository: str, commits: DataFrame) -> DataFrame:
    """Tags that point to stored commits."""
    refs = [(n.removeprefix("refs/tags/"), oid) for n, kind, oid in refs_of(repository) if kind == "tag"]
    rows = spark.createDataFrame(sorted(refs), "name string, oid string")
    return rows.join(commits.select("repo_id", "oid", "commit_id", "committed_at"), "oid").select("repo_id", F.row_number().over(Window.partitionBy("repo_id").orderBy("committed_at", "name")).alias("tag_id"), "name", F.col("commit_id").alias("target_id"), F.col("committed_at").alias("tagged_at"))


def index_repository(spark: SparkSession, repository: str, path: str) -> Store:
    """Walks a repository into a store, all tables with the hunks, and analyses it. A store of another repository is refused and stays as it is."""
    spark.dataSource.register(gitlog.RepositorySource)
    spark.dataSource.register(gitlog.HunkSource)
    store = Store(spark, path)
    claimed = store.meta().get("repo_id")
    if claimed:
        store.claim(identity_of(repository))
    store.set_state("walking")
    try:
        if not claimed:
            store.claim(identity_of(repository))
        raw = spark.read.format("history").option("repositories", repository).load()
        store.replace("raw_commits", raw)
        raw = store.read("raw_commits")
        shown = subprocess.run(["git", "-C", repository, "show", "HEAD:.mailmap"], capture_output=True, text=True)
        mailmap = gitlog.mailmap_table(spark, shown.stdout) if not shown.returncode and gitlog.parse_mailmap(shown.stdout) else None
        for name, df in layers(raw, mailmap).items():
            store.replace(name, df)
        store.replace("tags", read_tags(spark, repository, store.read("commits")))
        store.replace("refs", spark.createDataFrame(sorted(refs_of(repository)), "name string, kind string, oid string"))
        hunks = spark.read.format("history_hunks").option("repositories", repository).load()
        store.replace("hunks", gitlog.attach_hunks(hunks.drop("repo_id"), store.read("commits"), store.read("changes")))
        store.set_state("analyzing")
        analyse(store)
    except Exception:
        store.set_state("failed")
        raise
    store.set_state("ready")
    return store


def analyse(store: Store) -> None:
    """Rollups of a store with one repository, written as tables."""
    t = {n: store.read(n) for n in ("commits", "changes", "files", "people", "parents", "tags")}
    now = F.lit(t["commits"].agg(F.max("authored_at")).first()[0] or 0)
    x = t["changes"].where("file_id is not null")
    source = R.source_changes(x, t["commits"], t["files"])
    known = R.knowledge(source)
    store.replace("knowledge", known)
    owned = R.ownership(store.read("knowledge"), t["people"], now)
    seen = t["people"].select("person_id", "last_seen")  # over all roles
    store.replace("ownership", R.islands(owned, seen, now))
    store.replace("hotspots", R.hotspots(source, now))
    store.replace("coupling", R.coupling(x))
    format_only = R.format_only_commits(store.read("hunks")) if store.exists("hunks") else None
    store.replace("significance", R.significance(t["commits"], x, t["files"], t["parents"], t["tags"], format_only))
    tip = t["commits"].orderBy(F.col("commit_id").desc()).select("oid").first()
    store.record_run(ANALYZER, VERSION, tip[0] if tip else "")


def stats_report(store: Store, limits: dict[str, int] = LIMITS) -> dict[str, DataFrame]:
    """The report's parts: most significant commits (near repeats once), hotspots, islands, people, the rest of them."""
    commits, people, files = store.read("commits"), store.read("people"), store.read("files")
    scored = commits.join(store.read("significance"), "commit_id")
    hot = store.read("hotspots").join(files.select("file_id", "path"), "file_id").orderBy(F.col("score").desc(), "file_id")
    isl = store.read("ownership").where("is_island").join(files.where("alive").select("file_id", "path"), "file_id").join(store.read("hotspots").select("file_id", "score"), "file_id", "left")
    return {
        "significant": lookups.distinct_summaries(scored, limits["significant"]).select("oid", "subject", "author_id", "significance", C.flag_names(F.col("flags"), V.COMMIT_FLAGS).alias("flags")),
        "hotspots": hot.select("path", "score", "churn", "changes", "fix_density").limit(limits["hotspots"]),
        "islands": isl.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "file_id").select("path", "top_person", "top_share").limit(limits["islands"]),
        "people": people.where(~F.col("is_bot")).orderBy(F.col("commit_count").desc(), "name", "person_id").select("name", "commit_count").limit(limits["people"]),
        "tail": R.contributor_tail(commits, people, limits["people"]),
    }


def report_json(report: dict[str, DataFrame]) -> str:
    """The report as JSON; its parts have a few rows each."""
    return json.dumps({name: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()] for name, df in report.items()}, indent=2, ensure_ascii=False)
