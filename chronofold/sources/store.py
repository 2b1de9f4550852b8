"""The index on disk: one Parquet directory a table, written whole and then put in place; meta values; integrity."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 3
STATES = ("uninitialized", "discovering", "walking", "analyzing", "ready", "stale", "failed")
RESERVED = ("schema_version", "repo_id", "index_state")
#: Sort order of each table's rows within files, which stands in for its index.
KEYS = {
    "commits": ["commit_id"], "changes": ["commit_id", "file_id"], "parents": ["child_id", "ordinal"], "files": ["file_id"], "file_aliases": ["file_id", "from_commit"], "people": ["person_id"],
    "hunks": ["file_id", "new_start"], "knowledge": ["file_id", "person_id"], "ownership": ["file_id"], "hotspots": ["file_id"], "tags": ["tag_id"], "refs": ["name"], "coupling": ["file_a", "file_b"],
}


class IndexError_(Exception):
    """An error with a code, as SCHEMA_TOO_NEW or INDEX_CORRUPT."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's checkpoint folder; one of its own only where none is set and one machine runs all (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not path and not sc.master.startswith("local"):
            raise IndexError_("NO_SHARED_DIR", "spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="chronofold-"))


class Store:
    """Tables below a path. A write goes to a fresh directory that then takes the old one's place, so readers see whole tables.

    The old one is set aside until the new one is in place; a table that a crash left set aside is put back when it is next asked for.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = self.meta().get("schema_version")
        if found is not None and int(found) > SCHEMA_VERSION:
            raise IndexError_("SCHEMA_TOO_NEW", f"version {found}, this is {SCHEMA_VERSION}")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}")
        if fs.exists(p):
            return True
        _, aside = self._fs(f"{self.path}/_old-{name}")
        return fs.exists(aside) and fs.rename(aside, p)

    def read(self, name: str) -> DataFrame:
        self.exists(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a table whole, partitioned by repository where it has one, sorted by its key."""
        fresh = f"{self.path}/_new-{name}-{uuid.uuid4().hex}"
        by_repo = ["repo_id"] if "repo_id" in df.columns else []
        keys = [k for k in by_repo + KEYS.get(name, []) if k in df.columns]
        rows = df.sortWithinPartitions(*keys) if keys else df
        writer = rows.write.partitionBy(*by_repo) if by_repo else rows.write
        writer.parquet(fresh)
        fs, new = self._fs(fresh)
        _, place = self._fs(f"{self.path}/{name}")
        _, aside = self._fs(f"{self.path}/_old-{name}")
        if self.exists(name):
            fs.delete(aside, True)
            if not fs.rename(place, aside):
                raise IndexError_("INDEX_IO", f"cannot set {name} aside")
        if not fs.rename(new, place):
            raise IndexError_("INDEX_IO", f"cannot put {name} in place")
        fs.delete(aside, True)

    def append(self, name: str, df: DataFrame, key: list[str]) -> None:
        """Adds rows; a key that is there already is an error."""
        if self.exists(name):
            if df.join(self.read(name).select(*key), key, "left_semi").limit(1).count():
                raise IndexError_("DUPLICATE_ROW", f"{name} has a key of the new rows")
            self.replace(name, self.read(name).unionByName(df))
        else:
            self.replace(name, df)

    def upsert(self, name: str, df: DataFrame, key: list[str]) -> None:
        """Rows by key; the new ones win."""
        self.replace(name, merged(self.read(name), df, key) if self.exists(name) else df)

    # meta -------------------------------------------------------------------------------------------------
    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()} if self.exists("meta") else {}

    def set_meta(self, key: str, value: str) -> None:
        if key in RESERVED:
            raise ValueError(f"{key} is reserved")
        self._put({key: value})

    def set_state(self, state: str) -> None:
        if state not in STATES:
            raise ValueError(f"no such state: {state}")
        self._put({"index_state": state})

    def claim(self, repo_id: str) -> None:
        """Binds the index to a repository; another one's index is refused."""
        have = self.meta().get("repo_id")
        if have not in (None, repo_id):
            raise IndexError_("REPO_MISMATCH", f"the index belongs to {have}")
        self._put({"repo_id": repo_id, "schema_version": str(SCHEMA_VERSION)})

    def _put(self, values: dict[str, str]) -> None:
        rows = list((self.meta() | values).items())
        self.replace("meta", self.spark.createDataFrame(rows, "key string, value string").coalesce(1))

    def record_run(self, analyzer: str, version: int, through_oid: str) -> None:
        self.upsert("analyzer_runs", self.spark.createDataFrame([(analyzer, version, through_oid)], "analyzer_id string, version int, through_oid string"), ["analyzer_id"])

    def is_current(self, analyzer: str, version: int, tip: str) -> bool:
        """Whether an analyzer's last run has this version and tip."""
        if not self.exists("analyzer_runs"):
            return False
        return bool(self.read("analyzer_runs").where((F.col("analyzer_id") == analyzer) & (F.col("version") == version) & (F.col("through_oid") == tip)).limit(1).count())

    def integrity(self) -> list[str]:
        """What is wrong: rows that point to nothing."""
        relations = [("changes", "commit_id", "commits", "commit_id"), ("changes", "file_id", "files", "file_id"), ("parents", "child_id", "commits", "commit_id"), ("parents", "parent_id", "commits", "commit_id"), ("hunks", "commit_id", "commits", "commit_id"), ("knowledge", "file_id", "files", "file_id")]
        out = []
        for table, column, other, key in relations:
            if self.exists(table) and self.exists(other):
                lost = self.read(table).select(column).distinct().join(self.read(other).select(F.col(key).alias(column)), column, "left_anti").count()
                if lost:
                    out.append(f"{table}.{column}: {lost} without {other}")
        return out


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new laid over it by key; of new rows with one key the last by all columns stays."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in new.columns if c not in key] or [F.lit(0)]))
    last = new.withColumn("_n", nth).where("_n = 1").drop("_n")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def intern_paths(paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, path_id) of paths (path, seen: order of first sight); known ids stay, new ones follow in that order.

    Ids come from counts by range of ``seen``, so that no single task ranks all paths.
    """
    first = paths.groupBy("path").agg(F.min("seen").alias("seen"))
    base = 0
    if known is not None:
        base = known.agg(F.coalesce(F.max("path_id"), F.lit(0))).first()[0]
        first = first.join(known.select("path"), "path", "left_anti")
    out = dense_ids(first, ["seen", "path"], "path_id", base).select("path", "path_id")
    return out if known is None else known.select("path", "path_id").unionByName(out)


def dense_ids(df: DataFrame, order: list[str], name: str, base: int = 0) -> DataFrame:
    """Ids base + 1, base + 2, ... by a total order: a range sort, counts of each range, then ranks within ranges."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint()
    counts = ranged.groupBy("_part").count()  # one row a task
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth") + base).drop("_part", "_nth", "_before")
