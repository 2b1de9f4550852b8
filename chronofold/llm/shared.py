"""What the operators share: the cluster's shared folder, tables written there, and input normalisation."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing and one machine runs all (as in tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chronofold-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Paths that this driver has made, in order.
_MADE: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in this application's part of it."""
    path = f"{shared_dir(spark)}/chronofold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made() -> int:
    """How many paths have been made; a mark for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes the tables made since a mark (but the last one, if it is what is still read).

    Results that were not written or collected yet may read such tables, so call it when they are done with.
    """
    gone, kept = (_MADE[since:-1], _MADE[-1:]) if keep_last else (_MADE[since:], [])
    for path in gone:
        drop_path(spark, path)
    _MADE[since:] = kept


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back (row_group: bytes of a row group, for large rows).

    The task commit protocol makes the files whole and final, so what follows no longer depends on the
    executors (or on the row order) that computed them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group).option("compression", "zstd")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that ``stored`` gave, once nothing reads it any more."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for path in [x for x in _MADE if any(f.endswith(x.split("://")[-1].removeprefix("file:")) for f in folders)]:
        drop_path(df.sparkSession, path)
        _MADE.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes a shuffle's files only when the plan that made them is collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow and Parquet batches of at most n rows, for what is computed meanwhile: rows that are chunks would else fill memory."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(n))
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path through the file system that Spark would use for it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text column, a missing text as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that further ones with clashing names can do no harm."""
    return df.select(*[F.col(c) for c in columns])
