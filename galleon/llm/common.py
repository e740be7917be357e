"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_store: list = [None, {}]


def worker_store(name: str) -> dict:
    """A dictionary that a Python worker keeps between tasks, until another name is asked for.

    So a worker that lives through many stages holds what one of them has stored.
    """
    if _store[0] != name:
        _store[:] = name, {}
    return _store[1]


#: Rows that go to a Python worker at a time. Rows hold whole texts here, so Spark's own 10,000 would take much memory.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS`` rows where it has Spark's default; another value stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset, a master on this machine alone (tests,
    a laptop) gets a temporary folder for the life of the session; on a cluster it
    is an error, as executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="galleon-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark drops the shuffle files of a query at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read, not a recomputation. With ``release`` the
    shuffle files that the write made go at its end, so what comes after does not
    need disk besides them.
    """
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(RELEASE)
    if release:
        conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            conf.set(RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null, so that no row with a null id is lost."""
    return a.eqNullSafe(b)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def payload(name: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(text_or_empty(name), "UTF-8")


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id is written as ``null``."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "UTF-8")), F.lit(folds))
