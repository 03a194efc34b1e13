"""Sessions, tables of a folder, and where intermediate results are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with this library's defaults; keyword names have ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("tillgrain")
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_LOCAL: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset (local tests), one of this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tillgrain-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, rows: int = 0) -> DataFrame:
    """Written to Parquet and read back: computed once, and safe from lost executors. Spark deletes the shuffle files that led to
    it when the driver's collector finds them unused, which may be long after; so the collector is asked for. ``rows`` of a file at most."""
    path = work_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Rows go to Python in batches of so many bytes: of Spark's own 64 MB, few large rows are written, sent and read in turn, not at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def released(frame: DataFrame) -> None:
    """Delete what ``stored`` wrote for a frame from which nothing is still to be computed."""
    spark = frame.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(frame._stored_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
