"""Where intermediate results go, and how the tables of a folder are read."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows reach Python in Arrow batches of so many bytes at most (or one row). Spark's own default of 64 MB would take a few
#: hundred MB for each running task, on both sides, where texts are long.
BATCH_KEY, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "1m", ("67108864b", "64MB", None)


def bound_batches(spark: SparkSession) -> None:
    """Unless the session has a bound of its own."""
    if spark.conf.get(BATCH_KEY, None) in BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """A new folder, as a URI, in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where that setting is absent, as in local tests, a folder of this machine stands in for it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = _local_root()
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/tillgrain-{uuid.uuid4().hex}"


_ROOT: list[str] = []


def _local_root() -> str:
    if not _ROOT:
        _ROOT.append(tempfile.mkdtemp(prefix="tillgrain-"))
    return _ROOT[0]


#: Rows of a few numbers that make a file worth having.
ROWS_A_FILE = 50_000


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM knows them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and any executor can be lost after.

    ``rows``: about how many narrow rows it has, if known; small frames then become few files. The folder goes when the
    driver's JVM ends, or with ``released``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_folder(spark)
    (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.parquet(path)
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames. Only for frames from which nothing is still to be computed."""
    for frame in frames:
        if path := getattr(frame, "_stored_at", None):
            files, at = _hadoop(frame.sparkSession, path)
            files.delete(at, True)


def row_id(*columns: str | Column) -> Column:
    """128 bits that tell rows apart by these columns, nulls included: two 64-bit hashes over values and null flags."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    flags = [c.isNull() for c in cells]
    return F.struct(F.xxhash64(F.lit(1), *flags, *cells).alias("a"), F.xxhash64(F.lit(2), *flags, *cells).alias("b"))


def sent(spark: SparkSession, value: Any) -> Broadcast[bytes]:
    """Broadcast a value with its class, so that executors need no copy of this package; ``received`` opens it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast[bytes]) -> Any:
    return pickle.loads(broadcast.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
