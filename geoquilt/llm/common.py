"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import shutil
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or where that is unset and all runs on one machine, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = f"/tmp/checkpoints/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return _OWN_DIRS[app]


def save(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return what reads it back.

    This cuts the lineage: a lost executor costs only the tasks it was running,
    and several readers do not repeat the work that led here.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.saved_at = path
    return saved


def discard(saved: DataFrame) -> None:
    """Delete a table that ``save`` wrote and nothing reads any more."""
    jvm = saved.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(saved.saved_at)
    path.getFileSystem(saved.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles whose tables nothing refers to any more; it follows the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, a written table, with a hint to broadcast it if it has ``most_rows`` or fewer; else Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= most_rows else df


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def crc_mod_of(value: int | None, modulus: int) -> int | None:
    """The same for one value in Python."""
    return None if value is None else zlib.crc32(str(value).encode()) % modulus
