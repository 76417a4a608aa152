"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and all runs on one machine, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"/tmp/checkpoints/geo-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write a table once and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Number the rows from 0 by a column, without sorting them in one task: places within ranges, after the ranges' counts."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = saved(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("_range").agg(F.count("*").alias("n"))
    # one row for each range
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return cut.join(F.broadcast(before), "_range").withColumn(name, place.cast("long")).drop("_range", "_before")


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a written table, with a hint to broadcast it if it has ``most`` rows or fewer; else Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= most else df
