"""Operators on streams: the Column operators need no change; a static table of polygons joins a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregation import points_in_polygons


def geofence_counts(points: DataFrame, polygons: DataFrame, window: str = "5 minutes", late: str = "10 minutes", time: str = "ts", pid: str = "pid", fid: str = "fid") -> DataFrame:
    """(fid, window, n): points of a stream in each polygon by event time.

    The grid join is stateless; the counts keep state until the watermark passes
    a window, and later points are left out.
    """
    timed = points.withColumn("_pid", F.struct(F.col(pid).alias("pid"), F.col(time).alias("ts")))
    met = points_in_polygons(polygons, timed, fid=fid, pid="_pid")
    seen = met.select("fid", F.col("pid.ts").alias("ts")).withWatermark("ts", late)
    return seen.groupBy("fid", F.window("ts", window).alias("window")).agg(F.count("*").alias("n"))
