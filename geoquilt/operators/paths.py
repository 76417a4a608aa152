"""Paths whose vertices are rows, so that one path may span many tasks.

The rows are cut into ranges by path and order. Each range of a path is summed
up to its first and last vertex and the length between them; windows over these
few rows (one for each path and range) give where each range begins along its
path. Only the one range that holds a wanted point is walked vertex by vertex.

Vertices are ordered by the order column, then by longitude and latitude; rows
that repeat are vertices of their own. Rows without an ordinate are no vertices.
Rows with a null id make up one path with a null id. A table without rows has no
paths. Columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.constants import meters_in
from ..functions.sphere import point
from ..sources.scratch import saved

_PLACE = ("ix", "lon", "lat")


def _meters(a: Column) -> Column:
    """From a vertex, perhaps null, to the row's own."""
    return F.when(a.isNotNull(), sphere.haversine(a["lon"], a["lat"], F.col("lon"), F.col("lat")))


def _ranges(vertices: DataFrame, fid: str, order: str, lon: str, lat: str) -> DataFrame:
    """(fid, ix, lon, lat, chunk), written: equal ranges of all vertices in their order, however long a path is."""
    rows = vertices.select(F.col(fid).alias("fid"), F.col(order).alias("ix"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(rows.repartitionByRange(parts, "fid", *_PLACE).withColumn("chunk", F.spark_partition_id()), "paths")


def _chunks(rows: DataFrame) -> DataFrame:
    """(fid, chunk, before, prev, last, meters): each range of a path, how far along the path its first segment begins, the vertex before it, and its length with that segment."""
    inside = Window.partitionBy("fid", "chunk").orderBy(*_PLACE)
    here, at = point(F.col("lon"), F.col("lat")), F.struct(*_PLACE)
    stepped = rows.withColumn("m", _meters(F.lag(here).over(inside)))
    summed = stepped.groupBy("fid", "chunk").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("m"), F.min_by(here, at).alias("first"), F.max_by(here, at).alias("last"))
    along_path = Window.partitionBy("fid").orderBy("chunk")
    joined = summed.withColumn("prev", F.lag("last").over(along_path)).withColumns({"lon": F.col("first.lon"), "lat": F.col("first.lat")})
    whole = joined.select("fid", "chunk", "prev", "last", (F.col("m") + F.coalesce(_meters(F.col("prev")), F.lit(0.0))).alias("meters"))
    before = F.sum("meters").over(along_path.rowsBetween(Window.unboundedPreceding, -1))
    return whole.withColumn("before", F.coalesce(before, F.lit(0.0)))


def length(vertices: DataFrame, units: str = "kilometers", fid: str = "fid", order: str = "ix", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(fid, length): a path of one vertex has none."""
    return _chunks(_ranges(vertices, fid, order, lon, lat)).groupBy("fid").agg((F.sum("meters") / meters_in(units)).alias("length"))


def _walk(rows: DataFrame, chunks: DataFrame, target: Column) -> DataFrame:
    """(fid, lon, lat): the point at ``target`` meters, an expression over chunks; the last vertex where a path is shorter."""
    aimed = chunks.withColumn("target", target)
    reached = F.when(F.col("before") + F.col("meters") >= F.col("target"), F.struct("chunk", "before", "prev", "target"))
    found = aimed.groupBy("fid").agg(F.min(reached).alias("hit"), F.max_by("last", "chunk").alias("end"))
    hits = found.select("fid", "end", F.col("hit.chunk").alias("in_chunk"), F.col("hit.before").alias("before"), F.col("hit.prev").alias("prev"), F.col("hit.target").alias("target"))
    goal = hits.select(F.col("fid").alias("of"), "in_chunk", "before", "prev", "target").where("in_chunk IS NOT NULL")
    walked = rows.join(goal, rows["fid"].eqNullSafe(F.col("of")) & (rows["chunk"] == F.col("in_chunk")))
    inside = Window.partitionBy("fid", "chunk").orderBy(*_PLACE)
    stepped = walked.withColumn("from", F.coalesce(F.lag(point(F.col("lon"), F.col("lat"))).over(inside), F.col("prev"))).withColumn("m", _meters(F.col("from")))
    upto = F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = stepped.withColumn("over", F.col("before") + upto - F.col("target"))
    first = F.when(F.col("over") >= 0, F.struct(*_PLACE, "from", (F.col("m") - F.col("over")).alias("rest")))
    # where rounding leaves the target just beyond its range, the range's last vertex is the point
    per_path = placed.groupBy("fid").agg(F.min(first).alias("s"), F.max_by(point(F.col("lon"), F.col("lat")), F.struct(*_PLACE)).alias("stop"))
    a = F.col("s.from")
    there = sphere.destination(a["lon"], a["lat"], sphere.bearing(a["lon"], a["lat"], F.col("s.lon"), F.col("s.lat")), F.col("s.rest"))
    points = per_path.select(F.col("fid").alias("of"), F.when(F.col("s").isNotNull(), there).otherwise(F.col("stop")).alias("p"))
    out = hits.select("fid", "end").join(points, F.col("fid").eqNullSafe(F.col("of")), "left").select("fid", F.coalesce("p", "end").alias("p"))
    return out.select("fid", "p.lon", "p.lat")


def along(vertices: DataFrame, distance: float, units: str = "kilometers", fid: str = "fid", order: str = "ix", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(fid, lon, lat): the point at a distance along each path; its last vertex where the path is shorter."""
    if not distance >= 0:
        raise ValueError("distance must be >= 0.")
    rows = _ranges(vertices, fid, order, lon, lat)
    return _walk(rows, _chunks(rows), F.lit(float(distance) * meters_in(units)))


def point_on_path(vertices: DataFrame, fid: str = "fid", order: str = "ix", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(fid, lon, lat): the point half way along each path."""
    rows = _ranges(vertices, fid, order, lon, lat)
    return _walk(rows, _chunks(rows), F.sum("meters").over(Window.partitionBy("fid")) / 2.0)
