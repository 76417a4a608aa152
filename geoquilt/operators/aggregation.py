"""Spatial joins, clustering and nearest neighbours over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered, saved
from .density import clusters_dbscan
from .joins import points_in_polygons
from .nearest import nearest_point

__all__ = ["clusters_dbscan", "clusters_kmeans", "collect", "nearest_point", "points_in_polygons"]

def collect(polygons: DataFrame, points: DataFrame, in_field: str, out_field: str, fid: str = "fid", geom: str = "geom", pid: str = "pid", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """All polygons with ``out_field``: the values of ``in_field`` of the points in them, in order of points; an empty array for none.

    The array of a polygon grows with its points; points_in_polygons gives them
    as rows.
    """
    pairs = points_in_polygons(polygons, points, fid, geom, pid, lon, lat)
    values = points.select(F.col(pid).alias("pid"), F.col(in_field).alias("value"))
    listed = pairs.join(values, "pid").groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pid", "value"))), lambda x: x["value"]).alias(out_field))
    kept = polygons.drop(out_field) if out_field in polygons.columns else polygons
    joined = kept.join(listed.withColumnRenamed("fid", "_fid"), F.col(fid) == F.col("_fid"), "left").drop("_fid")
    kind = joined.schema[out_field].dataType
    return joined.withColumn(out_field, F.coalesce(out_field, F.array().cast(kind)))


def clusters_kmeans(points: DataFrame, number_of_clusters: int, most_rounds: int = 100, fid: str = "fid", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(fid, cluster): seeds are the points at places floor(i n / k); squared degrees, ties to the lower cluster; an empty cluster stays where it is."""
    rows = saved(numbered(points.select(F.col(fid).alias("fid"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")), "fid"), "points")
    n = rows.count()
    if not n or number_of_clusters < 1:
        raise ValueError("points must be non-empty and number_of_clusters at least 1.")
    k = min(n, number_of_clusters)
    seeds = [i * n // k for i in range(k)]
    at = {r["place"]: (r["lon"], r["lat"]) for r in rows.where(F.col("place").isin(seeds)).collect()}  # k rows
    centers = [at[s] for s in seeds]

    def label(where: list[tuple[float, float]]) -> Column:
        to = [F.struct(((F.col("lon") - x) * (F.col("lon") - x) + (F.col("lat") - y) * (F.col("lat") - y)).alias("d"), F.lit(c).alias("c")) for c, (x, y) in enumerate(where)]
        return F.array_min(F.array(*to))["c"]

    now = previous = F.lit(0)
    for _ in range(most_rounds):
        now = label(centers)
        sums = rows.select("lon", "lat", now.alias("c"), previous.alias("was")).groupBy("c").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"), F.sum(F.when(F.col("c") != F.col("was"), 1).otherwise(0)).alias("moved")).collect()  # k rows
        if not sum(r["moved"] for r in sums):
            break
        previous = now
        moved = {r["c"]: (r["x"], r["y"]) for r in sums}
        centers = [moved.get(c, where) for c, where in enumerate(centers)]
    return rows.select("fid", now.cast("long").alias("cluster"))
