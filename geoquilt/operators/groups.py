"""Measures of all geometries of a group of rows, as one collection of features.

Each is a grouped aggregate of sums, counts and extremes of single parts, which
Spark adds up in each task before it shuffles, so a group of any size moves as
one row a task. ``by`` names the columns that make the groups; none makes one
group of all rows. Null geometries add nothing. A group without any vertex (for
``area`` and, of polygons, ``center_of_mass``: without a polygon) has null for
its measure. An empty table has no groups, or with no ``by`` one null row. Null
keys are a group. Repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.constants import EARTH_RADIUS, EPSILON
from ..functions.sphere import check, let, point
from . import measurement as M

_GEOM = "_geom_of_group"


def _vertices(df: DataFrame, by: list[str], geom: str) -> DataFrame:
    """(by, v): a row for each vertex, and one of null for a geometry without any."""
    flat = df.select(*by, F.flatten(F.flatten(F.col(geom)["coords"])).alias(_GEOM))
    return flat.select(*by, F.explode_outer(_GEOM).alias(_GEOM))


def _extremes(df: DataFrame, by: list[str], geom: str) -> DataFrame:
    v = F.col(_GEOM)
    lows = [F.min(v[0]), F.min(v[1]), F.max(v[0]), F.max(v[1])]
    box = _vertices(df, by, geom).groupBy(*by).agg(*(x.alias(f"_b{k}") for k, x in enumerate(lows)))
    return box.select(*by, F.when(F.col("_b0").isNotNull(), F.array(*(F.col(f"_b{k}") for k in range(4)))).alias("bbox"))


def bbox(df: DataFrame, by: list[str] | None = None, geom: str = "geom") -> DataFrame:
    """(by, bbox): [min lon, min lat, max lon, max lat] of all vertices."""
    return _extremes(df, by or [], geom)


def _of_box(df: DataFrame, by: list[str] | None, geom: str, made: Column, name: str) -> DataFrame:
    return bbox(df, by, geom).select(*(by or []), F.when(F.col("bbox").isNotNull(), made).alias(name))


def envelope(df: DataFrame, by: list[str] | None = None, geom: str = "geom") -> DataFrame:
    """(by, geom): the bounding box as a Polygon."""
    return _of_box(df, by, geom, M.bbox_polygon(F.col("bbox")), "geom")


def center(df: DataFrame, by: list[str] | None = None, geom: str = "geom") -> DataFrame:
    """(by, point): the middle of the bounding box."""
    b = F.col("bbox")
    return _of_box(df, by, geom, point((b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0), "point")


def centroid(df: DataFrame, by: list[str] | None = None, geom: str = "geom") -> DataFrame:
    """(by, point): the mean of all vertices; a ring's closing vertex counts too."""
    by, v = by or [], F.col(_GEOM)
    means = _vertices(df, by, geom).groupBy(*by).agg(F.avg(v[0]).alias("_x"), F.avg(v[1]).alias("_y"))
    return means.select(*by, F.when(F.col("_x").isNotNull(), point(F.col("_x"), F.col("_y"))).alias("point"))


_METRICS = "struct<area:double,x:double,y:double,lat_sum:double,n:int>"


def _sums(df: DataFrame, by: list[str], geom: str) -> DataFrame:
    """(by, _area, _x, _y, _lat, _n of polygons; _lon_sum, _lat_sum, _count of all vertices)."""
    parts = df.select(*by, S.is_polygon(F.col(geom)).alias("_polygon"), F.explode_outer(F.col(geom)["coords"]).alias("_part"))
    measured = F.when(F.col("_polygon"), S.polygon_metrics(F.col("_part"))).otherwise(F.lit(None).cast(_METRICS))
    ends = let(F.flatten("_part"), lambda v: F.struct(S.total(F.transform(v, lambda p: p[0])).alias("lon"), S.total(F.transform(v, lambda p: p[1])).alias("lat"), F.size(v).alias("n")))
    # made as one array, so that a part is measured once and not for each sum
    rows = parts.select(*by, F.explode(F.array(F.struct(measured.alias("m"), F.when(F.col("_part").isNotNull(), ends).alias("v")))).alias("_s"))
    m, v = F.col("_s.m"), F.col("_s.v")
    return rows.groupBy(*by).agg(
        F.sum(m["area"]).alias("_area"), F.sum(m["area"] * m["x"]).alias("_x"), F.sum(m["area"] * m["y"]).alias("_y"), F.sum(m["lat_sum"]).alias("_lat"), F.sum(m["n"]).alias("_n"),
        F.sum(v["lon"]).alias("_lon_sum"), F.sum(v["lat"]).alias("_lat_sum"), F.sum(v["n"]).alias("_count"),
    )


def area(df: DataFrame, by: list[str] | None = None, geom: str = "geom") -> DataFrame:
    """(by, area): square meters of all polygons, each in its own equirectangular plane; other geometries add nothing."""
    return _sums(df, by or [], geom).select(*(by or []), F.col("_area").alias("area"))


def center_of_mass(df: DataFrame, by: list[str] | None = None, geom: str = "geom") -> DataFrame:
    """(by, point): the area-weighted centroid of a group's polygons; in a group without polygons the mean of all vertices."""
    cos0 = F.cos(F.radians(F.col("_lat") / F.col("_n")))
    heavy = check(F.abs(cos0) >= EPSILON, "Center of mass conversion failed near poles.", point(F.degrees(F.try_divide(F.col("_x"), F.col("_area") * EARTH_RADIUS * cos0)), F.degrees(F.try_divide(F.col("_y"), F.col("_area") * EARTH_RADIUS))))
    mean = point(F.col("_lon_sum") / F.col("_count"), F.col("_lat_sum") / F.col("_count"))
    found = F.when(F.col("_n") > 0, heavy).when(F.col("_count") > 0, mean)
    return _sums(df, by or [], geom).select(*(by or []), found.alias("point"))
