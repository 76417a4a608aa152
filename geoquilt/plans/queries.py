"""The reference operators' queries over the driver's tables: one for each operator, under its public name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.constants import EPSILON
from ..operators import aggregation as A
from ..operators import groups as G
from ..operators import joins as J
from ..operators import measurement as M
from ..operators import paths as W
from ..operators import predicates as P
from ..operators import transformation as T
from ..sources.scratch import saved
from .oracles import ORACLE_SQL
from .views import hexagons, lines, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Queries of operators over rows instead of one geometry in a column.
FORMS: dict[str, Query] = {}

_G = "geom"


def _query(name: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return register


def _at(p: Column, digits: int = 6) -> list[Column]:
    return [F.round(p["lon"], digits).alias("lon"), F.round(p["lat"], digits).alias("lat")]


def _ends() -> tuple[Column, Column]:
    return F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat"))


def _corners(df: DataFrame, key: str, g: Column, digits: int | None = 6, name: str = "ix") -> DataFrame:
    """A row for each vertex, numbered from 0."""
    rows = df.select(key, F.posexplode(S.vertices(g)).alias(name, "v"))
    place = _at(F.col("v"), digits) if digits is not None else [F.col("v.lon").alias("lon"), F.col("v.lat").alias("lat")]
    return rows.select(key, F.col(name).cast("long").alias(name), *place)


def _box(df: DataFrame, key: str, box: Column) -> DataFrame:
    return df.select(key, box.alias("b")).select(key, *(F.col("b")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


def _edges(df: DataFrame, *keys: str) -> DataFrame:
    """The edges of the polygons' outer rings as rows."""
    e = df.select(*keys, F.explode(S.pairs(S.as_points(F.col(_G)["coords"][0][0]))).alias("e"))
    return e.select(*keys, F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))


def _on_pairs(name: str, made: Callable[[Column, Column], list[Column]]) -> None:
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir, "geo_pairs").select("id", *made(*_ends()))


def _on_lines(name: str, made: Callable[[Column], list[Column]]) -> None:
    QUERIES[name] = lambda spark, sf_dir: lines(spark, sf_dir).select("fid", *made(F.col(_G)))


def _on_hexagons(name: str, made: Callable[[Column], list[Column]]) -> None:
    QUERIES[name] = lambda spark, sf_dir: hexagons(spark, sf_dir).select("nk", *made(F.col(_G)))


# measurement
_on_lines("along", lambda g: _at(M.along(g, F.lit(100.0))))
_on_hexagons("area", lambda g: [F.round(M.area(g) / 1e6, 3).alias("km2")])
QUERIES["bbox"] = lambda spark, sf_dir: _box(lines(spark, sf_dir), "fid", M.bbox(F.col(_G)))
QUERIES["bboxPolygon"] = lambda spark, sf_dir: _corners(hexagons(spark, sf_dir), "nk", M.bbox_polygon(M.bbox(F.col(_G))), None)
_on_pairs("bearing", lambda a, b: [F.round(M.bearing(a, b), 6).alias("deg")])
_on_lines("center", lambda g: _at(M.center(g)))
_on_hexagons("centerOfMass", lambda g: _at(M.center_of_mass(g)))
_on_lines("centroid", lambda g: _at(M.centroid(g), 10))  # a mean of up to 86 values of 4 digits may end in a 5 at fewer
_on_pairs("destination", lambda a, b: _at(M.destination(a, F.col("km"), F.col("bearing"))))
_on_pairs("distance", lambda a, b: [F.round(M.distance(a, b, "meters"), 3).alias("m")])
QUERIES["envelope"] = lambda spark, sf_dir: _corners(hexagons(spark, sf_dir), "nk", M.envelope(F.col(_G)), None)
_on_lines("length", lambda g: [F.round(M.length(g), 3).alias("km")])
_on_pairs("midpoint", lambda a, b: _at(M.midpoint(a, b)))
_on_lines("pointOnFeature", lambda g: _at(M.point_on_feature(g)))
_on_lines("pointToLineDistance", lambda g: [F.round(M.point_to_line_distance(M.centroid(g), g), 3).alias("km")])
_on_pairs("rhumbBearing", lambda a, b: [F.round(M.rhumb_bearing(a, b), 6).alias("deg")])
_on_pairs("rhumbDestination", lambda a, b: _at(M.rhumb_destination(a, F.col("km"), F.col("bearing"))))
_on_pairs("rhumbDistance", lambda a, b: [F.round(M.rhumb_distance(a, b, "meters"), 3).alias("m")])
QUERIES["square"] = lambda spark, sf_dir: _box(hexagons(spark, sf_dir), "nk", M.square(M.bbox(F.col(_G))))


@_query("greatCircle")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(view(spark, sf_dir, "geo_pairs"), "id", M.great_circle(*_ends(), npoints=5))


@_query("polygonTangents")
def polygon_tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = M.polygon_tangents(F.struct(F.lit(0.25).alias("lon"), F.lit(0.5).alias("lat")), F.col(_G))
    return hexagons(spark, sf_dir).select("nk", seen.alias("t")).select("nk", *(F.col(f"t.{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("lon", "lat")))


# predicates
_on_hexagons("booleanClockwise", lambda g: [P.boolean_clockwise(S.as_points(g["coords"][0][0])).alias("value")])


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "geo_pts").select(F.col("id").alias("pid"), "lon", "lat")


def _matches(name: str, test: Callable[[Column, Column], Column]) -> None:
    """Pairs of hexagon and point for which a predicate holds, by the grid join."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        met = A.points_in_polygons(hexagons(spark, sf_dir), _points(spark, sf_dir), fid="nk", inside=lambda p, g: test(S.of_point(p["lon"], p["lat"]), g))
        return met.select(F.col("fid").alias("nk"), F.col("pid").alias("id"))

    QUERIES[name] = query


_matches("booleanContains", lambda p, g: P.boolean_contains(g, p))
_matches("booleanWithin", lambda p, g: P.boolean_within(p, g))
_matches("booleanPointInPolygon", lambda p, g: P.boolean_point_in_polygon(p, g))


@_query("booleanCrosses")
def boolean_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each path's vertices against the others; a half of one vertex crosses nothing."""
    v = S.first_line(F.col(_G))
    half = F.floor(F.size(v) / 2).cast("int")
    paths = saved(lines(spark, sf_dir), "paths")
    found = J.lines_that_cross(paths.select("fid", S.of_line(F.slice(v, F.lit(1), half)).alias(_G)), paths.select("fid", S.of_line(F.slice(v, half + 1, F.size(v))).alias(_G)))
    return paths.select("fid").join(found.withColumn("value", F.lit(True)), "fid", "left").select("fid", F.coalesce("value", F.lit(False)).alias("value"))


@_query("booleanDisjoint")
def boolean_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hexagon how many points, and how many paths, are disjoint from it: all but those that the joins find to intersect."""
    hexes, points, paths = hexagons(spark, sf_dir), _points(spark, sf_dir), lines(spark, sf_dir)
    of_points = A.points_in_polygons(hexes, points, fid="nk", inside=lambda p, g: ~P.boolean_disjoint(S.of_point(p["lon"], p["lat"]), g)).select("fid")
    of_paths = J.spatial_join(paths, hexes, P.intersects, bid="nk").select(F.col("b").alias("fid"))

    def counted(kind: str, met: DataFrame, every: DataFrame) -> DataFrame:
        whole = every.agg(F.count("*").alias("whole"))
        found = met.groupBy("fid").agg(F.count("*").alias("met"))
        return hexes.select("nk").join(found, F.col("nk") == F.col("fid"), "left").crossJoin(F.broadcast(whole)).select(F.lit(kind).alias("kind"), "nk", (F.col("whole") - F.coalesce("met", F.lit(0))).alias("n"))

    return counted("point", of_points, points).unionByName(counted("path", of_paths, paths))


@_query("booleanEqual")
def boolean_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal hexagons, and of equal paths."""
    hexes, paths = hexagons(spark, sf_dir), lines(spark, sf_dir)
    same = J.spatial_join(hexes, hexes, P.boolean_equal, aid="nk", bid="nk").select(F.lit("hexagon").alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return same.unionByName(J.spatial_join(paths, paths, P.boolean_equal).select(F.lit("path").alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))


@_query("booleanOverlap")
def boolean_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that overlap: hexagons and hexagons moved by (9, 4), paths and hexagons."""
    hexes, moved, paths = hexagons(spark, sf_dir), hexagons(spark, sf_dir, 9.0, 4.0), lines(spark, sf_dir)
    met = J.spatial_join(hexes, moved, P.boolean_overlap, aid="nk", bid="nk").select(F.lit("hexagon").alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return met.unionByName(J.spatial_join(paths, hexes, P.boolean_overlap, bid="nk").select(F.lit("path").alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))


@_query("booleanParallel")
def boolean_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path against that of the next user; a path that ends where it began is parallel to none."""
    a = lines(spark, sf_dir)
    b = a.select((F.col("fid") - 1).alias("fid"), F.col(_G).alias("next"))
    return a.join(b, "fid").select("fid", P.boolean_parallel(F.col(_G), F.col("next"), without_length=False).alias("value"))


@_query("booleanPointOnLine")
def boolean_point_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of a path's vertices, end vertices excluded."""
    paths = saved(lines(spark, sf_dir), "paths")
    v = S.first_line(F.col(_G))
    at_end = lambda p, q: (F.abs(p["lon"] - q["lon"]) < EPSILON) & (F.abs(p["lat"] - q["lat"]) < EPSILON)
    ends = paths.select("fid", v[0].alias("first"), F.element_at(v, -1).alias("last"), F.posexplode(v).alias("ix", "v"))
    vertices = ends.select("fid", (F.col("ix") + 1).cast("long").alias("ix"), F.col("v.lon").alias("lon"), F.col("v.lat").alias("lat"), (at_end(F.col("v"), F.col("first")) | at_end(F.col("v"), F.col("last"))).alias("end"))
    on = J.points_on_lines(vertices, paths).withColumn("on", F.lit(True))
    return vertices.join(on, ["fid", "ix"], "left").select("fid", "ix", (F.coalesce("on", F.lit(False)) & ~F.col("end")).alias("value"))


# aggregation and classification
@_query("collect")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the points in each hexagon, in their order."""
    points = _points(spark, sf_dir).withColumn("value", F.col("pid").cast("string"))
    found = A.collect(hexagons(spark, sf_dir), points, "value", "ids", fid="nk")
    return found.select("nk", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


QUERIES["clustersDbscan"] = lambda spark, sf_dir: A.clusters_dbscan(view(spark, sf_dir, "geo_blobs"), 20.0, "kilometers", 4, fid="id").select(F.col("fid").alias("id"), "cluster")
QUERIES["clustersKmeans"] = lambda spark, sf_dir: A.clusters_kmeans(view(spark, sf_dir, "geo_blobs"), 5, fid="id").select(F.col("fid").alias("id"), "cluster")


@_query("nearestPoint")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = view(spark, sf_dir, "geo_pts").select(F.col("id").alias("tid"), "lon", "lat")
    sites = view(spark, sf_dir, "geo_sites").select(F.col("id").alias("fid"), "lon", "lat")
    return A.nearest_point(targets, sites).select("tid", "fid", F.round("meters", 3).alias("meters"))


# transformation
QUERIES["bezierSpline"] = lambda spark, sf_dir: _corners(lines(spark, sf_dir), "fid", T.bezier_spline(F.col(_G), sharpness=0.25))


def _ring_corners(df: DataFrame, key: str, g: Column) -> DataFrame:
    """Without the closing vertex."""
    return _corners(df, key, g).where("ix < 8")


QUERIES["buffer"] = lambda spark, sf_dir: _ring_corners(hexagons(spark, sf_dir), "nk", T.buffer(F.col(_G), F.lit(50.0), steps=8))
QUERIES["circle"] = lambda spark, sf_dir: _ring_corners(view(spark, sf_dir, "geo_pairs"), "id", T.circle(_ends()[0], F.col("km"), steps=8))
QUERIES["clone"] = lambda spark, sf_dir: _corners(hexagons(spark, sf_dir), "nk", T.clone(F.col(_G)), None)
QUERIES["convex"] = lambda spark, sf_dir: _edges(T.convex(view(spark, sf_dir, "geo_sites")))
QUERIES["concave"] = lambda spark, sf_dir: _edges(T.concave(view(spark, sf_dir, "geo_sites")))
QUERIES["dissolve"] = lambda spark, sf_dir: _edges(T.dissolve(hexagons(spark, sf_dir).withColumn("key", (F.col("nk") % 5).cast("string")), "key", fid="nk"), "key")


def _with_copy(name: str, made: Callable[[Column, Column], Column], show: Callable[[DataFrame], DataFrame]) -> None:
    """Each hexagon with its copy moved by (9, 4)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        copy = hexagons(spark, sf_dir, 9.0, 4.0).select("nk", F.col(_G).alias("copy"))
        return show(hexagons(spark, sf_dir).join(copy, "nk").select("nk", made(F.col(_G), F.col("copy")).alias(_G)))

    QUERIES[name] = query


def _ring_edges(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """The edges of all rings of one polygon a row, in their direction; an edge that rounding shuts is left out."""
    rings = df.select(key, F.posexplode(F.col(_G)["coords"][0]).alias("ring", "v"))
    e = rings.select(key, F.col("ring").cast("long").alias("ring"), F.explode(S.pairs(S.as_points(F.col("v")))).alias("e"))
    at = e.select(key, "ring", *(F.round(F.col(f"e.{p}.{c}"), digits).alias(n) for p, c, n in (("a", "lon", "x1"), ("a", "lat", "y1"), ("b", "lon", "x2"), ("b", "lat", "y2"))))
    return at.where("x1 <> x2 OR y1 <> y2")


_with_copy("union", T.union, lambda df: _edges(df, "nk"))
_with_copy("intersect", T.intersect, lambda df: _ring_edges(df, "nk"))
_with_copy("difference", T.difference, lambda df: _ring_edges(df, "nk"))
QUERIES["lineOffset"] = lambda spark, sf_dir: _corners(lines(spark, sf_dir), "fid", T.line_offset(F.col(_G), F.lit(50.0), "meters"))
QUERIES["simplify"] = lambda spark, sf_dir: _corners(lines(spark, sf_dir), "fid", T.simplify(F.col(_G), 0.5), None)


@_query("tesselate")
def tesselate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hexagons(spark, sf_dir).select("nk", F.posexplode(T.tesselate(F.col(_G))).alias("tri", "t"))
    corner = lambda k: F.col("t.coords")[0][0][k]
    return rows.select("nk", F.col("tri").cast("long").alias("tri"), *(corner(k)[o].alias(f"{n}{k}") for k in range(3) for o, n in ((0, "x"), (1, "y"))))


QUERIES["transformRotate"] = lambda spark, sf_dir: _corners(hexagons(spark, sf_dir), "nk", T.transform_rotate(F.col(_G), F.lit(30.0)))
QUERIES["transformScale"] = lambda spark, sf_dir: _corners(hexagons(spark, sf_dir), "nk", T.transform_scale(F.col(_G), F.lit(0.5)))


@_query("transformTranslate")
def transform_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = T.transform_translate(S.of_point(F.col("lon1"), F.col("lat1")), F.col("km"), F.col("bearing"))
    return view(spark, sf_dir, "geo_pairs").select("id", *_at(S.vertices(moved)[0]))


@_query("bboxClip")
def bbox_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths clipped to the middle half of their boxes: the segments of each part; a path with nothing left is one row of nulls."""
    df = lines(spark, sf_dir).withColumn("b", M.bbox(F.col(_G)))
    q = lambda k, o: F.col("b")[k] + (F.col("b")[o] - F.col("b")[k]) / 4.0
    left = T.bbox_clip(F.col(_G), F.array(q(0, 2), q(1, 3), q(2, 0), q(3, 1)))
    parts = df.select("fid", left.alias("left")).select("fid", F.col("left.type").alias("type"), F.posexplode_outer("left.coords").alias("part", "v"))
    e = parts.select("fid", "type", F.col("part").cast("long").alias("part"), F.explode_outer(S.pairs(S.as_points(F.col("v")[0]))).alias("e"))
    return e.select("fid", "type", "part", *(F.round(F.col(f"e.{p}.{c}"), 6).alias(n) for p, c, n in (("a", "lon", "x1"), ("a", "lat", "y1"), ("b", "lon", "x2"), ("b", "lat", "y2"))))


@_query("voronoi")
def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all cells in the whole world's box."""
    cells = T.voronoi(view(spark, sf_dir, "geo_sites"), fid="id")
    return _ring_edges(cells.select(F.col("fid").alias("id"), _G), "id", 4).drop("ring")


# paths whose vertices are rows
FORMS["alongRows"] = lambda spark, sf_dir: W.along(view(spark, sf_dir, "geo_path"), 100.0).select("fid", *_at(F.struct("lon", "lat")))
FORMS["lengthRows"] = lambda spark, sf_dir: W.length(view(spark, sf_dir, "geo_path")).select("fid", F.round("length", 3).alias("km"))
FORMS["pointOnPathRows"] = lambda spark, sf_dir: W.point_on_path(view(spark, sf_dir, "geo_path")).select("fid", *_at(F.struct("lon", "lat")))

# measures of all rows of a group
def _paths_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select((F.col("fid") % 16).alias("part"), _G)


def _boxes_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths' boxes as polygons."""
    return lines(spark, sf_dir).select((F.col("fid") % 16).alias("part"), M.envelope(F.col(_G)).alias(_G))


FORMS["areaByKey"] = lambda spark, sf_dir: G.area(_boxes_by_key(spark, sf_dir), ["part"]).select("part", F.round(F.col("area") / 1e6, 3).alias("km2"))
FORMS["bboxByKey"] = lambda spark, sf_dir: _box(G.bbox(_paths_by_key(spark, sf_dir), ["part"]), "part", F.col("bbox"))
FORMS["centerByKey"] = lambda spark, sf_dir: G.center(_paths_by_key(spark, sf_dir), ["part"]).select("part", *_at(F.col("point")))
FORMS["centerOfMassByKey"] = lambda spark, sf_dir: G.center_of_mass(_boxes_by_key(spark, sf_dir), ["part"]).select("part", *_at(F.col("point")))
FORMS["centroidByKey"] = lambda spark, sf_dir: G.centroid(_paths_by_key(spark, sf_dir), ["part"]).select("part", *_at(F.col("point"), 8))
FORMS["envelopeByKey"] = lambda spark, sf_dir: _corners(G.envelope(_paths_by_key(spark, sf_dir), ["part"]), "part", F.col(_G), None)


__all__ = ["FORMS", "ORACLE_SQL", "QUERIES"]
