"""Boolean predicates over geometry columns, for use in filters and joins; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.constants import EPSILON, PLANAR_EPSILON
from ..functions.sphere import check, let

#: Fixed value: below this determinant two segments count as parallel.
PARALLEL = 1e-14


def _inside(p: Column, g: Column, ignore_boundary: bool | Column) -> Column:
    ignore = F.lit(ignore_boundary) if isinstance(ignore_boundary, bool) else ignore_boundary
    return S.is_polygon(g) & let(p, lambda q: F.exists(g["coords"], lambda part: S.in_part_with_boundary(q, part, ignore)))


def _meeting(s: Column, t: Column) -> Column:
    """(d, t, u): the determinant of two segments and where along each they meet."""
    a, b, c, d = s["a"], s["b"], t["a"], t["b"]
    x1, y1, x2, y2 = b["lon"] - a["lon"], b["lat"] - a["lat"], d["lon"] - c["lon"], d["lat"] - c["lat"]
    x, y = c["lon"] - a["lon"], c["lat"] - a["lat"]
    det = x1 * y2 - y1 * x2
    return F.struct(det.alias("d"), F.try_divide(x * y2 - y * x2, det).alias("t"), F.try_divide(x * y1 - y * x1, det).alias("u"))


def segments_cross(s: Column, t: Column) -> Column:
    """They meet within both, ends excluded."""
    e = PLANAR_EPSILON
    return let(_meeting(s, t), lambda m: (F.abs(m["d"]) >= PARALLEL) & (m["t"] > e) & (m["t"] < 1.0 - e) & (m["u"] > e) & (m["u"] < 1.0 - e))


def segments_meet(s: Column, t: Column) -> Column:
    """They meet, ends included; parallel ones if an end lies on the other."""
    e = PLANAR_EPSILON
    touch = S.on_segment(s["a"], t) | S.on_segment(s["b"], t) | S.on_segment(t["a"], s) | S.on_segment(t["b"], s)
    return let(_meeting(s, t), lambda m: F.when(F.abs(m["d"]) < PARALLEL, touch).otherwise(m["t"].between(-e, 1.0 + e) & m["u"].between(-e, 1.0 + e)))


def _any_pair(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Any segment of a with any of b; the segments are worked out once."""
    return let(S.segments(b), lambda others: F.exists(S.segments(a), lambda s: F.exists(others, lambda t: test(s, t))))


def boolean_clockwise(ring: Column) -> Column:
    """A negative signed area; rings are not closed, and fewer than four vertices are not clockwise. ``ring``: structs of lon, lat."""
    return S.signed_area(ring) < 0.0


def boolean_contains(a: Column, b: Column) -> Column:
    """Every vertex of b lies in a polygon of a or on its boundary; edges are not tested."""
    return S.is_polygon(a) & F.forall(S.vertices(b), lambda p: _inside(p, a, False))


def boolean_within(a: Column, b: Column) -> Column:
    return boolean_contains(b, a)


def boolean_crosses(a: Column, b: Column) -> Column:
    """Two lines properly cross; or a line has vertices both strictly inside a polygon and not."""
    lines = _any_pair(a, b, segments_cross)

    def mixed(line: Column, g: Column) -> Column:
        return let(F.transform(S.vertices(line), lambda p: _inside(p, g, True)), lambda x: F.exists(x, lambda v: v) & F.exists(x, lambda v: ~v))

    return F.when(S.is_line(a) & S.is_line(b), lines).when(S.is_line(a) & S.is_polygon(b), mixed(a, b)).when(S.is_polygon(a) & S.is_line(b), mixed(b, a)).otherwise(F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    """Points against points, lines and polygons; else any two segments meet, or the first vertex of one lies in the other.

    MultiPoints and collections have no segments.
    """

    def of_point(p_of: Column, g: Column) -> Column:
        def test(p: Column) -> Column:
            same = let(S.vertices(g)[0], lambda q: (F.abs(p["lon"] - q["lon"]) < EPSILON) & (F.abs(p["lat"] - q["lat"]) < EPSILON))
            return F.when(g["type"] == "Point", same).when(S.is_line(g), F.exists(S.segments(g), lambda s: S.on_segment(p, s))).when(S.is_polygon(g), _inside(p, g, False)).otherwise(F.lit(False))

        return let(S.vertices(p_of)[0], test)

    def probe(of: Column, g: Column) -> Column:
        return (F.size(S.segments(of)) > 0) & _inside(S.vertices(of)[0], g, False)

    meet = _any_pair(a, b, segments_meet)
    return F.when(a["type"] == "Point", of_point(a, b)).when(b["type"] == "Point", of_point(b, a)).otherwise(meet | probe(b, a) | probe(a, b))


def boolean_disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


def boolean_equal(a: Column, b: Column) -> Column:
    """The same type and vertices, in the same order, up to 1e-10 degrees."""
    near = lambda p, q: (F.abs(p["lon"] - q["lon"]) <= PLANAR_EPSILON) & (F.abs(p["lat"] - q["lat"]) <= PLANAR_EPSILON)
    x, y = S.vertices(a), S.vertices(b)
    return (a["type"] == b["type"]) & (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, near), lambda ok: F.coalesce(ok, F.lit(False)))


def boolean_overlap(a: Column, b: Column) -> Column:
    """They intersect and neither contains the other."""
    return intersects(a, b) & ~boolean_contains(a, b) & ~boolean_contains(b, a)


def boolean_parallel(a: Column, b: Column, without_length: bool | None = None) -> Column:
    """The chords from first to last vertex of two LineStrings are parallel, or opposite. A chord of no length is an error unless ``without_length`` says what it gives."""
    chord = lambda g: let(S.first_line(g), lambda v: F.struct((F.element_at(v, -1)["lon"] - v[0]["lon"]).alias("x"), (F.element_at(v, -1)["lat"] - v[0]["lat"]).alias("y")))
    both = F.struct(chord(a).alias("p"), chord(b).alias("q"))

    def parallel(c: Column) -> Column:
        p, q = c["p"], c["q"]
        size = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]) * F.sqrt(q["x"] * q["x"] + q["y"] * q["y"])
        some = F.try_divide(F.abs(p["x"] * q["y"] - p["y"] * q["x"]), size) < 1e-8
        return check(size > 0, "LineString has zero length.", some) if without_length is None else F.when(size > 0, some).otherwise(F.lit(without_length))

    return check((a["type"] == "LineString") & (b["type"] == "LineString"), "line1 and line2 must both be LineString geometries.", let(both, parallel))


def boolean_point_in_polygon(p: Column, g: Column, ignore_boundary: bool = False) -> Column:
    """``p``: a Point geometry. On the boundary counts as inside unless it is ignored."""
    return check(p["type"] == "Point", "point must be a GeoJSON Point geometry.", _inside(S.vertices(p)[0], g, ignore_boundary))


def boolean_point_on_line(p: Column, line: Column, ignore_end_vertices: bool = False) -> Column:
    """``p``: a Point geometry on any segment of the lines; their end vertices may be excluded."""

    def test(v: Column) -> Column:
        on = F.exists(S.segments(line), lambda s: S.on_segment(v, s))
        if ignore_end_vertices:
            near = lambda q: (F.abs(v["lon"] - q["lon"]) < EPSILON) & (F.abs(v["lat"] - q["lat"]) < EPSILON)
            on = on & ~F.exists(S.rings(line), lambda r: near(r[0]) | near(F.element_at(r, -1)))
        return on

    on_line = let(S.vertices(p)[0], test)
    return check(p["type"] == "Point", "point must be a GeoJSON Point geometry.", check(S.is_line(line), "line must be a LineString or MultiLineString geometry.", on_line))
