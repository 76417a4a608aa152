"""Geometry columns and what operators read from them.

A geometry is a struct of ``type`` (a GeoJSON type name) and ``coords``, always
nested as part, ring, vertex, ordinate: a Point is one part of one ring of one
vertex, a LineString or MultiPoint one ring, a MultiLineString has a part for
each line, a Polygon one part whose first ring is the outer one, a MultiPolygon
a part for each polygon. Ordinates beyond longitude and latitude are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS, EPSILON, PLANAR_EPSILON
from .sphere import check, haversine, let, point

GEOMETRY = "struct<type:string,coords:array<array<array<array<double>>>>>"
LINES, POLYGONS = ("LineString", "MultiLineString"), ("Polygon", "MultiPolygon")


def geometry(kind: str | Column, coords: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), coords.alias("coords"))


def of_point(lon: Column, lat: Column) -> Column:
    return geometry("Point", F.array(F.array(F.array(F.array(lon, lat)))))


def of_line(vertices: Column) -> Column:
    """A LineString from an array of structs of lon and lat."""
    return geometry("LineString", F.array(F.array(F.transform(vertices, lambda v: F.array(v["lon"], v["lat"])))))


def of_ring(vertices: Column) -> Column:
    """A Polygon from one ring, an array of structs of lon and lat."""
    return geometry("Polygon", F.array(F.array(F.transform(vertices, lambda v: F.array(v["lon"], v["lat"])))))


def as_points(ring: Column) -> Column:
    """Structs of lon and lat from ordinate arrays."""
    return F.transform(ring, lambda v: point(v[0], v[1]))


def vertices(g: Column) -> Column:
    """All vertices in order, as structs; a ring's closing vertex included."""
    return as_points(F.flatten(F.flatten(g["coords"])))


def rings(g: Column) -> Column:
    """All rings or lines, as arrays of structs."""
    return F.transform(F.flatten(g["coords"]), as_points)


def outer_rings(g: Column) -> Column:
    return F.transform(g["coords"], lambda part: as_points(part[0]))


def first_line(g: Column) -> Column:
    return as_points(g["coords"][0][0])


def is_line(g: Column) -> Column:
    return g["type"].isin(*LINES)


def is_polygon(g: Column) -> Column:
    return g["type"].isin(*POLYGONS)


def pairs(path: Column) -> Column:
    """Consecutive vertices as structs a, b."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segments(g: Column) -> Column:
    """Segments of lines and rings, as structs a, b; none for points."""
    none = F.array().cast("array<struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>>>")
    return F.when(is_line(g) | is_polygon(g), F.flatten(F.transform(rings(g), pairs))).otherwise(none)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def path_length(path: Column) -> Column:
    return total(F.transform(pairs(path), lambda s: haversine(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])))


def mean_vertex(points: Column) -> Column:
    """The mean of all vertices; a closing vertex counts twice."""
    return point(total(F.transform(points, lambda v: v["lon"])) / F.size(points), total(F.transform(points, lambda v: v["lat"])) / F.size(points))


def valid(g: Column) -> Column:
    """The geometry, or an error where a vertex is out of the WGS84 range."""
    ok = F.forall(vertices(g), lambda v: v["lat"].between(-90, 90) & v["lon"].between(-180, 180))
    return check(ok, "WGS84 coordinates out of range. Latitude must be [-90, 90], longitude must be [-180, 180].", g)


def closed(ring: Column) -> Column:
    """A ring of ordinate arrays with its first vertex at its end too."""
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(ring[0])))


def signed_area(ring: Column) -> Column:
    """Shoelace area in square degrees, positive counter-clockwise; 0 for fewer than four vertices, and nothing is closed."""
    cross = F.transform(pairs(ring), lambda s: s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])
    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(0.5 * total(cross))


_SUMS = "struct<area:double,x:double,y:double>"


def _ring_sums(ring: Column, cos0: Column) -> Column:
    """(area, x, y): absolute area in square meters and centroid of a ring in the equirectangular plane."""
    k = EARTH_RADIUS
    flat = F.transform(ring, lambda v: F.struct((k * F.radians(v["lon"]) * cos0).alias("x"), (k * F.radians(v["lat"])).alias("y")))
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, s: Column) -> Column:
        cross = s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
        return F.struct((acc["c"] + cross).alias("c"), (acc["x"] + (s["a"]["x"] + s["b"]["x"]) * cross).alias("x"), (acc["y"] + (s["a"]["y"] + s["b"]["y"]) * cross).alias("y"))

    def done(acc: Column) -> Column:
        empty = F.abs(0.5 * acc["c"]) < EPSILON
        at = lambda v: F.when(empty, F.lit(0.0)).otherwise(F.try_divide(v, 3.0 * acc["c"]))
        return F.struct(F.when(empty, F.lit(0.0)).otherwise(F.abs(0.5 * acc["c"])).alias("area"), at(acc["x"]).alias("x"), at(acc["y"]).alias("y"))

    summed = F.aggregate(pairs(flat), zero, add, done)
    return check(F.size(ring) >= 4, "Polygon ring must contain at least 4 coordinates including closure.", summed)


def polygon_metrics(part: Column) -> Column:
    """(area, x, y, lat_sum, n) of a polygon, holes taken off; x and y are its centroid in its own plane."""
    some_rings = F.transform(part, as_points)
    outer = some_rings[0]
    lat_sum = total(F.transform(outer, lambda v: v["lat"]))

    def measured(cos0: Column) -> Column:
        sums = F.transform(some_rings, lambda r, i: let(_ring_sums(r, cos0), lambda s: F.struct((F.when(i == 0, 1.0).otherwise(-1.0) * s["area"]).alias("area"), s["x"].alias("x"), s["y"].alias("y"))))
        zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        return F.aggregate(sums, zero, lambda acc, s: F.struct((acc["area"] + s["area"]).alias("area"), (acc["x"] + s["area"] * s["x"]).alias("x"), (acc["y"] + s["area"] * s["y"]).alias("y")))

    def whole(m: Column) -> Column:
        ok = m["area"] > 0
        return check(ok, "Polygon area is zero after subtracting holes.", F.struct(m["area"].alias("area"), F.try_divide(m["x"], m["area"]).alias("x"), F.try_divide(m["y"], m["area"]).alias("y"), lat_sum.alias("lat_sum"), F.size(outer).alias("n")))

    cos0 = F.cos(F.radians(lat_sum / F.size(outer)))
    return let(cos0, lambda c: check(F.abs(c) >= EPSILON, "Polygon is too close to poles for planar approximation.", let(measured(c), whole)))


def in_ring(p: Column, ring: Column) -> Column:
    """Even-odd test; points on the boundary may fall on either side."""
    edges = pairs(F.concat(ring, F.slice(ring, 1, 1)))

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        # the reference walks edges as (vertex, the one before)
        return ((b["lat"] > p["lat"]) != (a["lat"] > p["lat"])) & (p["lon"] < F.try_divide((a["lon"] - b["lon"]) * (p["lat"] - b["lat"]), a["lat"] - b["lat"]) + b["lon"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def in_part(p: Column, part: Column) -> Column:
    """Inside the outer ring of a polygon and in none of its holes, half open."""
    return in_ring(p, as_points(part[0])) & ~F.exists(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda hole: in_ring(p, as_points(hole)))


def in_polygon(p: Column, g: Column) -> Column:
    return is_polygon(g) & F.exists(g["coords"], lambda part: in_part(p, part))


def cross_product(a: Column, b: Column, c: Column) -> Column:
    return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])


def on_segment(p: Column, s: Column) -> Column:
    """Within the segment's box, and collinear up to 1e-10 square degrees."""
    a, b = s["a"], s["b"]
    inside = [p[k].between(F.least(a[k], b[k]), F.greatest(a[k], b[k])) for k in ("lon", "lat")]
    return inside[0] & inside[1] & (F.abs(cross_product(a, b, p)) < PLANAR_EPSILON)


def on_ring(p: Column, ring: Column) -> Column:
    return F.exists(pairs(F.concat(ring, F.slice(ring, 1, 1))), lambda s: on_segment(p, s))


def in_part_with_boundary(p: Column, part: Column, ignore_boundary: Column) -> Column:
    """Inside a polygon; a point on any of its rings counts unless the boundary is ignored."""
    outer, holes = as_points(part[0]), F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), as_points)
    on_hole = F.exists(holes, lambda r: on_ring(p, r))
    return F.when(on_ring(p, outer), ~ignore_boundary).when(~in_ring(p, outer), F.lit(False)).when(on_hole, ~ignore_boundary).otherwise(~F.exists(holes, lambda r: in_ring(p, r)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
