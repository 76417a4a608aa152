"""Measurement operators as Column expressions over geometry columns; all stay in the JVM."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions import sphere
from ..functions.constants import EARTH_RADIUS, EPSILON, meters_in
from ..functions.sphere import check, let, point

BBOX = "array<double>"


def _xy(g: Column) -> Column:
    return S.vertices(g)[0]


def _not_negative(value: Column, name: str) -> Column:
    return check(value >= 0, f"{name} must be >= 0.", value)


def _walk(path: Column, meters: Column) -> Column:
    """The point that many meters along a path; its end if it is shorter."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("struct<lon:double,lat:double>").alias("hit"))

    def step(acc: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        args = (a["lon"], a["lat"], b["lon"], b["lat"])

        def add(size: Column) -> Column:
            here = acc["hit"].isNull() & (acc["done"] + size >= meters)
            found = sphere.destination(a["lon"], a["lat"], sphere.bearing(*args), meters - acc["done"])
            return F.struct((acc["done"] + size).alias("done"), F.when(here, found).otherwise(acc["hit"]).alias("hit"))

        return let(sphere.haversine(*args), add)

    return F.coalesce(F.aggregate(S.pairs(path), start, step)["hit"], F.element_at(path, -1))


def along(line: Column, distance: Column, units: str = "kilometers") -> Column:
    """The point at a distance along a LineString; its last vertex where the line is shorter."""
    return let(S.first_line(line), lambda path: _walk(path, _not_negative(distance, "distance") * meters_in(units)))


def area(g: Column) -> Column:
    """Square meters of all polygons, each in its own equirectangular plane."""
    areas = F.transform(g["coords"], lambda part: S.polygon_metrics(part)["area"])
    return check(S.is_polygon(g), "area needs Polygon or MultiPolygon geometry.", S.total(areas))


def bbox(g: Column) -> Column:
    """[min lon, min lat, max lon, max lat] of all vertices."""
    v = S.vertices(g)
    lon, lat = F.transform(v, lambda p: p["lon"]), F.transform(v, lambda p: p["lat"])
    return F.array(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat))


def valid_bbox(box: Column) -> Column:
    return check((F.size(box) == 4) & (box[0] <= box[2]) & (box[1] <= box[3]), "bbox must be [minX, minY, maxX, maxY] with min <= max.", box)


def bbox_polygon(box: Column) -> Column:
    """The box as a Polygon, from the south-west counter-clockwise."""
    return let(valid_bbox(box), lambda b: S.geometry("Polygon", F.array(F.array(F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]), F.array(b[0], b[1]))))))


def bearing(a: Column, b: Column) -> Column:
    """Initial bearing between two points; equal points are an error."""
    differ = (a["lon"] != b["lon"]) | (a["lat"] != b["lat"])
    return check(differ, "point1 and point2 must be different for bearing.", sphere.bearing(a["lon"], a["lat"], b["lon"], b["lat"]))


def center(g: Column) -> Column:
    """The middle of the bounding box."""
    return let(bbox(g), lambda b: point((b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0))


def center_of_mass(g: Column) -> Column:
    """The area-weighted centroid of polygons, the mean vertex of anything else."""

    def weigh(metrics: Column) -> Column:
        whole = S.total(F.transform(metrics, lambda m: m["area"]))
        lat0 = S.total(F.transform(metrics, lambda m: m["lat_sum"])) / S.total(F.transform(metrics, lambda m: m["n"].cast("double")))
        mean = lambda k: F.try_divide(S.total(F.transform(metrics, lambda m: m["area"] * m[k])), whole)
        cos0 = F.cos(F.radians(lat0))
        found = point(F.degrees(F.try_divide(mean("x"), EARTH_RADIUS * cos0)), F.degrees(mean("y") / EARTH_RADIUS))
        return check(F.abs(cos0) >= EPSILON, "Center of mass conversion failed near poles.", found)

    return F.when(S.is_polygon(g), let(F.transform(g["coords"], S.polygon_metrics), weigh)).otherwise(centroid(g))


def centroid(g: Column) -> Column:
    """The mean vertex; a ring's closing vertex counts too."""
    return let(S.vertices(g), S.mean_vertex)


def destination(origin: Column, distance: Column, bearing_: Column, units: str = "kilometers") -> Column:
    return sphere.destination(origin["lon"], origin["lat"], bearing_, _not_negative(distance, "distance") * meters_in(units))


def distance(a: Column, b: Column, units: str = "kilometers") -> Column:
    return sphere.haversine(a["lon"], a["lat"], b["lon"], b["lat"]) / meters_in(units)


def envelope(g: Column) -> Column:
    """The bounding box as a Polygon."""
    return bbox_polygon(bbox(g))


def length(g: Column, units: str = "kilometers") -> Column:
    """The length of all lines; other geometries are an error."""
    return check(S.is_line(g), "length needs LineString or MultiLineString geometry.", S.total(F.transform(S.rings(g), S.path_length)) / meters_in(units))


def midpoint(a: Column, b: Column) -> Column:
    return sphere.midpoint(a["lon"], a["lat"], b["lon"], b["lat"])


def point_on_feature(g: Column) -> Column:
    """A point itself; half way along a line; a polygon's center of mass, or its first vertex where that is outside; else the mean vertex."""
    half = let(S.first_line(g), lambda path: _walk(path, S.path_length(path) / 2.0))
    inside = let(center_of_mass(g), lambda c: F.when(S.in_polygon(c, g), c).otherwise(_xy(g)))
    return F.when(g["type"] == "Point", _xy(g)).when(g["type"] == "LineString", half).when(S.is_polygon(g), inside).otherwise(centroid(g))


def point_to_line_distance(p: Column, line: Column, units: str = "kilometers", method: str = "geodesic") -> Column:
    """The least distance to a segment of the line; both methods compute the same."""
    if method not in ("geodesic", "planar"):
        raise ValueError("options.method must be 'geodesic' or 'planar'.")
    # the point is worked out once, not for each segment
    return let(p, lambda q: F.array_min(F.transform(S.pairs(S.first_line(line)), lambda s: sphere.segment_distance(q, s["a"], s["b"])))) / meters_in(units)


def rhumb_bearing(a: Column, b: Column, final: bool = False) -> Column:
    """Rhumb bearing, or with ``final`` the reverse one turned round; equal points are an error."""
    differ = (a["lon"] != b["lon"]) | (a["lat"] != b["lat"])
    there = sphere.rhumb_bearing(a["lon"], a["lat"], b["lon"], b["lat"])
    back = sphere.normal_bearing(sphere.rhumb_bearing(b["lon"], b["lat"], a["lon"], a["lat"]) + 180.0)
    return check(differ, "point1 and point2 must be different for rhumbBearing.", back if final else there)


def rhumb_destination(origin: Column, distance: Column, bearing_: Column, units: str = "kilometers") -> Column:
    return sphere.rhumb_destination(origin["lon"], origin["lat"], bearing_, _not_negative(distance, "distance") * meters_in(units))


def rhumb_distance(a: Column, b: Column, units: str = "kilometers") -> Column:
    return sphere.rhumb_distance(a["lon"], a["lat"], b["lon"], b["lat"]) / meters_in(units)


def square(box: Column) -> Column:
    """The smallest square box, in degrees, with the same middle that holds the box."""

    def widen(b: Column) -> Column:
        half = F.greatest(b[2] - b[0], b[3] - b[1]) / 2.0
        x, y = (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0
        return F.array(x - half, y - half, x + half, y + half)

    return let(valid_bbox(box), widen)


def great_circle(a: Column, b: Column, npoints: int = 100) -> Column:
    """A LineString of ``npoints`` (2 or more) vertices along the great circle, its ends exact."""
    n = max(2, npoints)
    middle = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: sphere.on_great_circle(a["lon"], a["lat"], b["lon"], b["lat"], k / float(n - 1)))
    ends = lambda p: F.array(point(p["lon"], p["lat"]))
    return S.of_line(F.concat(ends(a), F.slice(middle, 1, n - 2), ends(b)))


def polygon_tangents(p: Column, g: Column) -> Column:
    """(left, right): the outer vertices with the least and greatest planar angle seen from p, the first of equals."""
    seen = F.transform(F.flatten(S.outer_rings(g)), lambda v, i: F.struct(F.atan2(v["lat"] - p["lat"], v["lon"] - p["lon"]).alias("angle"), (-i).alias("back"), v.alias("v")))
    first = F.transform(F.flatten(S.outer_rings(g)), lambda v, i: F.struct(F.atan2(v["lat"] - p["lat"], v["lon"] - p["lon"]).alias("angle"), i.alias("ahead"), v.alias("v")))
    return check(S.is_polygon(g), "polygon must contain Polygon or MultiPolygon geometry.", F.struct(F.array_min(first)["v"].alias("left"), F.array_max(seen)["v"].alias("right")))


def circle_ring(center_: Column, meters: Column, steps: int) -> Column:
    """A closed ring of steps + 1 vertices, clockwise from the north."""
    if not isinstance(steps, int) or steps < 4:
        raise ValueError("options.steps must be >= 4.")
    ring = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: sphere.destination(center_["lon"], center_["lat"], k * 360.0 / float(steps), meters))
    return let(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))


