"""Transformation operators. Coordinate maps, generators and clips of polygons are Column expressions; hulls, clips of lines and simplification use small Arrow helpers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions import sphere
from ..functions.constants import EARTH_RADIUS, EPSILON, meters_in
from ..functions.sphere import check, let
from ..sources.scratch import saved
from . import clipping, planar
from . import measurement as M


def _map_vertices(g: Column, change: Callable[[Column], Column]) -> Column:
    """Change every vertex (an array of ordinates) of a geometry."""
    return F.when(g.isNotNull(), S.geometry(g["type"], F.transform(g["coords"], lambda part: F.transform(part, lambda ring: F.transform(ring, change)))))


def bbox_clip(g: Column, box: Column) -> Column:
    """Lines and polygons within a box; holes are dropped, nothing left is null, points are an error."""
    shape = check(S.is_line(g) | S.is_polygon(g), "bboxClip supports LineString, MultiLineString, Polygon, and MultiPolygon.", g)
    flat = lambda ring: F.array(F.transform(ring, lambda v: F.array(v["lon"], v["lat"])))
    rings = lambda g, b: F.filter(F.transform(g["coords"], lambda part: flat(clipping.box_ring(S.as_points(part[0]), b))), lambda part: F.size(part[0]) > 0)
    bounds = M.valid_bbox(box)
    # the helper for lines gets no polygons, and the other way round
    lines = planar.clipped_lines(F.when(S.is_line(g), shape["coords"]), bounds)
    left = F.when(S.is_line(g), lines).otherwise(let(F.struct(shape.alias("g"), bounds.alias("b")), lambda s: F.when(s["b"].isNotNull(), rings(s["g"], s["b"]))))
    family = F.when(S.is_line(g), "LineString").otherwise("Polygon")
    kind = F.when((g["type"] == family) & (F.size(left) == 1), family).otherwise(F.concat(F.lit("Multi"), family))
    return F.when(F.size(left) > 0, S.geometry(kind, left))


def bezier_spline(line: Column, sharpness: float = 0.85, resolution: int = 10_000) -> Column:
    """A line with its corners cut in some passes, then thinned to ``resolution`` vertices."""
    passes = min(6, max(1, math.floor(min(1.0, max(0.1, sharpness)) * 4.0 + 0.5)))
    most = max(2, resolution)

    def corner(path: Column) -> Column:
        mix = lambda s, k, w: w * s["a"][k] + (1.0 - w) * s["b"][k]
        cut = F.flatten(F.transform(S.pairs(path), lambda s: F.array(*(sphere.point(mix(s, "lon", w), mix(s, "lat", w)) for w in (0.75, 0.25)))))
        return F.concat(F.slice(path, 1, 1), cut, F.slice(path, -1, 1))

    def thin(path: Column) -> Column:
        stride = (F.size(path) - 1) / float(most - 1)
        inner = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.element_at(path, F.least(F.floor(stride * k + 0.5).cast("int"), F.size(path) - 1) + 1))
        return F.when(F.size(path) <= most, path).otherwise(inner)

    def smooth(path: Column, left: int) -> Column:
        return let(path, lambda p: smooth(corner(p), left - 1)) if left else let(path, thin)

    return S.of_line(smooth(S.first_line(line), passes))


def circle(center: Column, radius: Column, units: str = "kilometers", steps: int = 64) -> Column:
    """A polygon of ``steps`` vertices around a point, clockwise from the north."""
    meters = check(radius >= 0, "Field 'radius' must be >= 0.", radius) * meters_in(units)
    return S.of_ring(M.circle_ring(center, meters, steps))


def buffer(g: Column, radius: Column, units: str = "kilometers", steps: int = 64) -> Column:
    """A circle around the mean vertex that reaches ``radius`` beyond the farthest vertex."""
    meters = check(radius >= 0, "Field 'radius' must be >= 0.", radius) * meters_in(units)

    def around(v: Column) -> Column:
        return let(S.mean_vertex(v), lambda c: S.of_ring(M.circle_ring(c, meters + F.array_max(F.transform(v, lambda p: sphere.haversine(c["lon"], c["lat"], p["lon"], p["lat"]))), steps)))

    return let(S.vertices(g), around)


def clone(g: Column) -> Column:
    return g


def _hulls(points: DataFrame, by: list[str], lon: str, lat: str) -> DataFrame:
    """(by, ring): hulls of groups of points. Each task first reduces what it has of a group to its hull, so a large group is not moved whole."""
    names = [*by, "lon", "lat"]
    rows = points.select(*by, F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")).where("lon IS NOT NULL AND lat IS NOT NULL")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            groups = some.groupby(by, dropna=False, sort=False) if by else [((), some)]
            for key, group in groups:
                p = list(zip(group["lon"], group["lat"], strict=True))
                # three points or fewer, or collinear ones, stay as they are
                least = planar.hull(p, EPSILON)[:-1] or list(dict.fromkeys(p))
                out = pd.DataFrame(least, columns=["lon", "lat"])
                for name, value in zip(by, key if isinstance(key, tuple) else (key,), strict=True):
                    out[name] = pd.Series([None if pd.isna(value) else value] * len(out), dtype=object)
                yield out[names]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        ring = planar.hull(zip(group["lon"], group["lat"], strict=True), EPSILON)
        out = group[by].iloc[:1].copy() if by else pd.DataFrame(index=[0])
        out["ring"] = [[{"lon": x, "lat": y} for x, y in ring]]
        return out

    shrunk = rows.mapInPandas(partial, rows.schema)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by), "ring array<struct<lon:double,lat:double>>"])
    return shrunk.groupBy(*by).applyInPandas(merge, fields)


def convex(points: DataFrame, by: list[str] | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(by, geom): the convex hull of each group of points; fewer than three distinct points, or collinear ones, are an error."""
    rings = _hulls(points, by or [], lon, lat)
    ring = check(F.size("ring") >= 4, "convex requires at least 3 non-collinear distinct points.", F.col("ring"))
    return rings.select(*(by or []), S.of_ring(ring).alias("geom"))


def concave(points: DataFrame, by: list[str] | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The same as convex."""
    return convex(points, by, lon, lat)


def _outer_hull(g: Column) -> Column:
    return planar.hull_ring(S.as_points(g["coords"][0][0]))


def union(a: Column, b: Column) -> Column:
    """The hull of both first outer rings."""
    ring = planar.hull_ring(F.concat(S.as_points(a["coords"][0][0]), S.as_points(b["coords"][0][0])))
    return S.of_ring(check(F.size(ring) >= 4, "Union result is empty.", ring))


def intersect(a: Column, b: Column) -> Column:
    """What the hulls of two polygons share; null if that has no area."""
    ring = clipping.common_ring(_outer_hull(a), _outer_hull(b))
    return F.when(F.size(ring) >= 4, S.of_ring(ring))


def difference(a: Column, b: Column) -> Column:
    """The hull of a, with what the hulls share as a hole."""
    outer = _outer_hull(a)
    shared = clipping.common_ring(outer, _outer_hull(b))
    flat = lambda r: F.transform(r, lambda v: F.array(v["lon"], v["lat"]))
    # the hole runs the other way from the last of its open vertices
    hole = F.reverse(F.slice(shared, 1, F.greatest(F.size(shared) - 1, F.lit(0))))
    hole = F.concat(hole, F.slice(hole, 1, 1))
    rings = F.when(F.size(shared) >= 4, F.array(flat(outer), flat(hole))).otherwise(F.array(flat(outer)))
    return check(F.size(outer) >= 4, "Difference result is empty.", S.geometry("Polygon", F.array(rings)))


def dissolve(polygons: DataFrame, key: str | None = None, geom: str = "geom", fid: str = "fid") -> DataFrame:
    """(key, geom): the hull of each group's first outer rings, in order of keys.

    ``key`` holds the property as JSON text; without it all are one group; a row
    whose key is null is a group of its own; groups without area are left out.
    """
    named = F.col(key).cast("string") if key else F.lit("__all__")
    rows = polygons.select(named.alias("key"), F.when(named.isNull(), F.col(fid)).alias("own"), F.explode(S.as_points(F.col(geom)["coords"][0][0])).alias("v"))
    rings = _hulls(rows.select("key", "own", "v.lon", "v.lat"), ["key", "own"], "lon", "lat")
    return rings.where("size(ring) >= 4").select("key", "own", S.of_ring(F.col("ring")).alias("geom")).orderBy("key", "own").select("key", "geom")


def line_offset(g: Column, distance: Column, units: str = "kilometers") -> Column:
    """Lines moved to the left of travel (right if negative) by the mean of the normals at each vertex."""
    meters = distance * meters_in(units)

    def moved(path: Column) -> Column:
        def around(c: Column) -> Column:
            cos0 = F.cos(F.radians(c["lat"]))
            flat = F.transform(path, lambda v: sphere.point(EARTH_RADIUS * F.radians(v["lon"] - c["lon"]) * cos0, EARTH_RADIUS * F.radians(v["lat"] - c["lat"])))

            def normal(s: Column) -> Column:
                dx, dy = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
                size = F.sqrt(dx * dx + dy * dy)
                some = lambda v: F.when(size < EPSILON, F.lit(0.0)).otherwise(F.try_divide(v, size))
                return F.struct(some(-dy).alias("x"), some(dx).alias("y"))

            def shift(flat: Column, normals: Column) -> Column:
                def at(v: Column, i: Column) -> Column:
                    before, after = F.get(normals, F.greatest(i - 1, F.lit(0))), F.get(normals, F.least(i, F.size(normals) - 1))
                    x, y = before["x"] + after["x"], before["y"] + after["y"]
                    size = F.sqrt(x * x + y * y)
                    mean = lambda v, k: F.when(size > EPSILON, F.try_divide(v, size)).otherwise(after[k])
                    inner = (i > 0) & (i < F.size(flat) - 1)
                    nx, ny = (F.when(inner, mean(v, k)).otherwise(F.when(i == 0, after[k]).otherwise(before[k])) for v, k in ((x, "x"), (y, "y")))
                    lon = sphere.normal_lon(c["lon"] + F.degrees((v["lon"] + nx * meters) / (EARTH_RADIUS * cos0)))
                    return F.array(lon, c["lat"] + F.degrees((v["lat"] + ny * meters) / EARTH_RADIUS))

                return F.transform(flat, at)

            both = F.struct(flat.alias("flat"), F.transform(S.pairs(flat), normal).alias("normals"))
            return check(F.abs(cos0) >= EPSILON, "lineOffset is unstable near the poles.", let(both, lambda s: shift(s["flat"], s["normals"])))

        return let(S.mean_vertex(path), around)

    lines = F.transform(S.rings(g), lambda path: F.array(moved(path)))
    kind = F.when(F.size(lines) == 1, "LineString").otherwise("MultiLineString")
    return check(S.is_line(g), "lineOffset needs LineString or MultiLineString geometry.", S.geometry(kind, lines))


def simplify(g: Column, tolerance: float = 1.0) -> Column:
    """Lines and rings with fewer vertices; the tolerance is in degrees, points stay."""
    return F.when(g.isNotNull(), S.geometry(g["type"], planar.simplify_udf(max(0.0, tolerance))(g["type"], g["coords"])))


def tesselate(g: Column) -> Column:
    """An array of triangles that fan out from the first vertex of a Polygon; holes are ignored."""
    ring = g["coords"][0][0]
    open_ = F.when((F.abs(ring[0][0] - F.element_at(ring, -1)[0]) < EPSILON) & (F.abs(ring[0][1] - F.element_at(ring, -1)[1]) < EPSILON), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)

    def fan(v: Column) -> Column:
        triangles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - 2, F.lit(1))), lambda k: S.geometry("Polygon", F.array(F.array(F.array(v[0], v[k], v[k + 1], v[0])))))
        return check(F.size(v) >= 3, "Polygon must contain at least 3 distinct vertices.", triangles)

    return check(g["type"] == "Polygon", "Field 'polygon' must be Polygon or Feature<Polygon>.", let(open_, fan))


def _about(g: Column, origin: Column | None, change: Callable[[Column, Column], tuple[Column, Column]], name: str) -> Column:
    """Change plane coordinates around an origin, the mean vertex unless one is given."""

    def with_origin(c: Column) -> Column:
        cos0 = F.cos(F.radians(c["lat"]))

        def vertex(v: Column) -> Column:
            x, y = EARTH_RADIUS * F.radians(v[0] - c["lon"]) * cos0, EARTH_RADIUS * F.radians(v[1] - c["lat"])
            x, y = change(x, y)
            lon = sphere.normal_lon(c["lon"] + F.degrees(x / (EARTH_RADIUS * cos0)))
            return F.concat(F.array(lon, c["lat"] + F.degrees(y / EARTH_RADIUS)), F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))))

        return check(F.abs(cos0) >= EPSILON, f"{name} is unstable near the poles.", _map_vertices(g, vertex))

    return let(S.mean_vertex(S.vertices(g)) if origin is None else origin, with_origin)


def transform_rotate(g: Column, angle: Column, pivot: Column | None = None) -> Column:
    """Turned clockwise by an angle in degrees."""
    theta = -F.radians(angle)
    return _about(g, pivot, lambda x, y: (x * F.cos(theta) - y * F.sin(theta), x * F.sin(theta) + y * F.cos(theta)), "transformRotate")


def transform_scale(g: Column, factor: Column, origin: Column | None = None) -> Column:
    return _about(g, origin, lambda x, y: (x * factor, y * factor), "transformScale")


def transform_translate(g: Column, distance: Column, direction: Column, units: str = "kilometers", z_translation: float = 0.0) -> Column:
    """Every vertex moved along a great circle; a third ordinate is raised by ``z_translation``."""

    def vertex(v: Column) -> Column:
        to = sphere.destination(v[0], v[1], direction, distance * meters_in(units))
        rest = F.transform(F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))), lambda z, i: F.when(i == 0, z + z_translation).otherwise(z))
        return let(to, lambda p: F.concat(F.array(p["lon"], p["lat"]), rest))

    return _map_vertices(g, vertex)


def voronoi(sites: DataFrame, box: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0), fid: str = "fid", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(fid, geom): the cell of each site within a box; cells without area are left out, sites in one place have the same cell.

    A cell is cut by the bisectors to the sites in the grid cells around it. It
    is final once no farther site can reach it: its farthest vertex is nearer
    than half the distance covered. Others look twice as far in the next round.
    """
    west, south, east, north = box
    rows = saved(sites.select(F.col(fid).alias("fid"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")), "sites")
    places = saved(rows.groupBy("x", "y").agg(F.min("fid").alias("first")), "places")
    n, x0, x1, y0, y1 = places.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        raise ValueError("points.features must be non-empty.")
    span = max(x1 - x0, y1 - y0, 1e-9)
    side = span / max(1.0, math.sqrt(n))

    def cell_of(group: pd.DataFrame, reach: float) -> pd.DataFrame:
        xi, yi = float(group["x"].iloc[0]), float(group["y"].iloc[0])
        ring = [(west, south), (east, south), (east, north), (west, north)]
        for xj, yj in group.sort_values("nfirst")[["nx", "ny"]].itertuples(index=False):
            if (xj, yj) != (xi, yi) and ring:
                ring = planar.cut(ring, xj - xi, yj - yi, 0.5 * ((xj * xj + yj * yj) - (xi * xi + yi * yi)), 1e-10)
        far = max((math.hypot(x - xi, y - yi) for x, y in ring), default=0.0)
        return pd.DataFrame({"x": [xi], "y": [yi], "final": [2 * far <= reach], "ring": [[{"lon": a, "lat": b} for a, b in planar.close(ring)]]})

    def cells_up_to(reach: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda group: cell_of(group, reach)

    todo, done, look = places, None, 2.0
    while True:
        size = side * look
        whole = size >= 2 * span
        key = lambda c, o, s=size: F.floor((F.col(c) - o) / s).cast("long")
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        mine = todo.select("x", "y", key("x", x0).alias("i"), key("y", y0).alias("j")).withColumn("di", around).withColumn("dj", around).select("x", "y", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
        near = places.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("first").alias("nfirst"), key("x", x0).alias("i"), key("y", y0).alias("j"))
        reach = float("inf") if whole else size
        found = saved(mine.join(near, ["i", "j"]).groupBy("x", "y").applyInPandas(cells_up_to(reach), "x double, y double, final boolean, ring array<struct<lon:double,lat:double>>"), "cells")
        settled = found.where("final").select("x", "y", "ring")
        done = settled if done is None else done.unionByName(settled)
        todo = found.where("NOT final").select("x", "y")
        if whole or todo.isEmpty():
            break
        look *= 2
    return rows.join(done.where("size(ring) >= 4"), ["x", "y"]).select("fid", S.of_ring(F.col("ring")).alias("geom"))
