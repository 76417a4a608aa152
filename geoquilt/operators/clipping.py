"""Convex clipping as Column expressions: a ring is cut by one half-plane after another.

A ring is an array of structs of lon and lat. A half-plane is a struct of a, b
and c that holds where a lon + b lat <= c.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.constants import EPSILON
from ..functions.sphere import let, point

_RING = "array<struct<lon:double,lat:double>>"


def _none() -> Column:
    return F.array().cast(_RING)


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring."""
    return F.aggregate(S.pairs(ring), F.lit(0.0), lambda sum_, e: sum_ + (e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]))


def cut(ring: Column, plane: Column) -> Column:
    """The part of an open convex ring in a half-plane."""
    side = lambda v: plane["a"] * v["lon"] + plane["b"] * v["lat"]

    def at(p: Column, k: Column) -> Column:
        q = F.when(k == 0, F.element_at(ring, -1)).otherwise(F.get(ring, k - 1))
        ends = F.struct(p.alias("p"), q.alias("q"), side(p).alias("v"), side(q).alias("w"))

        def vertices(s: Column) -> Column:
            p, q, v, w = (s[n] for n in "pqvw")
            inside, was = v <= plane["c"] + EPSILON, w <= plane["c"] + EPSILON
            t = F.when(F.abs(v - w) >= 1e-14, F.try_divide(plane["c"] - w, v - w)).otherwise(F.lit(1.0))
            edge = let(t, lambda t: point(q["lon"] + t * (p["lon"] - q["lon"]), q["lat"] + t * (p["lat"] - q["lat"])))
            return F.when(inside & was, F.array(p)).when(inside, F.array(edge, p)).when(was, F.array(edge)).otherwise(_none())

        return let(ends, vertices)

    return F.flatten(F.transform(ring, at))


def _cut_by(ring: Column, planes: Column) -> Column:
    return F.aggregate(planes, ring.cast(_RING), lambda left, plane: cut(left, plane))


def closed(ring: Column) -> Column:
    """The ring with its first vertex at its end; empty if it has no area."""

    def whole(r: Column) -> Column:
        first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
        shut = (F.size(r) > 1) & (F.abs(first["lon"] - last["lon"]) <= EPSILON) & (F.abs(first["lat"] - last["lat"]) <= EPSILON)
        return F.when(shut, r).otherwise(F.concat(r, F.slice(r, 1, 1)))

    return let(let(ring, whole), lambda r: F.when((F.size(r) >= 4) & (F.abs(twice_area(r)) / 2 > EPSILON), r).otherwise(_none()))


def _open(ring: Column) -> Column:
    return F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))


def common_ring(subject: Column, clip: Column) -> Column:
    """What two closed convex rings share, either way round; empty without area, null if one is null."""

    def planes(clip: Column) -> Column:
        """Left of each edge, counter-clockwise."""
        edges = S.pairs(F.when(twice_area(clip) > 0, clip).otherwise(F.reverse(clip)))

        def left(e: Column) -> Column:
            a, b = e["b"]["lat"] - e["a"]["lat"], e["a"]["lon"] - e["b"]["lon"]
            return F.struct(a.alias("a"), b.alias("b"), (a * e["a"]["lon"] + b * e["a"]["lat"]).alias("c"))

        return F.transform(edges, left)

    both = let(F.struct(subject.alias("s"), clip.alias("c")), lambda r: closed(_cut_by(_open(r["s"]), let(r["c"], planes))))
    none = (F.size(subject) == 0) | (F.size(clip) == 0)
    return F.when(subject.isNotNull() & clip.isNotNull(), F.when(none, _none()).otherwise(both))


def box_ring(ring: Column, box: Column) -> Column:
    """A ring clipped to a box, an array of least lon, least lat, greatest lon, greatest lat; empty without area."""

    def clipped(r: Column) -> Column:
        shut = (F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1))
        sides = ((-1.0, 0.0, -box[0]), (1.0, 0.0, box[2]), (0.0, -1.0, -box[1]), (0.0, 1.0, box[3]))
        planes = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.cast("double").alias("c")) for a, b, c in sides))
        return closed(_cut_by(F.when(shut, _open(r)).otherwise(r), planes))

    return let(ring, clipped)
