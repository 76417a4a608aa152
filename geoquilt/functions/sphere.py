"""Great-circle and rhumb-line formulas as Column expressions; angles are degrees, lengths meters.

A point is a struct of lon and lat.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS, EPSILON


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work out ``value`` once and use it in ``body`` many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def check(ok: Column, message: str, value: Column) -> Column:
    """``value`` where ``ok`` holds or is null; an error with the message otherwise."""
    return F.when(~F.coalesce(ok, F.lit(True)), F.raise_error(F.lit(message))).otherwise(value)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def normal_lon(lon: Column) -> Column:
    """To [-180, 180); the remainder keeps its sign."""
    return (lon + 540.0) % 360.0 - 180.0


def normal_bearing(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; NaN where rounding leaves the domain, at antipodes."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2)
    return let(a, lambda x: 2.0 * F.atan2(F.sqrt(x), F.sqrt(1.0 - x)) * EARTH_RADIUS)


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return normal_bearing(F.degrees(F.atan2(y, x)))


def destination(lon: Column, lat: Column, bearing_: Column, meters: Column) -> Column:
    """The point reached along a great circle."""
    angle, turn, p1 = meters / EARTH_RADIUS, F.radians(bearing_), F.radians(lat)
    p2 = F.asin(F.sin(p1) * F.cos(angle) + F.cos(p1) * F.sin(angle) * F.cos(turn))
    return let(p2, lambda p: point(normal_lon(F.degrees(F.radians(lon) + F.atan2(F.sin(turn) * F.sin(angle) * F.cos(p1), F.cos(angle) - F.sin(p1) * F.sin(p)))), F.degrees(p)))


def midpoint(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    bx, by = F.cos(p2) * F.cos(d), F.cos(p2) * F.sin(d)
    lat = F.atan2(F.sin(p1) + F.sin(p2), F.sqrt((F.cos(p1) + bx) * (F.cos(p1) + bx) + by * by))
    return point(normal_lon(F.degrees(F.radians(lon1) + F.atan2(by, F.cos(p1) + bx))), F.degrees(lat))


def on_great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, share: Column) -> Column:
    """The point at a share of the way; the start where both are closer than 1e-12 radians."""

    def xyz(lon: Column, lat: Column) -> list[Column]:
        return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]

    a, b = xyz(lon1, lat1), xyz(lon2, lat2)
    dot = F.least(F.greatest(a[0] * b[0] + a[1] * b[1] + a[2] * b[2], F.lit(-1.0)), F.lit(1.0))

    def way(omega: Column) -> Column:
        at = [let((F.sin((1.0 - share) * omega) * p + F.sin(share * omega) * q) / F.sin(omega), lambda v: v) for p, q in zip(a, b, strict=True)]
        return point(normal_lon(F.degrees(F.atan2(at[1], at[0]))), F.degrees(F.atan2(at[2], F.sqrt(at[0] * at[0] + at[1] * at[1]))))

    return let(F.acos(dot), lambda omega: F.when(F.abs(omega) < EPSILON, point(lon1, lat1)).otherwise(way(omega)))


def _stretch(lat1: Column, lat2: Column) -> Column:
    """The difference of stretched latitudes; infinite at a pole, where logarithms would be null."""
    ratio = F.try_divide(F.tan(F.radians(lat2) / 2.0 + math.pi / 4), F.tan(F.radians(lat1) / 2.0 + math.pi / 4))
    return let(ratio, lambda r: F.when(r > 0, F.ln(r)).when(r == 0, F.lit(float("-inf"))).when(r.isNull(), F.lit(float("inf"))).otherwise(F.lit(float("nan"))))


def _short_way(lon1: Column, lon2: Column) -> Column:
    """Difference of longitudes in radians, the shorter way round."""
    d = F.radians(lon2 - lon1)
    return F.when(F.abs(d) > math.pi, F.when(d > 0, d - 2 * math.pi).otherwise(d + 2 * math.pi)).otherwise(d)


def rhumb_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    across = F.radians(lat2) - F.radians(lat1)
    q = let(_stretch(lat1, lat2), lambda psi: F.when(F.abs(psi) > EPSILON, across / psi).otherwise(F.cos(F.radians(lat1))))
    return let(q, lambda f: EARTH_RADIUS * F.sqrt(across * across + f * f * _short_way(lon1, lon2) * _short_way(lon1, lon2)))


def rhumb_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return normal_bearing(F.degrees(F.atan2(_short_way(lon1, lon2), _stretch(lat1, lat2))))


def rhumb_destination(lon: Column, lat: Column, bearing_: Column, meters: Column) -> Column:
    """The point reached along a rhumb line; a way over a pole is reflected."""
    delta, theta, p1 = meters / EARTH_RADIUS, F.radians(bearing_), F.radians(lat)
    straight = p1 + delta * F.cos(theta)
    p2 = F.when(F.abs(straight) > math.pi / 2, F.when(straight > 0, math.pi - straight).otherwise(-math.pi - straight)).otherwise(straight)

    def way(p: Column) -> Column:
        q = let(_stretch(lat, F.degrees(p)), lambda psi: F.when(F.abs(psi) > EPSILON, (p - p1) / psi).otherwise(F.cos(p1)))
        return point(normal_lon(F.degrees(F.radians(lon) + F.try_divide(delta * F.sin(theta), q))), F.degrees(p))

    return let(p2, way)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance in meters of point p to the segment a-b, in the plane that touches p's latitude."""
    scale = EARTH_RADIUS * math.pi / 180
    c = F.cos(F.radians(p["lat"]))
    x, y = (lambda q: scale * (q["lon"] - p["lon"]) * c), (lambda q: scale * (q["lat"] - p["lat"]))
    planar = F.struct(x(a).alias("ax"), y(a).alias("ay"), (x(b) - x(a)).alias("dx"), (y(b) - y(a)).alias("dy"))

    def nearest(s: Column) -> Column:
        square = s["dx"] * s["dx"] + s["dy"] * s["dy"]
        t = F.when(square <= 1e-18, F.lit(0.0)).otherwise(F.least(F.greatest(F.try_divide(-(s["ax"] * s["dx"] + s["ay"] * s["dy"]), square), F.lit(0.0)), F.lit(1.0)))
        return let(t, lambda k: F.sqrt(F.pow(s["ax"] + k * s["dx"], 2) + F.pow(s["ay"] + k * s["dy"], 2)))

    return let(planar, nearest)
