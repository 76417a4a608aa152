"""Fixed values that results depend on."""

import math

# The mean Earth radius in meters, lengths of units in meters, and tolerances.
EARTH_RADIUS = 6371008.8
EPSILON = 1e-12
PLANAR_EPSILON = 1e-10
UNITS = {
    "meter": 1.0,
    "meters": 1.0,
    "kilometer": 1000.0,
    "kilometers": 1000.0,
    "mile": 1609.344,
    "miles": 1609.344,
    "nauticalmile": 1852.0,
    "nauticalmiles": 1852.0,
    "radian": EARTH_RADIUS,
    "radians": EARTH_RADIUS,
    "degree": EARTH_RADIUS * math.pi / 180.0,
    "degrees": EARTH_RADIUS * math.pi / 180.0,
}


def meters_in(units: str) -> float:
    """The length of a unit in meters; unknown units are an error."""
    if not isinstance(units, str) or units not in UNITS:
        raise ValueError(f"Unsupported units: {units}")
    return UNITS[units]
