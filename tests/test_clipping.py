"""Clips of convex rings against plain Python over lists."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoquilt.functions import shapes as S
from geoquilt.operators import clipping, planar
from geoquilt.operators import transformation as T

RINGS = "id int, a array<struct<lon:double,lat:double>>, b array<struct<lon:double,lat:double>>, box array<double>"


def area2(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))


def half(ring, a, b, c):
    out = []
    for q, p in zip(ring[-1:] + ring[:-1], ring):
        v, w = a * p[0] + b * p[1] - c, a * q[0] + b * q[1] - c
        if (v <= 1e-12) != (w <= 1e-12):
            t = -w / (v - w) if abs(v - w) >= 1e-14 else 1.0
            out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
        if v <= 1e-12:
            out.append(p)
    return out


def shut(ring):
    ring = ring if not ring or (len(ring) > 1 and max(abs(ring[0][0] - ring[-1][0]), abs(ring[0][1] - ring[-1][1])) <= 1e-12) else [*ring, ring[0]]
    return ring if len(ring) >= 4 and abs(area2(ring)) / 2 > 1e-12 else []


def both(a, b):
    edges, ring = (b if area2(b) > 0 else b[::-1]), a[:-1]
    for p, q in zip(edges, edges[1:]):
        x, y = q[1] - p[1], p[0] - q[0]
        ring = half(ring, x, y, x * p[0] + y * p[1])
    return shut(ring) if b else []


def in_box(ring, box):
    ring = ring[:-1]
    for a, b, c in ((-1, 0, -box[0]), (1, 0, box[2]), (0, -1, -box[1]), (0, 1, box[3])):
        ring = half(ring, a, b, c)
    return shut(ring)


def polygon(draw, backwards):
    """Corners on an ellipse, closed."""
    x, y, r, s = draw.uniform(-3, 3), draw.uniform(-3, 3), draw.uniform(0.5, 4), draw.uniform(0.5, 4)
    at = sorted(draw.uniform(0, 2 * math.pi) for _ in range(draw.randint(3, 12)))
    ring = [(x + r * math.cos(t), y + s * math.sin(t)) for t in at]
    ring = ring[::-1] if backwards else ring
    return [*ring, ring[0]]


@pytest.fixture(scope="module")
def cases():
    draw = random.Random(11)
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    box = lambda: [*sorted(draw.uniform(-4, 4) for _ in range(2)), *sorted(draw.uniform(-4, 4) for _ in range(2))]
    rows = [(polygon(draw, k % 2), polygon(draw, k % 3 == 0), (lambda b: [b[0], b[2], b[1], b[3]])(box())) for k in range(200)]
    # equal, one within the other, one common edge, one common corner, apart, nothing
    for other in (square(0, 0, 2), square(0.5, 0.5, 1), square(2, 0, 2), square(2, 2, 1), square(5, 5, 1), []):
        rows.append((square(0.0, 0.0, 2.0), [(float(x), float(y)) for x, y in other], [0.0, 0.0, 1.0, 2.0]))
    return [(i, *r) for i, r in enumerate(rows)]


def close_to(got, want):
    assert (got is None) == (want is None)
    if want is not None:
        assert len(got) == len(want)
        for p, q in zip(got, want):
            assert tuple(p) == pytest.approx(tuple(q), abs=1e-11)


def test_common_ring_and_box_ring(spark, cases):
    df = spark.createDataFrame([*cases, (-1, None, cases[0][2], None)], RINGS).repartition(3)
    got = {r["id"]: r for r in df.select("id", clipping.common_ring(F.col("a"), F.col("b")).alias("common"), clipping.box_ring(F.col("a"), F.col("box")).alias("boxed")).collect()}
    assert len(got) == len(cases) + 1 and got[-1]["common"] is None
    found = 0
    for i, a, b, box in cases:
        close_to(got[i]["common"], both(a, b))
        close_to(got[i]["boxed"], in_box(a, box))
        found += bool(got[i]["common"])
    assert 60 < found < len(cases)


def test_polygons_are_clipped_without_python(spark, cases):
    """A part left is a Polygon, more are a MultiPolygon, none is null; polygons and lines in one column; no Python in the plan of a ring's clip."""
    df = spark.createDataFrame(cases, RINGS)
    assert "ArrowEval" not in df.select(clipping.box_ring(F.col("a"), F.col("box")))._jdf.queryExecution().executedPlan().toString()
    outer = F.transform("a", lambda v: F.array(v["lon"], v["lat"]))
    other = F.transform("a", lambda v: F.array(v["lon"] + 100.0, v["lat"]))
    one = df.select("id", T.bbox_clip(S.geometry("Polygon", F.array(F.array(outer))), F.col("box")).alias("g"))
    two = df.select("id", T.bbox_clip(S.geometry("MultiPolygon", F.array(F.array(outer), F.array(other))), F.col("box")).alias("g"))
    line = df.select("id", T.bbox_clip(S.geometry(F.when(F.col("id") % 2 == 0, "LineString").otherwise("Polygon"), F.array(F.array(outer))), F.col("box")).alias("g"))
    want = {i: in_box(a, box) for i, a, _, box in cases}
    for rows, kind in ((one, "Polygon"), (two, "MultiPolygon")):
        for r in rows.collect():
            if not want[r["id"]]:
                assert r["g"] is None
            else:
                assert r["g"]["type"] == kind and len(r["g"]["coords"]) == 1
                close_to(r["g"]["coords"][0][0], want[r["id"]])
    mixed = {r["id"]: r["g"] for r in line.collect()}
    assert all((g is None) == (not want[i]) for i, g in mixed.items() if i % 2) and {g["type"] for i, g in mixed.items() if g and i % 2} == {"Polygon"}
    assert {g["type"] for i, g in mixed.items() if g and i % 2 == 0} <= {"LineString", "MultiLineString"}


def test_first_of_equal_vertices_stays():
    """Two vertices in one place are equally far, so the first stays, whatever their places in memory."""
    path = np.array([(37.7215, -15.493500000000001), (37.9113, -14.0017), (36.0504, -14.8536), (37.7404, -14.063600000000001), (36.0504, -14.8536), (36.0684, -15.0156), (37.9269, -15.7421)])
    assert planar.kept_by_tolerance(path, 0.5).tolist() == [True, True, True, True, True, False, True]


def test_helpers_get_columns_as_arrays():
    """Clips and simplification take a batch's coordinates as arrays, nulls and slices too, not as a Python object for each vertex."""
    coords = pa.array([None, [[[[0.0, 0.0], [4.0, 0.0]]], [[[0.0, 9.0], [1.0, 9.0]]]], [[[[0.0, 1.0], [1.0, 1.0001], [2.0, 1.0]]]]], pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))
    box = pa.array([[1.0, -1.0, 3.0, 2.0]] * 3)
    assert planar.clipped_lines.func(coords, box).to_pylist() == [None, [[[[1.0, 0.0], [3.0, 0.0]]]], [[[[1.0, 1.0001], [1.0, 1.0001], [2.0, 1.0]]]]]
    assert planar.clipped_lines.func(coords.slice(1), box.slice(1)).to_pylist()[0] == [[[[1.0, 0.0], [3.0, 0.0]]]]
    assert planar.simplify_udf(0.5).func(pa.array(["LineString"] * 3), coords).to_pylist() == [None, coords[1].as_py(), [[[[0.0, 1.0], [2.0, 1.0]]]]]
