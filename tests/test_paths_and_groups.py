"""Paths whose vertices are rows, and measures of all rows of a group, against plain Python and the column forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoquilt.functions import shapes as S
from geoquilt.functions.constants import EARTH_RADIUS
from geoquilt.functions.shapes import GEOMETRY
from geoquilt.operators import groups as G
from geoquilt.operators import measurement as M
from geoquilt.operators import paths as W
from geoquilt.plans.queries import FORMS, ORACLE_SQL

from .test_geo import duck, normal  # noqa: F401

VERTEX = "fid long, ix long, lon double, lat double"


@pytest.fixture(scope="module")
def long_path(spark):
    """One path of two million vertices along the equator, and three short ones."""
    one = spark.range(2_000_000).select(F.lit(1).cast("long").alias("fid"), F.col("id").alias("ix"), (F.col("id") * 5e-5).alias("lon"), F.lit(0.0).alias("lat"))
    few = spark.createDataFrame([(2, 0, 0.0, 0.0), (2, 1, 0.0, 1.0), (3, 0, 7.0, 7.0), (4, 0, 1.0, 1.0), (4, 1, 1.0, 1.0)], VERTEX)
    return one.unionByName(few)


def test_length_of_a_path_over_many_tasks(long_path):
    got = {r["fid"]: r["length"] for r in W.length(long_path, "meters").collect()}
    assert got == pytest.approx({1: math.radians(1_999_999 * 5e-5) * EARTH_RADIUS, 2: math.radians(1) * EARTH_RADIUS, 3: 0.0, 4: 0.0}, rel=1e-9)


def test_path_is_spread_over_tasks(long_path):
    rows = W._ranges(long_path, "fid", "ix", "lon", "lat")
    sizes = [r["count"] for r in rows.groupBy("chunk").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 800_000
    plan = W._chunks(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_points_of_a_path_over_many_tasks(long_path):
    got = {r["fid"]: (r["lon"], r["lat"]) for r in W.along(long_path, 5_000.0).collect()}
    assert got[1] == pytest.approx((math.degrees(5_000_000 / EARTH_RADIUS), 0.0), abs=1e-8)
    assert got[2] == (0.0, 1.0) and got[3] == (7.0, 7.0) and got[4] == (1.0, 1.0)
    half = {r["fid"]: (r["lon"], r["lat"]) for r in W.point_on_path(long_path).collect()}
    assert half[1] == pytest.approx((1_999_999 * 5e-5 / 2, 0.0), abs=1e-8) and half[2] == pytest.approx((0.0, 0.5), abs=1e-9)
    assert half[3] == (7.0, 7.0) and half[4] == (1.0, 1.0)


def test_rows_give_what_columns_give(spark):
    """Short paths of any kind, with repeated and equal vertices, in ranges that end anywhere."""
    rng = np.random.default_rng(5)
    rows = [(f, k, *map(float, rng.integers(-40, 40, 2) / 4)) for f in range(60) for k in range(int(rng.integers(2, 30)))]
    rows += [(f, k, x, y) for f, k, x, y in rows if k == 3]
    df = spark.createDataFrame(rows, VERTEX).repartition(5)
    as_lines = df.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("ix", "lon", "lat"))).alias("v")).select("fid", S.of_line(F.col("v")).alias("g"))
    want = {r["fid"]: r for r in as_lines.select("fid", M.length(F.col("g")).alias("length"), M.along(F.col("g"), F.lit(900.0)).alias("a"), M.along(F.col("g"), F.lit(0.0)).alias("z"), M.point_on_feature(F.col("g")).alias("h")).collect()}
    shuffled = df.select(F.lit("clash").alias("chunk"), F.lit("clash").alias("m"), F.col("fid").alias("id"), F.col("ix").alias("n"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    names = {"fid": "id", "order": "n", "lon": "x", "lat": "y"}
    assert {r["fid"]: r["length"] for r in W.length(shuffled, **names).collect()} == pytest.approx({k: r["length"] for k, r in want.items()}, rel=1e-12)
    for made, name in ((W.along(shuffled, 900.0, **names), "a"), (W.along(shuffled, 0.0, **names), "z"), (W.point_on_path(shuffled, **names), "h")):
        got = {r["fid"]: (r["lon"], r["lat"]) for r in made.collect()}
        assert got.keys() == want.keys()
        for k, p in got.items():
            assert p == pytest.approx((want[k][name]["lon"], want[k][name]["lat"]), abs=1e-8), (name, k)


def test_paths_with_nulls_or_without_rows(spark):
    df = spark.createDataFrame([(None, 0, 0.0, 0.0), (None, 1, 1.0, 0.0), (1, 0, None, 0.0), (2, None, 5.0, 5.0), (2, 1, 5.0, None)], VERTEX)
    assert {r["fid"]: round(r["length"], 3) for r in W.length(df).collect()} == {None: 111.195, 2: 0.0}
    assert {r["fid"]: (round(r["lon"], 6), round(r["lat"], 6)) for r in W.point_on_path(df).collect()} == {None: (0.5, 0.0), 2: (5.0, 5.0)}
    none = df.where("false")
    assert W.length(none).count() == W.along(none, 1.0).count() == W.point_on_path(none).count() == 0
    with pytest.raises(ValueError, match="distance"):
        W.along(df, -1.0)


def square(x, y, side, hole=False):
    ring = [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]
    inner = [[x + side / 4, y + side / 4], [x + side / 2, y + side / 4], [x + side / 2, y + side / 2], [x + side / 4, y + side / 4]]
    return [ring, inner] if hole else [ring]


SHAPES = [
    ("a", ("Polygon", [square(0.0, 0.0, 2.0)])), ("a", ("MultiPolygon", [square(10.0, 4.0, 1.0, True), square(20.0, -5.0, 3.0)])), ("a", ("Point", [[[[50.0, 50.0]]]])), ("a", None),
    ("b", ("Point", [[[[1.0, 2.0]]]])), ("b", ("Point", [[[[1.0, 2.0]]]])), ("b", ("LineString", [[[[4.0, 5.0], [7.0, 9.0]]]])),
    ("c", None), ("d", ("MultiPoint", [[[]]])), (None, ("Point", [[[[3.0, 3.0]]]])),
]


@pytest.fixture(scope="module")
def shapes(spark):
    df = spark.createDataFrame([(k, g) for k, g in SHAPES], f"key string, geom {GEOMETRY}")
    return df.repartition(3).withColumn("point", F.lit("clash")).withColumn("bbox", F.lit("clash"))


def at(df, name="point"):
    return {r["key"]: (None if r[name] is None else tuple(r[name])) for r in df.collect()}


def test_boxes_and_means_of_groups(shapes):
    vertices = {}
    for k, g in SHAPES:
        vertices.setdefault(k, []).extend(v for part in (g[1] if g else []) for ring in part for v in ring)
    box = {k: (min(x for x, _ in v), min(y for _, y in v), max(x for x, _ in v), max(y for _, y in v)) if v else None for k, v in vertices.items()}
    assert at(G.bbox(shapes, ["key"]), "bbox") == box
    assert at(G.center(shapes, ["key"])) == {k: b and ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for k, b in box.items()}
    got = at(G.centroid(shapes, ["key"]))
    for k, v in vertices.items():
        assert got[k] == (pytest.approx(tuple(np.mean(v, axis=0))) if v else None)
    rings = {r["key"]: r["geom"] for r in G.envelope(shapes, ["key"]).collect()}
    assert rings["c"] is None and rings["b"]["coords"] == [[[[1.0, 2.0], [7.0, 2.0], [7.0, 9.0], [1.0, 9.0], [1.0, 2.0]]]]


def test_areas_and_centers_of_mass_of_groups(shapes):
    """A group's polygons count as in the formula over all of them; points beside polygons do not."""
    total, sx, sy, lats = 0.0, 0.0, 0.0, []
    for _, g in SHAPES[:2]:
        for part in g[1]:
            lat0 = [y for _, y in part[0]]
            c, a_part, x_part, y_part = math.cos(math.radians(sum(lat0) / len(lat0))), 0.0, 0.0, 0.0
            for k, ring in enumerate(part):
                p = [(EARTH_RADIUS * math.radians(x) * c, EARTH_RADIUS * math.radians(y)) for x, y in ring]
                cross = [a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:])]
                a_ring, sign = abs(sum(cross)) / 2, -1 if k else 1
                a_part += sign * a_ring
                x_part += sign * a_ring * sum((a[0] + b[0]) * w for a, b, w in zip(p, p[1:], cross)) / (3 * sum(cross))
                y_part += sign * a_ring * sum((a[1] + b[1]) * w for a, b, w in zip(p, p[1:], cross)) / (3 * sum(cross))
            total, sx, sy, lats = total + a_part, sx + x_part, sy + y_part, lats + lat0
    areas = {r["key"]: r["area"] for r in G.area(shapes, ["key"]).collect()}
    assert areas["a"] == pytest.approx(total, rel=1e-9) and {areas[k] for k in ("b", "c", "d", None)} == {None}
    c0 = math.cos(math.radians(sum(lats) / len(lats)))
    got = at(G.center_of_mass(shapes, ["key"]))
    assert got["a"] == pytest.approx((math.degrees(sx / total / (EARTH_RADIUS * c0)), math.degrees(sy / total / EARTH_RADIUS)), rel=1e-9)
    assert got["b"] == pytest.approx((13 / 4, 18 / 4)) and got["c"] is None and got["d"] is None and got[None] == (3.0, 3.0)


def test_one_row_groups_are_the_column_forms(shapes):
    some = shapes.where("geom.type IN ('Polygon', 'MultiPolygon')").withColumn("key", F.monotonically_increasing_id())
    want = {r["key"]: r for r in some.select("key", M.area(F.col("geom")).alias("area"), M.center_of_mass(F.col("geom")).alias("point")).collect()}
    assert {r["key"]: r["area"] for r in G.area(some, ["key"]).collect()} == pytest.approx({k: r["area"] for k, r in want.items()})
    for k, p in at(G.center_of_mass(some, ["key"])).items():
        assert p == pytest.approx(tuple(want[k]["point"]))


def test_no_key_and_no_rows(shapes):
    assert G.bbox(shapes).collect()[0]["bbox"] == [0.0, -5.0, 50.0, 50.0]
    none = shapes.where("false")
    for made, name in ((G.bbox, "bbox"), (G.center, "point"), (G.centroid, "point"), (G.envelope, "geom"), (G.area, "area"), (G.center_of_mass, "point")):
        assert made(none, ["key"]).count() == 0
        assert [r[name] for r in made(none).collect()] == [None]


@pytest.mark.parametrize("name", list(FORMS))
def test_form_agrees_with_sql(spark, duck, name):  # noqa: F811
    got, want = FORMS[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert len(got)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=1e-9, atol=2e-6)
