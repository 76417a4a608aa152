"""Joins on place, clusters and nearest neighbours: crowded cells, all sizes of geometries, and the levels of trees, against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.functions import shapes as S
from geoquilt.operators import density, joins, nearest
from geoquilt.operators import predicates as P
from geoquilt.sources.scratch import saved

POINT = "pid long, lon double, lat double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def star(draw, x, y, size, corners=7):
    turns = sorted(draw.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [(x + size * draw.uniform(0.3, 1) * math.cos(t), y + size * draw.uniform(0.3, 1) * math.sin(t)) for t in turns]
    return [*ring, ring[0]]


def shapes(spark, rows, polygon):
    df = spark.createDataFrame([(k, [{"lon": float(a), "lat": float(b)} for a, b in v] if v else None) for k, v in rows], "fid long, v array<struct<lon:double,lat:double>>")
    return df.select("fid", F.when(F.col("v").isNotNull(), (S.of_ring if polygon else S.of_line)(F.col("v"))).alias("geom"))


@pytest.fixture(scope="module")
def some(spark):
    """Polygons and lines from a hundredth of a degree to a hundred degrees, crowded around one place, and a null each."""
    draw = random.Random(4)
    place = lambda k: (draw.gauss(10, 0.05), draw.gauss(20, 0.05)) if k % 2 else (draw.uniform(-100, 100), draw.uniform(-60, 60))
    polygons = [(k, star(draw, *place(k), 10 ** draw.uniform(-2, 1.7))) for k in range(80)] + [(80, None)]
    lines = []
    for k in range(80):
        x, y = place(k)
        size = 10 ** draw.uniform(-2, 1.7)
        lines.append((k, [(x + draw.uniform(-size, size), y + draw.uniform(-size, size)) for _ in range(draw.choice([2, 3, 9]))]))
    return shapes(spark, polygons, True).cache(), shapes(spark, [*lines, (80, None)], False).cache()


@pytest.mark.parametrize("crowd", [50_000, 5])
@pytest.mark.parametrize("name", ["intersects", "boolean_overlap", "boolean_contains", "boolean_crosses"])
def test_spatial_joins_agree_with_all_pairs(spark, some, monkeypatch, name, crowd):
    monkeypatch.setattr(joins, "CROWD", crowd)
    polygons, lines = some
    test = getattr(P, name)
    a, b = (polygons, lines) if name == "boolean_contains" else (lines, polygons)
    every = a.select(F.col("fid").alias("a"), F.col("geom").alias("g")).crossJoin(b.select(F.col("fid").alias("b"), F.col("geom").alias("h"))).where("g IS NOT NULL AND h IS NOT NULL")
    want = {(r["a"], r["b"]) for r in every.where(test(F.col("g"), F.col("h"))).select("a", "b").collect()}
    got = joins.spatial_join(a, b, test)
    rows = [(r["a"], r["b"]) for r in got.collect()]
    assert len(want) > 10 and len(rows) == len(set(rows)) and set(rows) == want
    semi, anti = ({r["a"] for r in joins.spatial_join(a, b, test, how).collect()} for how in ("left_semi", "left_anti"))
    assert semi == {x for x, _ in want} and anti == set(range(81)) - semi
    assert not any(x in plan_of(got) for x in ("CartesianProduct", "NestedLoop"))


def test_equal_geometries_and_empty_sides(spark, some):
    polygons, lines = some
    twice = polygons.unionByName(polygons.where("fid < 5").withColumn("fid", F.col("fid") + 1000))
    got = {(r["a"], r["b"]) for r in joins.spatial_join(twice, twice, P.boolean_equal).collect()}
    assert got == {(k, k) for k in (*range(80), *range(1000, 1005))} | {(k, 1000 + k) for k in range(5)} | {(1000 + k, k) for k in range(5)}
    assert joins.spatial_join(polygons.where("false"), lines, P.intersects).count() == 0
    assert joins.spatial_join(polygons, lines.where("false"), P.intersects, "left_anti").count() == 81


def test_long_lines_cross_segment_by_segment(spark):
    """A line of 4,000 segments is rows of their own; only lines of one key meet."""
    zigzag = lambda y, n: [(k * 0.01, y + (k % 2) * 0.005) for k in range(n)]
    a = shapes(spark, [(1, zigzag(0, 4001)), (2, zigzag(0, 50)), (3, zigzag(5, 9))], False)
    b = shapes(spark, [(1, [(39.953, -1), (39.953, 1)]), (2, [(39.953, -1), (39.953, 1)]), (3, None)], False)
    assert [r["fid"] for r in joins.lines_that_cross(a, b).collect()] == [1]
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 39.995, 0.0025), (1, 2, 39.995, 0.003), (2, 3, 0.005, 0.0025), (3, 4, 0.0, 0.0)], "fid long, ix long, lon double, lat double")
    assert {(r["fid"], r["ix"]) for r in joins.points_on_lines(points, a).collect()} == {(1, 0), (1, 1), (2, 3)}


@pytest.fixture
def no_coalescing(spark):
    """Small partitions stay apart, so that rows of a task can be counted."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("spot", [False, True])
def test_points_of_one_cell_are_spread(spark, monkeypatch, no_coalescing, spot):
    """All points in one cell, or all but some in one place: same pairs as by the plain test, with no task having most of them."""
    monkeypatch.setattr(joins, "CROWD", 100)
    rng = np.random.default_rng(5)
    n = 4_000
    xy = rng.uniform(0.05, 0.95, (n, 2)) if not spot else np.where(rng.random((n, 1)) < 0.9, 0.5, rng.uniform(0.05, 0.95, (n, 2)))
    xy[:4] = [(0.1, 0.1), (0.9, 0.1), (0.5, 0.5), (0.3, 0.3)]
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], POINT)
    hole = [[(0.3, 0.3), (0.7, 0.3), (0.7, 0.4), (0.3, 0.4), (0.3, 0.3)]]
    rings = {1: [[(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9), (0.1, 0.1)], *hole], 2: [[(0.5, 0.5), (0.6, 0.5), (0.6, 0.6), (0.5, 0.5)]], 3: [[(5, 5), (6, 5), (6, 6), (5, 5)]]}
    polygons = spark.createDataFrame([(k, {"type": "Polygon", "coords": [[[[float(a), float(b)] for a, b in r] for r in v]]}) for k, v in rings.items()], f"fid long, geom {S.GEOMETRY}")
    for inside in (None, lambda p, g: P.boolean_point_in_polygon(S.of_point(p["lon"], p["lat"]), g)):
        plain = inside or S.in_polygon
        every = rows.crossJoin(polygons).where(plain(F.struct("lon", "lat"), F.col("geom")))
        want = {(r["fid"], r["pid"]) for r in every.select("fid", "pid").collect()}
        got = joins.points_in_polygons(polygons, rows, inside=inside)
        pairs = [(r["fid"], r["pid"]) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > n / 3
        most = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        assert most < len(want) / 4


def clusters(p, meters, least):
    lon, lat = np.radians(p).T
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) * 6371008.8 <= meters
    core, labels, n = near.sum(axis=1) >= least, np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and labels[i] < 0:
            todo, labels[i] = [i], n
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j]).tolist() if core[j] else []:
                    if labels[k] < 0:
                        labels[k] = n
                        todo.append(k)
            n += 1
    return labels.tolist()


def as_rows(spark, p):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "fid long, lon double, lat double").repartition(3)


@pytest.mark.parametrize(("least", "direct"), [(2, 1024), (4, 1024), (4, 1), (25, 2)])
def test_clusters_agree_with_all_pairs(spark, monkeypatch, least, direct):
    """Dense and sparse cells, halved and not, across the antimeridian and at a pole."""
    monkeypatch.setattr(density, "DIRECT", direct)
    rng = np.random.default_rng(9)
    p = [rng.normal((179.98, 0), 0.06, (150, 2)), rng.normal((30, 10), 0.02, (150, 2)), rng.normal((30.25, 10), 0.02, (100, 2)), rng.uniform((29, 9), (31, 11), (150, 2)), np.column_stack([rng.uniform(-180, 180, 40), np.full(40, 90.0)])]
    p = np.round(np.concatenate(p), 4)
    p[:, 0] = (p[:, 0] + 540) % 360 - 180
    p = p[rng.permutation(len(p))]
    got = density.clusters_dbscan(as_rows(spark, p), 10.0, min_points=least).orderBy("fid").collect()
    assert [r["cluster"] for r in got] == clusters(p, 10_000, least)


def test_many_points_within_one_distance(spark, monkeypatch):
    """100,000 points near one another, a border beyond and noise: no pairs of them are made."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal((5, 5), 1e-4, (100_000, 2)), [[5.08, 5.0], [5.12, 5.0], [9.0, 9.0]]])
    got = density.clusters_dbscan(as_rows(spark, p), 10.0, min_points=4)
    assert {(r["cluster"], r["count"]) for r in got.groupBy("cluster").count().collect()} == {(0, 100_002), (-1, 1)}


@pytest.mark.parametrize(("fanout", "top", "crowd"), [(64, 1024, 50_000), (3, 4, 50_000), (4, 4, 40)])
def test_nearest_by_levels(spark, monkeypatch, fanout, top, crowd):
    """Some levels of boxes; targets in a crowd, far from all points, on points, at poles and the antimeridian; repeated and missing places."""
    for name, value in (("FANOUT", fanout), ("TOP", top)):
        monkeypatch.setattr(nearest, name, value)
    monkeypatch.setattr(joins, "CROWD", crowd)
    rng = np.random.default_rng(7)
    sites = np.concatenate([rng.normal((20, 20), 0.3, (200, 2)), rng.uniform((-180, -80), (180, 80), (60, 2)), [[179.9, 0.0], [-179.9, 0.0], [0.0, 90.0], [20.0, 20.0], [20.0, 20.0]]])
    asked = np.concatenate([rng.normal((20, 20), 0.3, (300, 2)), rng.uniform((-180, -90), (180, 90), (100, 2)), sites[:20], [[180.0, 0.1], [55.0, -90.0], [20.0, 20.0], [-160.0, -20.0]]])
    targets = [(k, float(x), float(y)) for k, (x, y) in enumerate(asked)] + [(9_000, None, 1.0), (9_001, float("nan"), 1.0)]
    points = as_rows(spark, sites).unionByName(spark.createDataFrame([(7_000, None, 3.0), (7_001, 20.0, float("nan"))], "fid long, lon double, lat double"))
    got = nearest.nearest_point(spark.createDataFrame(targets, "tid long, lon double, lat double"), points).toPandas().sort_values("tid")
    (lo1, la1), (lo2, la2) = (np.radians(x).T for x in (asked, sites))
    h = np.sin((la2 - la1[:, None]) / 2) ** 2 + np.cos(la1[:, None]) * np.cos(la2) * np.sin((lo2 - lo1[:, None]) / 2) ** 2
    meters = 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) * 6371008.8
    assert got["tid"].tolist() == list(range(len(asked)))
    np.testing.assert_allclose(got["meters"], meters.min(axis=1), rtol=1e-9, atol=1e-6)
    assert (meters[np.arange(len(asked)), got["fid"]] <= meters.min(axis=1) + 1e-6).all()
    assert got["fid"].iloc[len(asked) - 2] == len(sites) - 2
    with pytest.raises(ValueError, match="non-empty"):
        nearest.nearest_point(spark.createDataFrame(targets, "tid long, lon double, lat double"), points.where("false"))


def test_nearest_opens_boxes_for_runs_of_targets(spark, monkeypatch):
    """What is looked at grows with runs of targets, not with targets times the points around each; equal places go to the first id."""
    written = []
    monkeypatch.setattr(nearest, "saved", lambda df, tag: written.append((tag, out := saved(df, tag))) or out)
    rng = np.random.default_rng(5)
    sites = rng.uniform((-180, -80), (180, 80), (3_000, 2)).repeat(2, axis=0)
    got = nearest.nearest_point(as_rows(spark, rng.uniform((-180, -80), (180, 80), (20_000, 2))).withColumnRenamed("fid", "tid"), as_rows(spark, sites)).toPandas()
    assert len(got) == 20_000 and (got["fid"] % 2 == 0).all()
    assert sum(df.count() for tag, df in written if tag == "asked") < 20_000


@pytest.mark.parametrize("short", [512, 3])
def test_short_lines_meet_by_their_key_alone(spark, monkeypatch, short):
    """Lines of a few segments need no boxes; long ones go by boxes; both give the same."""
    monkeypatch.setattr(joins, "SHORT", short)
    boxes = []
    box_join = joins.box_join
    monkeypatch.setattr(joins, "box_join", lambda *a, **k: boxes.append(1) or box_join(*a, **k))
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 2.0)]), (2, [(0.0, float(k % 2)) if k % 3 else (float(k), 1.0) for k in range(9)])], "fid long, v array<struct<lon:double,lat:double>>").select("fid", S.of_line(F.col("v")).alias("geom"))
    points = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 1.0, 1.5), (2, 0, 0.0, 0.5), (2, 1, 3.0, 1.0), (2, 2, 9.0, 9.0), (3, 0, 1.0, 1.0)], "fid long, ix long, lon double, lat double")
    assert {(r["fid"], r["ix"]) for r in joins.points_on_lines(points, lines).collect()} == {(1, 0), (2, 0), (2, 1)}
    other = spark.createDataFrame([(1, [(0.0, 2.0), (2.0, 0.0)]), (2, [(2.0, 0.0), (2.0, 3.0)])], "fid long, v array<struct<lon:double,lat:double>>").select("fid", S.of_line(F.col("v")).alias("geom"))
    assert sorted(r["fid"] for r in joins.lines_that_cross(lines, other).collect()) == [1, 2]
    assert bool(boxes) == (short == 3)
