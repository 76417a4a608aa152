"""Golden values of the geospatial operators, their edge cases, and the queries against SQL."""

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoquilt.functions import shapes as S
from geoquilt.functions.constants import meters_in
from geoquilt.operators import aggregation as A
from geoquilt.operators import measurement as M
from geoquilt.operators import planar
from geoquilt.operators import predicates as P
from geoquilt.operators import transformation as T
from geoquilt.plans.queries import ORACLE_SQL, QUERIES
from geoquilt.sources import geojson

# The places that the golden results below belong to.
BT, ND, DD, HCR, VTS = (106.698, 10.773), (106.699, 10.780), (106.695, 10.777), (106.696, 10.791), (106.690, 10.797)
LM, TSN, PA, PB, PC, CL = (106.722, 10.795), (106.652, 10.819), (106.720, 10.730), (106.723, 10.728), (106.718, 10.732), (106.662, 10.751)
Q1 = [(106.685, 10.760), (106.715, 10.760), (106.715, 10.790), (106.685, 10.790), (106.685, 10.760)]
Q3 = [(106.685, 10.790), (106.715, 10.790), (106.715, 10.815), (106.685, 10.815), (106.685, 10.790)]
X = [(106.690, 10.770), (106.720, 10.770), (106.720, 10.800), (106.690, 10.800), (106.690, 10.770)]
L = [BT, (106.705, 10.778), (106.715, 10.785), LM]
NH = [(106.700, 10.763), (106.699, 10.773), (106.698, 10.780), (106.697, 10.791)]


def pt(p):
    return F.struct(F.lit(p[0]).alias("lon"), F.lit(p[1]).alias("lat"))


def pts(ps):
    return F.array(*map(pt, ps))


def line(ps):
    return S.of_line(pts(ps))


def ring(ps):
    return S.of_ring(pts(ps))


def point_geom(p):
    return S.of_point(F.lit(p[0]), F.lit(p[1]))


@pytest.fixture(scope="module")
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


def xy(row):
    return tuple(row)


def test_units():
    assert meters_in("miles") == 1609.344 and meters_in("degrees") == pytest.approx(111195.0802, rel=1e-9)
    with pytest.raises(ValueError, match="Unsupported units"):
        meters_in("Meters")


def test_measurement_goldens(value):
    near = lambda got, want, tol=1e-9: np.testing.assert_allclose(got, want, rtol=0, atol=tol)
    near(xy(value(M.along(line(L), F.lit(2.0)))), (106.71286261135037, 10.783503882266112))
    near(xy(value(M.along(line(L), F.lit(99.0)))), LM)
    near(value(M.area(ring(Q1))), 10931823.078125, 1e-2)
    near(value(M.bbox(line([BT, LM, ND, TSN]))), [106.652, 10.773, 106.722, 10.819])
    near(value(M.bearing(pt(BT), pt(LM))), 46.9784120514402)
    near(xy(value(M.center(line([BT, LM, ND, TSN])))), (106.687, 10.796))
    near(xy(value(M.center_of_mass(ring(Q1)))), (106.69999999407, 10.774999999402), 1e-8)
    near(xy(value(M.point_on_feature(ring(Q1)))), (106.69999999407, 10.774999999402), 1e-8)
    near(xy(value(M.centroid(ring(Q1)))), (106.697, 10.772))
    near(xy(value(M.destination(pt(BT), F.lit(5.0), F.lit(45.0)))), (106.73036963771222, 10.804794095920409))
    near(value(M.distance(pt(BT), pt(TSN))), 7.169934105724148)
    near(value(M.distance(pt(LM), pt(ND), "meters")), 3015.5571486, 1e-6)
    near(value(M.length(line(L))), 3.636141833643691)
    near(xy(value(M.midpoint(pt(BT), pt(LM)))), (106.7099995611868, 10.784000230973168))
    near(xy(value(M.point_on_feature(line(L)))), (106.7115062093236, 10.782554420000038))
    near(value(M.point_to_line_distance(pt(ND), line(L))), 0.5653001584437035)
    near(value(M.rhumb_bearing(pt(BT), pt(LM))), 46.98065655376032)
    near(xy(value(M.rhumb_destination(pt(BT), F.lit(3.0), F.lit(60.0)))), (106.72178474765758, 10.786489805455867))
    near(value(M.rhumb_distance(pt(BT), pt(TSN))), 7.169934112479614)
    near(value(M.square(F.array(*map(F.lit, (106.652, 10.760, 106.722, 10.819))))), [106.652, 10.7545, 106.722, 10.8245])
    arc = value(S.vertices(M.great_circle(pt(BT), pt(LM), 20)))
    assert len(arc) == 20 and xy(arc[0]) == BT and xy(arc[-1]) == LM
    near(xy(arc[10]), (106.71063114134142, 10.784579177706293))
    seen = value(M.polygon_tangents(pt(TSN), ring(Q1)))
    assert xy(seen["left"]) == (106.685, 10.760) and xy(seen["right"]) == (106.715, 10.790)


def test_boolean_goldens(value):
    x = lambda *ps: ring([*ps, ps[0]])
    shifted = x((106.700, 10.775), (106.730, 10.775), (106.730, 10.805), (106.700, 10.805))
    assert value(P.boolean_clockwise(pts(Q1))) is False
    assert value(P.boolean_clockwise(pts(Q1[::-1]))) is True
    assert value(P.boolean_contains(ring(Q1), point_geom(BT))) and value(P.boolean_within(point_geom(BT), ring(Q1)))
    # no vertex of the line lies inside, although it passes through
    assert value(P.boolean_crosses(line([(106.680, 10.770), (106.720, 10.780)]), ring(Q1))) is False
    assert value(P.boolean_crosses(line([(106.680, 10.770), BT]), ring(Q1))) is True
    assert value(P.boolean_crosses(line([(0, 0), (2, 2)]), line([(0, 2), (2, 0)]))) is True
    assert value(P.boolean_disjoint(point_geom(TSN), ring(Q1))) is True
    assert value(P.boolean_equal(point_geom(BT), point_geom(BT))) is True
    assert value(P.boolean_equal(line([BT, ND]), line([BT, ND, DD]))) is False
    assert value(P.boolean_overlap(ring(Q1), shifted)) is True
    assert value(P.boolean_overlap(ring(Q1), ring(Q1))) is False
    assert value(P.boolean_parallel(line([(0, 0), (1, 0)]), line([(5, 1), (3, 1)]))) is True
    assert value(P.boolean_point_in_polygon(point_geom(ND), ring(Q1))) is True
    corner = point_geom(Q1[0])
    assert value(P.boolean_point_in_polygon(corner, ring(Q1))) is True
    assert value(P.boolean_point_in_polygon(corner, ring(Q1), ignore_boundary=True)) is False
    assert value(P.boolean_point_on_line(point_geom(L[1]), line(L))) is True
    assert value(P.boolean_point_on_line(point_geom(L[0]), line(L), ignore_end_vertices=True)) is False


def test_points_without_segments(value):
    """A MultiPoint inside a polygon counts as disjoint: it has no segments to test."""
    many = S.geometry("MultiPoint", F.array(F.array(F.array(F.array(F.lit(BT[0]), F.lit(BT[1])), F.array(F.lit(ND[0]), F.lit(ND[1]))))))
    assert value(P.boolean_disjoint(many, ring(Q1))) is True


def test_transformation_goldens(value):
    ring_of = lambda g: [xy(v) for v in value(S.vertices(g))]
    near = lambda got, want, tol=1e-9: np.testing.assert_allclose(got, want, rtol=0, atol=tol)
    box = lambda *b: F.array(*map(F.lit, b))
    near(ring_of(T.bbox_clip(line(NH), box(106.695, 10.768, 106.705, 10.785))), [(106.6995, 10.768), (106.699, 10.773), (106.698, 10.780), (106.697545455, 10.785)])
    clip = ring_of(T.bbox_clip(ring(Q1), box(106.690, 10.765, 106.710, 10.785)))
    assert {(round(a, 9), round(b, 9)) for a, b in clip} == {(106.69, 10.765), (106.71, 10.765), (106.71, 10.785), (106.69, 10.785)}
    assert value(T.bbox_clip(ring(Q1), box(0.0, 0.0, 1.0, 1.0))) is None
    assert len(ring_of(T.bezier_spline(line(L)))) == 32 and len(ring_of(T.bezier_spline(line(L[:3])))) == 24
    assert len(ring_of(T.bezier_spline(line(L), resolution=5))) == 5
    buffered = ring_of(T.buffer(point_geom(BT), F.lit(500.0), "meters"))
    assert len(buffered) == 65
    near(buffered[0], (106.698, 10.777496601818621))
    near(ring_of(T.buffer(line(NH[:3]), F.lit(1.0)))[0], (106.699, 10.790046661360876))
    near(ring_of(T.circle(pt(ND), F.lit(1.0)))[0], (106.699, 10.788993203637244))
    near(ring_of(T.union(ring(Q1), ring(X))), [(106.685, 10.760), (106.715, 10.760), (106.720, 10.770), (106.720, 10.800), (106.690, 10.800), (106.685, 10.790), (106.685, 10.760)])
    shared = ring_of(T.intersect(ring(Q1), ring(X)))
    assert {(round(a, 9), round(b, 9)) for a, b in shared} == {(106.69, 10.77), (106.715, 10.77), (106.715, 10.79), (106.69, 10.79)}
    assert value(T.intersect(ring(Q1), ring([(0, 0), (1, 0), (1, 1), (0, 0)]))) is None
    strip = ring([(106.705, 10.760), (106.720, 10.760), (106.720, 10.790), (106.705, 10.790), (106.705, 10.760)])
    with_hole = value(T.difference(ring(Q1), strip))
    assert len(with_hole["coords"][0]) == 2
    assert {(round(v[0], 9), round(v[1], 9)) for v in with_hole["coords"][0][1]} == {(106.705, 10.76), (106.715, 10.76), (106.715, 10.79), (106.705, 10.79)}
    near(ring_of(T.line_offset(line(NH), F.lit(50.0), "meters")), [(106.69954446, 10.76295604), (106.69854549, 10.77294676), (106.69754525, 10.77994874), (106.69654408, 10.79096000)], 1e-8)
    near(ring_of(T.line_offset(line(NH[:3]), F.lit(-100.0), "meters")), [(106.70091107, 10.76308792), (106.69990901, 10.77310648), (106.69890657, 10.78012499)], 1e-8)
    assert value(F.size(T.tesselate(ring(Q1)))) == 2
    near(ring_of(T.transform_rotate(ring(Q1), F.lit(45.0))), [(106.679877, 10.77185), (106.70109, 10.751011), (106.722684, 10.772224), (106.701471, 10.793064), (106.679877, 10.77185)], 1e-6)
    near(ring_of(T.transform_rotate(ring(Q1), F.lit(90.0), pt(BT)))[0], (106.684767, 10.785771), 1e-6)
    near(ring_of(T.transform_translate(point_geom(BT), F.lit(1.0), F.lit(0.0)))[0], (106.698, 10.781993203637244))
    near(ring_of(T.transform_translate(ring(Q1), F.lit(500.0), F.lit(135.0), "meters"))[0], (106.68823645, 10.75682041), 1e-8)
    near(ring_of(T.transform_scale(ring(Q1), F.lit(2.0)))[0], (106.673, 10.748), 1e-9)
    near(ring_of(T.transform_scale(ring(Q1), F.lit(0.5)))[2], (106.706, 10.781), 1e-9)


def test_third_ordinates_are_kept(value):
    g = S.geometry("Point", F.array(F.array(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))))
    assert value(T.transform_translate(g, F.lit(1.0), F.lit(0.0), z_translation=4.0))["coords"][0][0][0][2] == 7.0
    assert value(T.transform_scale(g, F.lit(2.0)))["coords"][0][0][0][2] == 3.0


def test_simplify(value):
    zigzag = [(0, 0), (1, 0.4), (2, 0), (3, 3), (4, 0)]
    assert [xy(v) for v in value(S.vertices(T.simplify(line(zigzag), 0.5)))] == [(0, 0), (2, 0), (3, 3), (4, 0)]
    # a ring that collapses stays whole and gets one more closing vertex
    assert [xy(v) for v in value(S.vertices(T.simplify(ring(Q1))))] == [*Q1, Q1[0]]


def test_errors(value):
    for column, text in (
        (M.bearing(pt(BT), pt(BT)), "different"),
        (M.along(line(L), F.lit(-1.0)), "distance must be >= 0"),
        (T.buffer(point_geom(BT), F.lit(-500.0)), "radius"),
        (P.boolean_point_in_polygon(line(L), ring(Q1)), "Point"),
        (P.boolean_parallel(ring(Q1), line(L)), "LineString"),
        (M.length(ring(Q1)), "LineString"),
        (S.valid(point_geom((200.0, 0.0))), "WGS84"),
    ):
        with pytest.raises(Exception, match=text):
            value(column)


def test_hulls(spark):
    rows = spark.createDataFrame([(g, *p) for g, some in ((1, [BT, ND, LM, TSN, PA, CL]), (2, [BT, ND, DD, HCR, LM])) for p in some], "g int, lon double, lat double").repartition(3)
    got = {r["g"]: [xy(v) for v in r["v"]] for r in T.convex(rows, ["g"]).select("g", S.vertices(F.col("geom")).alias("v")).collect()}
    assert got[1] == [(106.652, 10.819), (106.662, 10.751), (106.720, 10.730), (106.722, 10.795), (106.652, 10.819)]
    assert got[2] == [(106.695, 10.777), (106.698, 10.773), (106.722, 10.795), (106.696, 10.791), (106.695, 10.777)]
    with pytest.raises(Exception, match="non-collinear"):
        T.convex(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], "lon double, lat double")).collect()


def test_hull_tells_close_points_apart(spark):
    """Points 5e-11 degrees apart are distinct; only those within 1e-12 are one."""
    near = [(0.0, 0.0), (5e-11, 0.0), (0.0, 5e-11), (2e-13, 2e-13)]
    ring = T.convex(spark.createDataFrame(near, "lon double, lat double")).select(S.vertices(F.col("geom")).alias("v")).first()["v"]
    assert [(v["lon"], v["lat"]) for v in ring] == [(0.0, 0.0), (5e-11, 0.0), (0.0, 5e-11), (0.0, 0.0)]


def test_hull_in_parts():
    rng = np.random.default_rng(0)
    for _ in range(100):
        p = [tuple(map(float, x)) for x in rng.integers(0, 12, (30, 2))]
        half = planar.hull(p[:15]) + planar.hull(p[15:])
        whole = planar.hull(p)
        assert whole == planar.hull((half or p) + p[:0]) or not planar.hull(p[:15]) or not planar.hull(p[15:])
        for a, b in zip(whole, whole[1:]):
            assert all(planar._turn(a, b, q) >= 0 for q in p)


def test_dissolve(spark):
    rows = [(0, '"a"', Q1), (1, '"a"', Q3), (2, None, X), (3, None, X)]
    df = spark.createDataFrame([(i, k, [{"lon": a, "lat": b} for a, b in r]) for i, k, r in rows], "fid long, key string, v array<struct<lon:double,lat:double>>").select("fid", "key", S.of_ring(F.col("v")).alias("geom"))
    got = T.dissolve(df, "key").select("key", S.vertices(F.col("geom")).alias("v")).collect()
    assert len(got) == 3
    merged = next(r for r in got if r["key"])
    np.testing.assert_allclose([xy(v) for v in merged["v"]], [(106.685, 10.760), (106.715, 10.760), (106.715, 10.815), (106.685, 10.815), (106.685, 10.760)])


def points(spark, ps):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(ps)], "fid long, lon double, lat double")


@pytest.mark.parametrize(("ps", "distance", "least", "want"), [([BT, ND, DD, PA, PB, PC, TSN], 2.0, 2, [0, 0, 0, 1, 1, 1, -1]), ([BT, ND, DD, PA, PB, PC, TSN], 0.5, 2, [-1, -1, -1, 0, 0, 0, -1]), ([BT, ND, DD, PA, PB, TSN], 2.0, 3, [0, 0, 0, -1, -1, -1])])
def test_dbscan_goldens(spark, ps, distance, least, want):
    got = A.clusters_dbscan(points(spark, ps), distance, min_points=least).orderBy("fid").collect()
    assert [r["cluster"] for r in got] == want


@pytest.mark.parametrize(("ps", "k", "want"), [([BT, ND, DD, HCR, VTS, LM, TSN, PA, PC], 3, [1, 1, 1, 1, 1, 1, 2, 0, 0]), ([BT, ND, DD, TSN, PA, PC], 2, [0, 0, 0, 1, 0, 0]), ([BT, ND, DD], 1, [0, 0, 0]), ([BT, LM], 5, [0, 1])])
def test_kmeans_goldens(spark, ps, k, want):
    assert [r["cluster"] for r in A.clusters_kmeans(points(spark, ps), k).orderBy("fid").collect()] == want


def test_nearest_and_collect(spark):
    targets = spark.createDataFrame([(1, *BT)], "tid long, lon double, lat double")
    got = A.nearest_point(targets, points(spark, [LM, ND, TSN])).first()
    assert got["fid"] == 1 and got["meters"] == pytest.approx(785.9930180, abs=1e-6)
    polygons = spark.createDataFrame([(0, [{"lon": a, "lat": b} for a, b in Q1]), (1, [{"lon": a, "lat": b} for a, b in Q3]), (2, [{"lon": a + 50, "lat": b} for a, b in Q1])], "fid long, v array<struct<lon:double,lat:double>>").select("fid", S.of_ring(F.col("v")).alias("geom"))
    named = spark.createDataFrame([(k, *p, n) for k, (p, n) in enumerate([(BT, "BT"), (ND, "ND"), (DD, "DD"), (HCR, None), (VTS, "VTS")])], "pid long, lon double, lat double, name string")
    got = {r["fid"]: r["names"] for r in A.collect(polygons, named, "name", "names").collect()}
    assert got == {0: ["BT", "ND", "DD"], 1: [None, "VTS"], 2: []}


def test_nearest_by_grid_agrees_with_all_pairs(spark):
    rng = np.random.default_rng(2)
    near = lambda n: np.column_stack([rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))])
    sites, asked = near(400), np.concatenate([near(300), [[180.0, 0.1], [-180.0, 0.1], [10.0, 90.0], [0.0, -90.0]]])
    t = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(asked)], "tid long, lon double, lat double")
    got = A.nearest_point(t, points(spark, [tuple(map(float, p)) for p in sites])).toPandas().sort_values("tid")
    lo, la = np.radians(asked).T[:, :, None], np.radians(sites).T[:, None, :]
    h = np.sin((la[1] - lo[1]) / 2) ** 2 + np.cos(lo[1]) * np.cos(la[1]) * np.sin((la[0] - lo[0]) / 2) ** 2
    assert list(got["fid"]) == list(np.argmin(h, axis=1))


def test_dbscan_agrees_with_plain_python(spark):
    rng = np.random.default_rng(4)
    p = np.round(np.concatenate([rng.normal((179.9, 0), 0.1, (60, 2)), rng.normal((20, 88), 0.2, (60, 2)), rng.uniform(-60, 60, (40, 2))]), 2)
    p[:, 0] = (p[:, 0] + 540) % 360 - 180
    p[:, 1] = np.clip(p[:, 1], -90, 90)
    lon, lat = np.radians(p).T
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) * 6371008.8 <= 12_000
    core = near.sum(axis=1) >= 4
    labels, n = np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and labels[i] < 0:
            todo, labels[i] = [i], n
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j]) if core[j] else []:
                    if labels[k] < 0:
                        labels[k] = n
                        todo.append(int(k))
            n += 1
    got = A.clusters_dbscan(points(spark, [tuple(map(float, x)) for x in p]), 12.0, min_points=4).orderBy("fid").collect()
    assert [r["cluster"] for r in got] == labels.tolist()


def test_voronoi_cells_hold_what_is_nearest(spark):
    rng = np.random.default_rng(6)
    p = [tuple(map(float, x)) for x in np.round(rng.uniform(-20, 20, (60, 2)), 3)]
    p.append(p[0])
    got = T.voronoi(points(spark, p), (-20.0, -20.0, 20.0, 20.0)).select("fid", S.vertices(F.col("geom")).alias("v")).collect()
    cells = {r["fid"]: [xy(v) for v in r["v"]] for r in got}
    assert set(cells) == set(range(61)) and sorted(cells[0]) == sorted(cells[60])
    assert sum(abs(planar.area2(c)) / 2 for k, c in cells.items() if k < 60) == pytest.approx(1600, rel=1e-9)
    for k, c in cells.items():
        mid = np.mean(c[:-1], axis=0)
        assert math.dist(mid, p[k]) == pytest.approx(min(math.dist(mid, q) for q in p))


def test_geojson_round_trip(spark, tmp_path):
    shapes = [
        {"type": "Point", "coordinates": [1.5, 2.0, 3.0]},
        {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]},
        {"type": "LineString", "coordinates": [[1, 2], [3, 4]]},
        {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]},
        {"type": "MultiPolygon", "coordinates": [[[[0, 0], [4, 0], [4, 4], [0, 0]]], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]},
    ]
    features = [{"type": "Feature", "properties": {"k": k}, "geometry": g} for k, g in enumerate([*shapes, None])]
    features.append({"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": shapes[:2]}})
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = geojson.read_geojson(spark, str(tmp_path / "a.json")).select("fid", geojson.geometry_json(F.col("geom")).alias("g")).orderBy("fid").collect()
    texts = [None if r["g"] is None else json.loads(r["g"]) for r in got]
    assert texts[:7] == [*shapes, None] and sorted(t["type"] for t in texts[7:]) == ["MultiPoint", "Point"]
    lines = geojson.read_geojson(spark, str(tmp_path / "a.json")).where("fid < 6").select("fid", "geom")
    geojson.write_geojson_lines(lines, str(tmp_path / "out"), properties=["fid"])
    again = geojson.read_geojson_lines(spark, str(tmp_path / "out")).select(F.try_variant_get("properties", "$.fid", "long").alias("k"), geojson.geometry_json(F.col("geom")).alias("g")).orderBy("k").collect()
    assert [json.loads(r["g"]) for r in again] == shapes
    (tmp_path / "b.json").write_text(json.dumps({"type": "Curve", "coordinates": []}))
    with pytest.raises(Exception, match="Unsupported GeoJSON"):
        geojson.read_geojson(spark, str(tmp_path / "b.json")).collect()


def normal(df):
    df = df[sorted(df.columns)]
    for c in df:
        if not pd.api.types.is_numeric_dtype(df[c]):
            df = df.assign(**{c: df[c].astype(str)})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "nation", "events", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=1e-9, atol=1e-6 if name == "area" else 2e-6)
