"""Single documents by operator name."""

import json
import math

import pytest

from geoquilt.api import Engine
from geoquilt.functions.constants import EARTH_RADIUS
from geoquilt.plans.queries import QUERIES

def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def collection(*features):
    return {"type": "FeatureCollection", "features": list(features)}


def box(west, south, east, north):
    return [[[west, south], [east, south], [east, north], [west, north], [west, south]]]


POINTS = collection(feature("Point", [3.2, 50.6], name="mill"), feature("Point", [3.26, 50.64], name="quay"), feature("Point", [3.31, 50.59], name="tower"))
SQUARE = feature("Polygon", box(3.18, 50.58, 3.24, 50.63), k="a")
#: A square of four times the other's side, and a point that is no part of areas.
TWO = collection(feature("Polygon", box(0, 0, 1, 1), k="small"), feature("Polygon", box(10, 0, 14, 4), k="large"), feature("Point", [40, 40]))
MIXED = {"type": "GeometryCollection", "geometries": [f["geometry"] for f in TWO["features"]]}


def haversine(a, b):
    (x, y), (u, v) = (map(math.radians, p) for p in (a, b))
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2))


def plane_area(side, middle):
    """A square of so many degrees around a latitude, in the plane of its five vertices' mean latitude."""
    lat0 = middle - side / 10
    return (math.radians(side) * EARTH_RADIUS) ** 2 * math.cos(math.radians(lat0))


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def data(reply):
    assert not reply["isError"], reply
    return json.loads(reply["content"][1]["text"])


def test_every_operator_is_listed(engine):
    assert set(engine.list_operators()) == set(QUERIES) and len(QUERIES) == 53


def test_replies(engine):
    got = data(engine.call("nearestPoint", {"target_point": [3.21, 50.61], "points": json.dumps(POINTS)}))
    assert got["geometry"]["coordinates"] == [3.2, 50.6] and got["properties"] == {"name": "mill", "distance": pytest.approx(haversine((3.21, 50.61), (3.2, 50.6)))}
    assert data(engine.call("distance", {"point1": [3.2, 50.6], "point2": [3.31, 50.59], "options": {"units": "kilometers"}}))["value"] == pytest.approx(haversine((3.2, 50.6), (3.31, 50.59)) / 1000)
    assert data(engine.call("bbox", {"geojson": POINTS})) == [3.2, 50.59, 3.31, 50.64]
    held = data(engine.call("collect", {"polygons": {"type": "FeatureCollection", "features": [SQUARE]}, "points": POINTS, "in_field": "name", "out_field": "names"}))
    assert held["features"][0]["properties"] == {"k": "a", "names": ["mill"]}
    assert len(data(engine.call("tesselate", {"polygon": SQUARE}))["features"]) == 2
    assert len(data(engine.call("voronoi", {"points": POINTS}))["features"]) == 3
    merged = data(engine.call("dissolve", {"featureCollection": {"type": "FeatureCollection", "features": [SQUARE, SQUARE]}, "options": {"propertyName": "k"}}))
    assert [f["properties"] for f in merged["features"]] == [{"k": "a"}]
    assert data(engine.call("intersect", {"featureCollection": {"type": "FeatureCollection", "features": [SQUARE, SQUARE]}}))["geometry"]["type"] == "Polygon"


@pytest.mark.parametrize("given", [TWO, MIXED, {"type": "Feature", "properties": {}, "geometry": MIXED}])
def test_collections(engine, given):
    small, large = plane_area(1, 0.5), plane_area(4, 2)
    assert data(engine.call("area", {"polygon": given}))["value"] == pytest.approx(small + large)
    lon, lat = data(engine.call("centerOfMass", {"geojson": given}))["geometry"]["coordinates"]
    # areas weigh the squares' middles; the way back to degrees takes the mean latitude of both
    cos = lambda lat: math.cos(math.radians(lat))
    assert lat == pytest.approx((0.5 * small + 2 * large) / (small + large))
    assert lon == pytest.approx((0.5 * cos(0.4) * small + 12 * cos(1.6) * large) / (small + large) / cos(1.0))
    assert data(engine.call("bbox", {"geojson": given})) == [0, 0, 40, 40]
    assert data(engine.call("centroid", {"geojson": given}))["geometry"]["coordinates"] == pytest.approx([(2 + 58 + 40) / 11, (2 + 8 + 40) / 11])
    for p, inside in (([0.5, 0.5], True), ([12, 3], True), ([5, 0.5], False)):
        assert data(engine.call("booleanPointInPolygon", {"point": {"type": "Point", "coordinates": p}, "polygon": given}))["value"] is inside
    tangents = data(engine.call("polygonTangents", {"point": [-5, 0.5], "polygon": given}))["features"]
    assert [f["geometry"]["coordinates"] for f in tangents] == [[0, 0], [10, 4]]


def test_transforms_keep_what_is_around_geometries(engine):
    moved = data(engine.call("transformTranslate", {"geojson": TWO, "distance": 0, "direction": 90}))
    assert [f["properties"] for f in moved["features"]] == [f["properties"] for f in TWO["features"]]
    assert [f["geometry"]["type"] for f in moved["features"]] == ["Polygon", "Polygon", "Point"]
    # a collection turns about the mean vertex of the whole, so its geometries change places
    pair = collection(feature("Point", [-1, 0], n=1), feature("Point", [1, 0], n=2), {"type": "Feature", "properties": {}, "geometry": None})
    turned = data(engine.call("transformRotate", {"geojson": pair, "angle": 180}))["features"]
    assert [f["geometry"] and f["geometry"]["coordinates"] for f in turned] == [pytest.approx([1, 0], abs=1e-9), pytest.approx([-1, 0], abs=1e-9), None]
    scaled = data(engine.call("transformScale", {"geojson": pair, "factor": 3}))["features"]
    assert [f["geometry"]["coordinates"] for f in scaled[:2]] == [pytest.approx([-3, 0]), pytest.approx([3, 0])]
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 0.001], [2, 0]]}
    assert data(engine.call("simplify", {"geojson": {"type": "GeometryCollection", "geometries": [line]}, "options": {"tolerance": 0.1}})) == {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0, 0], [2, 0]]}]}


def test_properties_pass_through(engine):
    options = {"properties": {"a": [1]}, "id": 7}
    for name, arguments in (("centroid", {"geojson": SQUARE}), ("destination", {"origin": [3, 50], "distance": 1, "bearing": 10}), ("bboxPolygon", {"bbox": [0, 0, 1, 1]}), ("circle", {"center": [3, 50], "radius": 1})):
        got = data(engine.call(name, arguments | {"options": options}))
        assert (got["properties"], got["id"]) == ({"a": [1]}, 7), name
    assert data(engine.call("buffer", {"geojson": SQUARE, "radius": 1, "options": options}))["properties"] == {"a": [1]}
    assert all(f["properties"] == {"k": "a"} for f in data(engine.call("tesselate", {"polygon": SQUARE}))["features"])
    assert data(engine.call("bezierSpline", {"line": feature("LineString", [[0, 0], [1, 1], [2, 0]], way="up")}))["properties"] == {"way": "up"}


def test_errors(engine):
    for name, arguments, text in (("nearestPoint", {"target_point": [0, 0], "points": {"type": "FeatureCollection", "features": []}}, "non-empty array"), ("area", {}, "Missing required field 'polygon'"), ("nothing", {}, "Unknown tool"), ("distance", {"point1": [0, 99], "point2": [0, 0]}, "WGS84"), ("buffer", {"geojson": SQUARE, "radius": -1}, "radius"), ("booleanPointInPolygon", {"point": [0, 0], "polygon": SQUARE}, "'type' field")):
        reply = engine.call(name, arguments)
        assert reply["isError"] and text in reply["content"][0]["text"]


def test_geofence_on_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from geoquilt.sources.geojson import parse_geometry
    from geoquilt.streaming.geofence import geofence_counts

    rows = [(k, 3.22 + 0.003 * k, 50.6, f"2026-01-01 00:{k:02d}:00") for k in range(8)]
    spark.createDataFrame(rows, "pid long, lon double, lat double, at string").selectExpr("pid", "lon", "lat", "CAST(at AS TIMESTAMP) AS ts").write.parquet(str(tmp_path / "in"))
    polygons = spark.createDataFrame([(0, json.dumps(SQUARE))], "fid long, text string").select("fid", parse_geometry(F.parse_json("text")).alias("geom"))
    stream = spark.readStream.schema("pid long, lon double, lat double, ts timestamp").parquet(str(tmp_path / "in"))
    query = geofence_counts(stream, polygons).writeStream.format("memory").queryName("fences").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["n"] for r in spark.table("fences").collect()) == [2, 5]
