"""Collections of any depth become rows of geometries."""

import json

import pytest
from pyspark.sql import functions as F

from geoquilt.operators import groups as G
from geoquilt.sources import geojson


def feature(g, **more):
    return {"type": "Feature", "geometry": g, "properties": {}, **more}


POINT, LINE = {"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [4.0, 6.0, 9.0]]}
SQUARE = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]}


def collection(*some):
    return {"type": "GeometryCollection", "geometries": list(some)}


DEEP = collection(POINT, collection(collection(SQUARE, collection()), LINE), collection())
TEXTS = {
    1: POINT,
    2: feature(DEEP),
    3: {"type": "FeatureCollection", "features": [feature(POINT), feature(DEEP), feature(None), {"type": "FeatureCollection", "features": [feature(LINE)]}]},
    4: collection(),
    5: feature(None),
    6: {"type": "FeatureCollection", "features": []},
    7: collection(None, POINT),
    8: collection(*[POINT] * 3),
}
WANT = {
    (1, (), "Point"), (2, (0,), "Point"), (2, (1, 0, 0), "Polygon"), (2, (1, 1), "LineString"),
    (3, (0,), "Point"), (3, (1, 0), "Point"), (3, (1, 1, 0, 0), "Polygon"), (3, (1, 1, 1), "LineString"), (3, (2,), None), (3, (3, 0), "LineString"),
    (5, (), None), (7, (0,), None), (7, (1,), "Point"), (8, (0,), "Point"), (8, (1,), "Point"), (8, (2,), "Point"), (9, (), None),
}


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(k, json.dumps(v), "kept") for k, v in TEXTS.items()] + [(9, None, "kept")]
    df = spark.createDataFrame(texts, "k int, doc string, other string").withColumn("path", F.lit("clash")).withColumn("geom", F.lit("clash"))
    return geojson.geometry_rows(df.repartition(3), "doc")


def test_every_geometry_is_a_row_with_its_place(rows):
    got = rows.select("k", "path", F.col("geom.type").alias("type"), "other").collect()
    assert len(got) == len(WANT) and {(r["k"], tuple(r["path"]), r["type"]) for r in got} == WANT and {r["other"] for r in got} == {"kept"}


def test_measures_of_whole_collections(rows):
    """A collection's box and mean vertex are those of all its geometries."""
    box = {r["k"]: r["bbox"] for r in G.bbox(rows, ["k"]).collect()}
    assert box[2] == [0.0, 0.0, 4.0, 6.0] and box[7] == [1.0, 2.0, 1.0, 2.0] and box[5] is None and 4 not in box
    mean = {r["k"]: r["point"] for r in G.centroid(rows, ["k"]).collect()}
    assert (mean[2]["lon"], mean[2]["lat"]) == pytest.approx(((1 + 2 + 4) / 8, (2 + 2 + 6) / 8))
    areas = {r["k"]: r["area"] for r in G.area(rows, ["k"]).collect()}
    assert areas[2] == pytest.approx(areas[3]) and areas[2] > 1e10 and areas[8] is None


def test_deep_chain_empty_table_and_wrong_members(spark):
    chain = LINE
    for _ in range(9):
        chain = collection(chain)
    df = spark.createDataFrame([(json.dumps(chain),)], "doc string")
    assert [(r["path"], r["t"]) for r in geojson.geometry_rows(df, "doc").select("path", F.col("geom.type").alias("t")).collect()] == [([0] * 9, "LineString")]
    assert geojson.geometry_rows(df.where("false"), "doc").count() == 0
    for wrong in ({"type": "FeatureCollection"}, {"type": "Sphere", "coordinates": [1, 2]}, collection({"type": "Sphere"})):
        with pytest.raises(Exception, match="Unsupported GeoJSON geometry type"):
            geojson.geometry_rows(spark.createDataFrame([(json.dumps(wrong),)], "doc string"), "doc").collect()


def test_files_with_nested_collections(spark, tmp_path):
    features = [feature(DEEP, id="deep"), feature(POINT, id="flat"), feature(collection(), id="empty"), feature(None, id="none")]
    (tmp_path / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "all.geojsonl").write_text("\n".join(map(json.dumps, features)) + "\n")
    for read, name in ((geojson.read_geojson, "all.geojson"), (geojson.read_geojson_lines, "all.geojsonl")):
        got = read(spark, f"file://{tmp_path}/{name}").select(F.col("id").cast("string").alias("id"), F.col("geom.type").alias("t")).collect()
        assert sorted((r["id"], r["t"] or "") for r in got) == [("deep", "LineString"), ("deep", "Point"), ("deep", "Polygon"), ("flat", "Point"), ("none", "")]


def test_ids_boxes_and_properties_go_out_and_come_back(spark, tmp_path):
    texts = [("a", json.dumps(POINT), '{"type": "x"}', None), (None, json.dumps(SQUARE), "2", [0.0, 0.0, 1.0, 1.0]), ('q"]', None, "[3]", None)]
    df = spark.createDataFrame(texts, "name string, doc string, raw string, box array<double>")
    made = geojson.geometry_rows(df, "doc").withColumn("ident", F.parse_json("raw"))
    geojson.write_geojson_lines(made, f"file://{tmp_path}/out", properties=["name"], id_="ident", bbox="box")
    got = sorted((json.loads(x["value"]) for x in spark.read.text(f"file://{tmp_path}/out").collect()), key=lambda f: str(f["id"]))
    assert [f["id"] for f in got] == [2, [3], {"type": "x"}] and [f.get("bbox") for f in got] == [[0.0, 0.0, 1.0, 1.0], None, None]
    assert [f["geometry"] for f in got] == [SQUARE, None, POINT] and [f["properties"].get("name") for f in got] == [None, 'q"]', "a"]
    again = geojson.read_geojson_lines(spark, f"file://{tmp_path}/out").select(F.to_json("id").alias("id"), F.col("geom.type").alias("t")).collect()
    assert sorted((r["id"], r["t"] or "") for r in again) == [("2", "Polygon"), ("[3]", ""), ('{"type":"x"}', "Point")]
    geojson.write_geojson_lines(made, f"file://{tmp_path}/names", id_="name")
    assert {json.loads(x["value"]).get("id", "none") for x in spark.read.text(f"file://{tmp_path}/names").collect()} == {"a", 'q"]', "none"}


def test_points_as_places(spark):
    df = spark.createDataFrame([(1, json.dumps(POINT)), (2, None)], "k int, doc string").withColumn("lon", F.lit("clash"))
    rows = geojson.geometry_rows(df, "doc")
    assert {(r["k"], r["lon"], r["lat"]) for r in geojson.point_places(rows).collect()} == {(1, 1.0, 2.0), (2, None, None)}
    with pytest.raises(Exception, match="Expected Point"):
        geojson.point_places(geojson.geometry_rows(spark.createDataFrame([(json.dumps(LINE),)], "doc string"), "doc")).collect()
