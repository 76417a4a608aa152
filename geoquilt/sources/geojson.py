"""GeoJSON files and columns to geometry columns, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.sphere import check
from .scratch import saved

#: Nesting of coordinates by type, and how they are brought to part, ring, vertex, ordinate.
_DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def parse_geometry(node: Column) -> Column:
    """A geometry column from a VARIANT that holds a geometry or a Feature; null for a null geometry, an error for an unknown type."""
    inner = F.when(F.try_variant_get(node, "$.type", "string") == "Feature", F.try_variant_get(node, "$.geometry", "variant")).otherwise(node)
    kind = F.try_variant_get(inner, "$.type", "string")
    coords = F.lit(None).cast("array<array<array<array<double>>>>")
    for name, depth in _DEPTH.items():
        value = F.try_variant_get(inner, "$.coordinates", "array<" * depth + "double" + ">" * depth)
        if name == "MultiLineString":
            value = F.transform(value, lambda line: F.array(line))
        else:
            for _ in range(4 - depth):
                value = F.array(value)
        coords = F.when(kind == name, value).otherwise(coords)
    # a collection is null here; explode_collections makes a row of each of its geometries
    parts = F.try_variant_get(inner, "$.geometries", "array<variant>")
    known = F.when(kind.isNull() | kind.isin(*_DEPTH), coords).otherwise(F.raise_error(F.concat(F.lit("Unsupported GeoJSON geometry type: "), kind)))
    return F.when(kind.isNotNull() & parts.isNull(), S.geometry(kind, known))


def explode_collections(df: DataFrame, node: str, path: str = "path") -> DataFrame:
    """A row for each geometry inside a VARIANT column of Features, FeatureCollections and GeometryCollections of any depth.

    ``node`` then holds a geometry that is no collection, and ``path`` (array of
    int) the places, from 0, that lead to it through the collections; the other
    columns are repeated. A Feature adds no place. An empty collection has no
    rows; a null member, a null geometry and a null node are a row with a null
    or JSON null in ``node``. A collection without its member array stays as it
    is, and ``parse_geometry`` calls it an error. What is no collection is not
    written; each level of collections is one job that writes their members.
    """
    keep = [c for c in df.columns if c not in (node, path)]
    level, found = df.select(*keep, node, F.array().cast("array<int>").alias(path)), None
    while True:
        kind = F.try_variant_get(node, "$.type", "string")
        listed = F.when(kind == "FeatureCollection", F.try_variant_get(node, "$.features", "array<variant>")).when(kind == "GeometryCollection", F.try_variant_get(node, "$.geometries", "array<variant>"))
        members = F.when(kind == "Feature", F.array(F.try_variant_get(node, "$.geometry", "variant"))).otherwise(listed)
        leaves = level.where(members.isNull())
        found = leaves if found is None else found.unionByName(leaves)
        opened = level.where(members.isNotNull()).select(*keep, path, (kind == "Feature").alias("_feature"), F.posexplode(members).alias("_place", "_member"))
        at = F.when(F.col("_feature"), F.col(path)).otherwise(F.concat(F.col(path), F.array("_place")))
        level = saved(opened.select(*keep, F.col("_member").alias(node), at.alias(path)), "members")
        if level.isEmpty():
            return found


def geometry_rows(df: DataFrame, text: str, geom: str = "geom", path: str = "path") -> DataFrame:
    """A column of GeoJSON texts as rows of geometries, collections of any depth included; a null text is a row of null, text that is no JSON an error.

    Grouped by a key of the rows, the measures of ``operators.groups`` are then those of the whole collections.
    """
    nodes = df.select(*(c for c in df.columns if c not in (text, geom, path)), F.parse_json(text).alias("_node"))
    return _parsed(explode_collections(nodes, "_node", path), "_node", geom)


def _parsed(df: DataFrame, node: str, geom: str = "geom") -> DataFrame:
    made = df.withColumn(geom, parse_geometry(F.col(node))).drop(node)
    return made.withColumn(geom, F.when(F.col(geom).isNotNull(), S.valid(F.col(geom))))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """fid, geom, properties (VARIANT), id (VARIANT), file of every feature in GeoJSON files, in file order.

    A file holds a FeatureCollection, a Feature or a geometry; what a feature holds
    in collections of any depth becomes one row for each geometry, a feature with
    an empty collection has none. Vertices out of the WGS84 range are an error.
    """
    docs = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"), F.col("_metadata.file_path").alias("file"))
    listed = F.coalesce(F.try_variant_get("doc", "$.features", "array<variant>"), F.array("doc"))
    features = docs.select("file", F.posexplode(listed).alias("fid", "feature"))
    return _features(features.select("file", F.col("fid").cast("long").alias("fid"), "feature"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for newline-delimited features, which are split among tasks; fid is unique but not consecutive."""
    rows = spark.read.text(path).where("trim(value) != ''").select(F.parse_json("value").alias("feature"), F.col("_metadata.file_path").alias("file"))
    return _features(rows.select("file", F.monotonically_increasing_id().alias("fid"), "feature"))


def _features(rows: DataFrame) -> DataFrame:
    shape = F.when(F.try_variant_get("feature", "$.type", "string") == "Feature", F.try_variant_get("feature", "$.geometry", "variant")).otherwise(F.col("feature"))
    shapes = rows.select("file", "fid", shape.alias("shape"), F.try_variant_get("feature", "$.properties", "variant").alias("properties"), F.try_variant_get("feature", "$.id", "variant").alias("id"))
    return _parsed(explode_collections(shapes, "shape"), "shape").select("file", "fid", "geom", "properties", "id")


def from_points(df: DataFrame, lon: str = "lon", lat: str = "lat", name: str = "geom") -> DataFrame:
    return df.withColumn(name, S.of_point(F.col(lon).cast("double"), F.col(lat).cast("double")))


def geometry_json(g: Column) -> Column:
    """The GeoJSON text of a geometry; a null geometry is null."""
    c = g["coords"]
    by_type = {"Point": c[0][0][0], "MultiPoint": c[0][0], "LineString": c[0][0], "Polygon": c[0], "MultiPolygon": c}
    text = F.to_json(F.transform(c, lambda part: part[0]))
    for kind, value in by_type.items():
        text = F.when(g["type"] == kind, F.to_json(value)).otherwise(text)
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), text, F.lit("}"))


def _json(value: Column) -> Column:
    """The JSON text of a column of any type; null of null."""
    return F.when(value.isNotNull(), F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))


def feature_json(g: Column, properties: Column | None = None, id_: Column | None = None, bbox: Column | None = None) -> Column:
    """The GeoJSON text of a Feature; ``properties`` and ``id_`` are JSON texts, ``bbox`` an array of numbers. Where one is null, the id and the box are left out, the properties are empty."""
    props = F.coalesce(properties, F.lit("{}")) if properties is not None else F.lit("{}")
    members = [F.concat(F.lit(f'"{name}":'), value, F.lit(",")) for name, value in (("id", id_), ("bbox", None if bbox is None else _json(bbox))) if value is not None]
    head = [F.lit('{"type":"Feature",'), *(F.coalesce(m, F.lit("")) for m in members)]
    return F.concat(*head, F.lit('"properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry_json(g), F.lit("null")), F.lit("}"))


def write_geojson_lines(df: DataFrame, path: str, geom: str = "geom", properties: list[str] | None = None, id_: str | None = None, bbox: str | None = None) -> None:
    """One feature a line, in as many files as there are tasks; ``properties``, ``id_`` (a string, a number or VARIANT) and ``bbox`` name columns."""
    props = F.to_json(F.struct(*properties)) if properties else None
    ident, box = (None if id_ is None else _json(F.col(id_))), (None if bbox is None else F.col(bbox))
    df.select(feature_json(F.col(geom), props, ident, box).alias("value")).write.text(path)


def point_places(df: DataFrame, geom: str = "geom") -> DataFrame:
    """lon and lat instead of a column of Points; a null geometry has nulls, any other type is an error."""
    g = F.col(geom)
    first = S.vertices(check(g["type"] == "Point", "Expected Point geometry.", g))[0]
    return df.select(*(c for c in df.columns if c not in (geom, "lon", "lat")), first["lon"].alias("lon"), first["lat"].alias("lat"))
