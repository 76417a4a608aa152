"""Single GeoJSON documents by operator name, for callers that hold one document and no table.

``Engine.call`` puts the arguments into a table of one row (or a row for each
feature), runs the operator on it, and returns the reply as a tool protocol has
it: two text items, the second of them JSON, and ``isError``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import shapes as S
from .functions.sphere import let, point
from .operators import aggregation as A
from .operators import measurement as M
from .operators import predicates as P
from .operators import transformation as T
from .sources.geojson import feature_json, geometry_json, parse_geometry


def _value(arguments: dict, key: str) -> Any:
    if key not in arguments:
        raise ValueError(f"Missing required field '{key}'.")
    value = arguments[key]
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            raise ValueError(f"Field '{key}' must contain valid JSON text.") from None
    return value


def _options(arguments: dict) -> dict:
    options = _value(arguments, "options") if "options" in arguments else {}
    if not isinstance(options, dict):
        raise ValueError("options must be a JSON object or JSON object string.")
    return options


def _lonlat(value: Any) -> tuple[float, float]:
    """[lon, lat, ...], a Point, or a Feature with a Point."""
    if isinstance(value, dict) and value.get("type") == "Feature":
        value = value.get("geometry")
    if isinstance(value, dict) and value.get("type") == "Point":
        value = value.get("coordinates")
    if not isinstance(value, list) or len(value) < 2:
        raise ValueError("Point coordinates must be a JSON array [lon, lat].")
    lon, lat = float(value[0]), float(value[1])
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError("WGS84 coordinates out of range. Latitude must be [-90, 90], longitude must be [-180, 180].")
    return lon, lat


def _geom(value: Any) -> Column:
    if not isinstance(value, dict) or not isinstance(value.get("type"), str):
        raise ValueError("GeoJSON must be an object with a 'type' field.")
    return parse_geometry(F.parse_json(F.lit(json.dumps(value))))


def _features(value: Any, key: str) -> list[dict]:
    if not isinstance(value, dict) or value.get("type") != "FeatureCollection" or not isinstance(value.get("features"), list) or not value["features"]:
        raise ValueError(f"Field '{key}' must be a FeatureCollection with a non-empty array of features.")
    return value["features"]


def _map_geometries(value: Any, change: Callable[[dict], Any]) -> Any:
    """The document with each plain geometry in it changed, in order; features without a geometry stay as they are."""
    if not isinstance(value, dict) or not isinstance(value.get("type"), str):
        raise ValueError("GeoJSON must be an object with a 'type' field.")
    for kind, key in (("FeatureCollection", "features"), ("GeometryCollection", "geometries")):
        if value["type"] == kind:
            if not isinstance(value.get(key), list):
                raise ValueError(f"{kind} must contain a {key} array.")
            return value | {key: [_map_geometries(x, change) for x in value[key]]}
    if value["type"] == "Feature":
        return value | {"geometry": _map_geometries(value["geometry"], change)} if value.get("geometry") else value
    return change(value)


def _geometries(value: Any) -> list[dict]:
    """The plain geometries that a document holds."""
    found: list[dict] = []
    _map_geometries(value, found.append)
    if not found:
        raise ValueError("GeoJSON must contain a geometry.")
    return found


class Engine:
    """The operators by their public names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def list_operators(self) -> list[str]:
        return sorted(_COLUMNS.keys() | _TABLES.keys())

    def call(self, name: str, arguments: dict) -> dict:
        try:
            if name in _COLUMNS:
                row = self.spark.range(1).select(_COLUMNS[name](arguments).alias("v")).first()
                data = None if row["v"] is None else _named(name, arguments, json.loads(row["v"]))
            elif name in _TABLES:
                data = _TABLES[name](self.spark, arguments)
            else:
                raise ValueError(f"Unknown tool: {name}")
        except Exception as error:  # a reply, as the protocol has it
            return {"content": [{"type": "text", "text": f"Invalid request: {error}"}], "isError": True}
        return {"content": [{"type": "text", "text": f"Computed {name}."}, {"type": "text", "text": json.dumps(data)}], "isError": False}


def _pt(arguments: dict, key: str) -> Column:
    lon, lat = _lonlat(_value(arguments, key))
    return point(F.lit(lon), F.lit(lat))


def _shape(arguments: dict, key: str) -> Column:
    """The only geometry of a document, or all its vertices as one MultiPoint, for operators on vertices."""
    found = _geometries(_value(arguments, key))
    if len(found) == 1:
        return _geom(found[0])
    vertices = F.flatten(F.array(*(F.flatten(F.flatten(_geom(g)["coords"])) for g in found)))
    return S.geometry("MultiPoint", F.array(F.array(vertices)))


def _areal(arguments: dict, key: str) -> Column:
    """The polygons that a document holds, as one MultiPolygon if there are several; without any, as _shape."""
    found = [g for g in _geometries(_value(arguments, key)) if g["type"] in S.POLYGONS]
    if not found:
        return _shape(arguments, key)
    if len(found) == 1:
        return _geom(found[0])
    parts = [part for g in found for part in (g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]])]
    return _geom({"type": "MultiPolygon", "coordinates": parts})


def _units(arguments: dict) -> str:
    return _options(arguments).get("units", "kilometers")


def _point_out(p: Column) -> Column:
    return feature_json(S.of_point(p["lon"], p["lat"]))


def _features_out(shapes: Column) -> Column:
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(shapes, lambda g: feature_json(g)), ","), F.lit("]}"))


def _number(value: Column, units: str | None = None) -> Column:
    return F.to_json(F.struct(value.alias("value"), *([F.lit(units).alias("units")] if units else [])))


def _array(box: Column) -> Column:
    return F.to_json(box)


def _box(arguments: dict, key: str = "bbox") -> Column:
    value = _value(arguments, key)
    if not isinstance(value, list) or len(value) != 4:
        raise ValueError("bbox must be [minX, minY, maxX, maxY] with min <= max.")
    return F.array(*(F.lit(float(x)) for x in value))


def _num(arguments: dict, key: str) -> Column:
    value = arguments.get(key)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"Field '{key}' must be a number.")
    return F.lit(float(value))


def _origin(arguments: dict, key: str) -> Column | None:
    value = _options(arguments).get(key, "centroid")
    if isinstance(value, str):
        if value != "centroid":
            raise ValueError(f"options.{key} supports only 'centroid' or a GeoJSON point input.")
        return None
    lon, lat = _lonlat(value)
    return point(F.lit(lon), F.lit(lat))


def _ring(arguments: dict) -> Column:
    return F.array(*(point(F.lit(float(x)), F.lit(float(y))) for x, y, *_ in _value(arguments, "ring")))


def _two(arguments: dict) -> tuple[Column, Column]:
    features = _features(_value(arguments, "featureCollection"), "featureCollection")
    if len(features) != 2:
        raise ValueError("featureCollection must contain exactly two polygon features.")
    return _geom(features[0]), _geom(features[1])


def _both(arguments: dict) -> tuple[Column, Column]:
    return _geom(_value(arguments, "geojson1")), _geom(_value(arguments, "geojson2"))


def _flag(arguments: dict, key: str) -> bool:
    return _options(arguments).get(key) is True


_COLUMNS: dict[str, Callable[[dict], Column]] = {
    "along": lambda a: _point_out(M.along(_shape(a, "line"), _num(a, "distance"), _units(a))),
    "area": lambda a: _number(M.area(_areal(a, "polygon")), "square meters"),
    "bbox": lambda a: _array(M.bbox(_shape(a, "geojson"))),
    "bboxPolygon": lambda a: feature_json(M.bbox_polygon(_box(a))),
    "bearing": lambda a: _number(M.bearing(_pt(a, "point1"), _pt(a, "point2")), "degrees"),
    "center": lambda a: _point_out(M.center(_shape(a, "geojson"))),
    "centerOfMass": lambda a: _point_out(M.center_of_mass(_areal(a, "geojson"))),
    "centroid": lambda a: _point_out(M.centroid(_shape(a, "geojson"))),
    "destination": lambda a: _point_out(M.destination(_pt(a, "origin"), _num(a, "distance"), _num(a, "bearing"), _units(a))),
    "distance": lambda a: _number(M.distance(_pt(a, "point1"), _pt(a, "point2"), _units(a)), _units(a)),
    "envelope": lambda a: feature_json(M.envelope(_shape(a, "geojson"))),
    "length": lambda a: _number(M.length(_geom(_value(a, "geojson")), _units(a)), _units(a)),
    "midpoint": lambda a: _point_out(M.midpoint(_pt(a, "point1"), _pt(a, "point2"))),
    "pointOnFeature": lambda a: _point_out(M.point_on_feature(_shape(a, "geojson"))),
    "pointToLineDistance": lambda a: _number(M.point_to_line_distance(_pt(a, "point"), _shape(a, "line"), _units(a), _options(a).get("method", "geodesic")), _units(a)),
    "rhumbBearing": lambda a: _number(M.rhumb_bearing(_pt(a, "point1"), _pt(a, "point2"), _flag(a, "final")), "degrees"),
    "rhumbDestination": lambda a: _point_out(M.rhumb_destination(_pt(a, "origin"), _num(a, "distance"), _num(a, "bearing"), _units(a))),
    "rhumbDistance": lambda a: _number(M.rhumb_distance(_pt(a, "point1"), _pt(a, "point2"), _units(a)), _units(a)),
    "square": lambda a: _array(M.square(_box(a))),
    "greatCircle": lambda a: feature_json(M.great_circle(_pt(a, "start"), _pt(a, "end"), int(_options(a).get("npoints", 100)))),
    "polygonTangents": lambda a: _features_out(let(M.polygon_tangents(_pt(a, "point"), _areal(a, "polygon")), lambda t: F.array(*(S.of_point(t[k]["lon"], t[k]["lat"]) for k in ("left", "right"))))),
    "booleanClockwise": lambda a: _number(P.boolean_clockwise(_ring(a))),
    "booleanContains": lambda a: _number(P.boolean_contains(*_both(a))),
    "booleanCrosses": lambda a: _number(P.boolean_crosses(*_both(a))),
    "booleanDisjoint": lambda a: _number(P.boolean_disjoint(*_both(a))),
    "booleanEqual": lambda a: _number(P.boolean_equal(*_both(a))),
    "booleanOverlap": lambda a: _number(P.boolean_overlap(*_both(a))),
    "booleanParallel": lambda a: _number(P.boolean_parallel(_geom(_value(a, "line1")), _geom(_value(a, "line2")))),
    "booleanPointInPolygon": lambda a: _number(P.boolean_point_in_polygon(_geom(_value(a, "point")), _areal(a, "polygon"), _flag(a, "ignoreBoundary"))),
    "booleanPointOnLine": lambda a: _number(P.boolean_point_on_line(_geom(_value(a, "point")), _geom(_value(a, "line")), _flag(a, "ignoreEndVertices"))),
    "booleanWithin": lambda a: _number(P.boolean_within(*_both(a))),
    "bboxClip": lambda a: feature_json(T.bbox_clip(_geom(_value(a, "feature")), _box(a))),
    "bezierSpline": lambda a: feature_json(T.bezier_spline(_shape(a, "line"), _options(a).get("sharpness", 0.85), int(_options(a).get("resolution", 10_000)))),
    "buffer": lambda a: feature_json(T.buffer(_shape(a, "geojson"), _num(a, "radius"), _units(a), _options(a).get("steps", 64))),
    "circle": lambda a: feature_json(T.circle(_pt(a, "center"), _num(a, "radius"), _units(a), _options(a).get("steps", 64))),
    "clone": lambda a: F.lit(json.dumps(_value(a, "geojson"))),
    "difference": lambda a: feature_json(T.difference(*_two(a))),
    "intersect": lambda a: F.when(T.intersect(*_two(a)).isNotNull(), feature_json(T.intersect(*_two(a)))),
    "union": lambda a: feature_json(T.union(*_two(a))),
    "lineOffset": lambda a: feature_json(T.line_offset(_geom(_value(a, "line")), _num(a, "distance"), _units(a))),
    "tesselate": lambda a: _features_out(T.tesselate(_geom(_value(a, "polygon")))),
}


#: What of the options is kept in the reply's Feature, and the argument whose Feature's properties are kept.
_FROM_OPTIONS = dict.fromkeys(("center", "centerOfMass", "centroid", "destination", "rhumbDestination"), ("properties", "id", "bbox")) | {"bboxPolygon": ("properties", "id"), "circle": ("properties", "id"), "buffer": ("properties",)}
_FROM_FEATURE = {"bezierSpline": "line", "tesselate": "polygon"}


def _named(name: str, arguments: dict, data: Any) -> Any:
    """The reply with the properties, id and bbox that the arguments give it."""
    options = _options(arguments)
    for key in _FROM_OPTIONS.get(name, ()):
        if key in options and isinstance(options[key], {"properties": dict, "bbox": list}.get(key, object)):
            data[key] = options[key]
    if name in _FROM_FEATURE:
        source = _value(arguments, _FROM_FEATURE[name])
        properties = source.get("properties") if source.get("type") == "Feature" else None
        if isinstance(properties, dict):
            for feature in data.get("features", [data]):
                feature["properties"] = properties
    return data


def _changed(spark: SparkSession, arguments: dict, change: Callable[[Column], Column]) -> Any:
    """The document with its geometries changed; all else in it stays."""
    value = _value(arguments, "geojson")
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, _geometries(value)))), "k long, text string")
    made = rows.select("k", geometry_json(change(parse_geometry(F.parse_json("text")))).alias("v")).orderBy("k").collect()
    new = iter([json.loads(r["v"]) for r in made])
    return _map_geometries(value, lambda _: next(new))


def _around(arguments: dict, key: str) -> Column:
    """The point that an option gives, else the mean vertex of the whole document."""
    origin = _origin(arguments, key)
    return M.centroid(_shape(arguments, "geojson")) if origin is None else origin


def _simplify(spark: SparkSession, a: dict) -> Any:
    return _changed(spark, a, lambda g: T.simplify(g, float(_options(a).get("tolerance", 1.0))))


def _rotate(spark: SparkSession, a: dict) -> Any:
    return _changed(spark, a, lambda g: T.transform_rotate(g, _num(a, "angle"), _around(a, "pivot")))


def _scale(spark: SparkSession, a: dict) -> Any:
    return _changed(spark, a, lambda g: T.transform_scale(g, _num(a, "factor"), _around(a, "origin")))


def _translate(spark: SparkSession, a: dict) -> Any:
    z = float(_options(a).get("zTranslation", 0.0))
    return _changed(spark, a, lambda g: T.transform_translate(g, _num(a, "distance"), _num(a, "direction"), _units(a), z))


def _point_table(spark: SparkSession, features: list[dict], name: str = "fid") -> DataFrame:
    return spark.createDataFrame([(k, *_lonlat(f)) for k, f in enumerate(features)], f"{name} long, lon double, lat double")


def _with(feature: dict, **properties: Any) -> dict:
    return feature | {"properties": {**(feature.get("properties") or {}), **properties}}


def _collection(features: list[dict]) -> dict:
    return {"type": "FeatureCollection", "features": features}


def _collect(spark: SparkSession, a: dict) -> dict:
    polygons, points = _features(_value(a, "polygons"), "polygons"), _features(_value(a, "points"), "points")
    named = [(k, f) for k, f in enumerate(points) if a["in_field"] in (f.get("properties") or {})]
    shapes = spark.createDataFrame([(k, json.dumps(f)) for k, f in enumerate(polygons)], "fid long, text string").select("fid", parse_geometry(F.parse_json("text")).alias("geom"))
    table = spark.createDataFrame([(k, *_lonlat(f), k) for k, f in named], "pid long, lon double, lat double, at long")
    found = {r["fid"]: [points[k]["properties"][a["in_field"]] for k in r["held"]] for r in A.collect(shapes, table, "at", "held").collect()}
    return _collection([_with(f, **{a["out_field"]: found[k]}) for k, f in enumerate(polygons)])


def _labelled(features: list[dict], labels: DataFrame) -> dict:
    of = {r["fid"]: r["cluster"] for r in labels.collect()}
    return _collection([_with(f, cluster=of[k]) for k, f in enumerate(features)])


def _dbscan(spark: SparkSession, a: dict) -> dict:
    features, options = _features(_value(a, "points"), "points"), _options(a)
    least = options.get("minPoints", 3)
    return _labelled(features, A.clusters_dbscan(_point_table(spark, features), float(a["max_distance"]), options.get("units", "kilometers"), least if isinstance(least, int) else 3))


def _kmeans(spark: SparkSession, a: dict) -> dict:
    features = _features(_value(a, "points"), "points")
    return _labelled(features, A.clusters_kmeans(_point_table(spark, features), int(_options(a).get("numberOfClusters", a.get("number_of_clusters", 1)))))


def _nearest(spark: SparkSession, a: dict) -> dict:
    features = _features(_value(a, "points"), "points")
    target = spark.createDataFrame([(0, *_lonlat(_value(a, "target_point")))], "tid long, lon double, lat double")
    best = A.nearest_point(target, _point_table(spark, features)).first()
    return _with(features[best["fid"]], distance=best["meters"])


def _hull(spark: SparkSession, a: dict) -> dict:
    row = T.convex(_point_table(spark, _features(_value(a, "points"), "points"))).select(feature_json(F.col("geom")).alias("v")).first()
    return json.loads(row["v"])


def _dissolve(spark: SparkSession, a: dict) -> dict:
    features, name = _features(_value(a, "featureCollection"), "featureCollection"), _options(a).get("propertyName")
    key = lambda f: json.dumps(f["properties"][name]) if name in (f.get("properties") or {}) else None
    rows = spark.createDataFrame([(k, key(f) if name else None, json.dumps(f)) for k, f in enumerate(features)], "fid long, key string, text string")
    merged = T.dissolve(rows.select("fid", "key", parse_geometry(F.parse_json("text")).alias("geom")), "key" if name else None)
    props = F.when(F.lit(bool(name)) & F.col("key").isNotNull(), F.concat(F.lit("{" + json.dumps(name or "") + ":"), F.col("key"), F.lit("}"))).otherwise(F.lit("{}"))
    return _collection([json.loads(r["v"]) for r in merged.select(feature_json(F.col("geom"), props).alias("v")).collect()])


def _voronoi(spark: SparkSession, a: dict) -> dict:
    features = _features(_value(a, "points"), "points")
    box = tuple(map(float, _options(a).get("bbox", (-180, -90, 180, 90))))
    rows = T.voronoi(_point_table(spark, features), box).select("fid", feature_json(F.col("geom")).alias("v")).orderBy("fid").collect()
    return _collection([json.loads(r["v"]) | {"properties": features[r["fid"]].get("properties") or {}} for r in rows])


_TABLES: dict[str, Callable[[SparkSession, dict], Any]] = {"collect": _collect, "clustersDbscan": _dbscan, "clustersKmeans": _kmeans, "nearestPoint": _nearest, "convex": _hull, "concave": _hull, "dissolve": _dissolve, "voronoi": _voronoi, "simplify": _simplify, "transformRotate": _rotate, "transformScale": _scale, "transformTranslate": _translate}
