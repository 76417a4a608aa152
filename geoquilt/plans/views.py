"""Geometries worked out from the driver's tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S

_LON, _LAT = "CAST(({k}*7919)%{a} AS DOUBLE)/CAST(10000 AS DOUBLE)", "CAST(({k}*104729)%{b} AS DOUBLE)/CAST(10000 AS DOUBLE)"
_HEX = " UNION ALL ".join(f"SELECT {i} AS i,{x} AS dx,{y} AS dy" for i, (x, y) in enumerate([(30, 1), (16, 14), (-14, 13), (-30, -1), (-16, -14), (14, -13), (30, 1)]))

#: View: (its tables, SQL that both engines run).
SQL: dict[str, tuple[list[str], str]] = {
    "geo_pts": (["customer"], f"""SELECT c_custkey AS id, c_nationkey AS nk, c_mktsegment AS seg,
        {_LON.format(k="c_custkey", a=3600000)}-CAST(180 AS DOUBLE) AS lon, {_LAT.format(k="c_custkey", b=1700000)}-CAST(85 AS DOUBLE) AS lat FROM customer"""),
    "geo_hex": (["nation"], f"""SELECT n.n_nationkey AS nk, k.i AS ix, CAST(-180+72*(n.n_nationkey%5)+36+k.dx AS DOUBLE) AS lon,
        CAST(-85+34*CAST(floor(n.n_nationkey/5) AS INT)+17+k.dy AS DOUBLE) AS lat FROM nation n CROSS JOIN ({_HEX}) k"""),
    "geo_path": (["events"], """SELECT user_id AS fid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS ix,
        CAST((user_id*37)%300-150 AS DOUBLE)+CAST((event_id*7919)%20000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lon,
        CAST((user_id*53)%140-70 AS DOUBLE)+CAST((event_id*104729)%20000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat FROM events"""),
    "geo_pairs": (["orders"], f"""SELECT o_orderkey AS id, {_LON.format(k="o_custkey", a=3600000)}-CAST(180 AS DOUBLE) AS lon1, {_LAT.format(k="o_custkey", b=1700000)}-CAST(85 AS DOUBLE) AS lat1,
        CAST((o_orderkey*15485863)%3600000 AS DOUBLE)/CAST(10000 AS DOUBLE)-CAST(180 AS DOUBLE) AS lon2,
        CAST((o_orderkey*32452843)%1700000 AS DOUBLE)/CAST(10000 AS DOUBLE)-CAST(85 AS DOUBLE) AS lat2,
        CAST((o_orderkey*31)%360 AS DOUBLE) AS bearing, CAST((o_orderkey*17)%500 AS DOUBLE) AS km FROM orders"""),
    "geo_blobs": (["customer"], f"""SELECT c_custkey AS id, CAST((c_nationkey%5)*4 AS DOUBLE)+{_LON.format(k="c_custkey", a=10000)} AS lon,
        CAST(CAST(floor(c_nationkey/5) AS INT)*4 AS DOUBLE)+{_LAT.format(k="c_custkey", b=10000)} AS lat FROM customer"""),
    "geo_sites": (["supplier"], f"""SELECT s_suppkey AS id, {_LON.format(k="s_suppkey", a=3000000)}-CAST(150 AS DOUBLE) AS lon,
        {_LAT.format(k="s_suppkey", b=1400000)}-CAST(70 AS DOUBLE) AS lat FROM supplier"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = SQL[name]
    return spark.sql(_placed(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _placed(sql: str, tables: list[str]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql


def with_views(names: list[str], body: str) -> str:
    """DuckDB SQL: the views as common tables, then the body (which may begin with more of them)."""
    ctes = ", ".join(f"{n} AS ({SQL[n][1]})" for n in names)
    return f"WITH RECURSIVE {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"


def _gathered(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ix", "lon", "lat"))).alias("v"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, geom): each user's path as a LineString."""
    return _gathered(view(spark, sf_dir, "geo_path"), "fid").where("size(v) > 1").select("fid", S.of_line(F.col("v")).alias("geom"))


def hexagons(spark: SparkSession, sf_dir: str, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """(nk, geom): each nation's hexagon, moved if asked."""
    df = view(spark, sf_dir, "geo_hex").withColumn("lon", F.col("lon") + dx).withColumn("lat", F.col("lat") + dy)
    return _gathered(df, "nk").select("nk", S.of_ring(F.col("v")).alias("geom"))
