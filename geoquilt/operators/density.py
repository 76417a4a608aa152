"""Density-based clusters by cells of the sphere that are small enough for all their points to be neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere
from ..functions.constants import EARTH_RADIUS, meters_in
from ..sources.scratch import numbered, saved, small
from .joins import dealt

#: Pairs of places up to which two cells are compared place by place; beyond, they are halved.
DIRECT = 1024
_CELL, _AXES = ["cx", "cy", "cz"], "xyz"


def on_sphere(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Add the place on the unit sphere, where neither poles nor the antimeridian need care."""
    lo, la = F.radians(F.col(lon)), F.radians(F.col(lat))
    return df.withColumns({"sx": F.cos(la) * F.cos(lo), "sy": F.cos(la) * F.sin(lo), "sz": F.sin(la)})


def chord_of(meters: float) -> float:
    """The straight way that is as long as an arc on the unit sphere."""
    return 2 * math.sin(min(math.pi, meters / EARTH_RADIUS) / 2)


def least_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each node reaches, by rounds of least labels and their labels' labels."""
    labels = saved(nodes.select("id", F.col("id").alias("root")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("heard"))
        told = labels.join(heard, "id", "left").select("id", F.least("root", F.coalesce("heard", "root")).alias("new"), "root")
        jumped = told.join(labels.select(F.col("id").alias("new"), F.col("root").alias("further")), "new").select("id", F.least("new", "further").alias("next"), "root")
        after = saved(jumped, "labels")
        if after.where("next != root").isEmpty():
            return labels
        labels = after.select("id", F.col("next").alias("root"))


def _apart(a: str, b: str) -> Column:
    """How far two boxes on the sphere are apart at least, squared."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}_low{k}") - F.col(f"{b}_high{k}"), F.col(f"{b}_low{k}") - F.col(f"{a}_high{k}")) for k in _AXES]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _groups(places: DataFrame, *keys: str) -> DataFrame:
    """Groups of places: how many, the box around them, and one of them."""
    one = F.min(F.struct("id", "lon", "lat"))
    boxes = [f(f"s{k}").alias(f"{n}{k}") for k in _AXES for n, f in (("low", F.min), ("high", F.max))]
    return places.groupBy(*keys).agg(F.count("*").alias("m"), one.alias("one"), *boxes)


def _sided(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in keys else F.col(c).alias(f"{side}_{c}") for c in df.columns))


def _near(a: str, b: str, meters: float) -> Column:
    return sphere.haversine(F.col(f"{a}.lon"), F.col(f"{a}.lat"), F.col(f"{b}.lon"), F.col(f"{b}.lat")) <= meters


def _around(df: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each cell at one of the offsets from a row's own."""
    steps = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) for v, k in zip(o, _AXES, strict=True))) for o in offsets))
    moved = df.withColumn("step", F.explode(steps))
    return moved.withColumns({f"c{k}": F.col(f"c{k}") + F.col(f"step.{k}") for k in _AXES}).drop("step")


def _dense_links(places: DataFrame, cells: DataFrame, meters: float, side: float, reach: int) -> DataFrame:
    """(a, b): dense cells with a place of one near a place of the other.

    The boxes around two cells' places and one place of each decide most pairs.
    The others are compared place by place if that takes few comparisons, else
    their places are halved along each axis and the halves' boxes and places
    looked at again.
    """
    far = (chord_of(meters) * (1 + 1e-9) + 1e-12) ** 2
    half = [(x, y, z) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) for z in range(-reach, reach + 1) if (x, y, z) > (0, 0, 0)]
    named = places.join(cells.select(*_CELL, F.col("cell").alias("of")), _CELL).select("of", "id", "lon", "lat", "sx", "sy", "sz")
    named = saved(named, "dense")
    boxes = saved(_groups(places, *_CELL).join(cells.select(*_CELL, F.col("cell").alias("of")), _CELL), "dense-boxes")

    def judged(pairs: DataFrame) -> DataFrame:
        """Pairs of boxes that are not too far apart, with whether their places say that they are linked."""
        tiny = lambda s: F.greatest(*(F.col(f"{s}_high{k}") - F.col(f"{s}_low{k}") for k in _AXES)) < 1e-15
        linked = _near("a_one", "b_one", meters)
        return pairs.where(_apart("a", "b") <= far).withColumn("linked", linked).where(F.col("linked") | ~(tiny("a") & tiny("b")))

    left, right, keys = dealt(_around(_sided(boxes, "a", _CELL), half), _sided(boxes, "b", _CELL), _CELL, ["a_of"], ["b_of"])
    pairs = saved(judged(left.join(right, keys)), "dense-pairs")
    done = pairs.where("linked").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))
    todo = pairs.where("NOT linked").select("a_of", F.array().cast("array<long>").alias("a_part"), "a_m", "b_of", F.array().cast("array<long>").alias("b_part"), "b_m")
    depth = 0
    parts = named.withColumn("part", F.array().cast("array<long>"))
    while not todo.isEmpty():
        few = todo.where(F.col("a_m") * F.col("b_m") <= DIRECT)
        one = lambda s: parts.select(F.col("of").alias(f"{s}_of"), F.col("part").alias(f"{s}_part"), F.struct("lon", "lat").alias(f"{s}_one"))  # noqa: E731, B023
        met = few.join(one("a"), ["a_of", "a_part"]).join(one("b"), ["b_of", "b_part"]).where(_near("a_one", "b_one", meters))
        done = done.unionByName(saved(met.select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).distinct(), "dense-links"))
        many = saved(todo.where(F.col("a_m") * F.col("b_m") > DIRECT).join(done.select(F.col("a").alias("a_of"), F.col("b").alias("b_of")), ["a_of", "b_of"], "left_anti"), "dense-pairs")
        if many.isEmpty():
            break
        depth += 1
        size = side / 2**depth
        finer = F.array(*(F.floor(F.col(f"s{k}") / size).cast("long") for k in _AXES))
        parts = saved(parts.withColumnRenamed("part", "was").withColumn("part", finer), "dense-parts")
        halves = saved(_groups(parts, "of", "was", "part"), "dense-boxes")
        both = many.select("a_of", "b_of", F.col("a_part").alias("a_was"), F.col("b_part").alias("b_was"))
        both = both.join(_sided(halves, "a", []), ["a_of", "a_was"]).join(_sided(halves, "b", []), ["b_of", "b_was"])
        pairs = saved(judged(both), "dense-pairs")
        done = done.unionByName(pairs.where("linked").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).distinct())
        todo = pairs.where("NOT linked").select("a_of", "a_part", "a_m", "b_of", "b_part", "b_m")
        parts = parts.drop("was")
    return done.distinct()


def clusters_dbscan(points: DataFrame, max_distance: float, units: str = "kilometers", min_points: int = 3, fid: str = "fid", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(fid, cluster): clusters are numbered from 0 by their first core point; noise is -1.

    A point with min_points neighbours or more, itself included, is core. Points
    fall into cells in which all are neighbours of one another, so a cell with
    min_points of them is dense: all are core and in one cluster. Only points of
    other cells are compared, with those of the cells around; there are fewer
    than min_points of them in a cell, so that what is compared, and what is
    kept, grows with the points. Of dense cells it matters only which are linked.
    """
    meters = max_distance * meters_in(units)
    chord = chord_of(meters)
    side = max(chord * (1 - 1e-6) / math.sqrt(3), 1e-12)
    reach = math.ceil((chord * (1 + 1e-9) + 1e-12) / side)
    around = [(x, y, z) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) for z in range(-reach, reach + 1) if (x, y, z) != (0, 0, 0)]
    rows = saved(points.select(F.col(fid).alias("fid"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat")), "points")
    placed = on_sphere(rows.groupBy("lon", "lat").agg(F.min("fid").alias("id"), F.count("*").alias("n")), "lon", "lat")
    places = saved(placed.withColumns({f"c{k}": F.floor(F.col(f"s{k}") / side).cast("long") for k in _AXES}), "places")
    counted = places.groupBy(*_CELL).agg(F.min("id").alias("cell"), F.sum("n").alias("in_cell"))
    cells = saved(counted.withColumn("dense", F.col("in_cell") >= min_points), "cells")
    by_cell = saved(places.join(small(cells), _CELL), "places")
    sparse = by_cell.where("NOT dense").select(F.col("id").alias("a"), F.struct("lon", "lat").alias("a_one"), F.col("cell").alias("a_cell"), *_CELL)
    others = by_cell.select(F.col("id").alias("b"), F.struct("lon", "lat").alias("b_one"), F.col("cell").alias("b_cell"), F.col("dense").alias("b_dense"), F.col("n").alias("b_n"), *_CELL)
    left, right, keys = dealt(_around(sparse, around), others, _CELL, ["a"], ["b"])
    met = left.join(right, keys).where(_near("a_one", "b_one", meters))
    # a row for each dense cell, and for each place of another, that a place of a cell that is not dense has near
    hits = saved(met.groupBy("a", "a_cell", "b_cell", "b_dense", F.when(~F.col("b_dense"), F.col("b")).alias("b")).agg(F.sum("b_n").alias("n")), "hits")
    degree = by_cell.where("NOT dense").select("id", "cell", "in_cell").join(hits.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more")), "id", "left")
    core = saved(degree.where(F.col("in_cell") + F.coalesce("more", F.lit(0)) >= min_points).select("id", "cell"), "core")
    nodes = saved(by_cell.where("dense").select("cell", "id").unionByName(core.select("cell", "id")).groupBy(F.col("cell").alias("id")).agg(F.min("id").alias("first")), "core-cells")
    of_core = hits.join(core.select(F.col("id").alias("a")), "a", "left_semi")
    links = of_core.where("b_dense").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"))
    links = links.unionByName(of_core.where("NOT b_dense").join(core.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")))
    links = links.unionByName(_dense_links(by_cell.where("dense").drop("cell"), cells.where("dense"), meters, side, reach)).where("a != b")
    edges = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = saved(least_reachable(nodes, edges), "roots")
    first = nodes.join(roots, "id").groupBy("root").agg(F.min("first").alias("first"))
    cluster = saved(roots.join(numbered(first, "first", "cluster").select("root", "cluster"), "root").select(F.col("id").alias("cell"), "cluster"), "clusters")
    near_core = hits.join(core.select(F.col("id").alias("b"), F.lit(True).alias("b_core")), "b", "left").where(F.col("b_dense") | F.col("b_core"))
    border = near_core.join(cluster.withColumnRenamed("cell", "b_cell"), "b_cell").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    border = border.join(core.select("id"), "id", "left_anti")
    is_core = by_cell.where("dense").select("id").unionByName(core.select("id")).withColumn("core", F.lit(True))
    told = by_cell.select("id", "lon", "lat", "cell").join(cluster, "cell", "left").join(border, "id", "left").join(is_core, "id", "left")
    # a place that is not core is near the core places of its own cell
    label = F.when(F.col("core"), F.col("cluster")).otherwise(F.coalesce(F.least("cluster", "near"), F.lit(-1)))
    return rows.join(told.select("lon", "lat", label.cast("long").alias("cluster")), ["lon", "lat"]).select("fid", "cluster")
