"""Nearest neighbours by a packed tree of boxes on the sphere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sphere
from ..sources.scratch import numbered, saved
from .density import on_sphere
from .joins import dealt

#: Points or boxes under one box, and boxes of the top level, which every task has.
FANOUT, TOP = 64, 8192
#: Targets of a run along the curve, and boxes opened for a run beyond which it is halved or its points are dealt.
RUN, MOST_OPEN = 1024, 64
#: What bounds are widened by: straight ways on the unit sphere, more than rounding takes.
SLACK = 1e-12
_BOX = [f"{n}{k}" for k in "xyz" for n in ("low", "high")]


def _spread(x: Column) -> Column:
    """Twenty bits with two empty ones between."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve(x: Column, y: Column, z: Column) -> Column:
    """The place along a curve that fills the cube around the sphere, so that what is near on it is near on the sphere."""
    axis = lambda c: _spread(F.floor((c + 1) / 2 * ((1 << 20) - 1)).cast("long"))
    return axis(x).bitwiseOR(F.shiftleft(axis(y), 1)).bitwiseOR(F.shiftleft(axis(z), 2))


def _levels(leaves: DataFrame, n: int) -> list[DataFrame]:
    """(node, parent, box) from the leaves up; the top level has TOP boxes at most."""
    levels = [leaves]
    n = -(-n // FANOUT)
    while n > TOP:
        n = -(-n // FANOUT)
        boxes = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in _BOX]
        levels.append(saved(levels[-1].groupBy(F.col("parent").alias("node")).agg(*boxes).withColumn("parent", F.expr(f"node div {FANOUT}")), "boxes"))
    return levels


def _length(gaps: list[Column]) -> Column:
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def _least(box: list[Column], other: list[Column]) -> Column:
    """How near one another points of two boxes may be."""
    return _length([F.greatest(F.lit(0.0), box[k] - other[k + 1], other[k] - box[k + 1]) for k in (0, 2, 4)])


def _most(box: list[Column], other: list[Column]) -> Column:
    """How far from one another points of two boxes may be."""
    return _length([F.greatest(box[k + 1] - other[k], other[k + 1] - box[k]) for k in (0, 2, 4)])


def _columns(rows: pa.Table, prefix: str) -> np.ndarray:
    return np.column_stack([rows.column(f"{prefix}{k}").to_numpy() for k in "xyz"])


def nearest_point(targets: DataFrame, points: DataFrame, tid: str = "tid", fid: str = "fid", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(tid, fid, meters): each target's nearest point, the first of equals; distances that are no number do not count.

    Points, one for each place, are packed along a curve into boxes of FANOUT,
    boxes into boxes, up to a top level of TOP. Targets are cut along the curve
    into runs, which go down the levels together: the box whose farthest corner
    is nearest to the run's own box bounds its distances, and only boxes that
    reach within the bound are opened. A run that opens many is halved, down to
    one place. A run meets the points of its boxes in one task, more than
    MOST_OPEN boxes in several; of these points only those as near as the
    nearest, up to rounding, have their distance worked out as such. Targets
    without a place have no row; no points at all are an error.
    """
    held = points.select(F.col(fid).alias("fid"), F.col(lon).cast("double").alias("lon2"), F.col(lat).cast("double").alias("lat2"))
    asked = targets.select(F.col(tid).alias("tid"), F.col(lon).cast("double").alias("lon1"), F.col(lat).cast("double").alias("lat1"))
    known = lambda df, *names: df.where(" AND ".join(f"abs({n}) < double('infinity')" for n in names))
    if points.isEmpty():
        raise ValueError("points must be a FeatureCollection with a non-empty array of features.")
    one = known(held, "lon2", "lat2").groupBy("lon2", "lat2").agg(F.min(F.struct("fid"))["fid"].alias("fid"))
    placed = on_sphere(one, "lon2", "lat2").withColumn("code", curve(F.col("sx"), F.col("sy"), F.col("sz")))
    packed = saved(numbered(placed, "code").withColumn("node", F.expr(f"place div {FANOUT}")).select("node", "fid", "lon2", "lat2", "sx", "sy", "sz"), "packed")
    boxes = lambda prefix, to="": [f(f"{prefix}{k}").alias(f"{to}{n}{k}") for k in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    leaves = saved(packed.groupBy("node").agg(*boxes("s")).withColumn("parent", F.expr(f"node div {FANOUT}")), "boxes")
    levels = _levels(leaves, packed.count())
    top = np.array(levels[-1].select("node", *_BOX).collect(), float).reshape(-1, 7)  # TOP rows at most
    numbers, low, high = top[:, 0].astype(np.int64), top[:, 1::2], top[:, 2::2]
    kind = held.schema["fid"].dataType.simpleString(), asked.schema["tid"].dataType.simpleString()

    def reached(least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, float]:
        """The top boxes to open for a box of targets, and the bound of its distances."""
        near = np.sqrt((np.maximum(0, np.maximum(low - most, least - high)) ** 2).sum(axis=1))
        bound = np.sqrt((np.maximum(high - least, most - low) ** 2).sum(axis=1)).min() if len(numbers) else 0.0
        return numbers[near <= bound + SLACK], float(bound)

    def halve(run: pa.Table) -> pa.Table:
        at = _columns(run, "t")
        piece, todo, pieces = np.zeros(len(at), np.int64), [np.arange(len(at))], 0
        while todo:
            some = todo.pop()
            least, most = at[some].min(axis=0), at[some].max(axis=0)
            if (most > least).any() and len(reached(least, most)[0]) > MOST_OPEN:
                order = some[np.argsort(at[some, (most - least).argmax()], kind="stable")]
                todo += [order[: len(order) // 2], order[len(order) // 2 :]]
            else:
                piece[some] = pieces
                pieces += 1
        return run.set_column(run.schema.get_field_index("run"), "run", pa.array(piece + run["run"][0].as_py() * RUN))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(f"t{c}").to_numpy() for c in _BOX])
            for k, row in enumerate(rows):
                nodes, bound = reached(row[::2], row[1::2])
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array([k] * len(nodes), pa.int64())).columns, pa.array(nodes), pa.array([bound] * len(nodes), pa.float64())], [*batch.schema.names, "node", "bound"])

    keyed = on_sphere(known(asked, "lon1", "lat1"), "lon1", "lat1").withColumnsRenamed({"sx": "tx", "sy": "ty", "sz": "tz"})
    runs = numbered(keyed.withColumn("code", curve(F.col("tx"), F.col("ty"), F.col("tz"))), "code").withColumn("run", F.expr(f"place div {RUN}"))
    fields = f"tid {kind[1]}, lon1 double, lat1 double, tx double, ty double, tz double"
    cut = saved(runs.select("run", "tid", "lon1", "lat1", "tx", "ty", "tz").groupBy("run").applyInArrow(halve, f"run long, {fields}"), "targets")
    around, names = [f"t{c}" for c in _BOX], ["run", *(f"t{c}" for c in _BOX)]
    todo = cut.groupBy("run").agg(*boxes("t", "t")).select(*names).mapInArrow(begin, f"run long, {', '.join(f'{c} double' for c in around)}, node long, bound double")
    box, of_run = [F.col(c) for c in _BOX], [F.col(c) for c in around]
    for level in reversed(levels[:-1]):
        todo = saved(todo, "asked")
        left, right, keys = dealt(todo, level.withColumnRenamed("node", "child").withColumnRenamed("parent", "node"), ["node"], ["run"], ["child"])
        opened = left.join(right, keys).select(*names, F.col("child").alias("node"), "bound", _least(box, of_run).alias("least"), _most(box, of_run).alias("most"))
        bound = F.least("bound", F.min("most").over(Window.partitionBy("run")))
        todo = opened.withColumn("bound", bound).where(F.col("least") <= F.col("bound") + SLACK).select(*names, "node", "bound")
    shares = F.ceil(F.count("*").over(Window.partitionBy("run")) / MOST_OPEN)
    todo = saved(todo.select("run", "node", F.pmod(F.xxhash64("node"), shares).alias("share")), "asked")
    left, right, keys = dealt(todo, packed, ["node"], ["run"], ["fid", "lon2", "lat2"])
    met = left.join(right, keys).select(F.col("run").alias("of"), F.col("share").alias("dealt"), "fid", "lon2", "lat2", "sx", "sy", "sz")

    def nearest(run: pa.Table, near: pa.Table) -> pa.Table:
        some, others = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if run.num_rows and near.num_rows:
            at, to, found = _columns(run, "t"), _columns(near, "s"), []
            for k in range(0, len(at), 128):
                way = np.sqrt(sum((at[k : k + 128, None, axis] - to[:, axis]) ** 2 for axis in range(3)))
                row, other = np.nonzero(way <= way.min(axis=1)[:, None] + SLACK)
                found.append((row + k, other))
            some, others = (np.concatenate(x) for x in zip(*found, strict=True))
        mine, theirs = run.select(["tid", "lon1", "lat1"]).take(pa.array(some)), near.select(["fid", "lon2", "lat2"]).take(pa.array(others))
        return pa.table([*mine.columns, *theirs.columns], [*mine.schema.names, *theirs.schema.names])

    sides = (cut.join(todo.select("run", "share").distinct(), "run").groupBy("run", "share"), met.groupBy("of", "dealt"))
    nearly = sides[0].cogroup(sides[1]).applyInArrow(nearest, f"tid {kind[1]}, lon1 double, lat1 double, fid {kind[0]}, lon2 double, lat2 double")
    meters = sphere.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    told = nearly.select("tid", "fid", meters.alias("m")).where("m IS NOT NULL AND NOT isnan(m)")
    return told.groupBy("tid").agg(F.min(F.struct("m", "fid")).alias("best")).select("tid", F.col("best.fid").alias("fid"), F.col("best.m").alias("meters"))
