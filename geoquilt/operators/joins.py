"""Joins on place, on equal cells of a grid of levels: boxes that meet, geometries for which a predicate holds, points in polygons.

No join here is a cross join, and no cell is left to one task: rows of crowded
cells are dealt over shares, and crowded cells of points are split before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.sphere import let
from ..sources.scratch import saved, small
from . import predicates as P

#: Rows of a side that meet under one key in one task; points of a cell beyond which it is split.
CROWD = 50_000
#: Segments of a line up to which all of them are compared with what has the line's key.
SHORT = 512
#: How much boxes are widened, in degrees: predicates allow for less.
MARGIN = 1e-9

Test = Callable[[Column, Column], Column]


def dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], left_deal: Sequence[str], right_deal: Sequence[str], most: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with two more columns to join on, so that under no key more than about ``most`` rows of a side come to one task.

    The rows of a crowded key are dealt over shares by a hash of ``left_deal`` or
    ``right_deal``, and the other side's rows are repeated for each share; two
    rows still meet once.
    """
    most = most or CROWD

    def crowded(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)
        return counts.select(*keys, F.ceil(F.col("n") / most).cast("int").alias(name))

    hot = saved(crowded(left, "_of_left").join(crowded(right, "_of_right"), list(keys), "full"), "crowded").fillna(1, ["_of_left", "_of_right"])
    if hot.isEmpty():
        return left, right, list(keys)

    def shares(df: DataFrame, mine: str, deal: Sequence[str], other: str) -> DataFrame:
        met = df.join(small(hot), list(keys), "left").fillna(1, ["_of_left", "_of_right"])
        own = F.pmod(F.xxhash64(*deal), F.col(f"_of_{mine}")).cast("int")
        return met.withColumn(f"_{mine}", own).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_of_{other}") - 1))).drop("_of_left", "_of_right")

    return shares(left, "left", left_deal, "right"), shares(right, "right", right_deal, "left"), [*keys, "_left", "_right"]


def cell_of(ordinate: Column, level: Column | int) -> Column:
    """The cell of a level, whose cells have sides of two to that power."""
    return F.floor(ordinate / F.pow(F.lit(2.0), level)).cast("long")


def box_of(points: Column) -> Column:
    """The box around some points, widened a little; null for none."""
    side = lambda k, f: f(F.transform(points, lambda v: v[k]))
    x0, y0, x1, y1 = side("lon", F.array_min), side("lat", F.array_min), side("lon", F.array_max), side("lat", F.array_max)
    return F.when(x0.isNotNull() & y0.isNotNull(), F.struct((x0 - MARGIN).alias("x0"), (y0 - MARGIN).alias("y0"), (x1 + MARGIN).alias("x1"), (y1 + MARGIN).alias("y1")))


def _leveled(df: DataFrame, box: str, level: str) -> DataFrame:
    b = F.col(box)
    size = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(2.0**-20))
    return df.where(b.isNotNull()).withColumn(level, F.ceil(F.log2(size)).cast("int"))


def _levels(df: DataFrame, level: str) -> list[int]:
    return sorted(r[0] for r in df.select(level).distinct().collect())  # thirty or so powers of two


def _posted(df: DataFrame, box: str) -> DataFrame:
    """A row for each cell of ``level`` that the box touches: four at most where the level's cells are as large as the box."""
    b, level = F.col(box), F.col("level")
    across, up = (F.explode(F.sequence(cell_of(b[low], level), cell_of(b[high], level))) for low, high in (("x0", "x1"), ("y0", "y1")))
    return df.withColumn("i", across).withColumn("j", up)


def box_join(a: DataFrame, b: DataFrame, test: Column | None = None, on: Sequence[tuple[str, str]] = (), a_box: str = "a_box", b_box: str = "b_box", how: str = "inner", a_deal: Sequence[str] = ("a_id",), b_deal: Sequence[str] = ("b_id",)) -> DataFrame:
    """Rows of ``a`` and ``b`` whose boxes meet, which agree in the columns of ``on`` and for which ``test`` holds; a pair once. With ``left_semi``: rows of ``a`` that have any such row, maybe several times.

    Names of the two sides must differ. The larger of two boxes is posted to the
    cells of its own level, the smaller to those of each such level, and the pair
    is reported where the lower corner of what the boxes share lies.
    """
    a, b = saved(_leveled(a, a_box, "a_level"), "boxes"), saved(_leveled(b, b_box, "b_level"), "boxes")
    of_a, of_b = _levels(a, "a_level"), _levels(b, "b_level")
    x, y = F.col(a_box), F.col(b_box)
    meet = (x["x0"] <= y["x1"]) & (y["x0"] <= x["x1"]) & (x["y0"] <= y["y1"]) & (y["y0"] <= x["y1"])
    level = F.col("level")
    first = (cell_of(F.greatest(x["x0"], y["x0"]), level) == F.col("i")) & (cell_of(F.greatest(x["y0"], y["y0"]), level) == F.col("j"))
    holds = meet & first if how == "inner" else meet
    holds = holds if test is None else holds & test

    def up(df: DataFrame, own: str, levels: list[int], least: int) -> DataFrame:
        wanted = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda v: v >= F.col(own) + least)
        return df.withColumn("level", F.explode(wanted))

    out = None
    for left, right in ((a.withColumn("level", F.col("a_level")), up(b, "b_level", of_a, 0)), (up(a, "a_level", of_b, 1), b.withColumn("level", F.col("b_level")))):
        left, right = _posted(left, a_box), _posted(right, b_box)
        keys = ["level", "i", "j", *(f"_on{k}" for k in range(len(on)))]
        left, right = left.withColumns({f"_on{k}": F.col(c) for k, (c, _) in enumerate(on)}), right.withColumns({f"_on{k}": F.col(c) for k, (_, c) in enumerate(on)})
        left, right, keys = dealt(left, right, keys, a_deal, b_deal)
        if how == "inner":
            met = left.join(right, keys).where(holds).select(*(c for c in a.columns if c != "a_level"), *(c for c in b.columns if c != "b_level"))
        else:
            names = [c for c in right.columns if c not in keys]
            other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *names)
            condition = holds
            for k in keys:
                condition = condition & (F.col(k) == F.col(f"_r_{k}"))
            met = left.join(other, condition, "left_semi").select(*(c for c in a.columns if c != "a_level"))
        out = met if out is None else out.unionByName(met)
    return out


def spatial_join(a: DataFrame, b: DataFrame, test: Test, how: str = "inner", aid: str = "fid", ageom: str = "geom", bid: str = "fid", bgeom: str = "geom") -> DataFrame:
    """Geometries for which a predicate holds that needs their boxes to meet (equal, overlap, intersects, contains, within, crosses, or any other).

    ``inner``: (aid, bid) as a, b. ``left_semi`` and ``left_anti``: a, the ids of
    ``a`` that some row of ``b``, or none, goes with; ids are taken to be
    different. Null geometries meet nothing, so they are in the anti join.
    """
    left = a.select(F.col(aid).alias("a_id"), F.col(ageom).alias("a_geom")).withColumn("a_box", box_of(S.vertices(F.col("a_geom"))))
    right = b.select(F.col(bid).alias("b_id"), F.col(bgeom).alias("b_geom")).withColumn("b_box", box_of(S.vertices(F.col("b_geom"))))
    holds = test(F.col("a_geom"), F.col("b_geom"))
    if how == "inner":
        return box_join(left, right, holds).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    met = box_join(left, right, holds, how="left_semi").select(F.col("a_id").alias("a")).distinct()
    if how == "left_semi":
        return met
    ids = a.select(F.col(aid).alias("_id"))
    return ids.join(met, F.col("_id").eqNullSafe(F.col("a")), "left_anti").select(F.col("_id").alias("a"))


def segment_rows(lines: DataFrame, key: str, geom: str, prefix: str) -> DataFrame:
    """A row for each segment of lines and rings: key, number, segment, and the segments of its line; names with a prefix."""
    found = lines.select(F.col(key).alias(f"{prefix}_key"), S.segments(F.col(geom)).alias("_all"))
    return found.select(f"{prefix}_key", F.size("_all").alias(f"{prefix}_n"), F.posexplode("_all").alias(f"{prefix}_id", f"{prefix}_s"))


def _semi_by_key(a: DataFrame, b: DataFrame, test: Column, long: DataFrame, a_box: Column, b_box: Column) -> DataFrame:
    """Rows of ``a`` for which ``test`` holds with a row of ``b`` of their key, maybe several times; both are written tables.

    On keys without a long line the rows meet as they are. On the others, the
    keys of ``long``, they meet by boxes, of which few are on such a line at once.
    """
    long = saved(long.distinct(), "long")
    some = not long.isEmpty()
    of = lambda df, side, how: df.join(small(long), F.col(f"{side}_key") == F.col("_long"), how)
    brief = (of(a, "a", "left_anti"), of(b, "b", "left_anti")) if some else (a, b)
    left, right, keys = dealt(brief[0].withColumn("_key", F.col("a_key")), brief[1].withColumn("_key", F.col("b_key")), ["_key"], ["a_id"], ["b_id"])
    other = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    condition = test
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_r{k}"))
    met = left.join(other, condition, "left_semi").select(*a.columns)
    if not some:
        return met
    boxed = of(a, "a", "left_semi").withColumn("a_box", a_box), of(b, "b", "left_semi").withColumn("b_box", b_box)
    return met.unionByName(box_join(*boxed, test, [("a_key", "b_key")], how="left_semi").select(*a.columns))


def _long(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.where(F.col(f"{prefix}_n") > SHORT).select(F.col(f"{prefix}_key").alias("_long"))


def _around(s: Column) -> Column:
    return box_of(F.array(s["a"], s["b"]))


def lines_that_cross(a: DataFrame, b: DataFrame, key: str = "fid", geom: str = "geom") -> DataFrame:
    """(key) of rows whose line in ``a`` properly crosses the line of the same key in ``b``: the segments meet as rows, so that long lines are spread over tasks."""
    left, right = saved(segment_rows(a, key, geom, "a"), "segments"), saved(segment_rows(b, key, geom, "b"), "segments")
    s, t = F.col("a_s"), F.col("b_s")
    met = _semi_by_key(left, right, P.segments_cross(s, t), _long(left, "a").unionByName(_long(right, "b")), _around(s), _around(t))
    return met.select(F.col("a_key").alias(key)).distinct()


def points_on_lines(points: DataFrame, lines: DataFrame, key: str = "fid", pid: str = "ix", lon: str = "lon", lat: str = "lat", geom: str = "geom") -> DataFrame:
    """(key, pid) of points that lie on a segment of the line of their key."""
    at = F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    left = saved(points.select(F.col(key).alias("a_key"), F.col(pid).alias("a_id"), at.alias("a_p")), "points")
    right = saved(segment_rows(lines, key, geom, "b"), "segments")
    p, s = F.col("a_p"), F.col("b_s")
    met = _semi_by_key(left, right, S.on_segment(p, s), _long(right, "b"), box_of(F.array(p)), _around(s))
    return met.select(F.col("a_key").alias(key), F.col("a_id").alias(pid)).distinct()


def _apart(s: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A segment and a box have no point in common."""
    a, b = s["a"], s["b"]
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    sides = F.array(*(dx * (y - a["lat"]) - dy * (x - a["lon"]) for x in (x0, x1) for y in (y0, y1)))
    outside = (F.greatest(a["lon"], b["lon"]) < x0) | (F.least(a["lon"], b["lon"]) > x1) | (F.greatest(a["lat"], b["lat"]) < y0) | (F.least(a["lat"], b["lat"]) > y1)
    return outside | F.forall(sides, lambda v: v > 0) | F.forall(sides, lambda v: v < 0)


def _cell_status(g: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """2 where a box lies inside a part of a polygon away from its rings, 0 where it lies outside all, 1 where only the points can tell."""
    middle = F.struct(((x0 + x1) / 2).alias("lon"), ((y0 + y1) / 2).alias("lat"))

    def of_part(part: Column) -> Column:
        clear = F.forall(part, lambda ring: F.forall(S.pairs(S.closed(ring)), lambda s: _apart(F.struct(_vertex(s["a"]).alias("a"), _vertex(s["b"]).alias("b")), x0, y0, x1, y1)))
        return F.when(~clear, 1).when(S.in_part(middle, part), 2).otherwise(0)

    return F.when(S.is_polygon(g), F.coalesce(F.array_max(F.transform(g["coords"], of_part)), F.lit(0))).otherwise(1)


def _vertex(v: Column) -> Column:
    return F.struct(v[0].alias("lon"), v[1].alias("lat"))


def points_in_polygons(polygons: DataFrame, points: DataFrame, fid: str = "fid", geom: str = "geom", pid: str = "pid", lon: str = "lon", lat: str = "lat", inside: Test | None = None) -> DataFrame:
    """(fid, pid): every point in every polygon, by a grid.

    A polygon is posted to the cells that its box touches, nine at most, of the
    level whose cells are half its size or more; a point is posted once for each
    level in use. So the join is on equal cells, whatever the polygons' sizes.
    Cells with more than CROWD points are cut, as a quadtree would, into as many
    quarters of quarters as their count asks for, for both sides: a polygon
    leaves those it does not touch, and all points of those wholly inside it are
    in it untested. What is crowded even then is dealt over shares. A stream of
    points cannot be counted before, so its cells stay whole.
    """
    inside = inside or S.in_polygon
    box = box_of(S.vertices(F.col(geom)))
    boxed = polygons.select(F.col(fid).alias("fid"), F.col(geom).alias("geom"), box.alias("box")).where("box IS NOT NULL")
    b = F.col("box")
    size = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"], F.lit(2.0**-20))
    leveled = saved(boxed.withColumn("level", (F.ceil(F.log2(size)) - 1).cast("int")), "leveled")
    levels = _levels(leveled, "level")
    posted = _posted(leveled, "box")
    rows = points.select(F.col(pid).alias("pid"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    keyed = rows.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>"))).withColumn("i", cell_of(F.col("lon"), F.col("level"))).withColumn("j", cell_of(F.col("lat"), F.col("level")))
    at = F.struct("lon", "lat")
    in_box = F.col("lon").between(b["x0"], b["x1"]) & F.col("lat").between(b["y0"], b["y1"])
    if points.isStreaming:
        return keyed.join(posted, ["level", "i", "j"]).where(in_box).where(inside(at, F.col("geom"))).select("fid", "pid")
    # a row for each crowded cell that some polygon touches: the quarters it is cut into, as a power of four
    counts = keyed.groupBy("level", "i", "j").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).join(posted.select("level", "i", "j"), ["level", "i", "j"], "left_semi")
    deep = F.least(F.ceil(F.log2(F.col("n") / CROWD) / 2).cast("int") + 1, F.lit(12))
    crowded = saved(counts.select("level", "i", "j", deep.alias("deep")), "crowded-cells")
    if crowded.isEmpty():
        tested = keyed.withColumns({"si": F.lit(0).cast("long"), "sj": F.lit(0).cast("long")}), posted.withColumns({"si": F.lit(0).cast("long"), "sj": F.lit(0).cast("long"), "status": F.lit(1)})
    else:
        step = F.pow(F.lit(2.0), F.col("level") - F.coalesce("deep", F.lit(0)))
        last = F.pow(F.lit(2.0), F.coalesce("deep", F.lit(0))).cast("long") - 1
        low = lambda k: F.col(k) * F.pow(F.lit(2.0), F.col("level"))
        # within the cell, whatever rounding says
        quarter = lambda c, k: F.greatest(F.lit(0).cast("long"), F.least(last, F.floor((c - low(k)) / step).cast("long")))
        fine = keyed.join(small(crowded), ["level", "i", "j"], "left").withColumn("si", quarter(F.col("lon"), "i")).withColumn("sj", quarter(F.col("lat"), "j")).drop("deep")
        cut = posted.join(small(crowded), ["level", "i", "j"], "left")
        cut = cut.withColumn("si", F.explode(F.sequence(quarter(b["x0"], "i"), quarter(b["x1"], "i")))).withColumn("sj", F.explode(F.sequence(quarter(b["y0"], "j"), quarter(b["y1"], "j"))))
        x0, y0 = low("i") + F.col("si") * step, low("j") + F.col("sj") * step
        status = F.when(F.col("deep").isNull(), 1).otherwise(_cell_status(F.col("geom"), x0 - MARGIN, y0 - MARGIN, x0 + step + MARGIN, y0 + step + MARGIN))
        tested = fine, cut.withColumn("status", status).where("status > 0").drop("deep")
    left, right, keys = dealt(*tested, ["level", "i", "j", "si", "sj"], ["pid", "lon", "lat"], ["fid"])
    met = left.join(right, keys).where((F.col("status") == 2) | in_box & inside(at, F.col("geom")))
    return met.select("fid", "pid")
