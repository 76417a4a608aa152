"""Mixing sources to target weights by fitting a subset sum.

A source may take each of its documents up to three times. How many copies of
each exact length it takes is planned from the histogram of lengths alone: an
even share of each length first, rounded up or down by seeded chance, then a
bounded-knapsack dynamic programme over the small remaining budget. A length's
copies go to its documents evenly; which of them get one more follows a seeded
hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, save, small_side

#: Mean lengths that the even share leaves to the dynamic programme at first, and words that bound its memory (five bytes a word).
PROGRAMME_DOCS, PROGRAMME_WORDS = 4, 1 << 24
#: Sources up to which the table of targets is broadcast.
BROADCAST_SOURCES = 1_000_000
#: Slices of the seeded order, ranked one by one.
SLICES = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, have ``weights`` in turn and share all
    sizes by weight; none gets more than ``most`` times its own size, and the
    excess goes to the others by weight. The order is over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighted = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    full = F.col("source_size") * F.lit(float(most))
    by_room = Window.orderBy(full / F.col("weight"), F.col("source").isNull(), "source")
    # sources in order of the level at which they are full; all up to some place are, the rest share what is left
    levels = weighted.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("all"),
        (F.sum(full).over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - full).alias("filled"),
        F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)).alias("weights_left"),
    )
    level = (F.col("all") - F.col("filled")) / F.col("weights_left")
    settled = levels.withColumn("level", F.when(level <= full / F.col("weight"), level))
    return settled.withColumn("level", F.first("level", ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(full, F.col("level") * F.col("weight"))).alias("target"))


def fill_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 42) -> np.ndarray:
    """How many items of each length to take so that their sum comes as near to the budget from below as can be found.

    Every length gives the same share of its items, its last one by seeded
    chance; in seeded order single items then go or come until a small budget is
    left, which the dynamic programme fills from the items not yet taken. Where it
    misses the budget it starts again with more left to it, in the end with all,
    so that no sum within the budget is nearer; PROGRAMME_WORDS bounds its memory
    where lengths are so few and long that this takes more.
    """
    counts = counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    # all sums are multiples of what divides all lengths
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, total, budget = lengths // unit, total // unit, budget // unit
    rng = np.random.default_rng([seed, total, budget])
    chance, order = rng.random(len(lengths)), rng.permutation(len(lengths))
    left = PROGRAMME_DOCS * -(-total // int(counts.sum()))
    best, best_sum = np.zeros(len(lengths), np.int64), -1
    while True:
        take = _even_share(lengths, counts, budget - left, chance, order)
        take = take + _knapsack(lengths, counts - take, budget - int((take * lengths).sum()), order)
        taken = int((take * lengths).sum())
        if taken > best_sum:
            best, best_sum = take, taken
        if best_sum == budget or left >= min(budget, PROGRAMME_WORDS):
            return best
        left *= 4


def _even_share(lengths: np.ndarray, counts: np.ndarray, budget: int, chance: np.ndarray, order: np.ndarray) -> np.ndarray:
    """About the same share of each length, its sum within the budget and short of it by less than any item in ``order`` that was passed by."""
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    share = counts * (budget / int((lengths * counts).sum()))
    take = np.minimum(counts, np.floor(share).astype(np.int64) + (chance < share % 1))
    rest = budget - int((take * lengths).sum())
    for k in order.tolist():
        size = int(lengths[k])
        if rest < 0 and take[k] and chance[k] < share[k] % 1:
            take[k] -= 1
            rest += size
        elif 0 < size <= rest and take[k] < counts[k] and chance[k] >= share[k] % 1:
            take[k] += 1
            rest -= size
    for k in order.tolist() if rest < 0 else []:
        fewer = min(int(take[k]), -(rest // int(lengths[k])))
        take[k] -= fewer
        rest += fewer * int(lengths[k])
        if rest >= 0:
            break
    return take


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """The items whose sum is the largest within the budget; in rounds over ``order``, so that a length's second item comes after the first of all."""
    take = np.zeros(len(lengths), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by_item = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    left = np.where(lengths > 0, np.minimum(counts, budget // np.maximum(lengths, 1)), 0)
    size = 1
    while left.any() and not reached[budget]:
        # rounds of 1, 2, 4, ... items of each length stand for any number of it
        for k in order[left[order] > 0].tolist():
            n = min(size, int(left[k]))
            left[k] -= n
            step = n * int(lengths[k])
            if step <= budget:
                new = reached[: budget + 1 - step] & ~reached[step:]
                by_item[step:][new] = len(items)
                reached[step:] |= new
                items.append((k, n))
            if reached[budget]:
                break
        size *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, n = items[by_item[at]]
        take[k] += n
        at -= n * int(lengths[k])
    return take


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), source, size, source_size, target, taken (words, repeats counted).

    Null and empty texts have size 0 and nothing to take; null is a source of its
    own, the last; rows that repeat an id are documents of their own; other
    columns are not used; an empty table gives no rows. The same rows give the
    same result whatever their order.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))
    sized = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), order.alias("order"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key")), "sizes")
    targets = save(source_targets(sized, weights, most), "targets")
    histogram = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))

    def plan(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        n = lengths["n"].to_numpy(np.int64)
        copies = fill_budget(lengths["size"].to_numpy(np.int64), most * n, int(round(lengths["target"].iloc[0])), seed)
        return pd.DataFrame({"source": lengths["source"], "size": lengths["size"], "n": lengths["n"], "copies": copies // n, "extra": copies % n})

    # a group is one source's distinct lengths, not its documents
    planned = histogram.join(targets, histogram["source"].eqNullSafe(targets["source"])).select(histogram["source"], "size", "n", "source_size", "target")
    planned = save(planned.groupBy("source").applyInPandas(plan, "source string, size long, n long, copies int, extra long"), "plan")
    # ranks within a length: counts of the slices of the seeded order first, then the order within a slice
    cut = sized.withColumn("slice", F.shiftrightunsigned("order", 64 - SLICES.bit_length() + 1))
    slices = cut.groupBy("source", "size", "slice").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source", "size").orderBy("slice")
    ahead = slices.select("source", "size", "slice", (F.sum("m").over(before) - F.col("m")).alias("ahead"), "m")
    ahead = ahead.join(planned.hint("shuffle_hash"), ahead["source"].eqNullSafe(planned["source"]) & (ahead["size"] == planned["size"])).select(ahead["source"], ahead["size"], "slice", "ahead", "m", "copies", "extra")
    some = ahead.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("slice").alias("c"), "copies", F.when(F.col("ahead") + F.col("m") <= F.col("extra"), F.col("m")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("extra") - F.col("ahead"))).alias("here"), "m")
    joined = cut.join(some, cut["source"].eqNullSafe(some["s"]) & (cut["size"] == some["z"]) & (cut["slice"] == some["c"]), "left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("order", "doc_id"))
    ranked = joined.where("here > 0 AND here < m").withColumn("extra", F.when(rank <= F.col("here"), 1).otherwise(0))
    others = joined.where("here IS NULL OR here = 0 OR here = m").withColumn("extra", F.when((F.col("here") > 0) & (F.col("here") == F.col("m")), 1).otherwise(0))
    taken = ranked.unionByName(others).select("doc_id", "text_key", F.col("source").alias("src"), "size", (F.col("size") * (F.coalesce("copies", F.lit(0)) + F.col("extra"))).cast("long").alias("taken"))
    return taken.join(small_side(targets, BROADCAST_SOURCES), taken["src"].eqNullSafe(targets["source"])).select("doc_id", "text_key", "source", "size", "source_size", "target", "taken")


def repeat_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows that share an id and a text share what is taken of them.

    Rows with null or empty texts have no words, so the mix takes none of them; a
    null source is one of its own; an empty table gives an empty one; other
    columns come along as they are.
    """
    mixed = mix_sources(docs, id_col, text_col, **options)
    copies = (F.col("taken") / F.col("size")).cast("int")
    plan = mixed.where("size > 0").groupBy("doc_id", "text_key").agg(F.sum(copies).alias("mix_copies"), F.count("*").alias("mix_rows"))
    plan = save(plan, "copies").select(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), "mix_copies", "mix_rows")
    names = docs.columns
    keyed = docs.select("*", F.xxhash64(F.col(text_col).cast("string")).alias("mix_key_of"))
    joined = keyed.join(plan, F.col(id_col).eqNullSafe(F.col("mix_id")) & (F.col("mix_key_of") == F.col("mix_key")))
    if plan.where("mix_rows > 1").isEmpty():
        times = F.col("mix_copies")
    else:
        others = [c for c in names if c not in (id_col, text_col)]
        place = F.row_number().over(Window.partitionBy(id_col, "mix_key_of").orderBy(*others) if others else Window.partitionBy(id_col, "mix_key_of").orderBy("mix_key_of"))
        joined = joined.withColumn("mix_place", place)
        times = F.expr("mix_copies div mix_rows") + F.when(F.col("mix_place") <= F.expr("mix_copies % mix_rows"), 1).otherwise(0)
    return joined.withColumn("mix_times", times.cast("int")).where("mix_times > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*names)
