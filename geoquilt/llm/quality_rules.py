"""Quality rules whose thresholds hold false rejections below a limit.

Four ratios are measured on every text. For each stratum and rule a fixed list
of cutoffs is tried from the most lenient down: a cutoff is certified if the
exact binomial test on labelled good documents rejects "it turns away more than
its share of the limit" at the level left by Bonferroni's correction over all
strata and rules, and the first failure ends the list (fixed-sequence testing).
So with probability 1 - ``error`` or more, no stratum loses more than ``limit``
of its good documents to the rules. A trial is one text, however many documents repeat
it, since copies pass or fail together. Where labels are too few, no cutoff can
be certified and the rule turns nothing away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small_side
from .words import split_words

#: The share of a stratum's good documents that all rules together may turn away, and the chance that the guarantee fails.
LIMIT, ERROR = 0.02, 0.05
#: Cutoffs are k / STEPS for k from STEPS down to 1; a document at or above its cutoff is turned away.
STEPS = 200
#: Rule: numerator and denominator among the measured columns.
RATIOS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "word_chars")}
#: Strata up to which the table of cutoffs is broadcast.
BROADCAST_STRATA = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_WORD_START = np.ones(256, bool)
_WORD_START[0x80:0xC0] = False
_WORD_START[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def _in_bounds(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each two bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(codes: np.ndarray, bounds: np.ndarray, window: int = 3) -> np.ndarray:
    """For each document the number of its words that lie in a window of words found twice or more in it."""
    n = len(codes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(np.arange(n) + window <= bounds[1:][doc]) if n else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(len(bounds) - 1, np.int64)
    key = doc[starts]
    for k in range(window):
        key = pd.factorize(key * (int(codes.max()) + 1) + codes[starts + k])[0]
    twice = starts[np.bincount(key)[key] > 1]
    covered = np.zeros(n + window, bool)
    for k in range(window):
        covered[twice + k] = True
    return _in_bounds(covered[:n], bounds)


def _lines(text: str | None) -> tuple[int, int]:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, and COUNTS (long) of every whole text; a null text counts as empty."""
    kept = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"kept_{c}") for c in keep), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), *(f"{c} long" for c in COUNTS)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                some = batch.slice(k, 1_000)
                texts = some.column(some.num_columns - 1)
                words = split_words(texts)
                lines = np.array([_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
                raw = words.buf[: int(words.offsets[-1])]
                counts = [np.diff(words.bounds), _in_bounds(_WORD_START[raw], words.offsets), _in_bounds(_SYMBOL[raw], words.offsets), lines[:, 1], repeated_words(words.numbered()[0], words.bounds), lines[:, 0], _in_bounds(_CAPITAL[raw], words.offsets)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *(pa.array(c.astype(np.int64)) for c in counts)], [*some.schema.names[:-1], *COUNTS])

    return kept.mapInArrow(each, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed from the largest term down until terms no longer count."""
    if k >= n:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    if k > n * p:  # past the mean, where no cutoff is certified: the other tail falls from k + 1 on
        term, total, j = math.exp(log_term), 0.0, k
        while j < n:
            term *= (n - j) / (j + 1) * p / (1 - p)
            total, j = total + term, j + 1
            if term < total * 1e-17:
                break
        return max(0.0, 1 - total)
    term = total = math.exp(log_term)
    for j in range(k, 0, -1):
        term *= j / (n - j + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)


def certify(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, error: float = ERROR, steps: int = STEPS) -> DataFrame:
    """(stratum, and for each rule cut_<rule> int: the strictest certified cutoff, null if none).

    ``measured`` has doc_id, stratum, text_key (equal for equal texts) and COUNTS
    of documents that pass the base rules; ``labels`` has doc_id and quality. Only
    sums over good texts by stratum, rule and step leave the tasks.

    Trials are distinct: an id counts once, by its text with the least key; a
    text counts once in a stratum. An id labelled both good and bad is no trial,
    and neither is a text of which one copy is good and another bad.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least"))
    names = list(RATIOS)
    steps_of = F.array(*(F.struct(F.lit(r).alias("rule"), _step(r, steps).alias("step")) for r in names))
    row = F.struct("text_key", "stratum", steps_of.alias("steps"), "least")
    by_id = measured.join(marks, "doc_id").groupBy("doc_id").agg(F.min_by(row, F.struct("text_key", "stratum")).alias("t")).select("t.*")
    # copies of one text have the same ratios, so any of their rows will do
    by_text = by_id.groupBy("stratum", "text_key").agg(F.min("least").alias("least"), F.first("steps").alias("steps")).where("least = 1")
    held = by_text.select("stratum", F.explode("steps").alias("x")).select("stratum", "x.rule", "x.step")
    counts = save(held.groupBy("stratum", "rule", "step").agg(F.count("*").alias("n")), "holdout")
    n_strata = max(1, counts.select(F.count_distinct(F.struct("stratum"))).first()[0])
    level, share = error / (n_strata * len(names)), limit / len(names)

    def strictest(some: pd.DataFrame) -> pd.DataFrame:
        by_step = np.bincount(some["step"].to_numpy(np.int64), some["n"].to_numpy(float), steps + 1).astype(np.int64)
        total, lost, cut = int(by_step.sum()), 0, None
        for k in range(steps, 0, -1):
            lost += int(by_step[k])
            if binomial_tail(lost, total, share) > level:
                break
            cut = k
        return pd.DataFrame({"stratum": some["stratum"].iloc[:1], "rule": some["rule"].iloc[:1], "cut": pd.array([cut], "Int32")})

    # a group is one stratum's histogram of one rule: steps + 1 rows at most
    cuts = counts.groupBy("stratum", "rule").applyInPandas(strictest, f"stratum {measured.schema['stratum'].dataType.simpleString()}, rule string, cut int")
    return save(cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in names)), "cutoffs")


def _step(rule: str, steps: int) -> Column:
    """The ratio in whole steps, rounded down; 0 where there is nothing to divide by."""
    over, under = RATIOS[rule]
    return F.expr(f"CAST(least({steps}, ({over} * {steps}) div greatest({under}, 1)) AS INT)")


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """One row per document: doc_id, stratum, COUNTS, base_failed, kept.

    base_failed: fewer than 50 words, or more than half its words in repeated
    windows. Null is a stratum of its own; rows without an id are judged but are
    no holdout; a row that repeats an id is judged by itself; labels without a
    document, null, or neither 0 nor 1 are not used; with no labels only the base decides; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text"))
    measured = save(measure(source, keep=("stratum", "text_key")), "measured").withColumnsRenamed({"kept_stratum": "stratum", "kept_text_key": "text_key"})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    cuts = certify(measured.where("NOT base_failed"), labels, limit, error).withColumnRenamed("stratum", "of")
    judged = measured.join(small_side(cuts, BROADCAST_STRATA), F.col("stratum").eqNullSafe(F.col("of")), "left")
    passes = [F.coalesce(_step(r, STEPS) < F.col(f"cut_{r}"), F.lit(True)) for r in RATIOS]
    kept = ~F.col("base_failed")
    for ok in passes:
        kept = kept & ok
    return judged.select("doc_id", "stratum", *COUNTS, "base_failed", kept.alias("kept"))
