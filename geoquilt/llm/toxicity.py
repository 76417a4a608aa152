"""Toxicity by compression distance.

zstandard trains three dictionaries: one on words that set toxic documents
apart, one of the same size on ordinary windows, and a larger common one on
other ordinary windows, which follows either of the two, so that usual words
cost the same with both. Which words of toxic documents to train on is decided
by contrast: those that begin with letters, or are words, found in far more
toxic documents than ordinary ones would lead to expect, by a bound that allows
for how many of them are tried. The trainer takes one segment from each stretch
of its samples, so samples come in an order that has nothing to do with what
they hold: equal ones side by side would fill stretches of their own and leave
most words out. A text is cut into
windows of a few words; a window that the toxic side shortens more than the
ordinary one speaks for toxicity. How often a text's windows differ by how many
bytes is turned into a probability by a calibration on labelled documents that
the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, crc_mod, save
from .fitting import fit_logistic, predict

#: Labelled documents from which a model is fitted, at most, by class; half make dictionaries, half calibrate.
MOST_TOXIC, MOST_ORDINARY = 6_000, 12_000
#: Words of a window, bytes of the common and of a class's own dictionary at most, zstandard's level, and the sizes of the segments it trains with.
WINDOW, COMMON_BYTES, OWN_BYTES, LEVEL, SEGMENT, MATCH = 4, 32_768, 4_096, 12, 32, 6
#: Samples of a class that dictionaries are trained on, at most: the first by a hash of text and place.
MOST_WINDOWS = 60_000
#: Differences in bytes are counted from -CLIP to CLIP.
CLIP = 10
#: A beginning of these lengths, or a word, marks toxic documents if fewer than CHANCE of all that are tried would be in so many of them by chance.
BEGINNINGS, CHANCE = (3, 4, 5, 6, 7, 8, 10), 0.01
#: From this score on a text is predicted to be toxic.
THRESHOLD = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    """The contents of both sides' dictionaries and the calibration's weights (none yet: empty)."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()


def windows(text: str | None) -> list[bytes]:
    """A text's words in lower case, WINDOW at a time, with a space at either end."""
    words = (text or "").lower().encode(errors="replace").split()
    return [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, len(words), WINDOW)]


class _Compressors:
    def __init__(self, model: ToxicityModel):
        import zstandard

        self.pair = []
        for content in (model.ordinary, model.toxic):
            # the trained content alone: entropy tables of their own would set the two sides apart on all texts
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def differences(self, text: str | None) -> np.ndarray:
        """How many bytes each window is shorter with the toxic dictionary."""
        ordinary, toxic = self.pair
        found = windows(text)
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in found), np.int64, len(found))

    def features(self, text: str | None) -> np.ndarray:
        """Shares and log counts of the windows by difference, the largest ones, the number of windows, and the mean."""
        found = self.differences(text)
        counts = np.bincount(np.clip(found, -CLIP, CLIP) + CLIP, minlength=2 * CLIP + 1)[CLIP + 2 :].astype(float)
        at_least = np.cumsum(counts[::-1])[::-1]
        top = np.sort(np.clip(found, -CLIP, 2 * CLIP))[-3:] if len(found) else np.zeros(1)
        return np.concatenate([10 * at_least / max(1, len(found)), np.log1p(at_least), [top.max() / 4, top.mean() / 4, np.log1p(len(found)), found.mean() if len(found) else 0]])


_COMPRESSORS: dict[ToxicityModel, _Compressors] = {}
N_FEATURES = 2 * (CLIP - 1) + 4


def _compressors(model: ToxicityModel) -> _Compressors:
    if model not in _COMPRESSORS:
        _COMPRESSORS.clear()
        _COMPRESSORS[model] = _Compressors(model)
    return _COMPRESSORS[model]


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes or less, trained by zstandard; where it finds too little in the samples, the last of them as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _markers(sample: DataFrame) -> list[str]:
    """Beginnings of words, and whole words with a space, that mark the toxic documents of a bounded sample (toxic, text)."""
    stripped = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), F.lit(0)), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    words = sample.select("toxic", F.array_distinct(F.filter(stripped, lambda w: F.length(w) >= 2)).alias("words"))
    begun = F.flatten(F.transform("words", lambda w: F.array(F.concat(w, F.lit(" ")), *(F.when(F.length(w) >= k, F.substring(w, 1, k)) for k in BEGINNINGS))))
    counts = words.select("toxic", F.explode(F.array_distinct(F.array_compact(begun))).alias("mark")).groupBy("mark").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("o"))
    tried = save(counts.where("t > 0"), "toxic-marks")
    n_tried = max(1, tried.count())
    n_toxic, n_ordinary = (max(1, sample.where(F.col("toxic") == k).count()) for k in (1, 0))
    expected = (F.col("o") + 1) / (n_ordinary + 1) * n_toxic
    # Chernoff's bound: a Poisson count reaches t with a probability of exp(-surprise) at most
    surprise = F.col("t") * F.log(F.col("t") / expected) - F.col("t") + expected
    found = tried.where((F.col("t") > expected) & (surprise >= math.log(n_tried / CHANCE)))
    return sorted(r["mark"] for r in found.select("mark").collect())


def _train_sides(sample: DataFrame) -> ToxicityModel:
    """Both sides' dictionaries from a bounded sample (toxic, text)."""
    marks = frozenset(_markers(sample))

    def marked(word: str) -> bool:
        bare = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        return f"{bare} " in marks or any(bare[:k] in marks for k in BEGINNINGS if len(bare) >= k)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # toxic texts give their marked words, ordinary ones their windows
                found = [f" {w} ".encode(errors="replace") for w in (text or "").lower().split() if marked(w)] if toxic else windows(text)
                at = pa.array(range(len(found)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array([key] * len(found), pa.int64()), at, pa.array(found, pa.binary())], ["toxic", "key", "at", "window"])

    keyed = sample.select("toxic", "text", F.xxhash64("text").alias("key"))
    found = save(keyed.mapInArrow(each, "toxic int, key long, at int, window binary"), "toxic-windows")
    # by text and place, not by content: the trainer would leave out most of what stands beside its equals
    order = F.xxhash64(F.lit(5), "key", "at")
    words, ordinary = ([bytes(r["window"]) for r in found.where(F.col("toxic") == k).orderBy(order, "key", "at", "window").limit(MOST_WINDOWS).select("window").collect()] for k in (1, 0))
    toxic = train(words, OWN_BYTES)
    # the ordinary side and the common part are trained on windows of their own
    cut = min(len(words), len(ordinary) // 2)
    own, common = train(ordinary[:cut], max(256, len(toxic))), train(ordinary[cut:], COMMON_BYTES)
    size = max(len(toxic), len(own))
    return ToxicityModel((toxic or own).rjust(size) + common, own.rjust(size) + common)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None) -> ToxicityModel:
    """Fit on labelled documents: at most MOST_TOXIC and MOST_ORDINARY ids, the first of each class by a hash.

    ``learn`` is a condition on doc_id. Documents with several labels are toxic if
    one says so; null labels do not count; of the rows of one id the text with
    the least hash stands for all. Without toxic labels every score is low.
    """
    truth = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if learn is not None:
        truth = truth.where(learn)
    order = F.xxhash64(F.lit(7), "doc_id")
    parts = [truth.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, MOST_TOXIC), (0, MOST_ORDINARY))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most MOST_TOXIC + MOST_ORDINARY rows of 12 bytes
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # copies of a text count once in a class, and are in the same half
    sample = save(one.dropDuplicates(["toxic", "text"]).select("toxic", "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")), "toxic-sample")
    model = _train_sides(sample.where("half = 0"))
    rows = _features(sample.where("half = 1"), model).toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, N_FEATURES))
    weights = fit_logistic(x, rows["toxic"].to_numpy(float), ridge=0.3)
    return ToxicityModel(model.toxic, model.ordinary, tuple(weights.tolist()))


def _features(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _compressors(model)
            x = [made.features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return sample.select("toxic", "text").mapInArrow(each, "toxic int, x array<double>")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted int. A null text is empty; an empty text gets the score of no evidence."""
    weights = np.array(model.weights)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _compressors(model)
            x = np.array([made.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            p = predict(x, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, score double, predicted int")


def score_held_out(docs: DataFrame, labels: DataFrame, modulus: int = 3, fold: int = 1) -> DataFrame:
    """Fit on labelled documents outside a fold of ids and score all: doc_id, held_out, score, predicted.

    The fold: crc32 of the id's text, modulo ``modulus``, is ``fold``. Labels,
    language, source and id are no inputs of a score. Rows without an id are
    scored (held_out null); rows that repeat an id are scored by their texts;
    an empty table gives no rows; columns that clash with others play no part.
    """
    own = labels.select("doc_id", "toxic")
    model = fit(docs, own, learn=crc_mod("doc_id", modulus) != fold)
    scored = score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", modulus) == fold).alias("held_out"), "score", "predicted")
