"""Quality classifier by co-training.

Two views of a document are separate sources of evidence: its text content (how
often pairs of bytes occur, and how much repeats) and its page metadata (source,
language, recorded size, and how these go together; nothing worked out from the
text). A logistic classifier is fitted to each view on a bounded sample of
labelled documents. Over some rounds each view scores all documents, and hands
the unlabelled ones of which it is most confident to the other view, with the
probability that a calibration on labelled documents set aside for this gives
its guess, and a weight by how much that says beyond the share of good
documents; so a weak view's guesses count for as little as they should. Platt's
scaling on labelled documents that took no part calibrates both views, a last
fit combines them, and every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .fitting import fit_logistic, predict
from .tokens import slices
from .words import split_words

#: Labelled documents that a model is fitted on, at most.
MOST_LABELLED = 12_000
#: Rounds of exchange, and the documents that a view hands over in each (split between the classes as the labels are): the most confident of all unlabelled ones.
ROUNDS, EXCHANGED = 3, 600
#: Log odds are counted in bins of 1 / BINS, up to 20 either way.
BINS = 50
#: A document is kept from this score on; lowered to the point at which at most KEEP_LIMIT of the good calibration documents fall below.
THRESHOLD, KEEP_LIMIT = 0.5, 0.01

#: Widths of the content view, and of the metadata view's parts: source, language, size, and their pairs.
PAIR_BUCKETS = 384
CONTENT_WIDTH = PAIR_BUCKETS + 2
META_PARTS = {"source": 32, "lang": 16, "size": 48, "source lang": 64, "lang size": 64, "source size": 128}
META_WIDTH = sum(META_PARTS.values()) + 2

#: The bucket of each pair of bytes, by a multiplicative hash.
_BUCKET_OF = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIR_BUCKETS


@dataclass(frozen=True)
class QualityModel:
    """Means, scales and weights of each view, their calibrations, the combination, and the threshold."""

    content: tuple[np.ndarray, np.ndarray, np.ndarray]
    meta: tuple[np.ndarray, np.ndarray, np.ndarray]
    content_scale: np.ndarray
    meta_scale: np.ndarray
    combine: np.ndarray
    threshold: float
    #: For each round, how many pseudo-labels content gave to metadata, and metadata to content.
    exchanged: tuple[tuple[int, int], ...] = ()


def content_view(texts: pa.Array) -> np.ndarray:
    """(documents, CONTENT_WIDTH) in half precision: roots of the rates of byte pairs, and shares of repeated words and lines."""
    words = split_words(texts)
    out = np.zeros((len(texts), CONTENT_WIDTH), np.float32)
    raw = words.buf
    n = int(words.offsets[-1])
    if n > 1:
        bucket = _BUCKET_OF[raw[: n - 1].astype(np.int64) << 8 | raw[1:n]]
        for k, (a, b) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
            if b - a > 1:
                out[k, :PAIR_BUCKETS] = np.sqrt(np.bincount(bucket[a : b - 1], minlength=PAIR_BUCKETS) / (b - a))
    codes, _ = words.numbered()
    for k, text in enumerate(texts.to_pylist()):
        some = codes[words.bounds[k] : words.bounds[k + 1]]
        lines = [x for x in (text or "").split("\n") if x]
        out[k, PAIR_BUCKETS] = 1 - len(np.unique(some)) / len(some) if len(some) else 0
        out[k, PAIR_BUCKETS + 1] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out.astype(np.float16)


def meta_view(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """(documents, META_WIDTH): source, language and recorded size in half powers of two, and their pairs, hashed; log size, and whether it is missing."""
    import zlib

    sizes = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    logs = np.log1p(np.maximum(np.nan_to_num(sizes), 0))
    steps = np.where(np.isnan(sizes), -1, np.floor(2 * logs / np.log(2))).astype(np.int64).tolist()
    held = {"source": source.to_pylist(), "lang": lang.to_pylist(), "size": steps}
    out, at, place = np.zeros((len(sizes), META_WIDTH), np.float32), 0, {}
    for part, width in META_PARTS.items():
        columns = [held[name] for name in part.split()]
        for k, value in enumerate(zip(*columns, strict=True)):
            key = (part, value)
            if key not in place:
                place[key] = at + zlib.crc32(repr(value).encode()) % width
            out[k, place[key]] = 1
        at += width
    out[:, at] = logs
    out[:, at + 1] = np.isnan(sizes)
    return out


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    has = set(docs.columns)
    meta = [(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *meta)


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    return mean, np.where(sd > 1e-7, 1 / np.maximum(sd, 1e-7), 0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))[:, None]


Labelled = tuple[np.ndarray, np.ndarray, np.ndarray]
View = tuple[np.ndarray, np.ndarray, np.ndarray]


def _calibration(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    return fit_logistic(logits, y, ridge=1e-3) if len(y) else np.array([1.0, 0.0])


class CoTraining:
    """Both views' fits on (content, meta, y), to which pseudo-labels are added."""

    def __init__(self, labelled: Labelled):
        self.scale = [_standard(v) if len(v) else (np.zeros(v.shape[1]), np.ones(v.shape[1])) for v in labelled[:2]]
        self.x = [self._put(k, labelled[k]) for k in (0, 1)]
        self.y = [labelled[2].astype(float)] * 2
        self.rate = float(labelled[2].mean()) if len(labelled[2]) else 0.5
        self.weight = [np.ones(len(labelled[2]))] * 2
        self.exchanged: list[tuple[int, int]] = []
        self.fit()

    def _put(self, k: int, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.float32) - self.scale[k][0]) * self.scale[k][1]).astype(np.float32)

    def fit(self) -> None:
        self.weights = [fit_logistic(self.x[k], self.y[k], ridge=10.0, weight=self.weight[k]) for k in (0, 1)]

    def views(self) -> tuple[View, View]:
        return tuple((*self.scale[k], self.weights[k]) for k in (0, 1))

    def learn(self, told: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take (features, probabilities) that each view was told by the other, and fit again."""
        for k, (x, p) in enumerate(told):
            if len(p):
                self.x[k], self.y[k] = np.concatenate([self.x[k], self._put(k, x)]), np.concatenate([self.y[k], p])
                self.weight[k] = np.concatenate([self.weight[k], _told(p, self.rate)])
        self.exchanged.append((len(told[1][1]), len(told[0][1])))
        self.fit()

    def finish(self, held: Labelled) -> QualityModel:
        """Calibrate and combine on labelled documents that took no part."""
        views = self.views()
        raw = [_logits(held[k], views[k]) for k in (0, 1)]
        platt = [_calibration(r, held[2]) for r in raw]
        both = np.column_stack([_logit(predict(raw[k], platt[k])) for k in (0, 1)])
        combine = fit_logistic(both, held[2], ridge=1e-3) if len(held[2]) else np.array([0.5, 0.5, 0.0])
        good = predict(both, combine)[held[2] == 1] if len(held[2]) else np.zeros(0)
        threshold = min(THRESHOLD, float(np.quantile(good, KEEP_LIMIT))) if len(good) else 0.0
        return QualityModel(*views, *platt, combine, threshold, tuple(self.exchanged))


def _told(p: np.ndarray, rate: float) -> np.ndarray:
    """What a guess says beyond the rate of good documents, as a share of what the certain label would: a ratio of divergences."""
    p, rate = np.clip(p, 1e-9, 1 - 1e-9), min(max(rate, 1e-3), 1 - 1e-3)
    gained = p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate))
    return gained / -np.log(np.where(p > rate, rate, 1 - rate))


def _logits(x: np.ndarray, view: View) -> np.ndarray:
    mean, scale, w = view
    return _logit(predict((x - mean) * scale, w))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, part, content, source, lang, n_chars) of every whole text: a hash of id and text, a fifth by text, and the content view in half precision."""
    text = F.col("text")
    rows = _columns(docs, id_col, text_col).withColumns({"key": F.xxhash64("doc_id", text), "part": F.pmod(F.xxhash64(text), F.lit(5)).cast("int")})
    names = ["doc_id", "key", "part", "source", "lang", "n_chars"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, batch.schema.get_field_index("text")):
                content = content_view(some.column(some.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(n)) for n in names), pa.array([x.tobytes() for x in content], pa.binary())], [*names, "content"])

    return rows.mapInArrow(each, "doc_id long, key long, part int, source string, lang string, n_chars long, content binary")


def _both(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views from a batch of features."""
    c = {name: batch.column(name) for name in batch.schema.names}
    content = np.frombuffer(b"".join(c["content"].to_pylist()), np.float16).reshape(-1, CONTENT_WIDTH)
    return content, meta_view(c["source"], c["lang"], c["n_chars"])


def _gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """A bounded table of features on the driver."""
    table = rows.toArrow().combine_chunks()
    if not table.num_rows:
        return np.zeros((0, CONTENT_WIDTH)), np.zeros((0, META_WIDTH)), table
    return *_both(table.to_batches()[0]), table


def _most_confident(rows: DataFrame, labels: DataFrame, views: tuple[View, View], wanted: tuple[int, int], used: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the features, in the other view's terms, and the view's own log odds, of the unlabelled documents of which it is most confident, as many of each class as ``wanted`` (bad, good)."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 40 * BINS + 1), np.int64)
        for batch in batches:
            for k, x in enumerate(_both(batch)) if batch.num_rows else ():
                np.add.at(total[k], _bin(_logits(x[~np.isin(batch.column("key").to_numpy(), used[k])], views[k])), 1)
        view, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[view, place])], ["view", "bin", "n"])

    kept = rows.select("key", "content", "source", "lang", "n_chars")
    counts = np.zeros((2, 40 * BINS + 1), np.int64)
    for r in kept.mapInArrow(histogram, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["view"], r["bin"]] = r["n"]
    # those used before do not count; twice as many as wanted, as some have labels; where whole bins hold more, a share of them by the hash
    ends, shares = np.zeros((2, 2), np.int64), np.ones((2, 2))
    for k in (0, 1):
        for good in (0, 1):
            seen = np.cumsum(counts[k][:: -1 if good else 1])
            at = min(int(np.searchsorted(seen, 2 * wanted[good])), len(seen) - 1)
            ends[k, good] = len(seen) - 1 - at if good else at
            shares[k, good] = min(1.0, 3 * wanted[good] / max(1, seen[at]))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            chance = (batch.column("key").to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53
            for k, x in enumerate(_both(batch)):
                place, fresh = _bin(_logits(x, views[k])), ~np.isin(batch.column("key").to_numpy(), used[k])
                for good in (0, 1):
                    hit = ((place >= ends[k, 1]) if good else (place <= ends[k, 0])) & (chance < shares[k, good]) & fresh
                    some = batch.filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(some.num_rows, k, np.int32)), pa.array(np.full(some.num_rows, good, np.int32))], [*some.schema.names, "view", "good"])

    marked = rows.select("key", "content", "source", "lang", "n_chars", "doc_id").mapInArrow(fetch, "key long, content binary, source string, lang string, n_chars long, doc_id long, view int, good int")
    found = save(marked.where("doc_id IS NOT NULL"), "quality-candidates")
    known = labels.join(F.broadcast(found.select("doc_id").distinct()), "doc_id", "left_semi")  # some thousand ids
    content, meta, table = _gathered(found.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_anti").drop("doc_id"))
    out = []
    for k in (0, 1):
        x, other = (content, meta) if k == 0 else (meta, content)
        places, odds = np.zeros(0, np.int64), np.zeros(0)
        if table.num_rows:
            key, view, good = (table[c].to_numpy() for c in ("key", "view", "good"))
            logit = _logits(x, views[k])[:, 0]
            for label in (0, 1):
                mine = np.flatnonzero((view == k) & (good == label))
                mine = mine[np.lexsort((key[mine], -logit[mine] if label else logit[mine]))][: wanted[label]]
                places = np.concatenate([places, mine])
            odds = logit[places]
            used[k] = np.concatenate([used[k], key[places]])
        out.append((other[places], odds))
    return out


def _bin(logits: np.ndarray) -> np.ndarray:
    return (np.clip(np.round(logits[:, 0] * BINS), -20 * BINS, 20 * BINS) + 20 * BINS).astype(np.int64)


def fit(rows: DataFrame, labels: DataFrame, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> QualityModel:
    """Fit on ``rows``, a written table of features: at most MOST_LABELLED labelled ids, the first by a hash, and of all others the most confident.

    Documents with several labels are good if one says so; null labels and rows
    without an id take no part; of the rows of one id the one with the least hash
    stands for all. Copies of a text are on one side of the split between
    fitting, check and calibration. Without labels the model keeps everything.
    """
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    chosen = truth.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(MOST_LABELLED)
    names = ("key", "part", "source", "lang", "n_chars", "content")
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("r"))  # at most MOST_LABELLED rows
    content, meta, table = _gathered(save(one.select("y", *(F.col(f"r.{n}").alias(n) for n in names)), "quality-sample"))
    y, part = (table[c].to_numpy() for c in ("y", "part"))
    labelled, check, held = ((content[some], meta[some], y[some]) for some in (part >= 2, part == 1, part == 0))
    training = CoTraining(labelled)
    wanted = (max(1, round(exchanged * (1 - training.rate))), max(1, round(exchanged * training.rate)))
    used = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for _ in range(rounds if len(labelled[2]) and len(check[2]) else 0):
        views = training.views()
        taught = _most_confident(rows, truth.select("doc_id"), views, wanted, used)
        told = [(x, predict(odds[:, None], _calibration(_logits(check[k], views[k]), check[2]))) for k, (x, odds) in enumerate(taught)]
        training.learn([told[1], told[0]])
    return training.finish(held)


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of features: doc_id, content_score, meta_score, score (0 to 1: good), kept boolean."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                content, meta, p = scores(model, *_both(batch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content), pa.array(meta), pa.array(p), pa.array(p >= model.threshold)], ["doc_id", "content_score", "meta_score", "score", "kept"])

    return rows.select("doc_id", "source", "lang", "n_chars", "content").mapInArrow(each, "doc_id long, content_score double, meta_score double, score double, kept boolean")


def scores(model: QualityModel, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of either view, and combined."""
    both = [predict(_logits(x, view), platt) for x, view, platt in ((content, model.content, model.content_scale), (meta, model.meta, model.meta_scale))]
    return both[0], both[1], predict(np.column_stack([_logit(p) for p in both]), model.combine)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labels and score all documents: doc_id, content_score, meta_score, score, kept.

    A null text counts as empty and gets a score like any other; null metadata is
    a value of its own; rows without an id, and rows that repeat one, are scored
    by what they hold; columns other than the views' are not used; an empty table
    gives no rows.
    """
    rows = save(features(docs, id_col, text_col), "quality-features")
    return score(rows, fit(rows, labels.select("doc_id", "quality")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns; what it needs not to know is passed through."""
    model = fit(save(features(docs, id_col, text_col), "quality-features"), labels.select("doc_id", "quality"))
    has = set(docs.columns)
    names = {"text": text_col, "source": "source", "lang": "lang", "n_chars": "n_chars"}
    missing = {v for v in names.values() if v not in has}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, batch.schema.get_field_index(text_col)):
                c = {role: pa.nulls(some.num_rows, pa.string()) if name in missing else some.column(some.schema.get_field_index(name)) for role, name in names.items()}
                _, _, p = scores(model, content_view(c["text"]), meta_view(c["source"], c["lang"], c["n_chars"]))
                yield some.filter(pa.array(p >= model.threshold))

    return docs.mapInArrow(each, docs.schema)
