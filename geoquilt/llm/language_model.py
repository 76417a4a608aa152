"""Scoring texts with a hierarchical Pitman-Yor bigram model.

Every word is a context with a restaurant of its own; all these restaurants
share one parent, the restaurant of single words, whose base is uniform. In a
restaurant the customers of a word sit at tables, and each table is a customer
of the parent. Seatings are sampled by blocked Gibbs, with two kinds of
auxiliary variables that make all groups of customers independent:

* a gamma variate for each restaurant given its number of tables T, of shape
  strength / discount + T: given it, a word's tables t have the conditional
  distribution P(t) ~ (discount x p)^t S(c, t), see ``restaurant.seat``;
* the parent's own probabilities p, drawn as Dirichlet weights given the
  parent's seating (what its unopened tables hold is spread evenly).

So each pass draws the parent's tables and probabilities from what the contexts
need, then SWEEPS times the contexts' tables from these. Several samples are
kept, and a word's probability is averaged over them.

Data flow. Documents become chunks of a bounded number of words, each with its
distinct words, known by 64-bit hashes. A chunk's distinct pairs go to buckets
by their contexts, where counts are summed; words live on shelves by their
hashes. In a pass buckets and shelves exchange packed arrays: tables by word one
way, the parent's weights the other. Only the pairs seen twice or more take part
(a pair seen once has one table). For scoring a bucket answers the chunks in the
order in which they sent their pairs, so the model is never collected or
broadcast. All counts cover all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, save
from .restaurant import DISCOUNT, gammas, mix, seat, uniforms
from .words import split_words

#: Strength of the context restaurants and of their parent.
CONTEXT_STRENGTH, PARENT_STRENGTH = 4.0, 1.0
#: Passes over all seatings before the samples are taken, samples (one a pass), and sweeps over the contexts in a pass.
BURN_IN, SAMPLES, SWEEPS = 2, 3, 2
#: Bytes of text in a chunk, unless one document is longer; tokens for each bucket of pairs; words of chunks for each shelf.
CHUNK_BYTES, BUCKET_TOKENS, SHELF_WORDS = 20 << 20, 2 << 20, 1 << 20
#: A context of more tokens than a piece is dealt to buckets in quarters of pieces: a 16th of a bucket, or the share at which FREQUENT contexts at most are so frequent.
PIECES, FREQUENT = 16, 10_000
#: Tokens of a chunk for which pairs are worked out at a time.
SLICE = 1 << 18

#: Words are known by the upper 48 bits of their XXH64 in the model, and by all 64 in the base.
SEED = 10
END, START = 1 << 16, 2 << 16

_TOKENS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("n_words", pa.list_(pa.int64())), ("n_distinct", pa.int64()), ("codes", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])
_TOKENS_SQL = "chunk long, doc_ids array<long>, learn array<boolean>, n_words array<long>, n_distinct long, codes binary, hashes binary, counts binary"


def tokenize(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, text, learn): the numbers of their words among the chunk's distinct ones, with hashes and training counts of those."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = (np.cumsum(lengths) - lengths) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                words = split_words(some.column(1), lower=True)
                codes, first = words.numbered()
                # numbers by frequency take the fewest bytes
                order = np.argsort(-np.bincount(codes, minlength=len(first)), kind="stable")
                rank = np.empty(len(first), np.int64)
                rank[order] = np.arange(len(first))
                codes, first = rank[codes], first[order]
                hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words.at(first)), np.uint64, len(first))
                n_words = np.diff(words.bounds)
                learn = some.column(2).to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(codes[np.repeat(learn, n_words)], minlength=len(first))
                row = (chunk, some.column(0).to_pylist(), learn, n_words, len(first), _put(codes, 4), _put(hashes, 8), _put(counts, 4))
                yield _rows(_TOKENS, [[x] for x in row])
                chunk += 1

    return docs.mapInArrow(chunks, _TOKENS_SQL)


# packed messages: rows of one kind, from one place (of) to another (to), with arrays as bytes
_PACKED = pa.schema([("kind", pa.string()), ("to", pa.int64()), ("of", pa.int64()), *((c, pa.binary()) for c in "abcdefpq"), *((c, pa.float64()) for c in "xyz")])
_PACKED_SQL = "kind string, to long, of long, a binary, b binary, c binary, d binary, e binary, f binary, p binary, q binary, x double, y double, z double"


def _put(numbers: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of whole numbers: all first bytes, then all second ones and so on, compressed."""
    import zstandard

    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _get(raw: bytes, width: int) -> np.ndarray:
    """The numbers that _put packed, unsigned."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


def _count(raw: bytes, width: int = 4) -> np.ndarray:
    return _get(raw, width).view(np.int64)


def _put_steps(places: np.ndarray) -> bytes:
    return _put(np.diff(places, prepend=0), 4)


def _get_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(_count(raw)) & 0xFFFFFFFF


def _rows(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _message(kind: str, to: int, of: int = 0, **values) -> dict:
    return {"kind": kind, "to": int(to), "of": int(of)} | values


def _packed(messages: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(messages, _PACKED)


def _of_kind(table: pa.Table, kind: str) -> list[dict]:
    """The messages of a kind, in order of where they come from."""
    return sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["of"])


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1, append=-1)) if len(values) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _shelf_of(words: np.ndarray, shelves: int) -> np.ndarray:
    """The shelf of words known by 48 bits."""
    return (mix(words) % np.uint64(shelves)).astype(np.int64)


class _Frequent:
    """The contexts that are dealt to several buckets (sorted, by 48 bits), and to how many each."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, piece: int):
        self.words, at = np.unique(words, return_inverse=True)
        self.parts = -(-4 * np.bincount(at, counts, len(self.words)).astype(np.int64) // piece)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among them, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


class _Chunk:
    """One chunk's tokens: each word and an end per document, with the word before it or the start as context.

    Words are numbered by hash, contexts by bucket and hash. A frequent context
    is several contexts, told apart by the word's hash, each with a bucket.
    """

    def __init__(self, row: dict, buckets: int, frequent: _Frequent):
        n_words = np.array(row["n_words"], np.int64)
        hashes = np.concatenate([_get(row["hashes"], 8), np.array([END, START], np.uint64)])
        n = len(hashes)
        order = np.argsort(hashes)
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        self.hashes = hashes[order]
        self.words = self.hashes >> np.uint64(16)
        # a token's numbers take four bytes, and what is worked out for all tokens is so by slices: a task's memory goes by its chunk's tokens
        codes = number.astype(np.int32)[_count(row["codes"])]
        ends = np.cumsum(n_words)
        self.sizes = n_words + 1
        self.word = np.insert(codes, ends, number[n - 2])
        context = np.insert(codes, ends - n_words, number[n - 1])
        del codes
        self.learn = np.repeat(np.array(row["learn"], bool), self.sizes)
        found = frequent.find(self.words)
        parts = np.where(found >= 0, frequent.parts[np.maximum(found, 0)] if len(frequent.parts) else 1, 1)
        first = np.cumsum(parts) - parts
        of = np.repeat(np.arange(n), parts)
        part = np.arange(len(of)) - first[of]
        bucket = (mix(self.words[of] + (part.astype(np.uint64) << np.uint64(48))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        self.context_word, self.context_bucket = of[order], bucket[order]
        self.key = np.empty(len(context), np.int64)
        for k in range(0, len(context), SLICE):
            c, w = context[k : k + SLICE], self.word[k : k + SLICE]
            self.key[k : k + SLICE] = place[first[c] + (self.words[w] % parts[c].astype(np.uint64)).astype(np.int64)] * n + w

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(key of each distinct pair in order of buckets, its training count). The tokens' own keys are given up."""
        key, self.key = self.key, np.zeros(0, np.int64)
        key <<= 1
        key |= self.learn
        key.sort()
        learnt = np.cumsum(key & 1, dtype=np.int32)
        key >>= 1
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        return key[last], np.diff(learnt[last].astype(np.int64), prepend=0)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(key of each distinct pair in order of buckets, the place there of each token's). The tokens' own keys are given up."""
        key, self.key = self.key, np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        place = np.empty(len(key), np.int32)
        place[order] = np.cumsum(first, dtype=np.int32) - 1
        return key[first], place


def _ask_pairs(tokens: DataFrame, buckets: int, frequent: _Frequent) -> DataFrame:
    """A row for each chunk and bucket: contexts and their runs, words, training counts."""
    schema = pa.schema([("to", pa.int64()), ("of", pa.int64()), *((c, pa.binary()) for c in "abcd")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                of = _Chunk(batch.slice(k, 1).to_pylist()[0], buckets, frequent)
                keys, total = of.pairs()
                context, word = np.divmod(keys, len(of.hashes))
                out: list[list] = [[] for _ in schema]
                for a, b in _runs(of.context_bucket[context]):
                    begins = np.flatnonzero(np.diff(context[a:b], prepend=-1))
                    contexts = of.words[of.context_word[context[a:b][begins]]]
                    values = (of.context_bucket[context[a]], batch.column(0)[k].as_py(), _put(contexts, 6), _put(np.diff(begins, append=b - a), 4), _put(of.words[word[a:b]], 6), _put(total[a:b], 4))
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                yield _rows(schema, out)

    return tokens.select("chunk", "learn", "n_words", "codes", "hashes").mapInArrow(each, "to long, of long, a binary, b binary, c binary, d binary")


def _ask_words(tokens: DataFrame, shelves: int) -> DataFrame:
    """A row for each chunk and shelf: the hashes of the chunk's distinct words, the end and the start, in order, and their training counts."""
    schema = pa.schema([("to", pa.int64()), ("of", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                learnt = sum(row["learn"])
                hashes = np.concatenate([_get(row["hashes"], 8), np.array([END, START], np.uint64)])
                counts = np.concatenate([_count(row["counts"]), [learnt, learnt]])
                shelf = _shelf_of(hashes >> np.uint64(16), shelves)
                order = np.lexsort((hashes, shelf))
                pieces = [order[a:b] for a, b in _runs(shelf[order])]
                yield _rows(schema, [[int(shelf[o[0]]) for o in pieces], [row["chunk"]] * len(pieces), [_put(hashes[o], 8) for o in pieces], [_put(counts[o], 4) for o in pieces]])

    return tokens.select("chunk", "learn", "hashes", "counts").mapInArrow(each, "to long, of long, a binary, b binary")


def _sum_words(piece: int):
    def of_shelf(table: pa.Table) -> pa.Table:
        """A shelf's words seen in training (a) and their counts (b); x tokens, y words; a row for each frequent context."""
        shelf = table["to"][0].as_py()
        words, at = np.unique(_joined([_get(x, 8) for x in table["a"].to_pylist()], np.uint64), return_inverse=True)
        counts = np.bincount(at, _joined([_count(x) for x in table["b"].to_pylist()]), len(words)).astype(np.int64)
        words, counts = words[counts > 0], counts[counts > 0]
        token = words != START
        often = [_message("often", shelf, w >> np.uint64(16), x=float(c)) for w, c in zip(words[counts > piece], counts[counts > piece], strict=True)]
        return _packed([_message("words", shelf, a=_put(words, 8), b=_put(counts, 8), x=float(counts[token].sum()), y=float(token.sum())), *often])

    return of_shelf


def _counter(shelves: int, frequent: _Frequent):
    def count(table: pa.Table) -> pa.Table:
        """Sum a bucket's pairs and seat each at one table.

        groups: the contexts (a) that have pairs seen twice or more, their pairs
        seen once (b) and groups (c); each group's word (d) and customers (e); the groups' words (f).
        pairs: 0, 1 or 2 for a distinct pair unseen, seen once, or more often (p);
        pairs seen once of each context (a), and whether it has groups (b).
        asked: the places of a chunk's pairs (p) and contexts (q).
        once, tables: to shelves, words and their pairs seen once, or tables.
        """
        bucket = table["to"][0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: r["of"])
        sent = [[_get(r["a"], 6), _count(r["b"]), _get(r["c"], 6), _count(r["d"])] for r in rows]
        contexts, ctx = np.unique(_joined([x[0] for x in sent], np.uint64), return_inverse=True)
        vocabulary, word = np.unique(_joined([x[2] for x in sent], np.uint64), return_inverse=True)
        pairs, place = np.unique(np.repeat(ctx, _joined([x[1] for x in sent])) * len(vocabulary) + word, return_inverse=True)
        total = np.bincount(place, _joined([x[3] for x in sent]), len(pairs)).astype(np.int64)
        of_context, of_word = np.divmod(pairs, len(vocabulary))
        by_context = lambda some: np.bincount(of_context[some], minlength=len(contexts))
        by_word = lambda some: np.bincount(of_word[some], minlength=len(vocabulary))
        shelf = _shelf_of(vocabulary, shelves)
        by_shelf = np.argsort(shelf, kind="stable")
        more, single = total > 1, total == 1
        held, n_once = by_word(more), by_word(single)
        grouped = by_shelf[held[by_shelf] > 0]
        number = np.zeros(len(vocabulary), np.int64)
        number[grouped] = np.arange(len(grouped))
        once, groups = by_context(single), by_context(more)
        has = groups > 0
        out = [_message("groups", bucket, a=_put(contexts[has], 6), b=_put(once[has], 4), c=_put(groups[has], 4), d=_put(number[of_word[more]], 4), e=_put(total[more], 4), f=_put(vocabulary[grouped], 6))]
        out.append(_message("pairs", bucket, p=_put(np.minimum(total, 2), 1), a=_put(once, 4), b=_put(has, 1)))
        pair_ends, context_ends = (np.cumsum([len(x[k]) for x in sent]).tolist() for k in (2, 0))
        for r, x, e, f in zip(rows, sent, pair_ends, context_ends, strict=True):
            out.append(_message("asked", bucket, r["of"], p=_put_steps(place[e - len(x[2]) : e]), q=_put_steps(ctx[f - len(x[0]) : f])))
        out += _to_shelves("tables", bucket, vocabulary[grouped], held[grouped], shelves)
        some = by_shelf[n_once[by_shelf] > 0]
        out += _to_shelves("once", bucket, vocabulary[some], n_once[some], shelves)
        out += _often(frequent, contexts, once + groups)
        return _packed(out)

    return count


def _to_shelves(kind: str, bucket: int, words: np.ndarray, values: np.ndarray, shelves: int) -> list[dict]:
    """A message to each shelf, of words sorted by shelf, and a number for each."""
    shelf = _shelf_of(words, shelves)
    return [_message(kind, shelf[a], bucket, a=_put(words[a:b], 6), b=_put(values[a:b], 4)) for a, b in _runs(shelf)]


def _often(frequent: _Frequent, contexts: np.ndarray, tables: np.ndarray) -> list[dict]:
    """A message with a bucket's tables of each frequent context."""
    found = frequent.find(contexts)
    return [_message("often", -1, int(frequent.words[k]), x=float(t)) for k, t in zip(found[found >= 0].tolist(), tables[found >= 0].tolist(), strict=True)]


class _Groups:
    """A bucket's groups and their contexts, from its message."""

    def __init__(self, row: dict):
        self.contexts, self.vocabulary = _get(row["a"], 6), _get(row["f"], 6)
        self.once, runs = _count(row["b"]), _count(row["c"])
        self.context = np.repeat(np.arange(len(runs)), runs)
        self.word, self.count = _count(row["d"]), _count(row["e"])
        self.tables = self.once + runs


def _parent(sums: DataFrame) -> tuple[float, float, float]:
    """What all shelves hold together: weights drawn, the parent's tables, its customers."""
    return tuple(map(float, sums.where("kind = 'sums'").agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in "xyz")).first()))


def _totals(tables: DataFrame, frequent: _Frequent) -> np.ndarray:
    """All tables of each frequent context; at most FREQUENT rows."""
    rows = tables.where("kind = 'often'").groupBy("of").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(len(frequent.words))
    if len(rows):
        out[frequent.find(rows["of"].to_numpy(np.uint64))] = rows["x"]
    return out


def _shelver(step: int, parent_gamma: float, base: float, keep: bool):
    def shelve(shelf: pa.Table, told: pa.Table) -> pa.Table:
        """Seat the parent's customers on a shelf, and answer each bucket with weights drawn for its words (a); held (a): what the parent's customers hold of each word, in halves."""
        if not shelf.num_rows:
            return _packed([])
        words = np.unique(_get(_of_kind(shelf, "words")[0]["a"], 8) >> np.uint64(16))
        customers = np.zeros(len(words), np.int64)
        rows = _of_kind(told, "tables")
        places = [np.searchsorted(words, _get(r["a"], 6)) for r in rows]
        for r, at in (*zip(rows, places, strict=True), *((r, np.searchsorted(words, _get(r["a"], 6))) for r in _of_kind(shelf, "once"))):
            customers[at] += _count(r["b"])
        some = np.flatnonzero(customers)
        tables = np.zeros(len(words), np.int64)
        tables[some] = seat(customers[some], np.full(len(some), DISCOUNT * parent_gamma * base), uniforms(words[some], step, 1))
        held = customers - DISCOUNT * tables
        drawn = np.zeros(len(words))
        drawn[some] = gammas(held[some], words[some], step, 2)
        number = int(shelf["to"][0].as_py())
        out = [_message("sums", number, x=float(drawn.sum()), y=float(tables.sum()), z=float(customers.sum()))]
        if keep:
            out.append(_message("held", number, step, a=_put(2 * held, 8)))
        return _packed(out + [_message("drawn", r["of"], number, a=drawn[at].astype("<f4").tobytes()) for r, at in zip(rows, places, strict=True)])

    return shelve


def _seater(step: int, weight: float, spare: float, totals: np.ndarray, frequent: _Frequent, shelves: int, keep: bool):
    def sit(groups: pa.Table, told: pa.Table) -> pa.Table:
        """Seat a bucket's groups given the parent's probabilities and the tables of the last pass.

        state (q): tables of each context; tables: to shelves; seats: tables of each group (p) and context (q).
        """
        if not groups.num_rows:
            return _packed([])
        of = _Groups(_of_kind(groups, "groups")[0])
        bucket = int(groups["to"][0].as_py())
        p = weight * _joined([np.frombuffer(r["a"], "<f4") for r in _of_kind(told, "drawn")], float) + spare
        state = _of_kind(told, "state")
        now = _count(state[0]["q"]) if state else of.tables
        found = frequent.find(of.contexts)
        t = np.zeros(0, np.int64)
        keys = mix(of.contexts[of.context] + mix(of.vocabulary[of.word]))
        for sweep in range(SWEEPS):
            x = gammas(CONTEXT_STRENGTH / DISCOUNT + now, of.contexts, step, 3, sweep)
            if (often := found >= 0).any():
                # the tables of a context in several buckets are known from the last pass
                x[often] = gammas(CONTEXT_STRENGTH / DISCOUNT + totals[found[often]], of.contexts[often], step, 3, 0)
            t = seat(of.count, DISCOUNT * x[of.context] * p[of.word], uniforms(keys, step, 4, sweep))
            now = of.once + np.bincount(of.context, t, len(of.once)).astype(np.int64)
        out = [_message("state", bucket, q=_put(now, 4))]
        out += _to_shelves("tables", bucket, of.vocabulary, np.bincount(of.word, t, len(of.vocabulary)), shelves) + _often(frequent, of.contexts, now)
        if keep:
            out.append(_message("seats", bucket, step, p=_put(t, 4), q=_put(now, 4)))
        return _packed(out)

    return sit


_REPLY = pa.schema([("chunk", pa.int64()), ("of", pa.int64()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary())])
_REPLY_SQL = "chunk long, of long, kind string, a binary, b binary"


def _answer_pairs():
    def answer(bucket: pa.Table, seats: pa.Table) -> pa.Table:
        """What the model holds of each pair (a), averaged over the samples, and each sample's tables of its contexts (b), in the order in which a chunk asked."""
        summed = _of_kind(bucket, "pairs")
        if not summed:
            return _REPLY.empty_table()
        count, samples = _count(_of_kind(bucket, "groups")[0]["e"]), _of_kind(seats, "seats")
        kinds, once, has = _count(summed[0]["p"], 1), _count(summed[0]["a"]), _count(summed[0]["b"], 1) > 0
        held = np.where(kinds == 1, 1 - DISCOUNT, 0.0)
        held[kinds == 2] = count - DISCOUNT * np.mean([_count(r["p"]) for r in samples], axis=0)
        tables = np.tile(once, (len(samples), 1))
        tables[:, has] = np.stack([_count(r["q"]) for r in samples])
        # those of a context in several buckets are told from the context's own by the chunk
        rows = _of_kind(bucket, "asked")
        planes = lambda x: _put(x.astype("<f4").view("<u4"), 4)
        out = [(r["of"], r["to"], "pairs", planes(held[_get_steps(r["p"])]), _put(tables[:, _get_steps(r["q"])].ravel(), 4)) for r in rows]
        return pa.Table.from_batches([_rows(_REPLY, list(map(list, zip(*out, strict=True))))]) if out else _REPLY.empty_table()

    return answer


def _answer_words(asked: pa.Table, shelf: pa.Table) -> pa.Table:
    """Training counts (a) of the words that a chunk asks for, and what the parent's customers hold of them in each sample (b), in halves."""
    known = _of_kind(shelf, "words")
    words = np.append(_get(known[0]["a"], 8) if known else np.zeros(0, np.uint64), np.uint64(2**64 - 1))
    counts = np.append(_count(known[0]["b"], 8) if known else np.zeros(0, np.int64), 0)
    short, at_short = np.unique(words >> np.uint64(16), return_inverse=True)
    held = np.stack([_count(r["a"], 8) for r in _of_kind(shelf, "held")]) if known else np.zeros((SAMPLES, 0), np.int64)
    held = np.pad(held, ((0, 0), (0, len(short) - held.shape[1])))[:, at_short]
    out: list[list] = [[] for _ in _REPLY]
    for r in asked.to_pylist():
        w = _get(r["a"], 8)
        at = np.searchsorted(words[:-1], w)
        at = np.where(words[at] == w, at, len(words) - 1)
        for o, v in zip(out, (r["of"], r["to"], "words", _put(counts[at], 8), _put(held[:, at].ravel(), 8)), strict=True):
            o.append(v)
    return pa.Table.from_batches([_rows(_REPLY, out)])


def _predictive(parents: list[tuple[float, float, float]], base: float) -> tuple[list[float], list[float]]:
    """For each sample the parent's probability of an unknown word, and what each unit that it holds of a word adds."""
    return [(PARENT_STRENGTH + DISCOUNT * r) / (PARENT_STRENGTH + c) * base for _, r, c in parents], [1 / (PARENT_STRENGTH + c) for *_, c in parents]


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens (long), base_score, score.

    Learns from the rows for which ``learn`` (a condition on doc_id) holds, and
    scores all. A token is a word, A-Z as a-z, or a document's end; n_known
    tokens occur in training; train_tokens is how many there are in training;
    base_score is the log10 probability by add-one counts of single words, score
    that of the model. A null text is empty and has the end only; a row without
    an id is scored, and learnt if ``learn`` holds; rows that repeat an id are
    documents of their own; other columns are not used; an empty table gives no
    rows. Without training tokens every token has the base's probability. All
    draws follow the words, so the scores do not depend on partitions.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    tokens = save(tokenize(source), "lm-tokens")
    spark = docs.sparkSession
    size = tokens.select(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), "n_distinct")
    n_all, n_asked = (int(x) for x in size.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first())
    buckets, shelves = (max(1, -(-n // most)) for n, most in ((n_all, BUCKET_TOKENS), (n_asked, SHELF_WORDS)))

    piece = max(BUCKET_TOKENS // PIECES, n_all // FREQUENT)
    words = save(_ask_words(tokens, shelves).groupBy("to").applyInArrow(_sum_words(piece), _PACKED_SQL), "lm-words")
    shelf = words.where("kind = 'words'")
    n_train, n_distinct = (int(x) for x in shelf.agg(F.coalesce(F.sum("x"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first())
    base = 1 / (n_distinct + 1)
    often = words.where("kind = 'often'").select("of", "x").toPandas()  # at most FREQUENT rows
    frequent = _Frequent(often["of"].to_numpy(np.uint64), often["x"].to_numpy(float), piece)

    first = save(_ask_pairs(tokens, buckets, frequent).groupBy("to").applyInArrow(_counter(shelves, frequent), _PACKED_SQL), "lm-pairs")
    release(spark)
    groups = first.where("kind = 'groups'").select("kind", "to", "of", *"abcdef")
    words = save(shelf.unionByName(first.where("kind = 'once'")).select("kind", "to", "of", "a", "b"), "lm-shelves")

    tables, totals, n_parent = first, _totals(first, frequent), float(n_distinct)
    seats, held, samples, parents = [], [], [], []
    # a pass seats the parent's customers, then the contexts' given what the parent drew; a sample is one of the latter with the parent that follows it
    for step in range(BURN_IN + SAMPLES + 1):
        gamma = float(gammas(np.array([PARENT_STRENGTH / DISCOUNT + n_parent]), np.array([START], np.uint64), step, 0)[0])
        asked = tables.where("kind = 'tables'").select("kind", "to", "of", "a", "b")
        keep = step > BURN_IN
        drawn = save(words.groupBy("to").cogroup(asked.groupBy("to")).applyInArrow(_shelver(step, gamma, base, keep), _PACKED_SQL), "lm-drawn")
        total, n_parent, customers = _parent(drawn)
        if keep:
            held.append(drawn.where("kind = 'held'").select("kind", "to", "of", "a"))
            parents.append((total, n_parent, customers))
        if step == BURN_IN + SAMPLES:
            break
        rest = float(gammas(np.array([PARENT_STRENGTH + DISCOUNT * n_parent]), np.array([END], np.uint64), step, 0)[0])
        told = drawn.where("kind = 'drawn'").select("kind", "to", "of", "a", F.lit(None).cast("binary").alias("q"))
        if step:
            told = told.unionByName(tables.where("kind = 'state'").select("kind", "to", "of", F.lit(None).cast("binary").alias("a"), "q"))
        sit = _seater(step, 1 / (total + rest), rest / (total + rest) * base, totals, frequent, shelves, step >= BURN_IN)
        last, tables = tables, save(groups.groupBy("to").cogroup(told.groupBy("to")).applyInArrow(sit, _PACKED_SQL), "lm-seats")
        totals = _totals(tables, frequent)
        if step >= BURN_IN:
            seats.append(tables.where("kind = 'seats'").select("kind", "to", "of", "p", "q"))
            samples.append(totals)
        # what later steps do not read
        release(spark)
        if step and step <= BURN_IN:
            discard(last)
        if not keep:
            discard(drawn)

    union = lambda some: some[0] if len(some) == 1 else union(some[: len(some) // 2]).unionByName(union(some[len(some) // 2 :]))
    bucket = first.where("kind IN ('groups', 'pairs', 'asked')").select("kind", "to", "of", F.when(F.col("kind") == "pairs", F.col("a")).alias("a"), F.when(F.col("kind") == "pairs", F.col("b")).alias("b"), "e", "p", "q")
    pair_replies = bucket.groupBy("to").cogroup(union(seats).groupBy("to")).applyInArrow(_answer_pairs(), _REPLY_SQL)
    shelved = words.where("kind = 'words'").select("kind", "to", "of", "a", "b").unionByName(union(held).withColumn("b", F.lit(None).cast("binary")))
    word_replies = _ask_words(tokens, shelves).groupBy("to").cogroup(shelved.groupBy("to")).applyInArrow(_answer_words, _REPLY_SQL)
    log_rest, n_samples = -np.log10(n_train + n_distinct + 1), SAMPLES
    unknown, unit = (np.array(x)[:, None] for x in _predictive(parents, base))

    def finish(chunk: pa.Table, told: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        of = _Chunk(row, buckets, frequent)
        asked, answers = _of_kind(told, "words"), _of_kind(told, "pairs")
        n = len(of.hashes)
        # words were asked for by shelf and hash
        by_shelf = np.lexsort((of.hashes, _shelf_of(of.words, shelves)))
        c, p = np.zeros(n, np.int64), np.zeros((n_samples, n))
        c[by_shelf] = _joined([_count(r["a"], 8) for r in asked])
        p[:, by_shelf] = unknown + unit / 2 * np.concatenate([_count(r["b"], 8).reshape(n_samples, -1) for r in asked], axis=1)
        keys, place = of.distinct()
        context, w = np.divmod(keys, n)
        held = _joined([_get(r["a"], 4).astype("<u4").view("<f4") for r in answers]).astype(float)
        begins = np.diff(context, prepend=-1) != 0
        run = np.cumsum(begins) - 1
        tables = np.concatenate([_count(r["b"]).reshape(n_samples, -1) for r in answers], axis=1)
        # a context in several buckets has the tables of all of them
        often = frequent.find(of.words[of.context_word[context[begins]]])
        tables = np.where(often >= 0, np.array(samples).reshape(n_samples, -1)[:, often] if len(frequent.words) else 0, tables)
        seen = c[of.context_word[context]].astype(float)
        over, below = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(n_samples):
            above = np.where(c[w] > 0, p[k, w], unknown[k])
            over += above
            below += (CONTEXT_STRENGTH + DISCOUNT * tables[k, run]) * above
        mean = np.where(seen > 0, (held + below / n_samples) / (CONTEXT_STRENGTH + seen), over / n_samples)
        starts = np.cumsum(of.sizes) - of.sizes
        by_doc = lambda x: np.add.reduceat(x, starts)
        known = c[of.word]
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(of.sizes), "n_known": pa.array(by_doc((known > 0).astype(np.int64))), "base_score": pa.array(by_doc(np.log10(known + 1) + log_rest)), "score": pa.array(by_doc(np.log10(mean)[place]))})

    replies = word_replies.unionByName(pair_replies)
    scored = tokens.select("chunk", "doc_ids", "learn", "n_words", "codes", "hashes").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
