"""Token-id output in Re-Pair grammar files, with random access to each document.

Documents are dealt to tasks by ranges of doc_id, sorted, encoded and cut into
shards of about ``shard_tokens`` ids. In each shard frequent pairs of ids are
replaced by nonterminals, round after round until none is left. A shard is one row of a Parquet
table, so Spark's committer makes the files safe against lost executors:

    part, shard    its place: parts in order, and shards in each part
    doc_ids        the ids of its documents, in order
    n_tokens       the number of token ids of each of them
    n_symbols      the number of symbols of each of them in ``symbols``
    symbols        little-endian uint32: token ids, and rule k as ``first_rule + k``
    rules          little-endian uint32 pairs: what each rule stands for
    rule_lengths   little-endian uint32: the number of token ids below each rule
    first_rule     the smallest number that is not a token id of the shard

A pair never begins with a document's last symbol, so each document is a run of
whole symbols, and ``rule_lengths`` lead to any token within it without
expanding what lies before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import save, small_side
from .tokens import encoder, slices, with_end

#: Shards up to which the table of their first tokens' places is broadcast.
BROADCAST_SHARDS = 2_000_000

SHARD_SCHEMA = StructType(
    [
        StructField("part", IntegerType()),
        StructField("shard", IntegerType()),
        StructField("doc_ids", ArrayType(LongType())),
        StructField("n_tokens", ArrayType(LongType())),
        StructField("n_symbols", ArrayType(LongType())),
        StructField("symbols", BinaryType()),
        StructField("rules", BinaryType()),
        StructField("rule_lengths", BinaryType()),
        StructField("first_rule", LongType()),
    ]
)


@dataclass
class Grammar:
    """symbols: the shortened sequence; rules: (k, 2) pairs; lengths: token ids below each rule; first_rule: the number of rule 0; sizes: symbols of each document."""

    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    first_rule: int
    sizes: np.ndarray

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """(the token ids below every rule one after the other, where each rule's begin)."""
        flat = np.zeros(int(self.lengths.sum()), np.uint32)
        starts = np.cumsum(self.lengths) - self.lengths
        for k, (left, right) in enumerate(self.rules.tolist()):
            at = int(starts[k])
            for symbol in (left, right):
                if symbol < self.first_rule:
                    flat[at] = symbol
                    at += 1
                else:
                    r = symbol - self.first_rule
                    n = int(self.lengths[r])
                    flat[at : at + n] = flat[starts[r] : starts[r] + n]
                    at += n
        return flat, starts

    def decode(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The token ids of the symbols begin:end."""
        symbols = self.symbols[begin:end].astype(np.int64)
        flat, starts = self.expansions()
        pool = np.concatenate([flat, symbols.astype(np.uint32)])
        is_rule = symbols >= self.first_rule
        lengths, sources = np.ones(len(symbols), np.int64), len(flat) + np.arange(len(symbols))
        rule = symbols[is_rule] - self.first_rule
        lengths[is_rule], sources[is_rule] = self.lengths[rule], starts[rule]
        ends = np.cumsum(lengths)
        return pool[np.repeat(sources - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, k: int) -> np.ndarray:
        """The token ids of document k alone."""
        return self.tokens(k)

    def tokens(self, k: int, i: int = 0, j: int | None = None) -> np.ndarray:
        """The token ids i:j of document k; only the rules on the way to them are opened."""
        begin = int(self.sizes[:k].sum())
        symbols = self.symbols[begin : begin + int(self.sizes[k])].astype(np.int64)
        lengths = np.ones(len(symbols), np.int64)
        is_rule = symbols >= self.first_rule
        lengths[is_rule] = self.lengths[symbols[is_rule] - self.first_rule]
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        i, j = max(0, i), n if j is None else min(j, n)
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last = int(np.searchsorted(ends, i, side="right")), int(np.searchsorted(ends, j))
        at, out = int(ends[first] - lengths[first]), []
        todo = symbols[first : last + 1][::-1].tolist()
        while todo and at < j:
            symbol = todo.pop()
            size = 1 if symbol < self.first_rule else int(self.lengths[symbol - self.first_rule])
            if at + size <= i:
                at += size
            elif symbol < self.first_rule:
                out.append(symbol)
                at += 1
            else:
                left, right = self.rules[symbol - self.first_rule].tolist()
                todo += [right, left]
        return np.array(out, np.uint32)


def _frequent_pairs(seq: np.ndarray, open_: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """Frequent pairs in falling order of frequency, such that no chosen pair's right symbol is another's left one.

    Then no two occurrences overlap, and all of them can be replaced at once.
    """
    bits = 20
    left, right = seq[:-1], seq[1:]
    slot = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.intp)
    slot[~open_[:-1] | (left == right)] = 1 << bits  # a slot for what is no pair
    counts = np.bincount(slot, minlength=(1 << bits) + 1)
    counts[-1] = 0
    often = counts[counts >= least]
    if not often.size:
        return []
    # slots beyond the fullest wait for a later round
    bar = np.partition(often, -2 * most)[-2 * most] if often.size > 2 * most else least
    candidates = np.flatnonzero((counts >= bar)[slot])
    pairs, n = np.unique(left[candidates].astype(np.int64) << 32 | right[candidates], return_counts=True)
    keep = n >= least
    pairs, n = pairs[keep], n[keep]
    role: dict[int, int] = {}
    chosen: list[tuple[int, int]] = []
    for pair in pairs[np.lexsort((pairs, -n))].tolist():
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if role.get(a, 0) == 0 and role.get(b, 1) == 1:
            role[a], role[b] = 0, 1
            chosen.append((a, b))
            if len(chosen) == most:
                break
    return chosen


def _doubled(seq: np.ndarray, open_: np.ndarray, least: int) -> tuple[list[int], np.ndarray]:
    """(symbols that are their own right neighbours ``least`` times or more, every other place within a run counted; these places)."""
    same = np.flatnonzero((seq[:-1] == seq[1:]) & open_[:-1])
    if not len(same):
        return [], same
    # a run's places follow one another and hold one symbol; the first, third and so on are taken
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(same) > 1) | (np.diff(seq[same].astype(np.int64)) != 0)]))
    step = np.arange(len(same)) - np.repeat(begins, np.diff(begins, append=len(same)))
    places = same[step % 2 == 0]
    symbols, counts = np.unique(seq[places], return_counts=True)
    symbols = symbols[counts >= least]
    return symbols.tolist(), places[np.isin(seq[places], symbols)]


def compress(ids: np.ndarray, sizes: np.ndarray, least: int = 16, rules_per_round: int = 4096) -> Grammar:
    """Re-Pair over documents of ``sizes`` ids each.

    Each round replaces up to ``rules_per_round`` pairs that occur ``least`` times
    or more, the most frequent first; then pairs of two equal symbols, from the
    left of each run. It ends when no pair is so frequent.
    """
    seq = ids.astype(np.uint32)
    first_rule = int(seq.max()) + 1 if len(seq) else 0
    last = np.zeros(len(seq), bool)
    ends = np.cumsum(sizes)
    last[ends[sizes > 0] - 1] = True
    rules: list[tuple[int, int]] = []
    lengths: list[int] = []

    def replace(chosen: list[tuple[int, int]], places: np.ndarray, which: np.ndarray) -> None:
        nonlocal seq, last, rules, lengths
        seq[places] = (first_rule + len(rules) + which).astype(np.uint32)
        last[places] = last[places + 1]
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, last = seq[keep], last[keep]
        known = lengths
        size = lambda s: 1 if s < first_rule else known[s - first_rule]
        lengths = known + [size(a) + size(b) for a, b in chosen]
        rules = rules + chosen

    while len(seq) > 1:
        chosen = _frequent_pairs(seq, ~last, least, rules_per_round)
        if chosen:
            table = np.array([a << 32 | b for a, b in chosen], np.int64)
            order = np.argsort(table)
            role = np.zeros(first_rule + len(rules) + 1, np.int8)
            role[[a for a, _ in chosen]] = 1
            role[[b for _, b in chosen]] = 2
            roles = role[seq]
            places = np.flatnonzero((roles[:-1] == 1) & (roles[1:] == 2) & ~last[:-1])
            keys = seq[places].astype(np.int64) << 32 | seq[places + 1]
            found = np.minimum(np.searchsorted(table[order], keys), len(table) - 1)
            hit = table[order][found] == keys
            replace(chosen, places[hit], order[found[hit]])
        equal, places = _doubled(seq, ~last, least) if len(seq) > 1 else ([], None)
        if equal:
            replace([(a, a) for a in equal], places, np.searchsorted(equal, seq[places]))
        if not chosen and not equal:
            break
    out_sizes = np.zeros(len(sizes), np.int64)
    out_sizes[sizes > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    return Grammar(seq, np.array(rules, np.uint32).reshape(-1, 2), np.array(lengths, np.int64), first_rule, out_sizes)


def read_shard(row: dict) -> Grammar:
    """The grammar in one row of the table."""
    symbols, rules, lengths = (np.frombuffer(row[k], "<u4") for k in ("symbols", "rules", "rule_lengths"))
    return Grammar(symbols, rules.reshape(-1, 2), lengths.astype(np.int64), int(row["first_rule"]), np.array(row["n_symbols"], np.int64))


def write_grammar(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 19, part_bytes: int = 8 << 20) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write Re-Pair shards in ascending order of ids.

    Null and empty texts have the end id only; rows without an id come first;
    rows of the same id are ordered by their texts; other columns are not used.
    An empty table gives an empty table of shards. Returns the written table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = to_arrow_schema(SHARD_SCHEMA)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, 0
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            doc_ids = [x for k in kept for x in k[0]]
            ids, sizes = (np.concatenate([k[i] for k in kept]) for i in (1, 2))
            g = compress(ids, sizes)
            pack = lambda a: a.astype("<u4").tobytes()
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "doc_ids": doc_ids, "n_tokens": sizes.tolist(), "n_symbols": g.sizes.tolist(), "symbols": pack(g.symbols), "rules": pack(g.rules), "rule_lengths": pack(g.lengths), "first_rule": g.first_rule}], schema)

        for batch in batches:
            for some in slices(batch, 1):
                ids, sizes = with_end(*encoder(tokenizer).encode(some.column(1)), end_id)
                kept.append((some.column(0).to_pylist(), ids, sizes))
                held += len(ids)
                if held >= shard_tokens:
                    yield row()
                    kept, held, number = [], 0, number + 1
        if kept:
            yield row()

    return save(ordered.mapInArrow(shards, SHARD_SCHEMA), "repair-shards")


def read_grammar(shards: DataFrame) -> DataFrame:
    """Decode a table of shards: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian uint32)."""
    totals = shards.select("part", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    by_part = totals.groupBy("part").agg(F.sum("n").alias("n"))
    parts = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("shard")
    begins = totals.select("part", "shard", (F.sum("n").over(in_part) - F.col("n")).alias("in_part"))
    placed = save(begins.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("first")), "shard-starts")
    # one row of 16 bytes for each shard; so shards are decoded where they are read
    rows = shards.join(small_side(placed, BROADCAST_SHARDS), ["part", "shard"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = batch.slice(k, 1).to_pylist()[0]
                raw = read_shard(shard).decode().astype("<u4").tobytes()
                sizes = np.array(shard["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                whole = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(shard["doc_ids"], pa.int64()), pa.array(shard["first"] + ends - sizes), pa.array(sizes), whole.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
