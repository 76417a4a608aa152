"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the powers of two of n
in binary, longest first, with as many of the largest length as it takes. Pieces
of equal length form a bucket; each is a sequence of its own, so that batches
of a bucket need no padding and no sequence crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_side
from .tokens import encoder, slices, with_end

#: Tasks up to which the table of their buckets' first sequences is broadcast: one row of some 200 bytes for each.
BROADCAST_PARTS = 1_000_000


def binary_lengths(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of each piece, length of each piece): whole ``longest`` ones first, then falling powers of two."""
    steps = longest.bit_length()
    counts = np.empty((len(sizes), steps), np.int64)
    counts[:, 0] = sizes // longest
    for k in range(1, steps):
        counts[:, k] = (sizes % longest) >> (steps - 1 - k) & 1
    lengths = np.tile(longest >> np.arange(steps), len(sizes))
    return np.repeat(np.repeat(np.arange(len(sizes)), steps), counts.ravel()), np.repeat(lengths, counts.ravel())


def pack_power_of_two(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and cut it into pieces of power-of-two length.

    Returns one row per piece: doc_id, start (the document's ids before it),
    length, ids (binary, little-endian uint32), doc_tokens (with the end id),
    sequence_id (long, unique; a bucket's are consecutive, longer pieces first),
    offset (0: a sequence is one piece). Null and empty texts have the end id
    only; a row without an id is packed like any other; rows of the same id are
    packed apart; other columns are not used; an empty table gives no pieces.
    ``longest`` is a power of two.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            for some in slices(batch, 1):
                ids, sizes = with_end(*encoder(tokenizer).encode(some.column(1)), end_id)
                doc, lengths = binary_lengths(sizes, longest)
                ends = np.cumsum(lengths)
                starts = ends - lengths - (np.cumsum(sizes) - sizes)[doc]
                bucket = longest.bit_length() - 1 - np.log2(lengths).astype(np.int64)
                rank = np.empty(len(bucket), np.int64)
                for b in np.unique(bucket):
                    mine = bucket == b
                    rank[mine] = seen[b] + np.arange(mine.sum())
                    seen[b] += mine.sum()
                whole = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(doc)), pa.array(starts), pa.array(lengths), whole.cast(pa.binary()), pa.array(sizes[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "part", "rank"],
                )

    cut = save(source.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, part int, rank long"), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # one row per length and task, so that the order over all of them stays small; then one row per task, so that pieces stay where they are
    first = counts.select("length", "part", (F.sum("n").over(Window.orderBy(F.desc("length"), "part")) - F.col("n")).alias("first"))
    first = save(first.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("first")), "first-sequences")
    placed = cut.join(small_side(first, BROADCAST_PARTS), "part")
    return placed.select("doc_id", "start", "length", "ids", "doc_tokens", (F.element_at("first", F.col("length")) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
