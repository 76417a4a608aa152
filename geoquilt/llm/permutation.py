"""Approximate nearest neighbours with a permutation index.

A bounded sample of the vectors gives the pivots. A vector is represented by its
nearest pivots in order. The vectors are dealt to shards of bounded size; a
shard keeps, for each pivot, the inverted file of the vectors that have it among
their nearest, with its place. A query meets every shard: the files of its own
pivots add up the footrule distance, where a pivot that only one side has counts
as one place beyond the last; the best by footrule are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

#: Vectors of the sample from which pivots are drawn, pivots, and pivots that represent a vector.
SAMPLE, PIVOTS, NEAREST = 10_000, 256, 128
#: Vectors of a shard, of which a query compares exactly the DEPTH best by footrule (a quarter of a smaller shard, but 4 for each neighbour asked for); queries of a block.
SHARD, DEPTH, BLOCK = 16_384, 640, 512


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array of double): the rows that take part.

    Rows without an id, and vectors that are null, empty, zero, or hold null or
    non-finite components, do not; nor do those whose length is not the most
    frequent one (ties: the longer).
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1)
    return good.join(F.broadcast(lengths.select("dim")), F.size("v") == F.col("dim"), "left_semi")  # one row


def choose_pivots(vectors: DataFrame, count: int, pivots: int = PIVOTS, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """Up to ``pivots`` distinct vectors of a bounded sample (``sample`` rows, the first by a seeded hash).

    Which of them is a seeded choice, so reruns agree. Of ``count`` vectors only
    about four times the sample are sorted for it.
    """
    hashed = vectors.select("v", F.xxhash64(F.lit(seed), "v").alias("h"))
    thin = max(1, count // (4 * sample))
    rows = hashed.where(F.pmod("h", F.lit(thin)) == 0).dropDuplicates(["h"]).orderBy("h").limit(sample).select("v").toPandas()
    if len(rows) < pivots and thin > 1:  # nearly all vectors are copies
        rows = hashed.dropDuplicates(["h"]).orderBy("h").limit(sample).select("v").toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    pool = np.stack(rows["v"].to_numpy())
    rng = np.random.default_rng(seed)
    return pool[np.sort(rng.permutation(len(pool))[:pivots])]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """(rows, nearest): the places of each vector's nearest pivots, nearest first, ties to the smaller place."""
    square = (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.argsort(square, axis=1, kind="stable")[:, :nearest].astype(np.int16)


_SHARD_SCHEMA = "shard int, n int, dim int, ids binary, numbers binary, vectors binary, rows binary, places binary, starts binary"


def build_index(vectors: DataFrame, pivots: np.ndarray, shards: int, nearest: int = NEAREST) -> DataFrame:
    """One row per shard: its ids, numbers of rows and vectors, and the inverted files of all pivots one after the other.

    rows: the shard's rows that have a pivot, in order of ids; places: where they
    have it; starts: where each pivot's file begins. Written to the shared folder.
    """
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "number", "v")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("number", "ascending")])
        ids = table["vec_id"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = nearest_pivots(x, pivots, nearest)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        width = order.shape[1]
        starts = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1)).astype(np.int64)
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                "n": pa.array([len(ids)], pa.int32()),
                "dim": pa.array([x.shape[1]], pa.int32()),
                "ids": [ids.astype("<i8").tobytes()],
                "numbers": [table["number"].to_numpy().astype("<i8").tobytes()],
                "vectors": [x.astype("<f8").tobytes()],
                "rows": [(by_pivot // width).astype("<i4").tobytes()],
                "places": [(by_pivot % width).astype("u1").tobytes()],
                "starts": [starts.astype("<i8").tobytes()],
            }
        )

    # shards are hashes of the rows, so none is much larger than the bound; no key is hot but for repeated rows of one id
    return save(dealt.groupBy("shard").applyInArrow(build, _SHARD_SCHEMA), "permutation-index")


def footrule(order: np.ndarray, rows: np.ndarray, places: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The footrule distance of one query's pivots to each of a shard's n vectors."""
    width = len(order)
    # a pivot that neither shares costs both sides the way from its place to one beyond the last
    total = np.full(n, width * (width + 1), np.int32)
    for place, pivot in enumerate(order.tolist()):
        part = slice(starts[pivot], starts[pivot + 1])
        theirs = places[part].astype(np.int32)
        total[rows[part]] += np.abs(theirs - place) - (width - place) - (width - theirs)
    return total


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, depth: int = DEPTH, exact: bool = False) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score): each query's ``k`` nearest found by Euclidean distance, ties to the smaller id.

    ``queries`` is a condition on vec_id. A query's own row is no candidate of
    it; with fewer candidates all are returned; rows that take no part (see
    usable) are neither; other columns are not used; an empty table gives no
    rows. Rows that repeat an id are candidates and queries of their own, with a
    list each, and meet one another. ``exact`` compares every vector, to measure
    recall.
    """
    spark: SparkSession = vectors.sparkSession
    # numbered as written, so that a row is known by its number from here on
    good = save(usable(vectors, id_col, vector_col).withColumn("number", F.monotonically_increasing_id()), "vectors")
    count = good.count()
    pivots = choose_pivots(good, count)
    schema = "query_number long, query_id long, vec_id long, score double"
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_shards = max(1, math.ceil(count / SHARD))
    index = build_index(good, pivots, n_shards, nearest)
    asked = good.where(queries).select("vec_id", "number", "v")
    n_blocks = max(1, math.ceil(asked.count() / BLOCK))
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "number", "v")).alias("q")).select("block", F.col("q.vec_id").alias("q_ids"), F.col("q.number").alias("q_numbers"), F.col("q.v").alias("qs"))
    blocks = save(blocks, "queries")
    # each block meets each shard once: rows of bounded size, as many as blocks times shards
    met = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).join(index, "shard")
    met = met.repartition(max(1, min(n_blocks * n_shards, 100_000)), "block", "shard")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                n, dim = row["n"].as_py(), row["dim"].as_py()
                ids, numbers = (np.frombuffer(row[c].as_buffer(), "<i8") for c in ("ids", "numbers"))
                x = np.frombuffer(row["vectors"].as_buffer(), "<f8").reshape(n, dim)
                rows, places, starts = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("rows", "<i4"), ("places", "u1"), ("starts", "<i8")))
                q_ids, q_numbers = (row[c].values.to_numpy() for c in ("q_ids", "q_numbers"))
                q = row["qs"].values.flatten().to_numpy().reshape(-1, dim)
                orders = nearest_pivots(q, pivots, nearest)
                out: list[tuple[np.ndarray, ...]] = []
                most = n if exact else min(n, depth, max(4 * k, n // 4))
                for q_id, number, one, order in zip(q_ids.tolist(), q_numbers.tolist(), q, orders, strict=True):
                    # rows are in order of ids, so equal footrules go to the smaller id
                    key = footrule(order, rows, places, starts, n).astype(np.int64) * n + np.arange(n)
                    best = np.argpartition(key, most - 1)[:most]
                    best = best[numbers[best] != number]
                    score = np.sqrt(((x[best] - one) ** 2).sum(axis=1))
                    top = np.lexsort((ids[best], score))[:k]
                    out.append((np.full(len(top), number), np.full(len(top), q_id), ids[best][top], score[top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], ["query_number", "query_id", "vec_id", "score"])

    found = met.select("q_ids", "q_numbers", "qs", "n", "dim", "ids", "numbers", "vectors", "rows", "places", "starts").mapInArrow(compare, schema)
    # k rows from each shard for each query
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    ranked = found.groupBy("query_number", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("place", "b"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))

