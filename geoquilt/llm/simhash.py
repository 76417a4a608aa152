"""SimHash near-duplicates by tiled exact comparison.

Documents with equal fingerprints are one class, so copies are never compared.
Classes are dealt to tiles by the population counts of their fingerprints' four
16-bit quarters: fingerprints at a distance of r differ by r or less in the sum
over the quarters, so all other pairs of tiles are skipped. Within a pair of
tiles numpy's exclusive-or and bit counts compare every pair; a tile pair gives
a spanning forest of the links that it finds, which is enough for components.

near_copies links texts by how much of their shingles they share. SimHash links
and texts with the same least shingle, verified, make the first components; what
they leave is found without loss by a prefix filter: two sets that share enough
have one of their rarest shingles in common, so only those are posted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, save, small_side
from .components import connected_components
from .restaurant import mix
from .tokens import slices
from .words import Words, split_words

#: For a byte: a 64-bit number with one byte per bit of it.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
#: A tile's key has four digits from 0 to 16; the base is so large that steps between tiles carry nothing over.
_QUARTERS, _BASE = 4, 64
#: Tiles that a tile meets in one group of the join.
_SALT = 64
#: Orders whose least shingles group texts at first in near_copies, and those of them that come first, buckets in which it counts how frequent shingles are (4 bytes each in every task), and rows of 8 bytes up to which its lists of texts, shingles and components are broadcast.
_LEAST, _EARLY, _BUCKETS, BROADCAST_KEYS = 6, 2, 1 << 19, 2_000_000
#: Columns of 64 parities each of a text's set of shingles.
_ODD = tuple(f"odd{k}" for k in range(8))
#: Partners of a class in each further order, and classes of one least shingle in one task; rows and bytes of texts that are taken apart at a time.
_PARTNERS, _SHARE, _SLICE = 5, 10_000, (500, 4 << 20)


def _shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 with seed 42 of each shingle of ``size`` words joined by spaces, number of shingles of each document)."""
    import xxhash

    steps = words.lengths + 1
    ends = np.cumsum(steps)
    starts = ends - steps
    joined = words.buf[np.repeat(words.starts - starts, steps) + np.arange(ends[-1] if len(ends) else 0)]
    joined[ends - 1] = 0x20
    raw = joined.tobytes()
    n_words = np.diff(words.bounds)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(counts)), counts)
    first = words.bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(first + size, words.bounds[1:][doc]) - 1
    pieces = (raw[a:b] for a, b in zip(starts[first].tolist(), (ends[last] - 1).tolist(), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(doc)), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document the bits that are 1 in over half its hashes; 0 if it has none."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    # runs of at most 255 hashes, so that a byte holds a bit's count
    runs = -(-counts[some] // 255)
    doc = np.repeat(np.arange(len(some)), runs)
    begins = (ends - counts[some])[doc] + 255 * (np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs))
    each = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    of_doc = np.cumsum(runs) - runs
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[each[:, k]], begins).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), of_doc, axis=0)
        bits = (2 * ones > counts[some][:, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
        out[some] |= bits.sum(axis=1).astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp long) of every whole text; A-Z count as a-z. Null and empty texts have fingerprint 0; text_key is a hash of the text."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                some = batch.slice(k, 1_000)
                found = majority_bits(*_shingle_hashes(split_words(some.column(1), lower=True), shingle))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    return source.mapInArrow(each, "doc_id long, text_key long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) that connect what pairs of a and b within the radius connect."""
    i, j = np.nonzero(_near(a, b, radius))
    return _spanning(a[i], b[j])


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    # unsigned: numpy counts the bits of a signed number's absolute value
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= radius


def _spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) that connect what the links (x, y) connect."""
    differ = x != y
    nodes, at = np.unique(np.concatenate([x[differ], y[differ]]), return_inverse=True)
    x, y = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while True:
        was = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == was).all():
            break
    kept = root != np.arange(len(nodes))
    return nodes[kept], nodes[root[kept]]


def _salted(left: DataFrame, counts: DataFrame) -> DataFrame:
    """A copy of each tile for every _SALT tiles of the key ``to`` that it goes to, so that no group of the join holds more of them."""
    return left.join(F.broadcast(counts), "to").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tiles - 1) div {_SALT}")))).drop("tiles")


def near_links(classes: DataFrame, radius: int = 2, tile: int = 512) -> DataFrame:
    """(src, dst): links between different values of the column fp of ``classes``, enough to connect all within the radius.

    No pair is lost: tiles hold about ``tile`` fingerprints each, as many as it
    takes, and every two tiles whose counts allow a link are compared.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(_QUARTERS)]
    key = sum((q * _BASE**k for k, q in enumerate(quarter)), F.lit(0)).cast("int")
    keyed = classes.select("fp", key.alias("key"))
    counts = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("tiles"))  # at most 17^4 rows
    tiles = keyed.join(F.broadcast(counts), "key").groupBy("key", F.pmod(F.xxhash64("fp"), "tiles").alias("sub")).agg(F.collect_list("fp").alias("fps"))
    tiles = save(tiles, "tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=_QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * _QUARTERS]
    reach = F.array(*(F.col("key") + sum(x * _BASE**k for k, x in enumerate(d)) for d in steps))
    left = _salted(tiles.select(F.explode(reach).alias("to"), F.col("key").alias("from"), F.col("sub").alias("sub_a"), F.col("fps").alias("a")), counts.withColumnRenamed("key", "to"))
    right = tiles.select(F.col("key").alias("to"), F.col("sub").alias("sub_b"), F.expr(f"sub div {_SALT}").alias("salt"), F.col("fps").alias("b"))
    pairs = left.join(right, ["to", "salt"]).where("to != from OR sub_a <= sub_b").select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in batch.columns]
            found = []
            for k in range(batch.num_rows):
                a, b = (v[o[k] : o[k + 1]] for v, o in sides)
                src, dst = _forest(a, b, radius)
                if len(src):
                    found.append((src, dst))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).astype(np.int64)) for k in (0, 1)], ["src", "dst"])

    return pairs.mapInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, text_key, fp (long), root (the component's own number), component_id (smallest doc_id reachable over links).

    Texts without words have fingerprint 0 and are linked like any others. Rows
    that repeat an id are rows of their own; rows without an id are linked too,
    but name no component; a component of such rows only has id null. Other
    columns are not used. An empty table gives no rows.
    """
    prints = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(near_links(classes, radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes, A-Z in lower case."""
    hashes, counts = _shingle_hashes(split_words(texts, lower=True), shingle)
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), 42) for x in sets], np.uint64).view(np.int64)


def _parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each set, 64-bit words whose bits tell whether an odd number of its shingles falls on them.

    A bit in which two sets differ needs a shingle that only one of them has, so
    differing bits are never more than such shingles.
    """
    bits = 64 * len(_ODD)
    row = np.repeat(np.arange(len(counts)), counts)
    odd = np.bincount(row * bits + (hashes % np.uint64(bits)).astype(np.int64), minlength=len(counts) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(counts), bits), axis=1).view(np.int64)


def _set_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_key, key, fp, n, parities, least shingles in other orders): key is a hash of a text's set of n shingles."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    low = [f"low{k}" for k in range(_LEAST)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, *_SLICE):
                sets = _sets(some.column(1), shingle)
                n, all_hashes = np.array([len(x) for x in sets], np.int64), np.concatenate(sets)
                least = [np.minimum.reduceat(np.append(mix(all_hashes + np.uint64(k + 1)), ~np.uint64(0)), np.cumsum(n) - n) for k in range(_LEAST)]
                columns = [_keys(sets), majority_bits(all_hashes, n).view(np.int64), *(np.where(n > 0, x, np.uint64(0)).view(np.int64) for x in least)]
                odd = _parities(all_hashes, n)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *map(pa.array, columns), *map(pa.array, odd.T), pa.array(n.astype(np.int32))], ["doc_id", "text_key", "key", "fp", *low, *_ODD, "n"])

    return source.mapInArrow(each, f"doc_id long, text_key long, key long, fp long, {', '.join(f'{c} long' for c in (*low, *_ODD))}, n int")


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(key, shingles) of the classes in some pairs (a, b): one text of each is read again."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    asked = save(classes.join(ends, "key", "left_semi").select("key", "text_key"), "asked")
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"))
    texts = texts.join(small_side(asked.select("text_key"), BROADCAST_KEYS), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0, *_SLICE):
                sets = _sets(some.column(0), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(sets)), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["key", "shingles"])

    sets = save(texts.select("text").mapInArrow(each, "key long, shingles binary").dropDuplicates(["key"]), "sets")
    discard(asked)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): those of the pairs (a, b) whose sets share enough."""
    one = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"set_{c}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("set_a", "set_b"))
            ok = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common * (1 + similarity) >= similarity * (len(p) + len(q)) - 1e-9)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(keep) for c in "ab"], ["src", "dst"])

    return save(pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").mapInArrow(verify, "src long, dst long"), "links")


def _links_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, links: DataFrame | None, similarity: float, text_col: str, shingle: int) -> DataFrame:
    """``links`` and those of the pairs (a, b) that share enough."""
    sized = pairs.join(classes.select(F.col("key").alias("a"), F.col("n").alias("n_a")), "a").join(classes.select(F.col("key").alias("b"), F.col("n").alias("n_b")), "b") if "n_a" not in pairs.columns else pairs
    left = save(sized.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9), "candidates")
    sets = _sets_of(docs, classes, left, text_col, shingle)
    found = _verified(left, sets, similarity)
    links = found if links is None else save(links.unionByName(found), "links")
    for used in (sets, left):
        discard(used)
    release(docs.sparkSession)
    return links


def _first_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): SimHash links, and each class with the first of those of its fingerprint and of its least shingles in some orders: a number of pairs that grows with the classes."""
    some = classes.where("n > 0")
    heads = save(some.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    near = near_links(heads.select("fp"), radius)
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    pairs = near.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_head").alias("a"), F.col("dst_head").alias("b"))
    for c in ("fp", *(f"low{k}" for k in range(_EARLY))):
        first = some.groupBy(c).agg(F.min("key").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
        pairs = pairs.unionByName(some.select(c, F.col("key").alias("b")).join(first, c).select("a", "b"))
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _further_pairs(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): each class with the next ones, in an order by chance, that have the same least shingle in further orders, where they are of different components.

    So each has as many partners as any other, and loose groups of near copies,
    in which only some pairs share enough, come together without all their pairs.
    """
    some = classes.where("n > 0").join(small_side(roots.withColumnRenamed("node", "key"), BROADCAST_KEYS), "key", "left").withColumn("root", F.coalesce("root", "key"))
    some = save(some.select("key", "root", *(f"low{k}" for k in range(_EARLY, _LEAST))), "rooted")
    pairs = None
    for k in range(_EARLY, _LEAST):
        # large groups are dealt to shares, each in an order of its own
        sizes = some.groupBy(f"low{k}").agg(F.count("*").alias("m"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
        held = some.select(f"low{k}", "key", "root").join(sizes.select(f"low{k}", F.ceil(F.col("m") / _SHARE).alias("shares")), f"low{k}")
        held = held.withColumn("place", F.xxhash64("key", F.lit(k))).withColumn("share", F.pmod("place", "shares"))
        order = Window.partitionBy(f"low{k}", "share").orderBy("place")
        partners = F.array(*(F.lead(F.struct("key", "root"), d).over(order) for d in range(1, _PARTNERS + 1)))
        met = held.select("key", "root", partners.alias("next")).select("key", "root", F.explode("next").alias("x")).where("x.root != root").select(F.col("key").alias("a"), F.col("x.key").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all texts fall into each of _BUCKETS buckets of hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            for some in slices(batch, 0, *_SLICE):
                found += np.bincount((np.concatenate(_sets(some.column(0), shingle)) % np.uint64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # _BUCKETS rows
    counts = np.zeros(_BUCKETS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)


def _prefix_pairs(docs: DataFrame, classes: DataFrame, roots: DataFrame, similarity: float, text_col: str, shingle: int) -> DataFrame:
    """(a, b): all pairs of classes of different components that can share enough.

    Shingles are in one order, those of rare buckets first. Of n shingles two
    sets that share enough have one in common among the first n - ceil(s n) + 1
    of each, whatever the order; rare ones first keep what is posted under one
    shingle short. Only shingles of several components matter, and only pairs
    whose parities differ in no more bits than a link allows and whose shared
    places leave enough behind them are joined (both are bounds that no link
    breaks); of these, pairs with so many in common that the rest can make up
    for what is missing.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    frequency = _frequencies(texts, shingle)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0, *_SLICE):
                sets = _sets(some.column(0), shingle)
                n = np.array([len(x) for x in sets], np.int64)
                row, values = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
                order = np.lexsort((values, frequency[(values % np.uint64(_BUCKETS)).astype(np.int64)], row))
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                first = place < (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[row]
                yield pa.RecordBatch.from_arrays([pa.array(values[order][first].view(np.int64)), pa.array(_keys(sets)[row[first]]), pa.array(place[first].astype(np.int32))], ["shingle", "key", "place"])

    postings = save(texts.mapInArrow(post, "shingle long, key long, place int"), "postings")
    roots = small_side(roots, BROADCAST_KEYS)
    rooted = postings.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    live = rooted.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("shingle")
    live = save(live, "live-shingles")
    release(docs.sparkSession)
    held = save(rooted.join(small_side(live, BROADCAST_KEYS), "shingle", "left_semi").distinct(), "live-postings")
    discard(postings)
    held = held.join(classes.select("key", "n", *_ODD), "key")
    side = lambda key, s: held.select("shingle", F.col("key").alias(key), *(F.col(c).alias(f"{c}_{s}") for c in ("root", "n", "place", *_ODD)))
    # part of the join's condition: at most as many shingles in one set alone as a link allows, by parities, and enough from the shared place on
    alone = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _ODD), F.lit(0))
    both = F.col("n_a") + F.col("n_b")
    could = F.least("place_a", "place_b") + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    near = (alone * (1 + similarity) <= (1 - similarity) * both + 1e-9) & (could * (1 + similarity) >= similarity * both - 1e-9)
    met = side("a", "a").join(side("b", "b"), "shingle").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & near).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    # whichever of two prefixes ends first in the order, all else that is shared lies behind it
    behind = F.greatest(*(F.ceil(similarity * F.col(n) - 1e-9) - 1 for n in ("n_a", "n_b")))
    enough = (F.col("common") + behind) * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-9
    return met.where(enough)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """As near_duplicates, but texts are linked where their sets of shingles have ``similarity`` (intersection by union) or more; no such link is lost.

    Texts of the same shingles are one class, those without words too. Here a
    shingle counts once for the fingerprint, however often it occurs. ``radius``
    is that of the first links, which are verified like all others.
    """
    prints = save(_set_prints(docs, id_col, text_col, shingle), "fingerprints")
    low = [f"low{k}" for k in range(_LEAST)]
    classes = save(prints.groupBy("key").agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("fp", "n", "text_key", *low, *_ODD))), "classes")
    links = _links_of(docs, classes, _first_pairs(classes, radius), None, similarity, text_col, shingle)
    for pairs in (_further_pairs, lambda classes, roots: _prefix_pairs(docs, classes, roots, similarity, text_col, shingle)):
        roots = save(connected_components(links), "roots")
        release(docs.sparkSession)
        links = _links_of(docs, classes, pairs(classes, roots), links, similarity, text_col, shingle)
    roots = connected_components(links)
    release(docs.sparkSession)
    rooted = classes.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "text_key", "key", "fp").join(rooted.join(named, "root").select("key", "root", "component_id"), "key").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, one for each component: that with the smallest id, then the smallest hash of its text.

    With a ``similarity`` components are those of near_copies.

    A row without an id stays only where its component has no ids. Rows of one
    id and text count once: the least of them by the other columns stays.
    """
    if similarity is None:
        found = near_duplicates(docs, id_col, text_col, shingle, radius)
    else:
        found = save(near_copies(docs, id_col, text_col, shingle, radius, similarity), "components")
    stays = save(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("s")).select("s.doc_id", "s.text_key"), "stays")
    stays = stays.select(F.col("doc_id").alias("stay_id"), F.col("text_key").alias("stay_key"))
    names = docs.columns
    keyed = docs.select("*", F.xxhash64(F.col(text_col).cast("string")).alias("stay_key_of"))
    kept = keyed.join(stays, F.col(id_col).cast("long").eqNullSafe(F.col("stay_id")) & (F.col("stay_key_of") == F.col("stay_key")), "left_semi")
    if found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept.select(*names)
    least = kept.groupBy(id_col, "stay_key_of").agg(F.min(F.struct(*names)).alias("row"))
    return least.select("row.*")
