"""Merkle manifest of a table: a tree of digests for each group of rows and one over the groups' roots.

Rows get their index within the group by row_number over sorted ranges; index
divided by the fanout is the parent's index, and a parent's digest is that of
its sorted children. The levels are tables; a row's proof is gathered by one
join a level, from the top down, so that each level's siblings are worked out
once and only the last join meets the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, save, small_side

#: Rows of a range in which row_number counts, and groups up to which a row for each is broadcast.
RANGE_ROWS, BROADCAST_GROUPS = 100_000, 10_000
#: Upper to lower case of what tampering changes in texts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of what is put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as the leaf holds it: ``-`` for null, else its length in bytes, a colon and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


@dataclass
class Tree:
    """rows: (key, grp, leaf, idx and what was carried); levels[k]: (grp, run, children), the runs whose digests make level k + 1; roots: (grp, node)."""

    rows: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def indexed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes``, written, with idx, the place from 0 within the group ``grp`` in ``order``, nulls first.

    Ranges of the order are numbered on their own and follow the counts of the
    ranges before them, so a group of any size is spread over many tasks. Rows
    that agree in all of ``order`` are dealt by a random number; any order of
    them is as good.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // RANGE_ROWS))
    keys = [F.col("grp").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("deal")]
    dealt = save(nodes.withColumn("deal", F.rand(11)).repartitionByRange(parts, *keys).withColumn("range", F.spark_partition_id()), "merkle-ranges")
    # a row for each group in each range
    counts = dealt.groupBy("grp", "range").agg(F.count("*").alias("n"))
    before = counts.select(F.col("grp").alias("g"), F.col("range").alias("r"), (F.sum("n").over(Window.partitionBy("grp").orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("grp", "range").orderBy(*keys[1:]))
    numbered = dealt.withColumn("place", place).join(before, F.col("grp").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    rows = save(numbered.withColumn("idx", (F.col("before") + F.col("place") - 1).cast("long")).drop("deal", "range", "place", "g", "r", "before"), "merkle-rows")
    discard(dealt)
    return rows


def grow(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) above nodes (grp, idx, node): while any group has several, every ``fanout`` consecutive ones become their digest."""
    levels, done = [], None
    sizes = small_side(save(nodes.groupBy(F.col("grp").alias("g")).agg(F.count("*").alias("n")), "merkle-sizes"), BROADCAST_GROUPS)
    now = nodes.join(sizes, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "idx", "node", "n")
    while True:
        single = now.where("n = 1").select("grp", "node")
        done = single if done is None else done.unionByName(single)
        many = now.where("n > 1")
        runs = many.groupBy("grp", F.expr(f"idx div {fanout}").alias("run"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("sorted"))
        runs = save(runs.select("grp", "run", F.expr(f"(n + {fanout} - 1) div {fanout}").alias("n"), F.transform("sorted", lambda x: x["node"]).alias("children")), "merkle-level")
        if runs.isEmpty():
            discard(runs)
            return levels, save(done, "merkle-roots")
        levels.append(runs.select("grp", "run", "children"))
        now = runs.select("grp", F.col("run").alias("idx"), F.sha2(F.array_join("children", ""), 256).alias("node"), "n")


def build(leaves: DataFrame, order: Sequence[str], fanout: int = 8) -> Tree:
    """The tree over leaves (grp, leaf and others, which are kept), per ``grp`` in ``order`` and then by the leaf's digest."""
    rows = indexed(leaves, [*order, "leaf"])
    levels, roots = grow(rows.select("grp", "idx", F.col("leaf").alias("node")), fanout)
    return Tree(rows, levels, roots)


def _step(children: Column, at: Column) -> Column:
    """One level of a proof: what stands before and after the own digest in its run."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("before"), F.array_join(F.slice(children, at + 2, F.size(children)), "").alias("after"))


def paths(nodes: DataFrame, levels: list[DataFrame], fanout: int) -> DataFrame:
    """``nodes`` (grp, idx and others) with path, the steps from their own level to the group's root.

    From the top down a run's path is the path of its digest in the run above it.
    """
    none = F.array().cast("array<struct<before:string,after:string>>")
    above = None
    for runs in reversed(levels):
        if above is None:
            above = runs.withColumn("up", none)
            continue
        up = above.select(F.col("grp").alias("g"), F.col("run").alias("r"), F.col("children").alias("c"), F.col("up").alias("higher"))
        joined = runs.join(up, F.col("grp").eqNullSafe(F.col("g")) & (F.expr(f"run div {fanout}") == F.col("r")), "left")
        step = F.concat(F.array(_step(F.col("c"), (F.col("run") % fanout).cast("int"))), F.col("higher"))
        above = save(joined.select("grp", "run", "children", F.when(F.col("c").isNull(), none).otherwise(step).alias("up")), "merkle-paths")
    if above is None:
        return nodes.withColumn("path", none)
    up = above.select(F.col("grp").alias("g"), F.col("run").alias("r"), F.col("children").alias("c"), F.col("up").alias("higher"))
    joined = nodes.join(up, F.col("grp").eqNullSafe(F.col("g")) & (F.expr(f"idx div {fanout}") == F.col("r")), "left")
    step = F.concat(F.array(_step(F.col("c"), (F.col("idx") % fanout).cast("int"))), F.col("higher"))
    return joined.withColumn("path", F.when(F.col("c").isNull(), none).otherwise(step)).drop("g", "r", "c", "higher")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings' digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None, fanout: int = 8) -> DataFrame:
    """One row per document: doc_id, grp, leaf, changed_leaf (with ``changed`` fields; the leaf where none are given), idx, subroot, root, path.

    ``path`` has the steps from the leaf to its group's subroot and on to the
    root, each with the siblings before and after. Groups are ordered as UTF-8,
    null first; so are ids, and rows that share one by the leaf's digest, so
    equal rows are equal leaves, each in the tree. A null or empty field is a
    field (``-`` and ``0:``); only ``fields`` and the two columns are read, so
    other columns may have any names; an empty table gives no rows.
    """
    changed = changed or {}
    leaf = digest(*(field(F.col(c)) for c in fields))
    other = digest(*(field(changed.get(c, F.col(c))) for c in fields))
    leaves = save(docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).cast("string").alias("grp"), leaf.alias("leaf"), other.alias("changed_leaf")), "merkle-leaves")
    tree = build(leaves, ["doc_id"], fanout)
    subroots = tree.roots.select(F.lit("all").alias("grp"), F.col("grp").alias("name"), F.col("node").alias("leaf"))
    top = build(subroots, ["name"], fanout)
    root = top.roots.select(F.col("node").alias("root"))  # one row, or none for an empty table
    over = paths(top.rows, top.levels, fanout).select("name", F.col("leaf").alias("subroot"), F.col("path").alias("over")).crossJoin(F.broadcast(root))
    over = save(over, "merkle-top")
    rows = paths(tree.rows, tree.levels, fanout)
    # a row for each group
    joined = rows.join(small_side(over, BROADCAST_GROUPS), F.col("grp").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "grp", "leaf", "changed_leaf", "idx", "subroot", "root", F.concat("path", "over").alias("path"))


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, of which those whose id's crc32 is divisible by 3 are tampered with: their texts' A-Z are in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = manifest(docs, changed={"text": lower})
    folded = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """The same in DuckDB SQL: levels as lists of digests by recursion, crc32 bit by bit, and each document folded level by level, by way of its group's subroot."""
    leaf = "sha256(" + "||".join(f"coalesce(strlen({c}::VARCHAR)||':'||{c}::VARCHAR,'-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    bits = "lambda x, i: CASE WHEN x%2=1 THEN xor(x//2, 3988292384) ELSE x//2 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR,''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc,b), [0,0,0,0,0,0,0,0]::BIGINT[]), {bits})), 4294967295)"
    lower = f"(CASE WHEN ({crc})%3=0 THEN translate(text,'{UPPER}','{LOWER}') ELSE text END)"
    up = "list_transform(range((len(hs)+7)//8), lambda k: sha256(array_to_string(list_slice(hs, k*8+1, least(k*8+8, len(hs))),'')))"
    before, after = "array_to_string(list_slice(x.hs, (f.i//8)*8+1, f.i),'')", "array_to_string(list_slice(x.hs, f.i+2, least((f.i//8)*8+8, len(x.hs))),'')"
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, lang, {leaf.format(text="text")} AS leaf, {leaf.format(text=lower)} AS other FROM documents),
    r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)-1 AS i FROM l),
    t AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS hs FROM r GROUP BY lang UNION ALL SELECT lang, level+1, {up} FROM t WHERE len(hs)>1),
    s AS MATERIALIZED (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST)-1 AS i FROM t WHERE len(hs)=1),
    u AS (SELECT 0 AS level, list(subroot ORDER BY i) AS hs FROM s UNION ALL SELECT level+1, {up} FROM u WHERE len(hs)>1),
    w AS MATERIALIZED (SELECT false AS top, lang, level, hs FROM t UNION ALL SELECT true, NULL, level, hs FROM u),
    f AS (SELECT doc_id, lang, leaf, 0 AS level, i, other AS node, '' AS proof, false AS top FROM r
        UNION ALL SELECT f.doc_id, f.lang, f.leaf, CASE WHEN len(x.hs)>1 THEN f.level+1 ELSE 0 END, CASE WHEN len(x.hs)>1 THEN f.i//8 ELSE s.i END,
            CASE WHEN len(x.hs)>1 THEN sha256({before}||f.node||{after}) ELSE f.node END,
            CASE WHEN len(x.hs)>1 THEN f.proof||{before}||{after} ELSE f.proof END, f.top OR len(x.hs)=1
        FROM f JOIN w x ON x.top=f.top AND x.level=f.level AND (f.top OR x.lang IS NOT DISTINCT FROM f.lang) JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE NOT f.top OR len(x.hs)>1)
    SELECT f.doc_id, f.leaf, s.subroot, x.hs[1] AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node=x.hs[1] AS verified
    FROM f JOIN w x ON x.top AND f.top AND x.level=f.level AND len(x.hs)=1 JOIN s ON s.lang IS NOT DISTINCT FROM f.lang"""
