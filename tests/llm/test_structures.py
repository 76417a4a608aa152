"""Manifests, licence notices and conversations against plain Python."""

import random
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoquilt.llm import conversations, licenses, merkle
from geoquilt.llm.queries import QUERIES

from . import brute
from .conftest import DOCS

NAN = lambda x: None if pd.isna(x) else x


# 11: manifest
def proofs(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: brute.h(*map(brute.field, r))
    lower = lambda r: r[:4] + (r[4].translate(brute.LOWER) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4],)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: brute.tree([leaf(r) for r in g]) for x, g in groups.items()}
    if not trees:
        return []
    root, over = brute.tree([trees[x][0] for x in langs])
    out = []
    for x, up in zip(langs, over, strict=True):
        for r, steps in zip(groups[x], trees[x][1], strict=True):
            node, path = leaf(lower(r)), steps + up
            for before, after in path:
                node = brute.h(*before, node, *after)
            out.append((r[0], leaf(r), trees[x][0], root, brute.h(*(d for before, after in path for d in before + after)), node, node == root))
    return out


def test_manifest_on_awkward_rows(docs):
    """Null ids, fields and languages, rows of one id, repeated rows, columns of other operators' names."""
    got = merkle.audit(docs.unionAll(docs)).collect()
    rows = [(i, s, la, None if t is None else len(t), t) for i, t, la, s in DOCS] * 2
    assert Counter(map(tuple, got)) == Counter(proofs(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 530])
def test_manifest_sizes(spark, n):
    rows = [(k, f"s{k % 5}", "a" if k % 7 else None, k, f"Text {k} É") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, merkle.audit(df).collect())) == Counter(proofs(rows))


def test_manifest_of_many_groups_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 3)
    rows = [(k // 2, "s", f"lang{k % 70}" if k % 3 else "hot", k, "x") for k in range(1_200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, merkle.audit(df).collect())) == Counter(proofs(rows))


# 12: licence notices
def test_base_phrases(docs, spark, small):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = licenses.report(docs).select("doc_id", *names).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute.license_places(t)) for i, t, *_ in DOCS)
    d = spark.read.parquet(f"{small}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op12_positional_license_scan"](spark, small).toPandas().sort_values("doc_id")
    assert [tuple(map(NAN, r)) for r in got[list(names)].itertuples(index=False)] == [brute.license_places(t) for t in d["text"]]
    assert all(set(b.split(",")) <= set(x.split(",")) or not b for b, x in zip(got["base_labels"], got["labels"], strict=True))
    assert got["score"].between(0, 1).all() and ((got["score"] > 0) == (got["labels"] != "")).all()


def test_notices_are_found_with_small_edits_and_not_by_words_alone(spark):
    """Whole notices, with a word changed or put in; not with words out of order, nor without the key phrase; every place of a phrase, however often."""
    draw = random.Random(3)
    filler = lambda n: " ".join("".join(draw.choices("abcdeimnorst", k=draw.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for k, t in enumerate(licenses.TEMPLATES):
        words = t.text.split()
        rows.append((10 * k, f"{filler(50)}\n{t.text.upper()}, {filler(50)}"))
        want[10 * k] = t.label
        if not t.base and len(words) > 9:
            keys = {w for key in t.keys for w in key.split()}
            spare = next(i for i, w in enumerate(words) if w not in keys)
            rows.append((10 * k + 1, f"{filler(70)} {' '.join('changed' if i == spare else w for i, w in enumerate(words))} {filler(9)}"))
            rows.append((10 * k + 2, f"{filler(70)} {' '.join(words[:spare] + ['more'] + words[spare:])} {filler(9)}"))
            want[10 * k + 1] = want[10 * k + 2] = t.label
            mixed = draw.sample(words, len(words))
            rows.append((10 * k + 3, f"{filler(40)} {' '.join(mixed)}"))
            rows.append((10 * k + 4, f"{filler(40)} {' '.join(w for w in words if w != t.keys[0].split()[0])}"))
    rows += [(1_000, "all rights reserved " * 20_000), (1_001, "cc by cc by nc cc  BY"), (1_002, "allrights reserved all rights\u00e9 reserved general public"), (1_003, None), (1_004, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash"))
    got = {r["doc_id"]: r for r in licenses.report(df).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"].split(","), (i, label, got[i])
    for i, text in rows:
        assert tuple(got[i])[1:6] == brute.license_places(text)
        if i % 10 in (3, 4) and i < 1_000:
            t = licenses.TEMPLATES[i // 10]
            assert t.label not in got[i]["labels"].split(",") or t.label in got[i]["base_labels"].split(",") or any(" ".join(text.split()).find(k) >= 0 for k in t.keys)
    assert got[1_000]["n_base"] == 20_000 and got[1_000]["last_word"] == 59_997
    assert got[1_001]["labels"] == "cc-by" and got[1_002]["labels"] == got[1_003]["labels"] == ""
    assert licenses.report(df.where("false")).count() == 0


# 13: conversations
def conversation_rows(draw, conv, n):
    texts = ["Yes.", "No?", "", " \t", "unfinished", "Good!", "end. ", "a.b", "\u00e9", "."]
    rows, turn = [], draw.randint(-2, 3)
    for _ in range(n):
        rows.append((conv, turn, draw.choice(["user", "assistant"] * 4 + ["system", "tool", "User", ""]), draw.choice(texts) + draw.choice(["", "", f" {draw.random()}."])))
        turn += draw.choice([1, 1, 1, 1, 2, 3])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def digests(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("part", "seq", "cost", "dropped", "k")}).repartition(parts)
    return Counter(map(tuple, conversations.digests(*conversations.repair(conversations.damage(df), **options)).collect()))


def test_cheapest_repairs(spark):
    """Many random conversations, of one to some turns, against all edits."""
    draw = random.Random(11)
    rows = [r for c in range(700) for r in conversation_rows(draw, c, draw.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 30]))]
    assert digests(spark, rows) == Counter((c, *brute.repaired(x)) for c, x in brute.damaged(rows).items())


def test_long_conversations_in_pieces(spark):
    """A conversation that has most of all rows is spread over ranges and pieces, with the same result."""
    draw = random.Random(12)
    rows = conversation_rows(draw, 5, 1_500) + conversation_rows(draw, None, 40) + [r for c in (1, 2, 9) for r in conversation_rows(draw, c, 60)]
    rows += [(7, 1, "user", "same."), (7, None, "system", "first."), (8, None, None, None), (8, None, "user", "Hm."), *[(6, k, "user", "ever the same.") for k in range(300)]]
    want = Counter((c, *brute.repaired(x)) for c, x in brute.damaged(rows).items())
    for most in (7, 64, 4096):
        assert digests(spark, rows, 5, piece_rows=most) == want


def test_conversations_without_rows(spark):
    """A conversation all of whose rows are dropped keeps its row; an empty table has none; repeated rows are turns."""
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (5_000, 3, "user", "Hi."), (5_000, 3, "user", "Hi."), (5_000, 3, "user", "Hi.")]
    got = digests(spark, rows)
    assert got == Counter((c, *brute.repaired(x)) for c, x in brute.damaged(rows).items())
    assert (gone, 0, 0, 0, 0, 0, 0, "", brute.h("")) in got
    assert not digests(spark, spark.createDataFrame([], SCHEMA).collect() or [(None, None, None, None)][:0])


def test_conversations_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, small).collect()
    assert Counter(map(tuple, got)) == Counter((c, *brute.repaired(x)) for c, x in brute.damaged(rows).items())
