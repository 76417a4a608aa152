"""The pipeline's near-dedup on planted near copies."""

import random

import corpus_pipeline
import numpy as np

from geoquilt.llm.simhash import _parities

from . import brute


def shingles(text, size=5):
    words = brute.WORD.findall(text.translate(brute.LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_planted_near_copies_are_dropped(spark, small):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9)))
    edited = lambda words, places: " ".join("edited" if k in places else w for k, w in enumerate(words))
    texts, stay, gone = {}, set(), set()
    for i in range(60):
        words = [word() for _ in range(300)]
        texts[10 * i] = " ".join(words)
        # two chained copies, one in other case, and a text with too little in common
        texts[10 * i + 1] = edited(words, {40, 180})
        texts[10 * i + 2] = edited(words, {40, 180, 100, 240, 290})
        texts[10 * i + 3] = edited(words, {40, 180}).upper()
        texts[10 * i + 4] = edited(words, set(range(5, 300, 12)))
        stay |= {10 * i, 10 * i + 4}
        gone |= {10 * i + k for k in (1, 2, 3)}
        assert jaccard(texts[10 * i], texts[10 * i + 1]) >= 0.9 and jaccard(texts[10 * i + 1], texts[10 * i + 2]) >= 0.85 and jaccard(texts[10 * i], texts[10 * i + 4]) < 0.6
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).select("doc_id").collect()}
    assert kept == stay and not kept & gone


def test_awkward_rows(spark, docs, empty, small):
    """Copies and texts without words are one each; a short near text with other words stays."""
    as_corpus = lambda df: df.select("doc_id", "text", "lang", "source", df["n_chars"].cast("int"))
    kept = corpus_pipeline.near_dedup(spark, as_corpus(docs), small).select("doc_id", "text").collect()
    want = [1, 3, 6, 7, 8, 9, 10, 11, 11, 12, None]
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, as_corpus(empty), small).count() == 0


def test_a_cluster_is_not_compared_in_pairs(spark, small):
    """2,000 near copies of one text, some at the edge of the similarity, among others: one of them stays, and so do those beyond."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9)))
    base = [word() for _ in range(120)]
    edited = lambda n: " ".join(word() if k in places else w for places in [set(draw.sample(range(120), n))] for k, w in enumerate(base))
    texts = [" ".join(base)] + [edited(draw.choice([1, 1, 2])) for _ in range(2_000)] + [edited(draw.randint(3, 9)) for _ in range(100)] + [" ".join(word() for _ in range(100)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    sets = [shingles(t) for t in texts]
    least, todo = list(range(len(texts))), [0]
    linked = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    left = set(range(1, len(texts)))
    groups = []
    while todo:
        group = [todo.pop()]
        for i in group:
            found = [j for j in left if linked(i, j)]
            left -= set(found)
            group += found
        groups.append(min(group))
        if left:
            todo = [min(left)]
            left -= {todo[0]}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).select("doc_id").collect()}
    assert kept == set(groups) and len(least) - len(kept) >= 2_000


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    draw = np.random.default_rng(3)
    sets = [draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 40, 200, 3_000)]
    sets += [np.concatenate([sets[3][k:], draw.integers(0, 1 << 63, k // 2, dtype=np.uint64)]) for k in (1, 10, 60)]
    odd = _parities(np.concatenate(sets), np.array([len(x) for x in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = sum(int(x).bit_count() for x in (odd[i] ^ odd[j]).view(np.uint64))
            assert differ <= len(set(a.tolist()) ^ set(b.tolist())) and differ % 2 == (len(a) + len(b)) % 2
