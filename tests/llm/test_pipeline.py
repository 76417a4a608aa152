"""The stages of the pipeline against plain Python, each on its own input."""

import numpy as np
import pytest

import corpus_pipeline

from . import brute


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The tables before and after each stage."""
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tables = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        tables[name] = docs.toPandas()
    return tables


def test_columns_and_types(stages):
    names = list(stages)
    for name in names[:-1]:
        assert list(stages[name].columns) == list(corpus_pipeline.COLUMNS)


def test_quality_keeps_whole_rows(stages):
    before, after = stages["documents"].set_index("doc_id"), stages["quality"].set_index("doc_id")
    assert len(after) > 0.5 * len(before)
    assert after["text"].equals(before.loc[after.index, "text"])


def test_one_of_each_group_stays(stages):
    """Texts of which 0.8 or more of the five-word shingles are the same are linked, by comparing all pairs."""
    before, after = stages["quality"].sort_values("doc_id"), stages["near_dedup"]
    ids, sets = before["doc_id"].tolist(), []
    for text in before["text"]:
        words = brute.WORD.findall((text or "").translate(brute.LOWER))
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))))
    least = list(range(len(ids)))
    for _ in ids:
        was = list(least)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if len(x & y) >= 0.8 * len(x | y):
                    least[i] = least[j] = min(least[i], least[j])
        if least == was:
            break
    want = {ids[k] for k in least}
    assert len(want) < len(ids) and set(after["doc_id"]) == want and len(after) == len(want)


def test_no_secret_is_left(stages):
    before, after = stages["near_dedup"].set_index("doc_id")["text"], stages["secret_scan"].set_index("doc_id")["text"]
    assert set(before.index) == set(after.index)
    for i, text in before.items():
        if brute.secret_spans(text):
            assert not any(s[2] in ("access", "hex") for s in brute.secret_spans(after[i]))
        else:
            assert after[i] == text
    n = stages["secret_scan"]
    assert (n["n_chars"] == n["text"].str.len()).all()


def test_mix_takes_whole_copies(stages):
    before, after = stages["secret_scan"], stages["mix"]
    words = lambda df: df.assign(n=[len(brute.WORD.findall(t)) for t in df["text"]]).groupby("source")["n"].sum()
    there, taken = words(before), words(after)
    assert (after.groupby("doc_id").size() <= 3).all()
    assert taken.sum() == pytest.approx(there.sum(), rel=0.01)


def test_packed_ids_are_the_texts(stages):
    from geoquilt.llm.tokens import default_tokenizer

    docs, pieces = stages["mix"].drop_duplicates("doc_id").head(40), stages["pack"]
    for i, ids in zip(docs["doc_id"], brute.encoded(default_tokenizer(), docs["text"], 2), strict=True):
        mine = pieces[pieces["doc_id"] == i].drop_duplicates("start").sort_values("start")
        assert np.frombuffer(b"".join(mine["ids"]), "<u4").tolist() == ids


def test_run_returns_the_last_stage(spark, small, stages):
    assert corpus_pipeline.run(spark, small).columns == list(stages["pack"].columns)
