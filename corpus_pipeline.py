"""From raw documents to packed sequences: five stages, each written and read again by the next.

The quality classifier drops what it rejects, one document of each group of near
copies stays, secrets are cut out, sources are mixed to their target weights
(texts repeat as often as the mix takes them), and the rest is packed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm import cotraining, mixing, packing, secrets, simhash
from geoquilt.llm.common import scratch_dir, table
from geoquilt.llm.tokens import default_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier keeps."""
    return cotraining.keep_good(_documents(docs), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked where 0.8 or more of their five-word shingles are the same: the one with the smallest id."""
    return simhash.keep_one(_documents(docs), shingle=5, similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced by the kind in brackets; n_chars follows the text."""
    found = secrets.find_secrets(_documents(docs), keep=("lang", "source", "n_chars"))
    clean = F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.select("doc_id", clean.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(clean)).otherwise(F.col("n_chars")).cast("int").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixing.repeat_taken(_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents, with their token ids."""
    return packing.pack_power_of_two(_documents(docs), default_tokenizer(), end_id=2, longest=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("pack", pack),
]

#: Classification, fingerprints and tokens are no SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
