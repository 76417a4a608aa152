"""The queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, cotraining, grammar, language_model, licenses, merkle, mixing, packing, permutation, quality_rules, secrets, simhash, toxicity
from .common import crc_mod, table
from .tokens import default_tokenizer


def op1_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: doc_id, content_score, meta_score, score, kept."""
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-Pair files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    shards = grammar.write_grammar(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1)
    return grammar.read_grammar(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all documents: doc_id, the measured counts, base_failed, kept, and the stratum."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100: query_id, rank, vec_id, score."""
    return permutation.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    packed = packing.pack_power_of_two(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=2, longest=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents: doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op9_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=3, fold=1)


def op10_pitman_yor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scored = language_model.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against a manifest of the untampered ones: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_positional_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return licenses.report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return conversations.digests(*conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_co_training_quality,
        op2_repair_token_files,
        op3_risk_controlled_rules,
        op4_permutation_index,
        op5_power_of_two_packing,
        op6_simhash_tiles,
        op7_subset_sum_mix,
        op8_trigram_secret_scan,
        op9_zstd_toxicity,
        op10_pitman_yor_score,
        op11_merkle_manifest,
        op12_positional_license_scan,
        op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {"op8_trigram_secret_scan": secrets.oracle_sql(), "op11_merkle_manifest": merkle.oracle_sql()}
