"""Queries over the corpus tables, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import decontamination, licenses, mixing, ngram_join, periodic_runs, pii, pivot_search, quality, sharding, token_blocks, tokens, toxicity, vector_codes
from matchloom.llm.common import read_table


#: The query's own key; users of the operator bring theirs.
QUERY_KEY = b"surrogate-key-1"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data; cases as in pii.pseudonymize."""
    return pii.pseudonymize(read_table(spark, sf_dir, "documents"), key=QUERY_KEY)


def op2_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, from a model fitted on labelled ones; cases as in toxicity.score."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within the error rate; cases as in decontamination.find_leaks."""
    return decontamination.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the public byte-level vocabulary; cases as in tokens.token_report."""
    from public_tokenizers import path

    return tokens.token_report(read_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document and of its lines; cases as in licenses.scan_licenses."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows for every 50th embedding; cases as in pivot_search.embedding_neighbours."""
    return pivot_search.embedding_neighbours(read_table(spark, sf_dir, "embeddings"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed epochs of all documents; cases as in mixing.select_prefixes."""
    return mixing.select_prefixes(read_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate class of every document; cases as in ngram_join.near_duplicates."""
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; cases as in sharding.assign_shards."""
    return sharding.shard_report(read_table(spark, sf_dir, "documents"))


def op10_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, from trees fitted outside the held-out fold; cases as in quality.quality_report."""
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every embedding's parts; cases as in vector_codes.compress."""
    return vector_codes.code_report(read_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, with planted periods; cases as in periodic_runs.run_report."""
    return periodic_runs.run_report(read_table(spark, sf_dir, "documents"))


def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as coded blocks and read back; cases as in token_blocks.write_tokens."""
    from public_tokenizers import path

    return token_blocks.token_file_report(read_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_toxic_severity": op2_toxic_severity,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_token_counts": op4_token_counts,
    "op5_license_digests": op5_license_digests,
    "op6_pivot_top_k": op6_pivot_top_k,
    "op7_mix_sources": op7_mix_sources,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_hash_ring_shards": op9_hash_ring_shards,
    "op10_boosted_quality": op10_boosted_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_blocks": op13_token_blocks,
}

ORACLES: dict[str, str] = {
    "op5_license_digests": licenses.scan_sql(),
    "op6_pivot_top_k": pivot_search.SQL,
    "op7_mix_sources": mixing.mixed_sql(),
    "op8_ngram_jaccard": ngram_join.SQL,
    "op11_vector_codes": vector_codes.code_sql(),
}
