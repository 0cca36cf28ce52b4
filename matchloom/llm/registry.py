"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hilbert_shards, jaccard_join, line_dedup, lm_scores, packing, piece_sampling, quality_rules, toxicity, transport_stream, url_filters
from .common import read


def tokenizer_path(name: str) -> str:
    """A public vocabulary file of the machine; it is read in place, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled_segmentations(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read(spark, sf_dir, "pages"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.sharded(read(spark, sf_dir, "documents"))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_report(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.stupid_backoff(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_best_fit_packing": op1_best_fit_packing, "op2_sampled_pieces": op2_sampled_pieces, "op3_quality_rules": op3_quality_rules, "op4_url_filters": op4_url_filters, "op5_hilbert_shards": op5_hilbert_shards, "op6_transport_stream": op6_transport_stream, "op7_toxicity": op7_toxicity, "op8_stupid_backoff": op8_stupid_backoff, "op9_line_dedup": op9_line_dedup, "op10_ngram_jaccard_join": op10_ngram_jaccard_join, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filters": url_filters.URL_SQL,
        "op8_stupid_backoff": lm_scores.BACKOFF_SQL,
        "op9_line_dedup": line_dedup.LINE_SQL.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS kept_chars, md5(text) AS kept_md5 FROM kept",
    }
