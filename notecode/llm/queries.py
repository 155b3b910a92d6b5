"""The registered queries of this package, each over its whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from notecode.llm import cotraining, embedding_join, jaccard_join, language, line_quality, mixing, part_codes, personal_data, pieces, prefix_trie, secret_scan, unit_dedup, warc


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.quality_scores(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op2_language_spans(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(_read(spark, folder, "documents"))


def op3_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, _read(spark, folder, "pages"))


def op4_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.verdicts(_read(spark, folder, "documents"))


def op5_grid_order(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_join.near_duplicates(_read(spark, folder, "embeddings"))


def op6_jaccard_regions(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, folder, "documents"))


def op7_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(_read(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return unit_dedup.repeated_units(_read(spark, folder, "documents"), unit_dedup.PASSAGE)


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(_read(spark, folder, "documents"), corpus_pipeline.model_path(), with_ids=False, with_decoded=False)


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digests(_read(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, folder, "conversations"))


def op12_part_codes(spark: SparkSession, folder: str) -> DataFrame:
    return part_codes.codes(_read(spark, folder, "embeddings"))


def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(_read(spark, folder, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_language_spans": op2_language_spans,
    "op3_warc_chunks": op3_warc_chunks,
    "op4_line_quality": op4_line_quality,
    "op5_grid_order": op5_grid_order,
    "op6_jaccard_regions": op6_jaccard_regions,
    "op7_fair_mix": op7_fair_mix,
    "op8_line_dedup": op8_line_dedup,
    "op9_pieces": op9_pieces,
    "op10_personal_data": op10_personal_data,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_part_codes": op12_part_codes,
    "op13_secret_scan": op13_secret_scan,
    "pipeline": corpus_pipeline.run,
}
