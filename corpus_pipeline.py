"""The pipeline of the training-data operators over `documents`.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again before the next one.
All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.llm import jaccard_join, language, mixing, personal_data, pieces
from notecode.sources.shared_folder import stored

LEAST_SCORE = 0.2


def model_path() -> str:
    """The public SentencePiece model; it has the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go; `lang` becomes the language that was found.

    Learns from all documents of the stage that have a lang. Without letters, or where no language
    holds a fifth of the letters with certainty, a document is rejected.
    """
    model = language.learn(docs.filter(~language.held_out(F.col("doc_id"))).select("text", "lang"))
    labelled = language.label(docs, model, with_spans=False)
    found = F.col("_nc_label.lang_pred")
    kept = labelled.filter((found != language.UNKNOWN) & (F.col("_nc_label.score") >= LEAST_SCORE))
    return kept.withColumn("lang", found).select(*docs.columns)


def one_row_per_document(docs: DataFrame) -> DataFrame:
    """Rows that share an id are one document: of them the row with the least text stays, NULL last.

    Rows without an id are one document if they share a text. Texts of other ids are not shuffled.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(F.col("text").isNull(), "text", *others)).alias("least")
    columns = [c if c == "doc_id" else F.col(f"least.{c}").alias(c) for c in docs.columns]
    with_id, without = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    repeated = stored(with_id.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    again = jaccard_join.only(with_id, repeated, "doc_id", "inner").groupBy("doc_id").agg(least)
    nameless = without.groupBy("doc_id", F.sha2("text", 256)).agg(least)
    reduced = stored(again.select(*columns).unionByName(nameless.select(*columns)), "repeated-documents")
    rest = jaccard_join.only(with_id, repeated, "doc_id", "left_anti").select(*docs.columns)
    return rest.unionByName(reduced)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join stays: the one with the least id.

    Each document is one row, see `one_row_per_document`; without an id it has no near duplicates.
    """
    docs = one_row_per_document(docs)
    found = jaccard_join.near_duplicates(docs)
    gone = stored(found.filter("doc_id != component_id").select("doc_id").distinct(), "near-duplicates")
    return jaccard_join.only(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return personal_data.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's whole text, with the digests of ids and decoded text."""
    return pieces.encode(docs, model_path(), with_decoded=False)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# The trained language model and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
