"""Nested patient records and patient-level regrouping of documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.functions.text import is_filled, truncate_code

DOCUMENTS_PER_STRETCH = 1_000
MOST_BYTES = 2_000_000_000


def patient_notes(patients: DataFrame, pool: str) -> DataFrame:
    """One row per document of the patients of a pool, with the first principal code as `dp`."""
    notes = patients.filter(F.col("pool") == pool).select(
        "patient_id",
        F.posexplode("documents.text").alias("document_no", "note_text"),
        F.get("structured_abstract.primary_diagnosis.code", F.lit(0)).alias("dp"),
    )
    return notes.filter(is_filled(F.col("dp")))


def patient_key(note_id: Column, suffix: int = 2) -> Column:
    """The note id as text without its last characters."""
    return truncate_code(note_id.cast("string"), -suffix)


def group_documents(
    documents: DataFrame,
    *,
    key: str = "patient_id",
    order: str = "document_no",
    text: str = "note_text",
    stretch: int = DOCUMENTS_PER_STRETCH,
) -> DataFrame:
    """Join the texts of each patient in order: (`key`, `n_documents`, `text`), one row per patient.

    Stretches of a patient's documents are joined first, then the stretches in order; their width
    changes the layout only. `order` is a non-negative number that is unique within a patient. A
    patient whose text is more than a row can hold is an error.
    """

    def joined(place: str, part: str) -> Column:
        in_order = F.array_sort(F.collect_list(F.when(F.col(part).isNotNull(), F.struct(place, part))))
        return F.array_join(F.transform(in_order, lambda d: d[part]), " ")

    stretches = documents.groupBy(key, F.floor(F.col(order) / stretch).alias("_stretch")).agg(
        F.count("*").alias("_n"), F.count(text).alias("_texts"), joined(order, text).alias("_text")
    )
    # A stretch without any text adds no blank.
    stretches = stretches.withColumn("_text", F.when(F.col("_texts") > 0, F.col("_text")))
    size = F.sum(F.octet_length("_text") + 1)
    too_long = F.raise_error(F.concat(F.lit("text too long for one row, patient "), F.col(key).cast("string")))
    whole = F.when(F.col("_size") > MOST_BYTES, too_long).otherwise(F.col(text))
    return (
        stretches.groupBy(key)
        .agg(F.sum("_n").alias("n_documents"), joined("_stretch", "_text").alias(text), size.alias("_size"))
        .select(key, "n_documents", whole.alias(text))
    )


def first_gold(documents: DataFrame, *, key: str, order: str, gold: str) -> DataFrame:
    """The gold code of the first document of each patient that has one."""
    known = F.when(F.col(gold).isNotNull(), F.col(order))
    return documents.groupBy(key).agg(F.min_by(gold, known).alias(gold))
