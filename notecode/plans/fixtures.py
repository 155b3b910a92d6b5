"""Coded notes derived from the given tables, as inputs of the registered queries.

A line of an order stands for one entry of a note's annotation, the part for its code, a part for a
synonym, a document for a note text and a conversation for a patient.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.operators.cleaning import apply_care_mode, validate_codes
from notecode.operators.joins import lookup_join
from notecode.operators.labels import valid_codes
from notecode.operators.once import with_columns_once
from notecode.sources.shared_folder import stored

# Room for part keys in the place of an annotation entry: line number, part key, flag.
_LINE = 1_000_000_000_000_000


class Fixtures:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def part_codes(self) -> DataFrame:
        letter = F.when(F.col("p_type") == "STANDARD", "Z").otherwise(F.left("p_type", F.lit(1)))
        size = F.lpad(F.col("p_size").cast("string"), 2, "0")
        brand = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
        return self.table("part").select(
            "p_partkey", "p_name", "p_type", F.concat(letter, size, brand).alias("code")
        )

    @cached_property
    def referential(self) -> DataFrame:
        """(`code`, `mco_had`); several codes have no category or one that is not valid.

        Stored once, as a referential is, so that each lookup reads a small file.
        """
        digit = F.col("p_partkey") % 10
        category = F.when(digit < 6, 0).when(digit < 9, digit - 5)
        default = self.spark.range(1).select(F.lit("Z769").alias("code"), F.lit(0).alias("c"))
        codes = self.part_codes().select("code", category.cast("int").alias("c"))
        return stored(codes.union(default).groupBy("code").agg(F.min("c").alias("mco_had")), "codes")

    def codes(self, head: str) -> DataFrame:
        return valid_codes(self.referential, head)

    def entries(self) -> DataFrame:
        """(`note_id`, `code`, `first_place`, `last_place`): the codes of each annotation.

        Places say where a code is written first and last; the last place also gives its position.
        """
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("note_id"),
            F.col("l_partkey").alias("p_partkey"),
            (
                F.col("l_linenumber") * F.lit(_LINE)
                + F.col("l_partkey") * 10
                + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
            ).alias("place"),
        )
        codes = self.part_codes().select("p_partkey", "code")
        coded = lookup_join(lines, codes, ["p_partkey"], salt_by=["note_id", "place"])
        return coded.groupBy("note_id", "code").agg(
            F.min("place").alias("first_place"), F.max("place").alias("last_place")
        )

    @staticmethod
    def position(place: Column) -> Column:
        line, related = F.floor(place / F.lit(_LINE)), place % 10 == 1
        return (
            F.when(line <= 2, "DP")
            .when((line == 3) & related, "DR")
            .when((line == 7) & related, "OTHER")
            .otherwise("DAS")
        )

    def annotation_texts(self) -> DataFrame:
        """(`note_id`, `annot_diagnostics_v2`): the dict text of each note.

        A code written more than once is in the text at its first and at its last place. Some notes
        use notations that only Python reads, some are no dict.
        """

        def item(place: Column) -> Column:
            detail = F.concat(F.lit("{'position': '"), self.position(place), F.lit("'}"))
            return F.struct(
                place.alias("place"),
                F.concat(F.lit("'"), F.col("code"), F.lit("': "), detail).alias("text"),
            )

        first, last = F.col("first_place"), F.col("last_place")
        both = F.array(item(first), F.when(first < last, item(last)))
        # A note cannot hold more items than twice the number of codes.
        items = self.entries().groupBy("note_id").agg(F.collect_list(both).alias("items"))
        parts = F.transform(F.array_sort(F.array_compact(F.flatten("items"))), lambda i: i.text)
        body = F.array_join(parts, ", ")
        kind = F.col("note_id") % 50
        text = (
            F.when(kind == 0, F.concat(F.lit("{'seen': None, "), body, F.lit("}")))
            .when(kind == 1, F.concat(F.lit("{"), body, F.lit(",}")))
            .when(kind == 2, F.concat(F.lit("{"), body, F.lit("} end")))
            .when(kind == 3, F.concat(F.lit("{'seen': null, "), body, F.lit("}")))
            .when(kind != 4, F.concat(F.lit("{"), body, F.lit("}")))
        )
        return with_columns_once(items, {"annot_diagnostics_v2": text}).drop("items")

    def python_notations(self) -> DataFrame:
        """`annotation_texts` with more details per code, in notations that JSON lacks."""
        detail = r"""'label': 'l\'examen "x" \\', "sure": True, 'rank': None, 'tags': [1, 'n\t'], 'position': """
        text = F.replace(F.col("annot_diagnostics_v2"), F.lit("'position': "), F.lit(detail))
        return self.annotation_texts().withColumn("annot_diagnostics_v2", text)

    def raw_notes(self) -> DataFrame:
        """Raw annotated notes; some lack the text or a further column."""
        note_id = F.col("note_id")
        text = F.concat(F.lit("Note "), note_id.cast("string"), F.lit("\nline \"two\", end"))
        return self.annotation_texts().select(
            "note_id",
            F.when(note_id % 41 != 0, text).alias("clinical_note"),
            "annot_diagnostics_v2",
            F.when(note_id % 37 != 0, F.concat(F.lit("w"), (note_id % 9).cast("string"))).alias("ward"),
        )

    def parsed_notes(self) -> DataFrame:
        """(`note_id`, `dp`, `dr`, `das`) folded from the entries without the detour over text."""
        position = self.position(F.col("last_place"))

        def last(name: str) -> Column:
            at = F.when(F.col("position") == name, F.col("first_place"))
            return F.max_by("code", at)

        # `das` is a set of codes, which the code list bounds.
        return (
            self.entries()
            .withColumn("position", position)
            .groupBy("note_id")
            .agg(
                last("DP").alias("dp"),
                last("DR").alias("dr"),
                F.collect_list(F.when(F.col("position") == "DAS", F.col("code"))).alias("das"),
            )
        )

    def notes(self) -> DataFrame:
        """Clean notes (`note_id`, `dp`, `das`, `mdp`, `split`)."""
        ruled = apply_care_mode(self.parsed_notes())
        valid = validate_codes(ruled, self.codes("dp"), self.codes("das"))
        split = F.when(F.col("note_id") % 5 == 0, "test").otherwise("train")
        return valid.select("note_id", "dp", "das", "mdp", split.alias("split"))

    def synonyms(self) -> DataFrame:
        text = F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string"))
        return self.part_codes().select(
            F.col("p_partkey").alias("ordinal"), "code", text.alias("libelle")
        )

    @staticmethod
    def predicted_dp() -> Column:
        """A made-up prediction for a clean note: right, near, wrong or missing."""
        note_id, dp = F.col("note_id"), F.col("dp")
        near = F.concat(F.left(dp, F.lit(3)), F.lit("99"))
        return (
            F.when(note_id % 17 == 0, None)
            .when(note_id % 3 == 0, dp)
            .when(note_id % 3 == 1, near)
            .otherwise(F.col("mdp"))
        )

    def scored(self) -> DataFrame:
        """(`note_id`, `dp_gold`, `dp`)."""
        return self.notes().select(
            "note_id", F.col("dp").alias("dp_gold"), self.predicted_dp().alias("dp")
        )

    def head_scores(self) -> DataFrame:
        """(`note_id`, `head`, `label`, `score`) with ties."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("note_id"), F.col("l_partkey").alias("p_partkey"), "l_quantity"
        )
        codes = self.part_codes().select("p_partkey", F.col("code").alias("label"))
        coded = lookup_join(lines, codes, ["p_partkey"], salt_by=["note_id", "l_quantity"])
        scores = coded.groupBy("note_id", "label").agg((F.max("l_quantity") / 50).alias("score"))
        return scores.select("note_id", F.lit("das").alias("head"), "label", "score")

    def documents(self) -> DataFrame:
        """(`note_id`, `note_text`, `lang`, `source`, `split`)."""
        split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
        return self.table("documents").select(
            F.col("doc_id").alias("note_id"), F.col("text").alias("note_text"), "lang", "source",
            split.alias("split"),
        )

    def patient_documents(self) -> DataFrame:
        """(`patient_id`, `document_no`, `type`, `note_text`, `pool`)."""
        pool = F.when(F.col("conv_id") % 3 == 0, "other").otherwise("coding")
        return self.table("conversations").select(
            F.col("conv_id").alias("patient_id"), F.col("turn").alias("document_no"),
            F.col("role").alias("type"), F.col("text").alias("note_text"), pool.alias("pool"),
        )

    def patients(self) -> DataFrame:
        """Nested patient records of one document each; some have no code, some no document."""
        document = F.struct("type", F.col("note_text").alias("text"))
        codes = F.when(F.col("patient_id") % 4 == 0, F.array().cast("array<struct<code:string>>")).otherwise(
            F.array(
                F.struct(F.concat(F.lit("P"), (F.col("patient_id") % 9).cast("string")).alias("code")),
                F.struct(F.lit("Q1").alias("code")),
            )
        )
        documents = F.when(
            F.col("document_no") % 5 == 4, F.array().cast("array<struct<type:string,text:string>>")
        ).otherwise(F.array(document, F.struct(F.lit("letter").alias("type"), F.lit("copy").alias("text"))))
        return self.patient_documents().select(
            (F.col("patient_id") * 1000 + F.col("document_no")).alias("patient_id"),
            "pool",
            documents.alias("documents"),
            F.struct(codes.alias("primary_diagnosis")).alias("structured_abstract"),
        )
