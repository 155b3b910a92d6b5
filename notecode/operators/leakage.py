"""Texts of an evaluation set whose beginning also occurs in the training set."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.operators.joins import lookup_join
from notecode.sources.shared_folder import stored

# Fixed value: characters compared.
PREFIX_CHARACTERS = 1000


def prefix_key(text: Column, characters: int) -> Column:
    """SHA-256 of the first characters: 32 bytes to shuffle in place of the text."""
    return F.unhex(F.sha2(F.left(text, F.lit(characters)), 256))


def _shared_prefixes(test: DataFrame, train: DataFrame, text: str, characters: int) -> DataFrame:
    """Each prefix of the test set once, with its number of notes and whether train has it."""
    in_test = test.groupBy(prefix_key(F.col(text), characters).alias("_prefix")).agg(
        F.count("*").alias("n")
    )
    in_train = train.select(
        prefix_key(F.col(text), characters).alias("_prefix"), F.lit(True).alias("_seen")
    ).distinct()
    return in_test.join(in_train, "_prefix", "left")


def flag_leaks(
    test: DataFrame,
    train: DataFrame,
    *,
    text: str = "note_text",
    note_key: str = "note_id",
    characters: int = PREFIX_CHARACTERS,
) -> DataFrame:
    """Add `leaked`: whether a training text starts with the same characters.

    Both sides are reduced to distinct prefixes before they meet. Those in both are stored, so that
    the texts are read once more only, to mark the test rows.
    """
    shared = _shared_prefixes(test, train, text, characters).filter(F.col("_seen"))
    leaked = stored(shared.select("_prefix", F.col("_seen").alias("leaked")), "leaked-prefixes")
    keyed = test.withColumn("_prefix", prefix_key(F.col(text), characters))
    marked = lookup_join(keyed, leaked, ["_prefix"], "left", salt_by=[note_key])
    return marked.withColumn("leaked", F.coalesce("leaked", F.lit(False))).drop("_prefix")


def leak_summary(
    test: DataFrame, train: DataFrame, *, text: str = "note_text", characters: int = PREFIX_CHARACTERS
) -> DataFrame:
    """Number of test notes with and without a leak."""
    shared = _shared_prefixes(test, train, text, characters)
    leaked = F.coalesce("_seen", F.lit(False)).alias("leaked")
    return shared.groupBy(leaked).agg(F.sum("n").alias("n"))
