"""Label spaces, frequencies, coverage, ids and class weights.

Every table here is long: one row per (`head`, `label`).
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notecode.operators.joins import BROADCAST_ROWS, ArrayLookup, is_small, lookup_join
from notecode.operators.ranking import rank_in_group
from notecode.sources.shared_folder import stored

HEADS = ("dp", "das", "mdp")

# Which referential categories make a code valid for a head.
PRINCIPAL_CATEGORIES = [0]
ASSOCIATED_CATEGORIES = [0, 1, 2]
CARE_MODE_PREFIX = "Z"


def valid_for(head: str, code: Column, category: Column) -> Column:
    """Whether a referential row is valid for a head."""
    if head == "das":
        return category.isin(ASSOCIATED_CATEGORIES)
    principal = category.isin(PRINCIPAL_CATEGORIES)
    return principal & code.startswith(CARE_MODE_PREFIX) if head == "mdp" else principal


def valid_codes(referential: DataFrame, head: str) -> DataFrame:
    """The codes that are valid for a head, in one column `code`."""
    return referential.filter(valid_for(head, F.col("code"), F.col("mco_had"))).select("code")


def referential_label_space(referential: DataFrame) -> DataFrame:
    """(`head`, `label`, `label_id`) with ids in referential order."""
    code, category = F.col("code"), F.col("mco_had")
    heads = F.array(*[F.when(valid_for(h, code, category), F.lit(h)) for h in HEADS])
    labels = referential.select(
        F.explode(F.array_compact(heads)).alias("head"), code.alias("label"), "ordinal"
    )
    stretch = F.floor(F.col("ordinal") / 4096)
    ranked = rank_in_group(labels, ["head"], stretch, ["ordinal"], "label_id")
    return ranked.select("head", "label", F.col("label_id").cast("int"))


def melt_labels(notes: DataFrame, heads: Sequence[str] = HEADS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per note, head and code; array heads are exploded, absent codes left out."""
    types = dict(notes.dtypes)

    def tagged(head: str) -> Column:
        codes = F.col(head) if types[head].startswith("array") else F.array(head)
        pairs = F.transform(codes, lambda c: F.struct(F.lit(head).alias("head"), c.alias("label")))
        return F.coalesce(pairs, F.array().cast("array<struct<head:string,label:string>>"))

    # The outer form adds no filter that would build the array a second time.
    melted = notes.select(*keep, F.inline_outer(F.concat(*[tagged(h) for h in heads])))
    return melted.filter(F.col("label").isNotNull())


def label_frequency(notes: DataFrame, heads: Sequence[str] = HEADS) -> DataFrame:
    """Number of notes per head and label."""
    return melt_labels(notes, heads).groupBy("head", "label").agg(F.count("*").alias("n"))


def distinct_labels(notes: DataFrame, heads: Sequence[str] = HEADS) -> DataFrame:
    return melt_labels(notes, heads).distinct()


def top_labels(frequency: DataFrame, k: int) -> DataFrame:
    """The `k` most frequent labels of each head; equal counts are ordered by label."""
    order = Window.partitionBy("head").orderBy(F.desc("n"), "label")
    ranked = frequency.withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("place") <= k)


def label_sources(tagged: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(`head`, `label`, one boolean per source) from rows (`source`, `head`, `label`)."""
    return tagged.groupBy("head", "label").agg(
        *[F.bool_or(F.col("source") == name).alias(name) for name in sources]
    )


def union_label_space(sources: DataFrame, used: dict[str, Sequence[str]]) -> DataFrame:
    """Labels of each head that occur in one of the sources used for it."""
    wanted = F.lit(False)
    for head, names in used.items():
        anywhere = F.lit(False)
        for name in names:
            anywhere = anywhere | F.col(name)
        wanted = wanted | ((F.col("head") == head) & anywhere)
    return sources.filter(wanted).select("head", "label")


def label_coverage(sources: DataFrame) -> DataFrame:
    """Labels that one source has alone, and evaluation labels no training source has.

    Expects the booleans `train`, `syn`, `test` and `other` (a further evaluation set).
    """
    train, syn, test, other = (F.col(c) for c in ("train", "syn", "test", "other"))
    kinds = F.array_compact(
        F.array(
            F.when(train & ~syn & ~test, F.lit("only_train")),
            F.when(syn & ~train, F.lit("syn_not_train")),
            F.when((test | other) & ~train & ~syn, F.lit("eval_unseen")),
        )
    )
    return sources.select("head", "label", F.explode(kinds).alias("kind"))


def number_labels(labels: DataFrame) -> DataFrame:
    """(`head`, `label`, `label_id`) with ids from 0 in label order within each head."""
    ranked = rank_in_group(
        labels.select("head", "label").distinct(), ["head"], F.left("label", F.lit(3)), ["label"],
        "label_id",
    )
    return ranked.select("head", "label", F.col("label_id").cast("int"))


def encode_label(notes: DataFrame, space: DataFrame, head: str, note_key: str = "note_id") -> DataFrame:
    """Add `<head>_id`: the id of the label, or of each label of an array (NULL if unknown)."""
    return _translate(notes, space, head, head, "label", "label_id", f"{head}_id", note_key)


def decode_label(
    notes: DataFrame, space: DataFrame, head: str, column: str, name: str, note_key: str = "note_id"
) -> DataFrame:
    """Add `name`: the label of the id in `column`, or of each id of an array."""
    return _translate(notes, space, head, column, "label_id", "label", name, note_key)


def _translate(notes, space, head, column, key, value, name, note_key):
    table = space.filter(F.col("head") == head).select(
        F.col(key).alias("_key"), F.col(value).alias("_value")
    )
    if not dict(notes.dtypes)[column].startswith("array"):
        keyed = notes.withColumn("_key", F.col(column))
        joined = lookup_join(keyed, table, ["_key"], "left", salt_by=[note_key])
        return joined.withColumnRenamed("_value", name).drop("_key")
    if is_small(table):
        lookup = ArrayLookup(table, "_key", "_value")
        values = F.transform(column, lambda c: lookup.get(F.col("_table"), c))
        return notes.withColumn("_table", lookup.column()).withColumn(name, values).drop("_table")
    # Note ids may repeat or be missing, so the arrays are put back by a row id stored with the notes.
    notes = stored(notes.withColumn("_row", F.monotonically_increasing_id()), "numbered-notes")
    exploded = notes.select("_row", F.posexplode(column).alias("_pos", "_key"))
    joined = lookup_join(exploded, table, ["_key"], "left", salt_by=["_row", "_pos"], small=False)
    arrays = joined.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_values")
    )
    empty = F.when(F.col(column).isNotNull(), F.array().cast(f"array<{dict(table.dtypes)['_value']}>"))
    values = F.coalesce(F.transform("_values", lambda e: e["_value"]), empty)
    return notes.join(arrays, "_row", "left").withColumn(name, values).drop("_values", "_row")


def labels_outside(frequency: DataFrame, space: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Labels in use, with their counts, that the label space of their head lacks."""
    return lookup_join(
        frequency, space.select("head", "label").distinct(), ["head", "label"], "left_anti",
        salt_by=["label"], broadcast_rows=broadcast_rows,
    )


def class_weights(frequency: DataFrame) -> DataFrame:
    """Balanced weights N / (K * n) per head: notes over labels times notes of the label."""
    totals = frequency.groupBy("head").agg(
        F.sum("n").alias("_total"), F.count("*").alias("_labels")
    )
    return lookup_join(frequency, totals, ["head"], salt_by=["label"]).select(
        "head", "label", "n",
        (F.col("_total") / (F.col("_labels") * F.col("n"))).alias("weight"),
    )


