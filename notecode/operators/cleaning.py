"""From raw annotated notes to clean labelled notes."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.functions.annotations import parse_annotations
from notecode.functions.text import is_filled
from notecode.operators.joins import (
    BROADCAST_ROWS,
    ArrayLookup,
    drop_listed,
    is_small,
    keep_listed,
    lookup_join,
)
from notecode.sources.shared_folder import stored

# Fixed value: the care mode of a note without a related diagnosis.
DEFAULT_CARE_MODE = "Z769"

# Principal codes of the training notes that are malformed or cannot be billed.
DENIED_CODES = ["C09", "C03", "T918", "E10", "C50", "C05", "C10", "E11ni", "C67", "C04"]


def drop_incomplete(raw: DataFrame) -> DataFrame:
    """Drop the rows with a NULL in any column; apply it before any projection."""
    return raw.na.drop("any")


def apply_care_mode(df: DataFrame) -> DataFrame:
    """Replace `dr` by `mdp`: with a related code, it becomes `dp` and `mdp` the former `dp`."""
    care_mode = F.when(F.col("dr").isNotNull(), F.col("dp")).otherwise(F.lit(DEFAULT_CARE_MODE))
    kept = [c for c in df.columns if c not in ("dp", "dr", "mdp")]
    return df.select(*kept, F.coalesce("dr", "dp").alias("dp"), care_mode.alias("mdp"))


def keep_valid_array_codes(
    notes: DataFrame,
    codes: DataFrame,
    column: str = "das",
    *,
    note_key: str = "note_id",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Keep the listed codes of an array column; an array may end empty, its note is kept."""
    listed = codes.toDF("code").distinct()
    if is_small(codes, broadcast_rows):
        lookup = ArrayLookup(listed.withColumn("listed", F.lit(True)), "code", "listed")
        kept = F.filter(column, lambda c: lookup.get(F.col("_listed"), c).isNotNull())
        return notes.withColumn("_listed", lookup.column()).withColumn(column, kept).drop("_listed")
    # A code list of unknown size: semi-join the exploded codes, then put the arrays back.
    # Note ids may repeat or be missing, so that goes by a row id stored with the notes.
    notes = stored(notes.withColumn("_row", F.monotonically_increasing_id()), "numbered-notes")
    exploded = notes.select("_row", F.posexplode(column).alias("_pos", "code"))
    valid = lookup_join(exploded, listed, ["code"], "left_semi", salt_by=["_row", "_pos"], small=False)
    arrays = valid.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "code"))).alias("_kept")
    )
    kept = F.transform("_kept", lambda e: e.code)
    filled = F.when(
        F.col(column).isNotNull(), F.coalesce(kept, F.array().cast("array<string>"))
    )
    return notes.join(arrays, "_row", "left").withColumn(column, filled).drop("_kept", "_row")


def drop_denied(
    notes: DataFrame,
    denied: Sequence[str] | DataFrame = DENIED_CODES,
    column: str = "dp",
    note_key: str = "note_id",
) -> DataFrame:
    """Drop the notes whose code is denied or NULL. Takes a short list or a one-column table."""
    if isinstance(denied, DataFrame):
        return drop_listed(notes, denied, column, salt_by=[note_key])
    return notes.filter(~F.col(column).isin(list(denied)))


def validate_codes(
    notes: DataFrame, dp_codes: DataFrame, das_codes: DataFrame, note_key: str = "note_id"
) -> DataFrame:
    """Keep the notes whose `dp` and `mdp` are valid principal codes, and their valid `das` codes."""
    notes = notes.filter(is_filled(F.col("dp")))
    notes = keep_listed(
        notes, dp_codes, "dp", "mdp", salt_by=[note_key], small=is_small(dp_codes)
    )
    notes = notes.withColumn("das", F.array_sort(F.array_distinct("das")))
    return keep_valid_array_codes(notes, das_codes, "das", note_key=note_key)


def clean_notes(
    raw: DataFrame,
    dp_codes: DataFrame,
    das_codes: DataFrame,
    *,
    text: str = "clinical_note",
    annotations: str = "annot_diagnostics_v2",
    note_key: str = "note_id",
) -> DataFrame:
    """Raw annotated notes to (`note_key`, `note_text`, `dp`, `das`, `mdp`)."""
    complete = drop_incomplete(raw).select(
        note_key, F.col(text).alias("note_text"), F.col(annotations).alias("_annotations")
    )
    parsed = parse_annotations(complete, "_annotations").drop("_annotations")
    valid = validate_codes(apply_care_mode(parsed), dp_codes, das_codes, note_key)
    return valid.select(note_key, "note_text", "dp", "das", "mdp")


def cleaning_funnel(
    raw: DataFrame,
    dp_codes: DataFrame,
    *,
    annotations: str = "annot_diagnostics_v2",
    note_key: str = "note_id",
) -> DataFrame:
    """Rows left after each cleaning step, counted in one pass: (`step`, `stage`, `n`)."""
    complete = F.lit(True)
    for column in raw.columns:
        complete = complete & F.col(column).isNotNull()
    flagged = raw.select(
        note_key, F.col(annotations).alias("_annotations"), complete.alias("complete")
    )
    ruled = apply_care_mode(parse_annotations(flagged, "_annotations"))
    listed, small = dp_codes.toDF("code").distinct(), is_small(dp_codes)
    for head in ("dp", "mdp"):
        keys = listed.select(F.col("code").alias(head), F.lit(True).alias(f"{head}_listed"))
        ruled = lookup_join(ruled, keys, [head], "left", salt_by=[note_key], small=small)
    stages = [
        ("read", F.lit(True)),
        ("complete", F.col("complete")),
        ("with_dp", is_filled(F.col("dp"))),
        ("dp_valid", F.coalesce("dp_listed", F.lit(False))),
        ("mdp_valid", F.coalesce("mdp_listed", F.lit(False))),
    ]
    counts, reached = [], F.lit(True)
    for name, passed in stages:
        reached = reached & passed
        counts.append(F.count(F.when(reached, 1)).alias(name))
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.col(name).alias("n"))
            for i, (name, _) in enumerate(stages)
        ]
    )
    return ruled.agg(*counts).select(F.inline(rows))
