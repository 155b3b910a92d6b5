"""Quoted CSV whose large files are read by many tasks.

A line break inside quotes does not end a record, so a task that starts in the middle of a file cannot
know whether its first line begins one. Each line is a small function here: the state behind it
(inside quotes or not) for each state before it. The lines of a block of a file make one such function,
a running composition over the blocks gives the state at the start of each, and with that every line
knows its record.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecode.functions.text import blank_to_null
from notecode.sources.shared_folder import stored

QUOTE, DELIMITER = '"', ","
OPTIONS = {"quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE"}
_BLOCK = ["_file", "_block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line with its file, block, place and `_after`: the state behind it for both states before.

    `_after.o` is for a line that begins outside quotes, `_after.i` for one that begins inside. Only a
    quote at the beginning of a field opens one; a doubled one changes nothing.
    """
    metadata = F.col("_metadata")
    # Alone `\n` separates, so a lone `\r` stays text; one in front of the line break does not.
    lines = spark.read.text(path, lineSep="\n").select(
        metadata.file_path.alias("_file"), metadata.file_block_start.alias("_block"),
        F.monotonically_increasing_id().alias("_place"), F.regexp_replace("value", "\r$", "").alias("_line"),
    )
    fields = F.transform(
        F.split("_line", DELIMITER),
        lambda f: F.struct(
            f.startswith(QUOTE).alias("opens"),
            ((F.length(f) - F.length(F.replace(f, F.lit(QUOTE), F.lit("")))) % 2 == 1).alias("odd"),
        ),
    )

    def behind(inside: Column, field: Column) -> Column:
        return F.when(inside, ~field.odd).otherwise(field.opens & field.odd)

    unchanged = F.struct(F.lit(False).alias("o"), F.lit(True).alias("i"))
    folded = F.aggregate(
        fields, unchanged, lambda s, f: F.struct(behind(s.o, f).alias("o"), behind(s.i, f).alias("i"))
    )
    after = F.when(F.contains("_line", F.lit(QUOTE)), folded).otherwise(unchanged)
    return lines.withColumn("_after", after)


def _with_state(rows: DataFrame, group: list[str], order: str, start: Column) -> DataFrame:
    """Add `_inside`: the state before each row of a group whose first row begins in `start`.

    A row either sets the state, keeps it or turns it over, so the state is the last one that was set,
    turned over as often as rows have done so since.
    """
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outside, inside = F.col("_after.o"), F.col("_after.i")
    turns = F.coalesce(F.sum((outside & ~inside).cast("long")).over(before), F.lit(0))
    rows = rows.withColumn("_turns", turns)
    sets = F.when(outside == inside, F.struct(inside.alias("state"), "_turns"))
    rows = rows.withColumn("_set", F.last(sets, ignorenulls=True).over(before))
    since = F.col("_turns") - F.coalesce("_set._turns", F.lit(0))
    state = F.coalesce("_set.state", start) != (since % 2 == 1)
    return rows.withColumn("_inside", state).drop("_turns", "_set")


def _blocks(lines: DataFrame) -> DataFrame:
    """(`_file`, `_block`, `_start`, `_owner`): the state a block begins in, and the block in which the
    record begun that is open there."""
    changes = F.when(F.col("_after.o") | ~F.col("_after.i"), F.struct("_place", "_after"))
    summary = lines.groupBy(*_BLOCK).agg(
        F.array_sort(F.collect_list(changes)).alias("_changes"), F.max("_place").alias("_last")
    )

    def through(state: Column, change: Column) -> Column:
        return F.when(state, change["_after"]["i"]).otherwise(change["_after"]["o"])

    def step(s: Column, change: Column) -> Column:
        inside = through(s.i, change)
        begins = s.begins | (~inside & (change["_place"] < F.col("_last")))
        return F.struct(through(s.o, change).alias("o"), inside.alias("i"), begins.alias("begins"))

    first = F.struct(F.lit(False).alias("o"), F.lit(True).alias("i"), F.lit(False).alias("begins"))
    summary = summary.select(*_BLOCK, F.aggregate("_changes", first, step).alias("_after"))
    started = _with_state(summary, ["_file"], "_block", F.lit(False))
    # A record begins in each block that starts outside quotes, or gets out of them before its last line.
    begins = F.when(~F.col("_inside") | F.col("_after.begins"), F.col("_block"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(begins, ignorenulls=True).over(earlier)
    return started.select(*_BLOCK, F.col("_inside").alias("_start"), owner.alias("_owner"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(`record`, `is_header`): the text of each record, its line breaks as `\\n`; empty lines go.

    The files are read twice, once for the states. Lines are shuffled once, by block, and their records
    stored; only those that cross from one block into another are shuffled again. A quote that is never
    closed makes the rest of its file one record, as in any reader.
    """
    lines = _lines(spark, path)
    placed = _with_state(lines.join(_blocks(lines), _BLOCK), _BLOCK, "_place", F.col("_start"))
    upto = Window.partitionBy(*_BLOCK).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("_number", F.sum((~F.col("_inside")).cast("long")).over(upto))
    behind = F.when(F.col("_inside"), F.col("_after.i")).otherwise(F.col("_after.o"))

    def in_order(place: str, text: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("t"))))
        return F.array_join(F.transform(pairs, lambda e: e.t), "\n")

    # The lines of a block lie together already, so this groups without a shuffle.
    parts = numbered.groupBy(*_BLOCK, "_number").agg(
        in_order("_place", "_line").alias("record"), F.max_by(behind, "_place").alias("_open"),
        F.first("_owner").alias("_owner"),
    )
    parts = stored(parts, "csv-records", compression="zstd")
    is_header = ((F.col("_block") == 0) & (F.col("_number") == 1)).alias("is_header")
    crosses = (F.col("_number") == 0) | F.col("_open")
    begun = F.when(F.col("_number") == 0, F.col("_owner")).otherwise(F.col("_block"))
    crossing = parts.filter(crosses).withColumn("_begun", begun).withColumn("is_header", is_header)
    crossing = crossing.groupBy("_file", "_begun").agg(
        in_order("_block", "record").alias("record"), F.max("is_header").alias("is_header")
    )
    records = parts.filter(~crosses).select("record", is_header).unionByName(crossing.select("record", "is_header"))
    return records.filter("record != ''")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of `tables.read_notes_csv`, with large files read by many tasks.

    The same holds for short and long rows and for the texts that mean "missing". The first record of
    each file is its header.
    """
    fields = schema or spark.read.options(header=True, multiLine=True, **OPTIONS).csv(path).schema
    names = [f"_{i}" for i in range(len(fields))]
    # The same spare fields as in `read_notes_csv` tell rows that are too long.
    parsed = F.from_csv(
        F.col("record"), ", ".join(f"{c} string" for c in [*names, "_beyond", "_incomplete"]),
        {**OPTIONS, "multiLine": "true", "columnNameOfCorruptRecord": "_incomplete"},
    )
    rows = csv_records(spark, path).filter("not is_header").select(parsed.alias("_row"))
    rows = rows.filter("_row._beyond is null and _row._incomplete is not null")
    return rows.select(
        *[blank_to_null(F.col(f"_row.{c}")).alias(f.name) for c, f in zip(names, fields, strict=True)]
    )
