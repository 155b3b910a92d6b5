"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of shuffled documents. A document's virtual finish time is the number of its
source's tokens up to and including it, divided by the source's target. All queues together are
range-sorted by that time and cut off where the total budget is reached. A source whose target is
above its size starts again with its first document, at most `MOST_LAPS` times in all.

Rows that are equal in id and text are one class with a count. They queue one behind the other, each
with its own finish time, and as many of them are taken as the budget reaches; which of them does not
matter to the columns that make them equal.

Defined results: a NULL text has no words; a NULL source is a source of its own and comes last; empty
input gives no rows; other columns of the input are not touched.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notecode.sources.shared_folder import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_LAPS = 3
ROWS_PER_RANGE = 10_000  # rows that one task sorts; the ranges follow the number of rows
KEY_DIGITS = 5
COPIES_PER_TASK = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """The place of a row in its shuffled source; only equal rows share it."""
    own, words = (F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) for c in (doc_id, text))
    return F.md5(F.concat(own, words).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(`source`, `source_size`, `target`) from (`source`, `size`), one row per source.

    The weights repeat over the sources in code point order. A source is capped at `MOST_LAPS` times
    its size; what it leaves is shared by the others. With the sources in the order in which they
    reach their caps, the level is the first one that the next source does not reach.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = total.withColumn("weight", weight)
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(
        F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            "left": F.sum("source_size").over(everything)
            - MOST_LAPS * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "open_weight": F.sum("weight").over(after),
        }
    ).withColumn("level", F.col("left") / F.col("open_weight"))
    fits = F.col("level") * F.col("weight") <= MOST_LAPS * F.col("source_size")
    rows = rows.withColumn("level", F.max(F.when(fits, F.col("level"))).over(everything))
    target = F.least(
        F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"),
        (MOST_LAPS * F.col("source_size")).cast("double"),
    )
    return rows.select("source", "source_size", target.alias("target"))


def running_total(rows: DataFrame, by: Sequence[str], ranges: Column, order: Sequence[str], value: str):
    """`rows` with `total`: the sum of `value` within `by`, up to and including the row.

    `order` tells all rows apart. `ranges` numbers stretches of the order. Their sums are summed up first, so no task has to sort
    more than a stretch.
    """
    rows = rows.withColumn("stretch", ranges)
    keys = [*by, "stretch"]
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("in_stretch"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"of_{k}") for k in keys],
        F.coalesce(F.sum("in_stretch").over(earlier), F.lit(0)).alias("offset"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, same)
        .withColumn("total", F.col("offset") + F.sum(value).over(inside))
        .drop("stretch", "offset", *[f"of_{k}" for k in keys])
    )


def _one_by_one(classes: DataFrame) -> DataFrame:
    """A row for each row of a class, numbered from 1 as `copy`; large classes are cut for many tasks."""

    def numbered(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        return rows.withColumn("copy", F.explode(F.sequence(first, last)))

    small = classes.filter(F.col("n") <= COPIES_PER_TASK)
    large = classes.filter(F.col("n") > COPIES_PER_TASK)
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES_PER_TASK))
    large = large.withColumn("part", F.explode(parts)).repartition("source", "key", "part")
    first = F.col("part") * COPIES_PER_TASK
    large = numbered(large, first + 1, F.least(first + COPIES_PER_TASK, F.col("n"))).drop("part")
    return numbered(small, F.lit(1).cast("bigint"), F.col("n")).unionByName(large)


def mix_plan(documents: DataFrame, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The sizes of the documents and, for each source, how far its queue is taken.

    Returns (`doc_id`, `source`, `size`, `key`) per row and (`source`, `source_size`, `target`,
    `lap`, `last_key`, `last_copy`, `last_n`) per source: rows with a key before `last_key` are taken
    `lap + 1` times, those after it `lap` times, and of the `last_n` rows with that key `last_copy`
    once more than the others.
    """
    rows = stored(
        documents.select(
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
            shuffle_key(F.col("doc_id"), F.col("text")).alias("key"),
        ),
        "mix-sizes",
    )
    targets = stored(source_targets(rows, weights), "mix-targets")
    digits = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("bigint")
    n_rows = rows.count()
    width = max(1, 16**KEY_DIGITS * ROWS_PER_RANGE // max(n_rows, 1))
    classes = rows.filter("size > 0").groupBy("source", "key").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    classes = classes.withColumn("whole", F.col("n") * F.col("size"))
    queue = running_total(classes, ["source"], F.floor(digits / width), ["key"], "whole")
    of = targets.select(F.col("source").alias("of"), "source_size", "target")
    queue = queue.join(of, F.col("source").eqNullSafe(F.col("of"))).filter("target > 0").drop("of")
    lap = F.explode(F.sequence(F.lit(0), F.lit(MOST_LAPS - 1))).alias("lap")
    laps = (
        _one_by_one(queue)
        .withColumn("before", F.col("total") - F.col("whole") + F.col("copy") * F.col("size"))
        .select("source", "key", "copy", "n", "size", "before", "source_size", "target", lap)
        .withColumn("place", F.col("lap") * F.col("source_size") + F.col("before"))
        .withColumn("finish", F.col("place") / F.col("target"))
    )
    laps = stored(laps.select("source", "key", "copy", "n", "size", "lap", "place", "finish"), "mix-queue")
    n_ranges = max(1, MOST_LAPS * n_rows // ROWS_PER_RANGE)
    merged = running_total(laps, [], F.floor(F.col("finish") * n_ranges), ["finish", "source", "key"], "size")
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    taken = (
        merged.filter(F.col("total") <= budget)
        .groupBy("source")
        .agg(F.max(F.struct("place", "lap", "key", "copy", "n")).alias("last"))
        .select(F.col("source").alias("of"), "last.lap", *[F.col(f"last.{c}").alias(f"last_{c}") for c in ("key", "copy", "n")])
    )
    plan = targets.join(taken, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source",
        "source_size",
        "target",
        F.coalesce("lap", F.lit(0)).alias("lap"),
        F.coalesce("last_key", F.lit("")).alias("last_key"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("last_copy", "last_n")],
    )
    return rows, stored(plan, "mix-plan")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan, F.col("_nc_source").eqNullSafe(F.col("_nc_of"))).drop("_nc_of")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` with `_nc_taken`, from `_nc_source` and `_nc_key`; a row's place in its class is drawn.

    Only rows of a class that is taken in part are numbered: stored first, so that a task that runs
    again finds the same numbers, then counted per part, so that no class is in one task.
    """
    plan = plan.select(*[F.col(c).alias(f"_nc_{n}") for c, n in {
        "source": "of", "lap": "lap", "last_key": "last_key", "last_copy": "last_copy", "last_n": "last_n"
    }.items()])
    cut = F.col("_nc_last_copy") < F.col("_nc_last_n")
    own = [f"_nc_{c}" for c in ("lap", "last_key", "last_copy", "last_n")]
    with_plan = _with_plan(rows, plan)
    more = F.when(F.col("_nc_key") <= F.col("_nc_last_key"), 1).otherwise(0)
    if plan.filter(cut).isEmpty():
        return with_plan.withColumn("_nc_taken", F.col("_nc_lap") + more).drop(*own)
    in_part = cut & (F.col("_nc_key") == F.col("_nc_last_key"))
    whole = with_plan.filter(~in_part).withColumn("_nc_taken", F.col("_nc_lap") + more)
    part = with_plan.filter(in_part).withColumn("_nc_row", F.monotonically_increasing_id())
    part = stored(part, "mix-cut-classes").withColumn("_nc_part", F.shiftright("_nc_row", 33))
    counts = part.groupBy("_nc_source", "_nc_part").agg(F.count("*").alias("_nc_n"))
    earlier = Window.partitionBy("_nc_source").orderBy("_nc_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_nc_source").alias("_nc_of"),
        F.col("_nc_part").alias("_nc_at"),
        F.coalesce(F.sum("_nc_n").over(earlier), F.lit(0)).alias("_nc_first"),
    )
    inside = F.row_number().over(Window.partitionBy("_nc_source", "_nc_part").orderBy("_nc_row"))
    part = part.withColumn("_nc_inside", inside).join(
        starts, F.col("_nc_source").eqNullSafe(F.col("_nc_of")) & (F.col("_nc_part") == F.col("_nc_at"))
    )
    once_more = F.when(F.col("_nc_first") + F.col("_nc_inside") <= F.col("_nc_last_copy"), 1).otherwise(0)
    part = part.withColumn("_nc_taken", F.col("_nc_lap") + once_more).select(*rows.columns, "_nc_taken")
    return whole.select(*rows.columns, "_nc_taken").unionByName(part)


def mixed_sizes(documents: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(`doc_id`, `size`, `source_size`, `target`, `taken`) for every document."""
    rows, plan = mix_plan(documents, weights)
    named = rows.select("doc_id", "size", F.col("source").alias("_nc_source"), F.col("key").alias("_nc_key"))
    of = plan.select(F.col("source").alias("_nc_of"), "source_size", "target")
    return _with_plan(_taken(named, plan), of).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("_nc_taken")).cast("bigint").alias("taken"),
    )


def mixed(documents: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken; the texts are not shuffled.

    The plan has one row per source. Spark broadcasts it below its own size limit and joins by
    shuffle above it.
    """
    _, plan = mix_plan(documents, weights)
    rows = documents.filter(n_words(F.col("text")) > 0).withColumns(
        {"_nc_source": F.col("source"), "_nc_key": shuffle_key(F.col("doc_id"), F.col("text"))}
    )
    taken = _taken(rows, plan).filter("_nc_taken > 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_nc_taken").cast("int")))
    return taken.withColumn("_nc_copy", copies).select(*documents.columns)
