"""Row numbers inside groups of any size."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notecode.sources.shared_folder import stored


def rank_in_group(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], name: str
) -> DataFrame:
    """Add the position (from 0) of each row in its group, ordered by `bucket`, then `order`.

    `bucket` cuts a group into consecutive stretches of that order. Each stretch is numbered on its
    own and starts after the counted rows of the earlier ones, so a group is never sorted in one
    task. The result depends on the data only, not on the partitioning. A NULL key is an error. The
    rows are read twice, so costly ones should be stored first.
    """
    stretch = [*group, "_rank_bucket"]
    rows = df.withColumn("_rank_bucket", bucket)
    earlier = (
        Window.partitionBy(*group).orderBy("_rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*stretch)
        .agg(F.count("*").alias("_rank_n"))
        .select(*stretch, F.coalesce(F.sum("_rank_n").over(earlier), F.lit(0)).alias("_rank_start"))
    )
    inside = F.row_number().over(Window.partitionBy(*stretch).orderBy(*order))
    no_key = F.raise_error(F.lit("a row to be numbered has no key")).cast("long")
    start = F.coalesce("_rank_start", no_key)
    return (
        rows.withColumn("_rank_inside", inside)
        .join(starts, stretch, "left")
        .withColumn(name, start + F.col("_rank_inside") - 1)
        .drop("_rank_bucket", "_rank_inside", "_rank_start")
    )


def dense_ids(df: DataFrame, key: str, name: str = "note_id", width: int = 1_000_000) -> DataFrame:
    """Number all rows from 0 in the order of a numeric key, `width` key values to a stretch."""
    one = df.withColumn("_all", F.lit(0))
    return rank_in_group(one, ["_all"], F.floor(F.col(key) / width), [key], name).drop("_all")


def exact_ids(df: DataFrame, keys: Sequence[str], name: str = "note_id", first: int = 0) -> DataFrame:
    """Number all rows from `first` in the order of keys of any type, NULL keys in front.

    The rows are range-partitioned by their keys and sorted within the parts; a part starts after the
    counted rows of the earlier ones. Rows with equal keys go by a hash of the whole row, so the ids
    depend on the rows alone, not on files or partitions, and many equal keys do not end in one task.
    The numbered rows are stored.
    """
    columns = df.columns
    order = [*[F.col(f"`{k}`").asc_nulls_first() for k in keys], F.col("_row_hash")]
    hashed = df.withColumn("_row_hash", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    sorted_rows = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id that Spark gives holds the part in its upper bits and the place in the part in the lower.
    rows = stored(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "numbered-rows")
    part = F.shiftright("_place", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row per part
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + inside + first).select(*columns, name)
