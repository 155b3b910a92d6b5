"""Joins against code tables and other key tables.

A table is broadcast only after a count has shown that it is small. A larger one is joined by a
shuffle in which the fact rows of a frequent key are spread over as many salts as they fill tasks, so
that a key holding a large share of all rows does not end in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.sources.shared_folder import stored

BROADCAST_ROWS = 200_000
ROWS_PER_TASK = 5_000_000
TOP_KEYS, TRACKED_KEYS = 10_000, 32_768
HASH_SLOTS = 8192


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if the table has at most `rows` rows. For a stored table, file footers tell the number."""
    return table.count() <= rows


def frequent_keys(facts: DataFrame, on: Sequence[str], rows_per_task: int) -> DataFrame:
    """(`_key_hash`, `_salts`): hash of each key with more rows than a task should get, and its tasks.

    A frequent-items sketch finds them in one pass without shuffling the keys; it has at most
    `TRACKED_KEYS` entries. An estimate only sets over how many tasks a key is spread, which does not
    change any result. The table is stored, so that both sides of a join see the same numbers.
    """
    top = F.expr(f"approx_top_k(_key_hash, {TOP_KEYS}, {TRACKED_KEYS})")
    hashes = facts.select(F.xxhash64(*on).alias("_key_hash"))
    items = hashes.agg(top.alias("top")).select(F.inline("top"))
    salts = F.ceil(F.col("count") / rows_per_task)
    frequent = items.select(F.col("item").alias("_key_hash"), salts.alias("_salts"))
    return stored(frequent.filter(F.col("_salts") > 1), "frequent-keys")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    salt_by: Sequence[str],
    small: bool | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join facts to a narrow table; for an inner or left join it must hold each key once.

    `salt_by` names the fact columns that tell the rows of one key apart. Unless the caller has asked
    `is_small` before, the table is read to check its size; one that is costly to compute should be
    stored first.
    """
    on = list(on)
    if is_small(table, broadcast_rows) if small is None else small:
        return facts.join(F.broadcast(table), on, how)
    frequent = F.broadcast(frequent_keys(facts, on, rows_per_task))  # at most TOP_KEYS rows
    salts = F.coalesce("_salts", F.lit(1).cast("long"))

    def with_salts(side: DataFrame) -> DataFrame:
        hashed = side.withColumn("_key_hash", F.xxhash64(*on))
        return hashed.join(frequent, "_key_hash", "left").drop("_key_hash")

    salted_facts = with_salts(facts).withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts))
    salted_table = with_salts(table).withColumn(
        "_salt", F.explode_outer(F.sequence(F.lit(0).cast("long"), salts - 1))
    )
    joined = salted_facts.drop("_salts").join(salted_table.drop("_salts"), [*on, "_salt"], how)
    return joined.drop("_salt")


def keep_listed(
    facts: DataFrame, codes: DataFrame, *columns: str, salt_by: Sequence[str], **limits
) -> DataFrame:
    """Keep the rows whose `columns` are all in the one-column table `codes`."""
    for column in columns:
        keys = codes.toDF(column)
        facts = lookup_join(facts, keys, [column], "left_semi", salt_by=salt_by, **limits)
    return facts


def drop_listed(
    facts: DataFrame, codes: DataFrame, column: str, *, salt_by: Sequence[str], **limits
) -> DataFrame:
    """Drop the rows whose `column` is in `codes`, and those where it is NULL."""
    filled = facts.filter(F.col(column).isNotNull())
    return lookup_join(filled, codes.toDF(column), [column], "left_anti", salt_by=salt_by, **limits)


class ArrayLookup:
    """Look up array elements in a small key/value table without exploding the array.

    The table becomes one value, an array of maps addressed by key hash, which an uncorrelated
    scalar subquery hands to every task. Rows stay where they are: no shuffle of the note text.
    Only for tables that `is_small` has accepted.
    """

    def __init__(self, table: DataFrame, key: str, value: str, slots: int = HASH_SLOTS):
        self.slots = slots
        pairs = table.select(
            F.pmod(F.hash(key), F.lit(slots)).alias("slot"),
            F.struct(F.col(key).alias("key"), F.col(value).alias("value")).alias("pair"),
        )
        empty = table.sparkSession.range(slots).select(
            F.col("id").cast("int").alias("slot"),
            F.lit(None).cast(pairs.schema["pair"].dataType).alias("pair"),
        )
        by_slot = pairs.union(empty).groupBy("slot").agg(F.collect_list("pair").alias("pairs"))
        all_slots = F.array_sort(F.collect_list(F.struct("slot", "pairs")))
        self.maps = by_slot.agg(
            F.transform(all_slots, lambda s: F.map_from_entries(s.pairs)).alias("maps")
        )

    def column(self) -> Column:
        """The looked-up table as a column, to be added to the facts under a name of choice."""
        return self.maps.scalar()

    def get(self, maps: Column, key: Column) -> Column:
        return F.try_element_at(F.get(maps, F.pmod(F.hash(key), F.lit(self.slots))), key)
