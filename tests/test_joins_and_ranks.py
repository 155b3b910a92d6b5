import pytest
from pyspark.sql import functions as F

from notecode.operators.joins import is_small, lookup_join
from notecode.operators.ranking import dense_ids, exact_ids, rank_in_group


def facts_with_hot_key(spark):
    """1,200 rows, a third of them with one key, some with a key the table lacks or with none."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 != 1, F.col("id") % 50)
    return spark.range(1200).select("id", key.alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_all_ways_to_join_agree(spark, how):
    facts = facts_with_hot_key(spark)
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    expected = sorted(map(str, facts.join(table, "k", how).select(sorted(facts.join(table, "k", how).columns)).collect()))
    for limits in ({}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "rows_per_task": 10}):
        joined = lookup_join(facts, table, ["k"], how, salt_by=["id"], **limits)
        assert sorted(map(str, joined.select(sorted(joined.columns)).collect())) == expected


def test_hot_key_is_spread(spark):
    facts = facts_with_hot_key(spark)
    table = spark.range(40).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = lookup_join(facts, table, ["k"], salt_by=["id"], broadcast_rows=0, rows_per_task=20)
        parts = joined.filter("k = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts == 4


def test_is_small(spark):
    assert is_small(spark.range(5), 5) and not is_small(spark.range(6), 5)


@pytest.mark.parametrize("partitions", [1, 7])
def test_rank_in_group(spark, partitions):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"))
    rows = rows.repartition(partitions)
    ranked = rank_in_group(rows, ["g"], F.floor(F.col("id") / 37), ["id"], "place")
    assert ranked.columns == ["g", "id", "place"] or set(ranked.columns) == {"g", "id", "place"}
    wrong = ranked.filter(F.col("place") != F.when(F.col("g") == "hot", F.col("id")).otherwise(F.col("id") - 900))
    assert ranked.count() == 1000 and wrong.count() == 0


def test_dense_ids(spark):
    rows = spark.range(0, 5000, 7).select((F.col("id") + 3).alias("k"))
    numbered = dense_ids(rows, "k", width=100)
    assert numbered.filter(F.col("note_id") * 7 + 3 != F.col("k")).count() == 0


def test_rows_without_key_are_an_error(spark):
    rows = spark.range(10).select("id", F.when(F.col("id") != 3, "a").alias("g"))
    with pytest.raises(Exception, match="has no key"):
        rank_in_group(rows, ["g"], F.floor(F.col("id") / 3), ["id"], "place").collect()


def test_exact_ids_do_not_follow_the_layout(spark):
    rows = [("b", 2.5, 1), (None, 1.0, 2), ("a", None, 3), ("a", 0.5, 4), ("b", 2.5, 5), ("b", 2.5, 5)] + [("c", 1.0, k) for k in range(300)]
    given = spark.createDataFrame(rows, "k string, x double, n int")
    numbered = [sorted(map(tuple, exact_ids(df, ["k", "x"], first=10).collect()), key=str) for df in (given, given.repartition(7), given.coalesce(1))]
    assert numbered[0] == numbered[1] == numbered[2]
    ids = {r[3]: r[:3] for r in numbered[0]}
    assert sorted(ids) == list(range(10, 10 + len(rows)))
    keys = [((k is not None, k or ""), (x is not None, x or 0.0)) for k, x, _ in (ids[i] for i in sorted(ids))]
    assert keys == sorted(keys)
    assert exact_ids(given.limit(0), ["k"]).count() == 0
