"""Versions of data sets appear as a whole or not at all."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from notecode.sources.catalog import Catalog


def test_readers_see_whole_versions_only(spark, tmp_path):
    catalog = Catalog(spark, (tmp_path / "sets").as_uri())
    assert catalog.names() == []
    with pytest.raises(FileNotFoundError):
        catalog.read("train")
    assert catalog.publish(spark.range(5), "train") == 1
    reader = catalog.read("train")
    # A write that dies half-way: some files are there, the manifest is not.
    fails = F.when(F.col("id") == 900, F.raise_error(F.lit("killed"))).otherwise(F.col("id"))
    with pytest.raises(PySparkException):
        catalog.publish(spark.range(0, 1000, 1, 8).select(fails.cast("long").alias("id")), "train")
    assert len(list((tmp_path / "sets" / "train").iterdir())) == 3
    assert catalog.read("train").count() == 5
    # A torn manifest of a later version is passed over.
    (tmp_path / "sets" / "train" / "_manifests" / "000000000007.json").write_text('{"folder": "da')
    assert catalog.read("train").count() == 5
    assert catalog.publish(spark.range(9), "train", partitions=2) == 8
    assert catalog.read("train").count() == 9 and reader.count() == 5
    assert catalog.read("train", 1).count() == 5
    assert catalog.names() == ["train"]


def test_old_versions_and_leftovers_go(spark, tmp_path):
    catalog = Catalog(spark, (tmp_path / "sets").as_uri())
    for n in (1, 2, 3):
        catalog.publish(spark.range(n), "notes")
    (tmp_path / "sets" / "notes" / "data-dead").mkdir()
    (tmp_path / "sets" / "notes" / "_manifests" / "_draft-dead").write_text("{")
    catalog.clean("notes", keep=2)
    assert catalog.versions("notes") == [2, 3]
    assert [catalog.read("notes", v).count() for v in (2, 3)] == [2, 3]
    assert len(list((tmp_path / "sets" / "notes").iterdir())) == 3
    assert not list((tmp_path / "sets" / "notes" / "_manifests").glob("_draft*"))
