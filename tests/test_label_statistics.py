"""Label counts kept up to date equal those of a full run."""

import pytest

from notecode.operators import label_statistics, labels
from notecode.sources.catalog import Catalog, Outdated


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_notes(spark, *rows):
    return spark.createDataFrame(list(rows), "dp string, das array<string>, mdp string")


@pytest.fixture
def kept(spark, tmp_path):
    return label_statistics.LabelStatistics(Catalog(spark, (tmp_path / "sets").as_uri()))


def test_add_replace_and_withdraw_equal_a_full_run(spark, kept):
    monday = some_notes(spark, ("A", ["B", "C"], "Z1"), ("A", None, None))
    tuesday = some_notes(spark, ("D", ["C"], "Z1"), (None, [], "Z2"))
    corrected = some_notes(spark, ("E", ["C", "C"], "Z1"))
    test = some_notes(spark, ("A", ["X"], "Z3"))
    assert kept.version() == 0 and kept.counts().count() == 0
    kept.put("train", monday, "monday")
    first = kept.put("train", tuesday, "tuesday")
    kept.put("test", test)
    assert table(kept.frequency(["train"])) == table(labels.label_frequency(monday.union(tuesday)))
    # The same batch again, as after a failed job, and a corrected one.
    kept.put("train", monday, "monday")
    kept.put("train", corrected, "tuesday")
    expected = labels.label_frequency(monday.union(corrected))
    assert table(kept.frequency(["train"])) == table(expected)
    assert table(kept.weights(["train"])) == table(labels.class_weights(expected))
    tagged = labels.melt_labels(monday.union(corrected)).selectExpr("'train' as source", "*")
    tagged = tagged.union(labels.melt_labels(test).selectExpr("'test' as source", "*"))
    assert table(kept.sources(["train", "test"])) == table(labels.label_sources(tagged, ["train", "test"]))
    assert table(kept.changes(["train"], first)) == [("das", "C", 2, 3), ("dp", "D", 1, 0), ("dp", "E", 0, 1), ("mdp", "Z2", 1, 0)]
    # An old version still gives what it gave.
    assert table(kept.frequency(["train"], first)) == table(labels.label_frequency(monday.union(tuesday)))
    kept.compact()
    assert table(kept.frequency(["train"])) == table(expected)
    kept.withdraw("train", "monday")
    assert table(kept.frequency(["train", "test"])) == table(labels.label_frequency(corrected.union(test)))
    kept.withdraw("test")
    assert table(kept.frequency(["train", "test"])) == table(labels.label_frequency(corrected))
    with pytest.raises(KeyError):
        kept.withdraw("test")


def test_a_change_by_someone_else_is_not_lost(spark, kept, monkeypatch):
    kept.put("train", some_notes(spark, ("A", [], None)))
    publish, calls = kept.catalog.publish, []

    def late(rows, name, **options):
        calls.append(options["after"])
        if len(calls) == 1:  # another job publishes in between
            monkeypatch.setattr(kept.catalog, "publish", publish)
            kept.put("other", some_notes(spark, ("B", [], None)))
            monkeypatch.setattr(kept.catalog, "publish", late)
        return publish(rows, name, **options)

    monkeypatch.setattr(kept.catalog, "publish", late)
    kept.put("test", some_notes(spark, ("C", [], None)))
    assert calls == [1, 2]
    assert {r.source for r in kept.counts().collect()} == {"train", "other", "test"}
    with pytest.raises(Outdated):
        publish(spark.range(1), kept.name, after=1)


def test_known_labels_keep_their_ids(spark):
    found = [("dp", "B"), ("dp", "D"), ("das", "X")]
    space = labels.number_labels(spark.createDataFrame(found, "head string, label string"))
    more = spark.createDataFrame([("dp", "A"), ("dp", "B"), ("dp", "C"), ("dp", "C"), ("mdp", "Z")], "head string, label string")
    extended = label_statistics.extend_numbering(space, more)
    assert table(extended) == [("das", "X", 0), ("dp", "A", 2), ("dp", "B", 0), ("dp", "C", 3), ("dp", "D", 1), ("mdp", "Z", 0)]
    assert extended.schema["label_id"].dataType == space.schema["label_id"].dataType
