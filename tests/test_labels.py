import pytest

from notecode.operators import labels


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(
        [(1, "A", ["B", "C"], "Z1"), (2, "A", [], "Z1"), (3, "B", ["C"], None), (4, "D", None, "Z2")],
        "note_id int, dp string, das array<string>, mdp string",
    )


def table(df):
    return sorted(tuple(r) for r in df.collect())


def test_frequency_distinct_top(notes):
    frequency = labels.label_frequency(notes)
    assert table(frequency) == [
        ("das", "B", 1), ("das", "C", 2), ("dp", "A", 2), ("dp", "B", 1), ("dp", "D", 1),
        ("mdp", "Z1", 2), ("mdp", "Z2", 1),
    ]
    assert len(table(labels.distinct_labels(notes))) == 7
    top = labels.top_labels(frequency.filter("head = 'dp'"), 2).select("label", "place")
    assert table(top) == [("A", 1), ("B", 2)]


def test_referential_space(spark):
    referential = spark.createDataFrame(
        [(0, "B1", 3.0), (1, "Z00", 0.0), (2, "A00", 0.0), (3, "C50", 1.0), (4, "D1", None)],
        "ordinal long, code string, mco_had double",
    )
    assert table(labels.referential_label_space(referential)) == [
        ("das", "A00", 1), ("das", "C50", 2), ("das", "Z00", 0),
        ("dp", "A00", 1), ("dp", "Z00", 0), ("mdp", "Z00", 0),
    ]
    assert table(labels.valid_codes(referential, "mdp")) == [("Z00",)]


def test_coverage_and_union(spark):
    rows = [("train", "a"), ("train", "b"), ("syn", "b"), ("syn", "c"), ("test", "b"), ("test", "d"), ("other", "e")]
    tagged = spark.createDataFrame([(s, "dp", l) for s, l in rows], "source string, head string, label string")
    sources = labels.label_sources(tagged, ["train", "syn", "test", "other"])
    assert table(labels.label_coverage(sources)) == [
        ("dp", "a", "only_train"), ("dp", "c", "syn_not_train"), ("dp", "d", "eval_unseen"), ("dp", "e", "eval_unseen"),
    ]
    union = labels.union_label_space(sources, {"dp": ["train", "syn", "test"]})
    assert table(union) == [("dp", x) for x in "abcd"]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_encode_and_decode(notes, monkeypatch, rows):
    monkeypatch.setattr(labels, "is_small", lambda table: rows > 0)
    space = labels.number_labels(labels.distinct_labels(notes.filter("note_id < 4")))
    assert table(space.filter("head = 'dp'")) == [("dp", "A", 0), ("dp", "B", 1)]
    encoded = labels.encode_label(labels.encode_label(notes, space, "dp"), space, "das")
    ids = {r.note_id: (r.dp_id, r.das_id) for r in encoded.collect()}
    assert ids == {1: (0, [0, 1]), 2: (0, []), 3: (1, [1]), 4: (None, None)}
    decoded = labels.decode_label(encoded.drop("das"), space, "das", "das_id", "das")
    assert {r.note_id: r.das for r in decoded.collect()} == {1: ["B", "C"], 2: [], 3: ["C"], 4: None}


def test_outside_and_weights(spark, notes):
    frequency = labels.label_frequency(notes)
    space = spark.createDataFrame([("dp", "A", 0), ("mdp", "B", 0)], "head string, label string, label_id int")
    outside = labels.labels_outside(frequency.filter("head = 'dp'"), space)
    assert table(outside) == [("dp", "B", 1), ("dp", "D", 1)]
    weights = {r.label: r.weight for r in labels.class_weights(frequency.filter("head = 'dp'")).collect()}
    assert weights == {"A": 4 / (3 * 2), "B": 4 / 3, "D": 4 / 3}
