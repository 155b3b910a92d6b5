import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecode.operators import bayes, feed, leakage, patients, scoring, synthesis
from notecode.schemas import PATIENT
from notecode.sources import tables
from notecode.sources.shared_folder import new_path


def test_notes_csv(spark):
    path = new_path(spark, "csv-test")
    lines = [
        "clinical_note,annot_diagnostics_v2,ward", '"two\nlines","a ""b""",w', "too,many,fields,here",
        "too,few", "x,,w", "NA,b,w", "text,b,N/A", "empty,field,more,", "short",
    ]
    spark.createDataFrame([("\n".join(lines),)], "value string").repartition(1).write.text(path)
    rows = tables.read_notes_csv(spark, path).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [
        ("two\nlines", 'a "b"', "w"), ("x", None, "w"), (None, "b", "w"), ("text", "b", None), ("too", "few", None), ("short", None, None),
    ]))


def test_referential_file(spark):
    path = new_path(spark, "referential-test")
    lines = ["Codes", "code;libellé long;code MCO/HAD;chapter", "A00 ;Cholera;0;I", "B01;x;3;I", ";none;0;I",
             'Z00;"a; b";0;I', "C50;x; 1;I", "D1;x;abc;I"]
    spark.createDataFrame([("\n".join(lines),)], "value string").repartition(1).write.text(path)
    rows = [tuple(r) for r in tables.read_referential(spark, path).orderBy("ordinal").collect()]
    assert rows == [
        (0, "A00", "Cholera", 0.0), (1, "B01", "x", 3.0), (3, "Z00", "a; b", 0.0), (4, "C50", "x", 1.0), (5, "D1", "x", None),
    ]


def test_write_and_read(spark):
    notes = spark.createDataFrame([("t", "A", ["B"], "Z")] * 10, "note_text string, dp string, das array<string>, mdp string")
    path = new_path(spark, "notes-test")
    tables.write_notes(notes, path, ["note_text", "dp", "das", "mdp"], partitions=3)
    again = tables.read_notes(spark, path)
    assert again.count() == again.select("note_id").distinct().count() == 10
    assert len([f for f in again.inputFiles()]) == 3
    keyed = notes.limit(1).select(tables.note_id("a", F.col("dp")).alias("a"), tables.note_id("b", F.col("dp")).alias("b")).head()
    assert keyed.a != keyed.b


def test_patient_notes(spark):
    def record(key, pool, texts, codes):
        return (key, pool, [("letter", t) for t in texts], ([(c,) for c in codes],))

    rows = [record(1, "coding", ["a", "b"], ["I10", "J45"]), record(2, "other", ["c"], ["I10"]),
            record(3, "coding", [], ["I10"]), record(4, "coding", ["d"], []), record(5, "coding", ["e"], [""])]
    notes = patients.patient_notes(spark.createDataFrame(rows, PATIENT), "coding")
    assert sorted((r.patient_id, r.document_no, r.note_text, r.dp) for r in notes.collect()) == [(1, 0, "a", "I10"), (1, 1, "b", "I10")]


def test_group_documents_of_any_number(spark):
    rows = [("p", i, f"t{i}" if i % 7 else None) for i in range(5000)] + [("q", 0, "x"), ("r", 3, None)]
    documents = spark.createDataFrame(rows, "patient_id string, document_no long, note_text string").repartition(5)
    expected = {
        ("p", 5000, " ".join(f"t{i}" for i in range(5000) if i % 7)),
        ("q", 1, "x"),
        ("r", 1, ""),
    }
    for stretch in (1, 3, 40, 10_000):
        assert {tuple(r) for r in patients.group_documents(documents, stretch=stretch).collect()} == expected


def test_patient_key_and_first_gold(spark):
    row = spark.range(1).select(patients.patient_key(F.lit(12345)).alias("a"), patients.patient_key(F.lit(7)).alias("b")).head()
    assert tuple(row) == ("123", "")
    documents = spark.createDataFrame([("p", 2, "B"), ("p", 1, "A"), ("p", 0, None), ("q", 1, None)], "patient_id string, n int, gold string")
    gold = patients.first_gold(documents, key="patient_id", order="n", gold="gold")
    assert {r.patient_id: r.gold for r in gold.collect()} == {"p": "A", "q": None}



def test_leaks(spark):
    train = spark.createDataFrame([("abcdX",), ("zzzz",), (None,)], "note_text string")
    test = spark.createDataFrame([(1, "abcdY"), (2, "abc"), (3, None), (4, "abcdZ")], "note_id int, note_text string")
    flags = {r.note_id: r.leaked for r in leakage.flag_leaks(test, train, characters=4).collect()}
    assert flags == {1: True, 2: False, 3: False, 4: True}
    summary = {r.leaked: r.n for r in leakage.leak_summary(test, train, characters=4).collect()}
    assert summary == {True: 2, False: 2}


@pytest.fixture
def synonyms(spark):
    """60 codes; one has a third of all synonyms."""
    code = F.when(F.col("id") % 3 == 0, "C00").otherwise(F.concat(F.lit("C"), F.lpad((F.col("id") % 59 + 1).cast("string"), 2, "0")))
    return spark.range(600).select(F.col("id").alias("ordinal"), code.alias("code"), F.concat(F.lit("s"), F.col("id")).alias("libelle"))


def test_multi_code_notes(spark, synonyms):
    documents = spark.range(2000).withColumnRenamed("id", "doc_no")
    valid = synonyms.select("code").distinct().filter("code <> 'C59'")
    notes = synthesis.multi_code_notes(documents, synonyms, valid)
    rows = {r.doc_no: (r.note_text.split("\n"), r.das) for r in notes.collect()}
    assert len(rows) == 2000
    of_code = {r.libelle: r.code for r in synonyms.collect()}
    sizes = [0] * 9
    for texts, codes in rows.values():
        assert len(set(codes)) == len(codes) == len(texts)
        assert [of_code[t] for t in texts] == codes and "C59" not in codes
        sizes[len(codes)] += 1
    assert sizes[0] == 0 and all(180 < n < 320 for n in sizes[1:])
    again = synthesis.multi_code_notes(documents.repartition(3), synonyms.repartition(5), valid)
    assert {r.doc_no: (r.note_text.split("\n"), r.das) for r in again.collect()} == rows


def test_too_few_codes_raise(spark, synonyms):
    few = synonyms.filter("code in ('C00', 'C01')")
    notes = synthesis.multi_code_notes(spark.range(5).withColumnRenamed("id", "doc_no"), few, few.select("code"))
    with pytest.raises(Exception, match="fewer than 8 codes"):
        notes.collect()


def test_mix_streams(spark):
    real = spark.createDataFrame([(1, "t", "A", ["B"], "Z")], "note_id int, note_text string, dp string, das array<string>, mdp string")
    syn = spark.createDataFrame([(1, "s", "A")], "note_id int, note_text string, dp string")
    streams = {"real": feed.Stream(real, ("dp", "das", "mdp")), "syn": feed.Stream(syn, ("dp",), "synthetic", feed.SYNTHETIC_SCALE)}
    mixed = feed.mix_streams(streams, {"dp": 0.5})
    rows = {r.stream: r for r in mixed.collect()}
    assert (rows["real"].sample_weight, rows["real"].dp_weight, rows["real"].das_weight) == (1.0, 0.5, 1.0)
    assert (rows["syn"].sample_weight, rows["syn"].dp_weight, rows["syn"].das, rows["syn"].das_weight) == (0.1, 0.05, None, None)
    assert feed.ambiguous_notes(mixed).isEmpty()
    with pytest.raises(ValueError, match="das"):
        feed.mix_streams({"syn": feed.Stream(syn, ("das",))})


def documents(spark, partitions):
    hot = F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("f"), (F.col("id") % 11).cast("string")))
    return spark.range(1000).repartition(partitions).select(
        F.col("id").alias("note_id"), F.lit("s").alias("stream"), hot.alias("fragment"), (F.col("id") % 700).alias("n_words")
    )


@pytest.mark.parametrize("shuffle", [feed.shuffle_dataset, feed.shuffle_fragments])
def test_shuffles(spark, shuffle):
    one = sorted((r.position, r.note_id) for r in shuffle(documents(spark, 1), seed=1).collect())
    assert [p for p, _ in one] == list(range(1000))
    assert one == sorted((r.position, r.note_id) for r in shuffle(documents(spark, 6), seed=1).collect())
    assert one != sorted((r.position, r.note_id) for r in shuffle(documents(spark, 1), seed=1, epoch=1).collect())


def test_fragments_stay_together(spark):
    rows = feed.shuffle_fragments(documents(spark, 4), seed=3).orderBy("position").collect()
    changes = sum(a.fragment != b.fragment for a, b in zip(rows, rows[1:]))
    assert changes == len({r.fragment for r in rows}) - 1


def test_batches(spark):
    batched = feed.assign_batches(feed.shuffle_dataset(documents(spark, 4), seed=1), 32)
    sizes = [r.n for r in batched.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert sizes == [32] * 31 + [8]
    placed = feed.assign_sub_batches(batched, budget=2000)
    words = placed.groupBy("batch", "sub_batch").agg(F.sum("n_words").alias("words"))
    assert placed.count() == 1000 and words.filter("words > 2000").count() == 0
    rows = spark.createDataFrame([("s", 0, i, i, w) for i, w in enumerate([5, 20, 5, 5, 3])], "stream string, batch long, position long, note_id long, n_words long")
    placed = feed.assign_sub_batches(rows, budget=12).orderBy("note_id").collect()
    assert [r.sub_batch for r in placed] == [0, 1, 2, 2, 3]


def test_score_notes_loads_once_per_worker(spark, tmp_path):
    def load():
        with open(tmp_path / "loads", "a") as log:
            log.write("x")
        return lambda texts: pd.DataFrame({"dp": texts.str.upper(), "n": texts.str.len()})

    notes = spark.range(100).select("id", F.lit("ab").alias("note_text"), F.lit("G").alias("dp_gold"))
    scored = scoring.score_notes(notes.repartition(40), load, {"dp": T.StringType(), "n": T.LongType()})
    assert scored.columns == ["id", "note_text", "dp_gold", "dp", "n"]
    assert scored.filter("dp = 'AB' and n = 2 and dp_gold = 'G'").count() == 100
    assert len((tmp_path / "loads").read_text()) < 40


def test_head_decisions(spark):
    scores = spark.createDataFrame(
        [(1, "das", "b", 0.5), (1, "das", "a", 0.5), (1, "das", "c", 0.2), (2, "das", "a", 0.1)],
        "note_id int, head string, label string, score double",
    )
    single = {r.note_id: (r.label, r.score) for r in scoring.select_single_label(scores).collect()}
    assert single == {1: ("a", 0.5), 2: ("a", 0.1)}
    multi = {r.note_id: r.labels for r in scoring.select_multi_label(scores).collect()}
    assert multi == {1: ["a", "b"], 2: []}
    strict = scoring.select_multi_label(scores, inclusive=False)
    assert {r.note_id: r.labels for r in strict.collect()} == {1: [], 2: []}


def test_windows(spark):
    notes = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "x")], "note_id int, note_text string")
    plain = scoring.token_windows(notes, size=2, stride=2)
    assert sorted(map(tuple, plain.collect())) == [(1, 0, 2, "a b"), (1, 1, 2, "c d"), (1, 2, 1, "e"), (3, 0, 1, "x")]
    sliding = scoring.token_windows(notes, size=3, stride=1).filter("note_id = 1")
    assert [r.window_text for r in sliding.orderBy("window_no").collect()][:2] == ["a b c", "b c d"]


def test_pooling(spark):
    rows = spark.createDataFrame([(1, "g", [1.0, 0.0], 700.0), (2, "g", [0.0, 2.0], 700.0), (3, "h", [5.0, 5.0], -9.0)], "i int, k string, v array<double>, l double")

    def pooled(**options):
        return {r.k: r.pooled for r in scoring.pool_vectors(rows, key="k", vector="v", row_key="i", **options).collect()}

    assert pooled(logit=F.col("l")) == {"g": pytest.approx([0.5, 1.0]), "h": pytest.approx([5.0, 5.0])}
    # Logits far apart, a missing one and a missing vector; 64 is where one stretch ends.
    logits = F.when(F.col("i") == 2, 699.0).when(F.col("i") == 1, 704.5).otherwise(F.lit(None))
    share = 1 / (1 + math.exp(-5.5))
    assert pooled(logit=logits) == {"g": pytest.approx([share, 2 * (1 - share)])}
    assert pooled(logit=F.when(F.col("i") == 1, -1e6).otherwise(1e6))["g"] == pytest.approx([0.0, 2.0])
    plan = scoring.pool_vectors(rows, key="k", vector="v", logit=F.col("l"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert pooled(mode="mean")["g"] == pytest.approx([0.5, 1.0])
    assert pooled(mode="max")["g"] == [1.0, 2.0]


def test_bayes_by_broadcast_and_by_shuffle(spark):
    words = [("a", "x y z"), ("a", "x x"), ("b", "y y w"), ("c", "q"), ("c", "q z"), ("d", "")]
    feed_rows = spark.createDataFrame([(l, t, 1.0) for l, t in words], "label string, note_text string, w double")
    path = new_path(spark, "bayes-test")
    bayes.save(bayes.fit(feed_rows, label="label", weight="w"), path)
    model = bayes.load(spark, path)
    notes = spark.createDataFrame([(1, "x x"), (2, "q q z"), (3, "y w unseen"), (4, ""), (5, None)], "note_id int, note_text string")

    def predicted(**options):
        return {r.note_id: (r.label, pytest.approx(r.score)) for r in bayes.predict(notes, model, **options).collect()}

    whole = predicted()
    assert {i: label for i, (label, _) in whole.items()} == {1: "a", 2: "c", 3: "b", 4: "a", 5: "a"}
    assert predicted(broadcast_rows=3) == whole
    assert predicted(broadcast_rows=0) == whole
    assert predicted(broadcast_rows=0, rows_per_task=1) == whole
    assert bayes.predict(notes, bayes.NaiveBayes(model.tokens.limit(0), model.labels.limit(0))).count() == 0
    arrays = feed_rows.withColumn("label", F.array("label"))
    counted = bayes.fit(arrays, label="label", weight="w")
    assert sorted(map(tuple, counted.tokens.collect())) == sorted(map(tuple, model.tokens.collect()))


def test_bayes_with_many_labels(spark):
    draw = random.Random(6)
    labels = {f"L{k:05d}": {f"t{draw.randrange(3000)}": float(draw.randint(1, 4)) for _ in range(4)} for k in range(40_000)}
    tokens = [(label, t, n) for label, counts in labels.items() for t, n in counts.items()]
    notes_of = {label: float(draw.randint(1, 3)) for label in labels}
    model = bayes.NaiveBayes(
        spark.createDataFrame(pd.DataFrame(tokens, columns=["label", "token", "n"])),
        spark.createDataFrame(pd.DataFrame(list(notes_of.items()), columns=["label", "n_notes"])),
    )
    texts = [" ".join(f"t{draw.randrange(3100)}" for _ in range(draw.randint(0, 12))) for _ in range(25)]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id int, note_text string")
    unit, vocabulary, all_notes = float(1 << 36), len({t for _, t, _ in tokens}), sum(notes_of.values())

    def fixed(x):
        return round(x * unit)

    def best(text):
        found = None
        for label, counts in labels.items():
            unseen = fixed(math.log(1 / (sum(counts.values()) + vocabulary)))
            total = fixed(math.log(notes_of[label] / all_notes)) + len(text.split()) * unseen
            total += sum(fixed(math.log(counts[t] + 1)) for t in text.split() if t in counts)
            if found is None or total > found[1]:
                found = (label, total)
        return found

    expected = {k: best(text) for k, text in enumerate(texts)}
    for options in ({}, {"broadcast_rows": 1000}):
        rows = bayes.predict(notes, model, **options).collect()
        assert {r.note_id: r.label for r in rows} == {k: label for k, (label, _) in expected.items()}
        assert all(r.score * unit == pytest.approx(expected[r.note_id][1], abs=100) for r in rows)


@given(st.lists(st.tuples(st.integers(-40, 0), st.integers(-9, 0), st.sampled_from("abcdefgh")), max_size=12))
@settings(max_examples=300, deadline=None)
def test_envelope_holds_the_best_line_of_each_length(lines):
    hull = bayes.envelope(lines)
    for length in range(60):
        best = min(((-(p + u * length), name) for p, u, name in lines), default=None)
        reached = [h for h in hull if h[0] <= length]
        assert (best is None) == (not reached)
        if best:
            _, prior, unseen, name = reached[-1]
            assert (-(prior + unseen * length), name) == best
    assert bayes.envelope([*(h[1:] for h in bayes.envelope(lines[:5])), *lines[5:]]) == hull


def test_synonym_files_and_scored_sink(spark):
    rows = [("A00", "Choléra"), ("A00", "Cholera, classical"), ("B01", "Varicella")]
    synonyms = spark.createDataFrame(rows, "code string, libelle string")
    for file_format in ("csv", "parquet"):
        path = new_path(spark, "synonyms-test")
        synonyms.write.options(**({"header": True} if file_format == "csv" else {})).format(file_format).save(path)
        read = tables.read_synonyms(spark, path, file_format)
        assert sorted((r.code, r.libelle) for r in read.collect()) == sorted(rows)
        assert read.select("ordinal").distinct().count() == 3
        numbered = synthesis.number_synonyms(read)
        assert sorted((r.code, r.pick) for r in numbered.collect()) == [("A00", 0), ("A00", 1), ("B01", 0)]
    path = new_path(spark, "scored-test")
    tables.write_scored(synonyms, path)
    assert spark.read.parquet(path).count() == 3


def test_scoring_runs_once_below_a_filter(spark):
    def load():
        return lambda texts: pd.DataFrame({"dp": texts})

    notes = spark.createDataFrame([(1, "a"), (2, None)], "note_id int, note_text string")
    scored = scoring.score_notes(notes, load, {"dp": T.StringType()}).filter("dp is not null")
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.dp for r in scored.collect()] == ["a"]
