"""The registered queries: each operator on the whole of the given tables.

Arrays are shown as joined text and vectors as rows, so that every engine prints them alike.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecode.functions.annotations import annotation_routes as count_routes
from notecode.functions.text import first_word, truncate_code, word_count
from notecode.operators import bayes, cleaning, feed, heads, labels, leakage, metrics, patients, scoring, synthesis
from notecode.operators.label_statistics import LabelStatistics, extend_numbering
from notecode.operators.joins import keep_listed
from notecode.operators.ranking import dense_ids, exact_ids, rank_in_group
from notecode.plans.fixtures import Fixtures
from notecode.sources import tables
from notecode.sources.catalog import Catalog
from notecode.sources.shared_folder import new_path, stored
from notecode.sources.split_csv import read_split_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PHRASES = {"EN": " the ", "FR": " que ", "DE": " und "}
GRANULARITIES = [0, 3, -1]
SEED = 42


def query(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Fixtures(spark, folder))
    return build


def joined(column: str) -> Column:
    return F.array_join(column, "|")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs, the width the SQL engine counts in."""
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


# Sources and sinks


@query
def notes_csv_scan(fx: Fixtures) -> DataFrame:
    raw = fx.raw_notes().withColumn("ward", F.coalesce("ward", F.lit("NA")))
    path = new_path(fx.spark, "notes-csv")
    raw.write.options(header=True, escape='"', quoteAll=True).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns])
    notes = tables.read_notes_csv(fx.spark, path, schema)
    return notes.withColumn("note_id", F.col("note_id").cast("long"))


@query
def split_csv_scan(fx: Fixtures) -> DataFrame:
    """Whole texts with quotes and line breaks through CSV files that are read by blocks."""
    path = new_path(fx.spark, "documents-csv")
    documents = fx.table("documents").select("doc_id", "text", "lang")
    options = {"header": True, "escape": '"', "quoteAll": True}
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    documents.write.options(**options, **blanks).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in documents.columns])
    rows = read_split_csv(fx.spark, path, schema)
    return rows.select(
        F.col("doc_id").cast("long"), "lang", F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def _numbered_referential(fx: Fixtures) -> DataFrame:
    codes = fx.referential.withColumn("_all", F.lit(0))
    ranked = rank_in_group(codes, ["_all"], F.left("code", F.lit(3)), ["code"], "ordinal")
    return ranked.drop("_all").withColumn("mco_had", F.col("mco_had").cast("double"))


@query
def referential_scan(fx: Fixtures) -> DataFrame:
    ordinal, code = F.col("ordinal"), F.col("code")
    padded = (
        F.when(ordinal % 17 == 0, F.lit(""))
        .when(ordinal % 13 == 0, F.concat(code, F.lit("  ")))
        .when(ordinal % 13 == 1, F.concat(F.lit("\xa0"), code, F.lit("\t")))
        .otherwise(code)
    )
    number = F.coalesce(F.col("mco_had").cast("int").cast("string"), F.lit(""))
    category = F.when(ordinal % 11 == 0, "abc").when(ordinal % 11 == 1, F.concat(F.lit(" "), number)).otherwise(number)
    name = F.concat(F.lit('"Label; '), code, F.lit('"'))
    lines = _numbered_referential(fx).select(
        (ordinal + 2).alias("line"), F.concat_ws(";", padded, name, category, F.lit("x")).alias("value")
    )
    head = fx.spark.createDataFrame(
        [(0, "Codes 2025"), (1, "code;libellé long;code MCO/HAD;chapter")], "line long, value string"
    )
    path = new_path(fx.spark, "referential")
    # The referential is one file with its title on top; it holds each code once.
    head.union(lines).repartition(1).sortWithinPartitions("line").select("value").write.text(path)
    return tables.read_referential(fx.spark, path)


@query
def dataset_sink_roundtrip(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "notes")
    notes = fx.notes().withColumn("note_text", F.concat(F.lit("Note "), F.col("note_id").cast("string")))
    tables.write_notes(notes, path, ["note_text", "dp", "das", "mdp"], identifier=F.col("note_id"))
    return tables.read_notes(fx.spark, path).withColumn("das", joined("das"))


@query
def published_notes(fx: Fixtures) -> DataFrame:
    """Two versions of the notes in a catalog; readers get the last one."""
    catalog = Catalog(fx.spark, new_path(fx.spark, "catalog"))
    notes = fx.notes().select("note_id", "dp", "mdp", "split")
    catalog.publish(notes.filter(F.col("split") == "test"), "notes")
    catalog.publish(notes, "notes")
    return catalog.read("notes")


@query
def label_space_ref(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "labels")
    tables.write_labels(labels.referential_label_space(_numbered_referential(fx)), path)
    return longs(tables.read_labels(fx.spark, path))


# Rows and columns


@query
def drop_incomplete_rows(fx: Fixtures) -> DataFrame:
    return cleaning.drop_incomplete(fx.raw_notes()).select("note_id", "clinical_note", "annot_diagnostics_v2")


@query
def filter_valid_codes(fx: Fixtures) -> DataFrame:
    ruled = cleaning.apply_care_mode(fx.parsed_notes()).select("note_id", "dp", "mdp")
    kept = keep_listed(ruled, fx.codes("dp"), "dp", "mdp", salt_by=["note_id"])
    return kept.select("note_id", "dp", "mdp")


@query
def drop_denied_codes(fx: Fixtures) -> DataFrame:
    ruled = cleaning.apply_care_mode(fx.parsed_notes()).select("note_id", "dp", "mdp")
    denied = fx.referential.filter(F.col("mco_had") > 0).select("code")
    return cleaning.drop_denied(cleaning.drop_denied(ruled), denied).select("note_id", "dp", "mdp")


@query
def doc_type_slices(fx: Fixtures) -> DataFrame:
    return metrics.by_document_type(fx.documents().select("note_id", "note_text"), phrases=PHRASES)


@query
def mdp_rule(fx: Fixtures) -> DataFrame:
    return cleaning.apply_care_mode(fx.parsed_notes()).select("note_id", "dp", "mdp")


@query
def assign_note_ids(fx: Fixtures) -> DataFrame:
    documents = fx.documents().select(F.col("note_id").alias("doc_id"), "lang")
    return dense_ids(documents, "doc_id")


@query
def truncate_codes(fx: Fixtures) -> DataFrame:
    codes = fx.referential.select("code")
    cuts = [
        F.struct(F.lit(g).alias("granularity"), truncate_code(F.col("code"), g).alias("cut"))
        for g in [*GRANULARITIES, -2]
    ]
    return longs(codes.select("code", F.inline(F.array(*cuts))))


# Annotations and cleaning


@query
def parse_annotations(fx: Fixtures) -> DataFrame:
    parsed = cleaning.parse_annotations(fx.annotation_texts(), "annot_diagnostics_v2")
    return parsed.select("note_id", "dp", "dr", F.array_join(F.array_sort("das"), "|").alias("das"))


@query
def parse_python_notations(fx: Fixtures) -> DataFrame:
    parsed = cleaning.parse_annotations(fx.python_notations(), "annot_diagnostics_v2")
    return parsed.select("note_id", "dp", "dr", F.array_join(F.array_sort("das"), "|").alias("das"))


@query
def annotation_routes(fx: Fixtures) -> DataFrame:
    return count_routes(fx.annotation_texts(), "annot_diagnostics_v2")


@query
def filter_das_codes(fx: Fixtures) -> DataFrame:
    notes = fx.parsed_notes().select("note_id", F.array_sort("das").alias("das"))
    return cleaning.keep_valid_array_codes(notes, fx.codes("das")).withColumn("das", joined("das"))


@query
def clean_notes(fx: Fixtures) -> DataFrame:
    notes = cleaning.clean_notes(fx.raw_notes(), fx.codes("dp"), fx.codes("das"))
    return notes.withColumn("das", joined("das"))


@query
def cleaning_funnel(fx: Fixtures) -> DataFrame:
    return longs(cleaning.cleaning_funnel(fx.raw_notes(), fx.codes("dp")))


@query
def patient_explode(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "patients")
    fx.patients().write.json(path)
    notes = patients.patient_notes(tables.read_patients(fx.spark, path, "json"), "coding")
    return longs(notes)


# Labels


def _train(fx: Fixtures) -> DataFrame:
    return cleaning.drop_denied(fx.notes().filter(F.col("split") == "train"))


def _label_sources(fx: Fixtures) -> DataFrame:
    denied = (F.col("split") == "train") & F.col("dp").isin(cleaning.DENIED_CODES)
    real = labels.melt_labels(fx.notes().filter(~denied), keep=["split"])
    syn = synthesis.single_code_notes(fx.synonyms(), fx.codes("dp"))
    other = patients.patient_notes(fx.patients(), "coding")
    tagged = real.withColumnRenamed("split", "source")
    for name, notes in (("syn", syn), ("other", other)):
        tagged = tagged.unionByName(labels.melt_labels(notes, ["dp"]).withColumn("source", F.lit(name)))
    return labels.label_sources(tagged, ["train", "syn", "test", "other"])


def _label_space(fx: Fixtures) -> DataFrame:
    used = {"dp": ["train", "syn", "test"], "das": ["train", "test"], "mdp": ["train", "test"]}
    return labels.union_label_space(_label_sources(fx), used)


@query
def label_freq_single(fx: Fixtures) -> DataFrame:
    return labels.label_frequency(_train(fx), ["dp", "mdp"])


@query
def label_freq_multi(fx: Fixtures) -> DataFrame:
    return labels.label_frequency(_train(fx), ["das"])


@query
def label_distinct(fx: Fixtures) -> DataFrame:
    return labels.distinct_labels(fx.notes())


@query
def top_labels(fx: Fixtures) -> DataFrame:
    return labels.top_labels(labels.label_frequency(fx.notes()), 10)


@query
def label_space_union(fx: Fixtures) -> DataFrame:
    return _label_space(fx)


@query
def label_coverage(fx: Fixtures) -> DataFrame:
    return labels.label_coverage(_label_sources(fx)).filter(F.col("head") == "dp")


@query
def label_ids(fx: Fixtures) -> DataFrame:
    return longs(labels.number_labels(stored(_label_space(fx), "label-space")))


def _encoded(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    notes = stored(fx.notes(), "notes")
    train = cleaning.drop_denied(notes.filter(F.col("split") == "train"))
    space = stored(labels.number_labels(labels.distinct_labels(train)), "label-space")
    notes = notes.select("note_id", "dp", "das")
    return labels.encode_label(labels.encode_label(notes, space, "dp"), space, "das"), space


@query
def encode_labels(fx: Fixtures) -> DataFrame:
    encoded, _ = _encoded(fx)
    ids = F.transform("das_id", lambda i: F.coalesce(i.cast("string"), F.lit("?")))
    dp_id = F.coalesce(F.col("dp_id").cast("long"), F.lit(-1))
    return encoded.select("note_id", dp_id.alias("dp_id"), F.array_join(ids, "|").alias("das_id"))


@query
def decode_labels(fx: Fixtures) -> DataFrame:
    encoded, space = _encoded(fx)
    codes = labels.decode_label(encoded.select("note_id", "dp_id", "das_id"), space, "dp", "dp_id", "dp")
    codes = labels.decode_label(codes, space, "das", "das_id", "das")
    return codes.select("note_id", "dp", joined("das").alias("das"))


@query
def label_oov(fx: Fixtures) -> DataFrame:
    space = stored(labels.referential_label_space(_numbered_referential(fx)), "label-space")
    return labels.labels_outside(labels.label_frequency(fx.notes()), space)


@query
def class_weights(fx: Fixtures) -> DataFrame:
    frequency = stored(labels.label_frequency(_train(fx)), "label-frequency")
    return rounded(labels.class_weights(frequency))


def _kept_statistics(fx: Fixtures) -> tuple[LabelStatistics, int]:
    """Counts of the sets put in batches, of which one is wrong at first and one set is withdrawn."""
    notes = stored(fx.notes(), "notes")
    train = cleaning.drop_denied(notes.filter(F.col("split") == "train"))
    kept = LabelStatistics(Catalog(fx.spark, new_path(fx.spark, "catalog")))
    kept.put("train", train.filter("note_id % 2 = 0"), "even")
    wrong = kept.put("train", notes.filter("note_id % 4 = 1"), "odd")
    kept.put("other", patients.patient_notes(fx.patients(), "coding"), heads=["dp"])
    kept.put("syn", synthesis.single_code_notes(fx.synonyms(), fx.codes("dp")), heads=["dp"])
    kept.put("train", train.filter("note_id % 2 = 1"), "odd")
    kept.compact()
    kept.withdraw("other")
    return kept, wrong


@query
def label_statistics_kept(fx: Fixtures) -> DataFrame:
    kept, _ = _kept_statistics(fx)
    return rounded(kept.weights(["train", "syn", "other"]))


@query
def label_statistics_changes(fx: Fixtures) -> DataFrame:
    kept, wrong = _kept_statistics(fx)
    return kept.changes(["train"], wrong)


@query
def label_ids_extended(fx: Fixtures) -> DataFrame:
    """Labels of the synthetic notes behind those of the training notes, whose ids stay."""
    space = stored(labels.number_labels(labels.distinct_labels(_train(fx))), "label-space")
    synthetic = synthesis.single_code_notes(fx.synonyms(), fx.codes("dp"))
    return longs(extend_numbering(space, stored(labels.distinct_labels(synthetic, ["dp"]), "synthetic-labels")))


# Leakage


@query
def prefix_leakage(fx: Fixtures) -> DataFrame:
    documents = fx.documents()
    test = documents.filter(F.col("split") == "test").select("note_id", "note_text")
    train = documents.filter(F.col("split") == "train").select("note_text")
    return leakage.flag_leaks(test, train).select("note_id", "leaked")


@query
def prefix_leakage_summary(fx: Fixtures) -> DataFrame:
    documents = fx.documents()
    test = documents.filter(F.col("split") == "test")
    return leakage.leak_summary(test, documents.filter(F.col("split") == "train"))


# Synthetic notes and the feed


@query
def synonym_scan(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "synonyms")
    fx.synonyms().select("code", "libelle").write.options(header=True).csv(path)
    return tables.read_synonyms(fx.spark, path, "csv").select("code", "libelle")


@query
def syn_dp(fx: Fixtures) -> DataFrame:
    return synthesis.single_code_notes(fx.synonyms(), fx.codes("dp"))


def _multi_code_notes(fx: Fixtures) -> DataFrame:
    documents = fx.table("orders").select(F.col("o_orderkey").alias("doc_no"))
    return synthesis.multi_code_notes(documents, fx.synonyms(), fx.codes("das"))


@query
def syn_das(fx: Fixtures) -> DataFrame:
    return _multi_code_notes(fx).withColumn("das", joined("das"))


def _mixed(fx: Fixtures, head_weights: dict[str, float] | None = None) -> DataFrame:
    real = fx.notes().withColumn("note_text", F.concat(F.lit("Note "), F.col("note_id").cast("string")))
    single = synthesis.single_code_notes(fx.synonyms(), fx.codes("dp")).withColumnRenamed("ordinal", "note_id")
    multi = _multi_code_notes(fx).withColumnRenamed("doc_no", "note_id")
    synthetic = {"pipe": "synthetic", "scale": feed.SYNTHETIC_SCALE}
    return feed.mix_streams(
        {
            "real": feed.Stream(real, ("dp", "das", "mdp")),
            "syn": feed.Stream(single, ("dp",), **synthetic),
            "syn_das": feed.Stream(multi, ("das",), **synthetic),
        },
        head_weights,
    )


@query
def mix_streams(fx: Fixtures) -> DataFrame:
    mixed = _mixed(fx)
    shown = ["note_id", "note_text", "dp", "mdp", "stream", "pipe", "sample_weight"]
    return mixed.select(*shown, joined("das").alias("das"))


@query
def mix_head_weights(fx: Fixtures) -> DataFrame:
    mixed = _mixed(fx, {"dp": 2.0, "das": 0.5})
    return rounded(mixed.select("note_id", "stream", *[f"{h}_weight" for h in labels.HEADS]))


def _shuffled(fx: Fixtures, columns: list[str]) -> DataFrame:
    documents = fx.documents().withColumns(
        {"stream": F.col("split"), "n_words": word_count(F.col("note_text"))}
    )
    documents = documents.select("stream", *columns)
    return feed.shuffle_dataset(documents, seed=SEED)


@query
def shuffle_dataset(fx: Fixtures) -> DataFrame:
    return _shuffled(fx, ["note_id"])


@query
def shuffle_fragment(fx: Fixtures) -> DataFrame:
    documents = fx.documents().select("note_id", F.col("split").alias("stream"), F.col("source").alias("fragment"))
    return feed.shuffle_fragments(documents, seed=SEED)


@query
def assign_batches(fx: Fixtures) -> DataFrame:
    return feed.assign_batches(_shuffled(fx, ["note_id"])).select("stream", "note_id", "batch")


@query
def assign_batches_by_stream(fx: Fixtures) -> DataFrame:
    size = F.when(F.col("stream") == "train", feed.REAL_BATCH).otherwise(feed.SYNTHETIC_BATCH)
    return feed.assign_batches(_shuffled(fx, ["note_id"]), size).select("stream", "note_id", "batch")


@query
def assign_sub_batches(fx: Fixtures) -> DataFrame:
    return feed.assign_sub_batches(feed.assign_batches(_shuffled(fx, ["note_id", "n_words"])))


@query
def feed_from_files(fx: Fixtures) -> DataFrame:
    """The whole feed, with the files of the tables as fragments, written and read again."""

    def notes(table: str, key: Column, text: str, label: Column) -> DataFrame:
        rows = tables.with_fragment(fx.table(table))
        return rows.select(key.alias("note_id"), F.col(text).alias("note_text"), label.alias("dp"), "fragment")

    none = F.lit(None).cast("string")
    real = notes("documents", F.col("doc_id"), "text", F.col("lang"))
    real = real.unionByName(notes("pages", -1 - F.col("page_id"), "html", none))
    synthetic = notes("benchmark", F.col("item_id"), "text", none)
    mixed = feed.mix_streams(
        {
            "real": feed.Stream(real, ("dp",)),
            "syn": feed.Stream(synthetic, ("dp",), pipe="synthetic", scale=feed.SYNTHETIC_SCALE),
        },
        keep=["fragment"],
    )
    path = new_path(fx.spark, "feed")
    feed.write_feed(feed.place_in_feed(mixed, seed=SEED), path)
    shown = ["stream", "fragment", "note_id", "position", "batch", "n_words", "sub_batch"]
    return longs(fx.spark.read.parquet(path).select(*shown))


@query
def exact_note_ids(fx: Fixtures) -> DataFrame:
    lines = fx.table("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    numbered = exact_ids(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], "line_id", first=100)
    return longs(numbered.select("l_orderkey", "l_linenumber", "line_id"))


# Scoring


def _guess_language() -> scoring.Predictor:
    """A rule in place of a trained model: the language whose frequent word the text holds."""

    def predict(texts: pd.Series) -> pd.DataFrame:
        def has(word: str) -> pd.Series:
            return texts.str.contains(word, regex=False)

        guess = pd.Series("en", index=texts.index)
        return pd.DataFrame({"dp": guess.mask(has(" und "), "de").mask(has(" que "), "fr")})

    return predict


@query
def score_notes(fx: Fixtures) -> DataFrame:
    notes = feed.select_attributes(fx.documents(), {"lang": "dp_gold"})
    scored = scoring.score_notes(notes, _guess_language, {"dp": T.StringType()})
    path = new_path(fx.spark, "scored")
    tables.write_scored(scored, path)
    return fx.spark.read.parquet(path).select("note_id", "dp_gold", "dp")


def _language_and_length() -> scoring.Predictor:
    guess = _guess_language()

    def predict(texts: pd.Series) -> pd.DataFrame:
        return guess(texts).assign(n_chars=texts.str.len())

    return predict


@query
def score_by_length(fx: Fixtures) -> DataFrame:
    """Texts handed to the predictor in batches of like length."""
    heads = {"dp": T.StringType(), "n_chars": T.LongType()}
    scored = scoring.score_notes(fx.documents(), _language_and_length, heads, by_length=True)
    return scored.select("note_id", "dp", "n_chars")


@query
def select_single_label(fx: Fixtures) -> DataFrame:
    return rounded(scoring.select_single_label(fx.head_scores()))


@query
def select_multi_label(fx: Fixtures) -> DataFrame:
    return scoring.select_multi_label(fx.head_scores()).withColumn("labels", joined("labels"))


@query
def token_windows(fx: Fixtures) -> DataFrame:
    return scoring.token_windows(fx.documents())


@query
def pool_vectors(fx: Fixtures) -> DataFrame:
    pooled = scoring.pool_vectors(
        fx.table("embeddings"), key="label", vector="embedding", logit=F.col("vec_id") % 7, row_key="vec_id"
    )
    return rounded(longs(pooled.select("label", F.posexplode("pooled").alias("dim", "value"))))


def _pooled(fx: Fixtures, mode: str) -> DataFrame:
    pooled = scoring.pool_vectors(fx.table("embeddings"), key="label", vector="embedding", mode=mode, row_key="vec_id")
    return rounded(longs(pooled.select("label", F.posexplode("pooled").alias("dim", "value"))))


@query
def pool_vectors_mean(fx: Fixtures) -> DataFrame:
    return _pooled(fx, "mean")


@query
def pool_vectors_max(fx: Fixtures) -> DataFrame:
    return _pooled(fx, "max")


def _bayes(fx: Fixtures) -> bayes.NaiveBayes:
    train = fx.documents().filter(F.col("split") == "train")
    weight = F.when(F.col("note_id") % 2 == 0, feed.REAL_SCALE).otherwise(feed.SYNTHETIC_SCALE)
    return bayes.fit(train.withColumn("sample_weight", weight), label="lang", weight="sample_weight")


@query
def nb_fit(fx: Fixtures) -> DataFrame:
    return rounded(_bayes(fx).tokens)


@query
def nb_predict(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "bayes")
    bayes.save(_bayes(fx), path)
    test = fx.documents().filter(F.col("split") == "test")
    return rounded(bayes.predict(test, bayes.load(fx.spark, path)))


@query
def train_heads(fx: Fixtures) -> DataFrame:
    """Heads trained on the mixed feed, held against notes that were left out of it."""
    mixed = _mixed(fx)
    held_out = (F.col("pipe") == "synthetic") & (F.col("note_id") % 5 == 0)
    model = heads.fit(mixed.filter(~held_out), ["dp", "das"], rounds=6)
    key = F.concat_ws(":", "stream", F.col("note_id").cast("string"))
    test = stored(mixed.filter(held_out).select(key.alias("note_id"), "note_text", "dp", "das"), "held-out")
    # Packed and not stored: a table of all of them would have a row per note and label.
    scores = heads.probabilities(test, model, packed=True)
    dp = scoring.select_single_label(scores.filter("head = 'dp'")).select("note_id", F.col("label").alias("dp"))
    das = scoring.select_multi_label(scores.filter("head = 'das'")).select("note_id", F.col("labels").alias("das"))
    gold = test.select("note_id", F.col("dp").alias("dp_gold"), F.col("das").alias("das_gold"))
    aligned = metrics.align_predictions(metrics.align_predictions(gold, dp), das)
    counts = metrics.head_counts(aligned, {h: (f"{h}_gold", h) for h in ("dp", "das")})
    return rounded(metrics.report(counts, ["head"]))


# Evaluation


@query
def align_gold_pred(fx: Fixtures) -> DataFrame:
    scored = stored(fx.scored(), "scored")
    # Some notes have no prediction, and some predictions are of other notes.
    other = F.when(F.col("note_id") % 5 == 0, -F.col("note_id")).otherwise(F.col("note_id"))
    predictions = scored.filter("note_id % 11 <> 0").select(other.alias("note_id"), "dp")
    return metrics.align_predictions(scored.select("note_id", "dp_gold"), predictions)


@query
def metrics_micro(fx: Fixtures) -> DataFrame:
    report = metrics.report(metrics.single_label_counts(fx.scored()))
    return rounded(report.select("n_gold", "micro_precision", "micro_recall", "micro_f1"))


@query
def metrics_macro(fx: Fixtures) -> DataFrame:
    report = metrics.report(metrics.single_label_counts(fx.scored()))
    return rounded(report.select("macro_precision", "macro_recall", "macro_f1"))


@query
def metrics_per_label(fx: Fixtures) -> DataFrame:
    return rounded(metrics.label_report(metrics.single_label_counts(fx.scored())))


@query
def metrics_by_granularity(fx: Fixtures) -> DataFrame:
    cut = metrics.at_granularities(fx.scored(), GRANULARITIES)
    report = metrics.report(metrics.single_label_counts(cut, by=["granularity"]), ["granularity"])
    return rounded(longs(report))


@query
def metrics_by_doc_type(fx: Fixtures) -> DataFrame:
    predicted = F.when(F.col("note_id") % 3 == 0, F.col("lang")).when(F.col("note_id") % 7 != 0, "en")
    scored = fx.documents().select("note_id", "note_text", F.col("lang").alias("dp_gold"), predicted.alias("dp"))
    typed = metrics.by_document_type(scored, phrases=PHRASES)
    return rounded(metrics.report(metrics.single_label_counts(typed, by=["doc_type"]), ["doc_type"]))


@query
def metrics_by_head(fx: Fixtures) -> DataFrame:
    notes = fx.notes()
    gold = notes.select(
        "note_id",
        *[F.col(h).alias(f"{h}_gold") for h in labels.HEADS],
        fx.predicted_dp().alias("dp"),
        F.lit(cleaning.DEFAULT_CARE_MODE).alias("mdp"),
    )
    das = scoring.select_multi_label(fx.head_scores()).select("note_id", F.col("labels").alias("das"))
    aligned = metrics.align_predictions(gold, das)
    counts = metrics.head_counts(aligned, {h: (f"{h}_gold", h) for h in labels.HEADS})
    return rounded(metrics.report(counts, ["head"]))


def _coded_documents(fx: Fixtures) -> DataFrame:
    """Patient documents with ids that end in two digits of document number, and gold codes."""
    documents = fx.patient_documents()
    note_id = F.col("patient_id") * 100 + F.col("document_no")
    gold = F.when(F.col("document_no") % 3 != 0, F.concat(F.lit("C"), (F.col("patient_id") % 7).cast("string"), F.lit(" x")))
    return documents.select(
        note_id.alias("note_id"), patients.patient_key(note_id).alias("patient_id"), "document_no", "note_text",
        gold.alias("dp_gold"),
    )


@query
def group_documents(fx: Fixtures) -> DataFrame:
    return patients.group_documents(_coded_documents(fx))


def _code_from_length() -> scoring.Predictor:
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"dp": "C" + (texts.str.split().str.len() % 7).astype(str)})

    return predict


@query
def metrics_grouped(fx: Fixtures) -> DataFrame:
    documents = _coded_documents(fx)
    grouped = patients.group_documents(documents)
    scored = scoring.score_notes(grouped, _code_from_length, {"dp": T.StringType()})
    gold = patients.first_gold(documents, key="patient_id", order="document_no", gold="dp_gold")
    gold = gold.withColumn("dp_gold", first_word(F.col("dp_gold")))
    aligned = metrics.align_predictions(gold, scored.select("patient_id", "dp"), "patient_id")
    return rounded(metrics.report(metrics.single_label_counts(aligned)))
