"""A naive Bayes classifier per head, trained on the weighted feed.

It gives scoring a predictor without an outside model. Training is counting; prediction joins the
tokens of the notes to the model as an inverted index, so no part of it passes through the driver.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.functions.text import words
from notecode.operators.joins import ROWS_PER_TASK, is_small, lookup_join
from notecode.operators.once import with_columns_once
from notecode.sources.shared_folder import stored

INDEX_ROWS = 1_000_000  # rows of a hash, a label and a number: some 100 MB as a broadcast
UNIT = float(1 << 36)  # scores are summed as whole numbers, so that no order of summing shows

_TOKENS = "label string, token string, n double"
_LABELS = "label string, n_notes double"


@dataclass(frozen=True)
class NaiveBayes:
    """Weighted counts: `tokens` (`label`, `token`, `n`) and `labels` (`label`, `n_notes`)."""

    tokens: DataFrame
    labels: DataFrame
    smoothing: float = 1.0


def fit(
    feed: DataFrame, *, label: str, text: str = "note_text", weight: str | None = None,
    smoothing: float = 1.0,
) -> NaiveBayes:
    """Count tokens and notes per label. An array label counts the note for each of its codes."""
    is_array = dict(feed.dtypes)[label].startswith("array")
    labelled = feed.select(
        (F.explode(label) if is_array else F.col(label)).alias("label"),
        F.col(text).alias("_text"),
        (F.col(weight) if weight else F.lit(1.0)).alias("_weight"),
    ).filter(F.col("label").isNotNull())
    tokens = (
        labelled.select("label", "_weight", F.explode_outer(words(F.col("_text"))).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("label", "token")
        .agg(F.sum("_weight").alias("n"))
    )
    labels = labelled.groupBy("label").agg(F.sum("_weight").alias("n_notes"))
    return NaiveBayes(tokens, labels, smoothing)


def save(model: NaiveBayes, path: str) -> None:
    model.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
    model.labels.write.mode("overwrite").parquet(f"{path}/labels")


def load(spark: SparkSession, path: str, smoothing: float = 1.0) -> NaiveBayes:
    tables = (
        spark.read.schema(_TOKENS).parquet(f"{path}/tokens"),
        spark.read.schema(_LABELS).parquet(f"{path}/labels"),
    )
    return NaiveBayes(*tables, smoothing)


def _fixed(value: Column) -> Column:
    return F.round(value * UNIT).cast("long")


def _label_bases(model: NaiveBayes) -> DataFrame:
    """(`label`, `prior`, `unseen`): log prior, and log probability of a token the label lacks."""
    vocabulary = model.tokens.select("token").distinct().agg(F.count("*").alias("v")).scalar()
    notes = model.labels.agg(F.sum("n_notes").alias("n")).scalar()
    totals = model.tokens.groupBy("label").agg(F.sum("n").alias("n_tokens"))
    n_tokens = F.coalesce("n_tokens", F.lit(0.0))
    smoothing = F.lit(model.smoothing)
    return model.labels.join(totals, "label", "left").select(
        "label",
        _fixed(F.log(F.col("n_notes") / notes)).alias("prior"),
        F.coalesce(_fixed(F.log(smoothing / (n_tokens + smoothing * vocabulary))), F.lit(0)).alias("unseen"),
    )


def envelope(lines: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(`from_length`, `prior`, `unseen`, `label`): the label that is best at each length without any hit.

    `lines` holds (`prior`, `unseen`, `label`); the base of a label at a length is a line, and the best
    ones are the upper envelope over whole lengths. Of equal bases the first label wins.
    """
    best: dict[int, tuple[int, str]] = {}
    for prior, unseen, label in lines:
        if unseen not in best or (-prior, label) < (-best[unseen][0], best[unseen][1]):
            best[unseen] = (prior, label)
    hull: list[tuple[int, int, int, str]] = []
    for unseen, (prior, label) in sorted(best.items()):
        first = 0
        while hull:
            start, top_prior, top_unseen, top_label = hull[-1]
            ahead, steeper = top_prior - prior, unseen - top_unseen
            first = -(-ahead // steeper) if label < top_label else ahead // steeper + 1
            first = max(first, 0)
            if first > start:
                break
            hull.pop()
        hull.append((first if hull else 0, prior, unseen, label))
    return hull


def _envelope(bases: DataFrame) -> DataFrame:
    """The envelope of all labels as one row with an array: first within each part, then of what is left."""
    schema = "from_length long, prior long, unseen long, label string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hull: list[tuple[int, int, int, str]] = []
        for batch in batches:
            lines = zip(*(batch.column(c).to_pylist() for c in ("prior", "unseen", "label")))
            hull = envelope([*(h[1:] for h in hull), *lines])
        columns = list(zip(*hull)) if hull else [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["from_length", "prior", "unseen", "label"]
        )

    lines = bases.select("prior", "unseen", "label")
    parts = lines.mapInArrow(run, schema).select("prior", "unseen", "label")
    whole = parts.repartition(1).mapInArrow(run, schema)
    return whole.agg(F.array_sort(F.collect_list(F.struct("from_length", "prior", "unseen", "label"))).alias("hull"))


def predict(
    notes: DataFrame, model: NaiveBayes, *, text: str = "note_text", broadcast_rows: int = INDEX_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(`note_id`, `label`, `score`): the best label of each note, the first in case of a tie.

    The model is an inverted index, token to (label, gain), that is joined to the notes' tokens: only
    labels that share a token with a note are summed up, so rows grow with the hits. All others are
    worth their base, a line in the note's length, and only the upper envelope of these lines can win.
    A small model is broadcast and the sums are built before any shuffle; for a large one the tokens
    are counted per note and joined by shuffle, frequent ones over several tasks.

    Notes with the same id are one note with the best of their scores. Tokens are compared by 64-bit
    hashes. The limits change the layout, never the answer. Use a saved model.
    """
    tokens = F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda t: F.xxhash64(t))
    row = F.monotonically_increasing_id()
    rows = with_columns_once(notes.select("note_id", F.col(text), row.alias("row")), {"tokens": tokens}).drop(text)
    rows = stored(rows.withColumn("length", F.size("tokens").cast("long")), "note-tokens")
    bases = stored(_label_bases(model), "label-bases")
    gain = _fixed(F.log((F.col("n") + model.smoothing) / F.lit(model.smoothing)))
    index = stored(model.tokens.select(F.xxhash64("token").alias("token"), "label", gain.alias("gain")), "postings")
    own = ["row", "note_id", "length"]
    single = rows.select(*own, F.explode("tokens").alias("token"))
    small = is_small(index, broadcast_rows)
    counted = single.withColumn("times", F.lit(1)) if small else single.groupBy(*own, "token").agg(F.count("*").alias("times"))
    if not small:
        counted = stored(counted, "counted-tokens")
    hits = lookup_join(counted, index, ["token"], salt_by=["row"], small=small, rows_per_task=rows_per_task)
    sums = hits.groupBy(*own, "label").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))
    lines = bases.select("label", "prior", "unseen")
    sums = lookup_join(sums, lines, ["label"], salt_by=["row"], broadcast_rows=broadcast_rows, rows_per_task=rows_per_task)
    with_hits = sums.select(
        "note_id", "label", (F.col("prior") + F.col("length") * F.col("unseen") + F.col("gain")).alias("sum")
    )
    # One row per label that can win without hits; no more than there are lengths of notes.
    hull = stored(_envelope(bases), "label-envelope")
    reached = F.filter("hull", lambda h: h.from_length <= F.col("length"))
    best = rows.withColumn("hull", hull.scalar()).withColumn("line", F.try_element_at(reached, F.lit(-1)))
    without = best.filter(F.col("line").isNotNull()).select(
        "note_id", "line.label", (F.col("line.prior") + F.col("length") * F.col("line.unseen")).alias("sum")
    )
    return (
        with_hits.union(without)
        .groupBy("note_id")
        .agg(F.min_by("label", F.struct(-F.col("sum"), "label")).alias("label"), F.max("sum").alias("sum"))
        .select("note_id", "label", (F.col("sum") / UNIT).alias("score"))
    )
