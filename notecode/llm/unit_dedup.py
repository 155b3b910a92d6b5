"""Substring dedup by hashing lines, paragraphs, sentences, or lines and sentences together.

Units are normalised (lower case, blanks as one space) and hashed. Of equal units with at least
`MIN_WORDS` words, the first by (`doc_id`, offset) stays; the others are removed, with their offsets
in code points of the original text. Only digests and offsets are shuffled, never texts.

A passage inside a line is found by `PASSAGE`: the lines, and from each sentence on the shortest run of
sentences with enough words. Such units overlap, so spans to remove may too, and the first place of one
unit may lie partly in the repeat of another; each removed word still has an earlier copy that stays.
Repeats that touch or overlap are one stretch, and of `PASSAGE` only stretches with `STRETCH_WORDS` words are
removed: shorter ones are turns of phrase that documents share without a copied passage.

Defined results: a NULL text has no units; rows with a NULL `doc_id` rank last; equal rows with the
same `doc_id` share a place, and if it is the first, all of them keep it (`with_text` asks for equal texts
as well); empty input gives no rows;
other columns are not touched.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notecode.llm.batches import short_batches, trimmed
from notecode.sources.shared_folder import stored

MIN_WORDS = 8
# A passage of 51 words holds whole sentences with 13 words or more if none of them has over 20 words.
STRETCH_WORDS = 13

# Fixed patterns: what ends a unit belongs to it, so the units of a text add up to the text.
UNITS = {
    "line": r"[^\n]*\n|[^\n]+\Z",
    "paragraph": r"(?s:.*?)\n\n+|(?s:.+)\Z",
    "sentence": r"[^\n]*?(?:[.!?] |\n)|[^\n]+\Z",
}
PASSAGE = "passage"


def _digest(words: list[str]) -> bytes:
    from hashlib import blake2b

    return blake2b(" ".join(words).encode(), digest_size=16).digest()


def _pieces(text: str, unit: str) -> Iterator[tuple[int, int, list[str], int]]:
    """(start, end, words, number of words before) of each unit."""
    before = 0
    for m in re.finditer(UNITS[unit], text):
        words = m.group().lower().split()
        yield m.start(), m.end(), words, before
        before += len(words)


def _units_of(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(start, end, number of words, digest, number of words before) for each unit with enough words."""
    places = set()
    for start, end, words, before in _pieces(text, "line" if unit == PASSAGE else unit):
        if len(words) >= min_words:
            places.add((start, end))
            yield start, end, len(words), _digest(words), before
    if unit != PASSAGE:
        return
    sentences = [p for p in _pieces(text, "sentence") if p[2]]
    ends: dict[bytes, int] = {}
    for i, (start, _, _, before) in enumerate(sentences):
        words: list[str] = []
        for _, end, more, _ in sentences[i:i + max(min_words, 1)]:  # each has a word at least
            words = words + more
            if len(words) >= min_words:
                break
        if len(words) < min_words:
            break
        digest = _digest(words)
        # Equal runs of a text do not overlap, or "a. a. a." would lose its first run too.
        if ends.get(digest, 0) <= start:
            ends[digest] = end
            if (start, end) not in places:
                yield start, end, len(words), digest, before


def units(
    documents: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, with_text: bool = False
) -> DataFrame:
    """(`row`, `doc_id`, `start`, `end`, `n_words`, `words_before`, `digest`) for each unit with enough words.

    `row` is a number of the document's row. With `with_text`, `text_hash` tells the texts of rows apart that
    share an id.
    """
    short_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, end, size, digest, before = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                for a, b, n, d, w in _units_of(text.as_py() or "", unit, min_words):
                    rows.append(row)
                    start.append(a)
                    end.append(b)
                    size.append(n)
                    digest.append(d)
                    before.append(w)
            kept = {c: batch.column(c).take(pa.array(rows, pa.int64())) for c in columns}
            yield pa.RecordBatch.from_pydict(
                {
                    **kept,
                    "start": pa.array(start, pa.int32()),
                    "end": pa.array(end, pa.int32()),
                    "n_words": pa.array(size, pa.int32()),
                    "words_before": pa.array(before, pa.int32()),
                    "digest": pa.array(digest, pa.binary()),
                }
            )

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    columns = ["row", "doc_id", "text_hash"] if with_text else ["row", "doc_id"]
    schema = (
        f"row bigint, doc_id {doc_id}, {'text_hash bigint, ' if with_text else ''}start int, end int, n_words int, "
        "words_before int, digest binary"
    )
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if with_text:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(trimmed(run), schema)


def repeated_units(
    documents: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, with_text: bool = False
) -> DataFrame:
    """The units to remove: (`doc_id`, `start`, `end`, `n_words`, `first_doc_id`, `first_start`).

    With `with_text`, rows of one id with different texts are told apart, and `text_hash` is added. The first place of each digest is an aggregate, which is stored, so that the join back is between
    two shuffles and Spark can split the rows of a frequent unit.
    """
    found = stored(units(documents, unit, min_words, with_text), "units")
    text = ["text_hash"] if with_text else []
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *text, "start")
    first = (
        found.groupBy("digest")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", *text, "start")])
    )
    first = stored(first, "first-units")
    same = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("start") == F.col("first_start"))
    if with_text:
        same = same & (F.col("text_hash") == F.col("first_text_hash"))
    repeats = found.join(first, "digest").filter(~same)
    if unit == PASSAGE:
        repeats = _long_stretches(repeats)
    return repeats.drop("row", "words_before", "digest", "first_text_hash")


def _long_stretches(repeats: DataFrame) -> DataFrame:
    """The spans of stretches with `STRETCH_WORDS` words, where a row's spans that touch are one stretch.

    A window holds the spans of one row of `documents`, so no more than its text gives.
    """
    in_order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = repeats.withColumn("_new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn(
        "_stretch", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    of_stretch = Window.partitionBy("row", "_stretch")
    last_word = F.max(F.col("words_before") + F.col("n_words")).over(of_stretch)
    sized = numbered.withColumn("_words", last_word - F.min("words_before").over(of_stretch))
    return sized.filter(F.col("_words") >= STRETCH_WORDS).drop("_new", "_stretch", "_words")


def without_repeats(documents: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """`documents` with `clean_text` and `removed`, the spans that were cut out, sorted; they may overlap.

    Rows that share an id are told apart by their text. Rows with a NULL `doc_id` keep their text.
    """
    of_text = F.xxhash64("text")
    cut = (
        repeated_units(documents, unit, min_words, with_text=True)
        .groupBy("doc_id", F.col("text_hash").alias("_nc_hash"))
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    )
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate(
        "removed",
        begin,
        lambda s, c: F.struct(
            F.greatest(s["at"], c["end"]).alias("at"),
            F.concat(s["parts"], F.array(text.substr(s["at"] + 1, F.greatest(c["start"] - s["at"], F.lit(0))))).alias("parts"),
        ),
        lambda s: F.array_join(F.concat(s["parts"], F.array(text.substr(s["at"] + 1, F.char_length(text)))), ""),
    )
    cleaned = documents.withColumn("_nc_hash", of_text).join(cut, ["doc_id", "_nc_hash"], "left")
    return cleaned.withColumn("clean_text", F.when(F.col("removed").isNull(), text).otherwise(parts)).drop("_nc_hash")
