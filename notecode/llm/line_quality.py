"""Line-first cleaning: rules per line, then the documents that lose too much text are rejected.

DataFrame operations only. A line fails when it is bare navigation, boilerplate, made of symbols, has
bars for a fifth of its words or more, or does not end with punctuation, however long it is. Failing
lines are removed; a document is rejected when it fails the base limits, when less than `MIN_KEPT` of
its words remain, or fewer than `MIN_WORDS`.

Windows of five words are compared by 64-bit hashes within their document.

Defined results: a NULL or blank text has no words and fails the base limits; equal rows give equal
results; empty input gives no rows.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.operators.once import with_columns_once

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_KEPT = 0.5

ENDS_WELL = r"[.!?:;…\"'”’»)\]。！？：；」』）؟۔।։።][\x20\x09-\x0D]*$"
NAVIGATION = (
    r"(?i)^\W*+(home|menu|next|previous|back to top|read more|click here|share( this)?|log ?in|sign (in|up)|"
    r"subscribe|follow us|contact us|about us|search|skip to content|site ?map)\b(\W++\w++){0,3}+\W*+$"
)
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms and conditions",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "enable javascript",
    "lorem ipsum",
    "copyright ©",
    "copyright (c)",
    "powered by",
)
MAX_SYMBOL_SHARE = 0.1
MAX_BAR_SHARE = 0.2
# Words of bars and bullets only, as between the entries of a menu; "&", "$" and "%" are words of prose too.
BAR = r"(?<![^\x20\x09-\x0D])[#*|<>¦·•›→]++(?![^\x20\x09-\x0D])"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words between blanks; no words for NULL and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    """How many symbols the text holds; texts without any are told by plain searches."""
    some = reduce(lambda a, b: a | b, [text.contains(c) for c in "#*$%&|<>"])
    return F.when(some, F.regexp_count(text, F.lit(SYMBOLS))).otherwise(0)


def line_fails(line: Column) -> Column:
    """Whether a line is to be removed; lines without a word stay."""
    unfinished = ~line.rlike(ENDS_WELL)
    symbols = n_symbols(line) > MAX_SYMBOL_SHARE * F.char_length(line)
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]++"))
    bars = line.rlike(BAR) & (F.regexp_count(line, F.lit(BAR)) >= MAX_BAR_SHARE * n_words)

    def boilerplate(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(b) for b in BOILERPLATE])

    spoken = line.rlike(r"[^\x20\x09-\x0D]")
    return spoken & (unfinished | line.rlike(NAVIGATION) | symbols | bars | _let(F.lower(line), boilerplate))


def repeated_words(tokens: Column) -> Column:
    """How many words lie in windows of five words that occur at least twice in the array."""
    pair = lambda a, b: F.xxhash64(a, b)

    def from_place(values: Column, first: int, n: Column) -> Column:
        return F.slice(values, F.lit(first), n)

    def counted(single: Column) -> Column:
        n = F.size(single) - WINDOW + 1
        return _let(
            F.zip_with(from_place(single, 1, n + 3), from_place(single, 2, n + 3), pair),
            lambda two: _let(
                F.zip_with(
                    F.zip_with(from_place(two, 1, n), from_place(two, 3, n), pair),
                    from_place(single, 5, n),
                    pair,
                ),
                lambda five: F.when(F.size(F.array_distinct(five)) == n, 0).otherwise(_covered(five)),
            ),
        )

    some = F.size(tokens) >= WINDOW
    return F.when(some, _let(F.transform(tokens, lambda w: F.xxhash64(w)), counted)).otherwise(0)


def _covered(hashes: Column) -> Column:
    """The size of the union of the windows whose hash is there more than once."""

    def places(row: Column) -> Column:
        def again(p: Column, k: Column) -> Column:
            same = F.coalesce(F.get(row, k - 1)["h"] == p["h"], F.lit(False))
            return same | F.coalesce(F.get(row, k + 1)["h"] == p["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(row, again), lambda p: p["i"]))

    begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    return F.aggregate(
        _let(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places),
        begin,
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at")),
        lambda s: s["n"],
    )


def judge(documents: DataFrame) -> DataFrame:
    """The base figures, the lines and words removed, the cleaned text and the verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    rows = with_columns_once(
        rows, {"tokens": words(F.col("text")), "lines": F.split("text", "\n", -1)}
    )
    with_word = F.filter("lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = with_columns_once(
        rows.withColumn("spoken", with_word),
        {
            "n_words": F.size("tokens").cast("bigint"),
            "word_chars": F.char_length(F.array_join("tokens", "")).cast("bigint"),
            "n_symbols": n_symbols(F.col("text")).cast("bigint"),
            "n_dup_lines": (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("bigint"),
            "n_repeat_words": repeated_words(F.col("tokens")).cast("bigint"),
            "passed": F.filter("lines", lambda line: ~line_fails(line)),
        },
    )
    cleaned = F.array_join("passed", "\n")
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    whole = F.size("passed") == F.size("lines")
    left = F.when(whole, F.col("n_words")).otherwise(
        F.regexp_count(F.col("cleaned"), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    )
    rows = with_columns_once(rows.withColumn("cleaned", cleaned), {"left_words": left, "base_failed": base_failed})
    lost_too_much = (F.col("left_words") < MIN_KEPT * F.col("n_words")) | (F.col("left_words") < MIN_WORDS)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~lost_too_much).alias("kept"),
        (F.size("lines") - F.size("passed")).cast("bigint").alias("n_lines_removed"),
        (F.col("n_words") - F.col("left_words")).alias("n_words_removed"),
        F.col("cleaned").alias("clean_text"),
    )


def verdicts(documents: DataFrame) -> DataFrame:
    """What `judge` says, without the cleaned text."""
    return judge(documents).drop("clean_text")
