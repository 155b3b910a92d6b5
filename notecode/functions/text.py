"""Column expressions on codes and note text."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a CSV cell may hold that mean "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Document types and the phrase that marks each of them.
DOC_TYPE_PHRASES = {
    "CRC": "Compte rendu de consultation",
    "CRH": "Compte rendu d'hospitalisation",
    "CRO": "Compte rendu opératoire",
}

# Every character that counts as white space in Unicode text.
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Those of them that `\s` does not match: single ones, and many that begin with the same bytes.
_RARE = [*map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x205F, 0x3000))]
_RARE_PREFIX, _RARE_BEHIND = b"\xe2\x80", [*map(chr, (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F))]
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def blank_to_null(col: Column) -> Column:
    return F.when(~col.isin(MISSING_TOKENS), col)


def strip_blanks(col: Column) -> Column:
    """Strip all Unicode white space; `trim` removes plain blanks only."""
    return F.regexp_replace(col, f"^{_BLANK}+|{_BLANK}+$", "")


def lenient_double(col: Column) -> Column:
    """Decimal text as a double, NULL for anything else."""
    return F.when(col.rlike(_NUMBER), F.trim(col).try_cast("double"))


def is_filled(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def truncate_code(code: Column, granularity: int | None) -> Column:
    """First `granularity` characters; negative drops from the end, 0 or None keeps the code."""
    if not granularity:
        return code
    if granularity > 0:
        return F.left(code, F.lit(granularity))
    return F.left(code, F.greatest(F.length(code) + granularity, F.lit(0)))


def first_word(text: Column) -> Column:
    return F.get(words(text), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words, without empty ones.

    The class of all blanks is slow to match, so only texts that hold a rare one are split by it; to
    look for each of them is faster than a pattern.
    """
    raw = text.cast("binary")

    def any_of(blanks: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(raw, F.lit(blank.encode())) for blank in blanks])

    has_rare = any_of(_RARE) | (F.contains(raw, F.lit(_RARE_PREFIX)) & any_of(_RARE_BEHIND))
    split = F.when(has_rare, F.split(text, f"{_BLANK}+")).otherwise(F.split(text, r"\s+"))
    return F.filter(split, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def doc_types(text: Column, phrases: dict[str, str] | None = None) -> Column:
    """Array with `all` and each type whose phrase occurs in the text; types may overlap."""
    phrases = DOC_TYPE_PHRASES if phrases is None else phrases
    tags = [
        F.when(F.coalesce(F.contains(text, F.lit(phrase)), F.lit(False)), F.lit(tag))
        for tag, phrase in phrases.items()
    ]
    return F.array_compact(F.array(*tags, F.lit("all")))


def row_hash(seed: int, *cols: Column) -> Column:
    """Hex md5 over the seed and the key columns: the same on every run and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_number(text: Column) -> Column:
    """First 32 bits of the md5 of a text as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
