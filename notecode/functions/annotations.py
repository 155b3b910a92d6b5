"""Annotation cells: the text of a Python dict `{code: {"position": "DP" | "DR" | "DAS", ...}}`.

Most cells are read by the JSON reader inside the JVM. A cell that is no JSON is cut into tokens, quoted
texts and what stands between them, and each token is written as JSON: `None`, `True`, `False`, trailing
commas, escapes, both kinds of quotes and tabs in texts. What still cannot be read, such as tuples, hexadecimal
numbers, strings side by side or broken cells, goes to a small Arrow UDF; all other rows send it a NULL.
`annotation_routes` counts the cells per way.
"""

import ast
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecode.operators.once import with_columns_once

PRINCIPAL, RELATED, ASSOCIATED = "DP", "DR", "DAS"

_PARSED = T.StructType(
    [
        T.StructField("dp", T.StringType()),
        T.StructField("dr", T.StringType()),
        T.StructField("das", T.ArrayType(T.StringType())),
    ]
)
# A line break and blanks before the first bracket, which Python takes for an indent; JSON-only words; back-slash escapes, which the two notations read differently; and a bracket after
# a dict, which may close the array the cell is read in.
_INDENTED = r"^[^{]*[\r\n][ \t\f]+\{"
_JSON_ONLY = r"\b(null|true|false|NaN|Infinity|INF)\b|\}\s*\]"
_NOT_SHARED = rf"{_INDENTED}|{_JSON_ONLY}|\\"
# Outside of quotes, a comma right behind a bracket must not pass for a trailing one.
_NOT_PYTHON = rf"{_JSON_ONLY}|[\[{{]\s*,"
# Escapes that mean the same in both notations once quotes and backslashes are rewritten.
_ESCAPE = r"\\(?:[\\'\"ntrbf]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})"
_IN_TEXT = r"\\\x00-\x08\x0a-\x1f"
_QUOTED = "|".join(f"{q}[^{q}{_IN_TEXT}]*+(?:{_ESCAPE}[^{q}{_IN_TEXT}]*+)*+{q}" for q in "'\"")
# Quoted texts without an escape, a tab or the like are most; a plain class and no group takes half the time.
_PLAIN = "|".join(rf"{q}[^{q}\\\x00-\x1f]*+{q}" for q in "'\"")
_TOKEN = rf"[^'\"]++|{_PLAIN}|{_QUOTED}"
# Ways to read a cell, see `annotation_routes`.
MISSING, JSON, TOKENS, PYTHON = "missing", "json", "tokens", "python"


def fold_python_dict(cell: str | None) -> dict | None:
    """Codes per position of one cell read as a Python literal."""
    if cell is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval(cell)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        value = None
    found: dict[str, list] = {PRINCIPAL: [], RELATED: [], ASSOCIATED: []}
    for code, detail in value.items() if isinstance(value, dict) else ():
        position = detail.get("position") if isinstance(detail, dict) else None
        if isinstance(position, str) and position in found:
            found[position].append(code)
    dp = found[PRINCIPAL][-1] if found[PRINCIPAL] else None
    dr = found[RELATED][-1] if found[RELATED] else None
    if not isinstance(dr, str | None):
        dp = dr = None  # a related code that is no text leaves no usable principal code
    return {
        "dp": dp if isinstance(dp, str) else None,
        "dr": dr,
        "das": [c for c in found[ASSOCIATED] if isinstance(c, str)],
    }


@F.pandas_udf(_PARSED)
def _fold_cells(cells: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in cells:
        rows = [fold_python_dict(c) or {"dp": None, "dr": None, "das": None} for c in batch]
        yield pd.DataFrame(rows, columns=["dp", "dr", "das"])


def _last_at(entries: Column, position: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e.position == position), F.lit(-1)).code


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _token_as_json(token: Column) -> Column:
    # Once `\\` is gone, each backslash that is left begins an escape.
    text = F.substring(token, F.lit(2), F.char_length(token) - 2)
    for found, other in [("\\\\", "\\u005c"), ("\\'", "'"), ('\\"', '"'), ('"', '\\"'), ("\t", "\\t")]:
        text = F.replace(text, F.lit(found), F.lit(other))
    between = F.regexp_replace(token, r",(\s*[}\]])", "$1")
    for found, word in [("None", "null"), ("True", "true"), ("False", "false")]:
        between = F.regexp_replace(between, rf"\b{found}\b", word)
    # Most tokens need no change. The JSON reader takes both kinds of quotes.
    written = F.when(token.rlike(r"[NTF]|,\s*[}\]]"), between).otherwise(token)
    other = token.contains("\\") | token.contains("\t") | (token.startswith("'") & token.contains('"'))
    quoted = F.when(other, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(token)
    return F.when(_is_text(token), quoted).otherwise(written)


def _is_text(token: Column) -> Column:
    return token.startswith("'") | token.startswith('"')


def _literal_as_json(text: Column) -> Column:
    """The cell with each token as JSON; NULL where the tokens leave something out or JSON would read too much."""

    def written(tokens: Column) -> Column:
        whole = F.array_join(tokens, "") == text
        strange = F.exists(tokens, lambda t: ~_is_text(t) & t.rlike(_NOT_PYTHON))
        return F.when(whole & ~strange, F.array_join(F.transform(tokens, _token_as_json), ""))

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.when(~text.rlike(_INDENTED), _with(tokens, written))


def _dicts(text: Column) -> Column:
    return F.from_json(
        F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>", {"allowSingleQuotes": "true"}
    )


def _entries(dicts: Column) -> Column:
    """(`code`, `position`) of the only dict as a Python dict keeps them, NULL for anything else."""
    entries = F.transform(
        F.map_entries(F.get(dicts, F.lit(0))),
        lambda e: F.struct(
            e.key.alias("code"),
            F.try_variant_get(e.value, "$.position", "string").alias("position"),
        ),
    )
    return F.when(F.size(dicts) == 1, _with(entries, _fold_repeats))


def _fold_repeats(entries: Column) -> Column:
    """Each code once, at its first place with its last position; sorted, not compared pair by pair."""

    def ends(placed: Column) -> Column:
        other = lambda s, at: ~F.get(placed, at).code.eqNullSafe(s.code)
        firsts = F.filter(placed, lambda s, i: (i == 0) | other(s, i - 1))
        lasts = F.filter(placed, lambda s, i: (i == F.size(placed) - 1) | other(s, i + 1))
        both = F.zip_with(firsts, lasts, lambda a, b: F.struct(a.place, a.code, b.position))
        return F.transform(F.array_sort(both), lambda s: F.struct(s.code.alias("code"), s.position.alias("position")))

    placed = F.transform(
        entries, lambda e, i: F.struct(e.code.alias("code"), i.alias("place"), e.position.alias("position"))
    )
    repeats = F.size(F.array_distinct(F.transform(entries, lambda e: e.code))) < F.size(entries)
    return F.when(repeats, _with(F.array_sort(placed), ends)).otherwise(entries)


def _read(df: DataFrame, column: str) -> DataFrame:
    """Add `_dicts`, read inside the JVM, and `_route`, the way of the cell."""
    text = F.col(column)
    shared = F.col("_json").isNotNull()
    rewritten = F.when(text.isNotNull() & (F.col("_route") != JSON), _dicts(_literal_as_json(text)))
    # Cells that the two notations read differently are not tried as JSON; a vain try costs more than a read.
    first = with_columns_once(df, {"_json": F.when(~text.rlike(_NOT_SHARED), _dicts(text))})
    second = with_columns_once(first, {"_route": F.when(shared, JSON).when(text.isNull(), MISSING).otherwise(TOKENS)})
    third = with_columns_once(second, {"_tokens": rewritten})
    unread = (F.col("_route") == TOKENS) & F.col("_tokens").isNull()
    return third.select(
        *df.columns,
        F.when(F.col("_route") == JSON, F.col("_json")).otherwise(F.col("_tokens")).alias("_dicts"),
        F.when(unread, PYTHON).otherwise(F.col("_route")).alias("_route"),
    )


def annotation_routes(df: DataFrame, column: str) -> DataFrame:
    """(`route`, `n`): how many cells are `missing`, read as `json`, rewritten by `tokens` or left to `python`."""
    return _read(df.select(column), column).groupBy(F.col("_route").alias("route")).agg(F.count(F.lit(1)).alias("n"))


def parse_annotations(df: DataFrame, column: str) -> DataFrame:
    """Add `dp`, `dr` and `das` read from the dict text in `column`.

    As in a dict, a repeated code keeps its first place and its last value; the last `DP` and the
    last `DR` win. A cell that is missing, unreadable or no dict gives NULL, NULL and an empty list.
    """
    left = F.when(F.col("_route") == PYTHON, F.col(column))
    prepared = (
        with_columns_once(_read(df, column), {"_entries": _entries(F.col("_dicts"))})
        .withColumn("_python", _fold_cells(left))
    )
    associated = F.filter("_entries", lambda e: e.position == ASSOCIATED)
    parsed = {
        "dp": F.coalesce(_last_at(F.col("_entries"), PRINCIPAL), "_python.dp"),
        "dr": F.coalesce(_last_at(F.col("_entries"), RELATED), "_python.dr"),
        "das": F.coalesce(
            F.transform(associated, lambda e: e.code),
            "_python.das",
            F.array().cast("array<string>"),
        ),
    }
    return with_columns_once(prepared, parsed).select(
        *[c for c in df.columns if c not in parsed], *parsed
    )
