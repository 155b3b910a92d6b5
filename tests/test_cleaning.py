import pytest
from pyspark.sql import functions as F

from notecode.functions.annotations import fold_python_dict, parse_annotations
from notecode.functions.text import (
    blank_to_null,
    first_word,
    lenient_double,
    strip_blanks,
    truncate_code,
    word_count,
)
from notecode.operators import cleaning

CELLS = {
    "{'I10': {'position': 'DP'}, 'J45': {'position': 'DAS'}}": ("I10", None, ["J45"]),
    "{'I10': {'position': 'DP'}, 'Z51': {'position': 'DR'}}": ("I10", "Z51", []),
    "{'Z51': {'position': 'DR'}}": (None, "Z51", []),
    "{'A': {'position': 'DP'}, 'B': {'position': 'DP'}}": ("B", None, []),
    "{'A': {'position': 'DP'}, 'A': {'position': 'DAS'}}": (None, None, ["A"]),
    "{'A': {'position': 'DP'}, 'B': {'position': 'DP'}, 'A': {'position': 'DP'}}": ("B", None, []),
    "{'A': 'text', 'B': {'position': 'DP'}}": ("B", None, []),
    "{'A': {'position': 'DP', 'desc': None}}": ("A", None, []),
    "{'A': {'position': 'DP', 'desc': \"l'asthme\"}}": ("A", None, []),
    '{"A": {"position": "DP", "seen": True}}': ("A", None, []),
    "{'A': {'position': 'XX'}}": (None, None, []),
    "{'A': {'position': 1}}": (None, None, []),
    "{'A': {'position': 'DP'}} trailing": (None, None, []),
    "{'A': {'position': 'DP'}}, {'B': {'position': 'DP'}}": (None, None, []),
    "{'A': {'position': 'DP', 'x': null}}": (None, None, []),
    "{'A': {'position': 'DP', 'x': NaN}}": (None, None, []),
    "{'A': {'position': 'DP', 'x': 'a null word'}}": ("A", None, []),
    "{'A': {'position': 'DP', 'x': 'tab\\t'}}": ("A", None, []),
    "{'A': '{\"position\": \"DP\"}'}": (None, None, []),
    "{'A': {'position': 'DP'},}": ("A", None, []),
    "{'A': {'position': 'DP', 'l': [1,(2,3)]}}": ("A", None, []),
    "{'A': {'position': 'DP', 'position': 'DAS'}}": (None, None, ["A"]),
    "{1: {'position': 'DP'}}": (None, None, []),
    "{'A': {'position': 'DP'}, 1: {'position': 'DR'}}": (None, None, []),
    "{'A': {'position': 'DP'}, None: {'position': 'DR'}}": ("A", None, []),
    "{[1]: 2}": (None, None, []),
    "{'A': {'position': 'DP'}}]": (None, None, []),
    "{'A': {'position': 'DP'}} ], [{}": (None, None, []),
    "{'A': {'position': 'DP', 'l': [{'x': 1}]}}": ("A", None, []),
    "['A']": (None, None, []),
    "{}": (None, None, []),
    "not a dict": (None, None, []),
    "": (None, None, []),
}


def test_parse_annotations(spark):
    cells = [*CELLS, None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    rows = parse_annotations(df, "cell").orderBy("i").collect()
    expected = [*CELLS.values(), (None, None, [])]
    assert [(r.dp, r.dr, r.das) for r in rows] == expected


@pytest.mark.parametrize("cell", CELLS)
def test_python_reader_gives_the_same(cell):
    found = fold_python_dict(cell)
    assert (found["dp"], found["dr"], found["das"]) == CELLS[cell]


def codes(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "code string")


def test_care_mode(spark):
    df = spark.createDataFrame(
        [(1, "I10", None), (2, "I10", "Z51"), (3, None, "Z51"), (4, None, None)],
        "note_id int, dp string, dr string",
    )
    rows = cleaning.apply_care_mode(df).orderBy("note_id").collect()
    assert [(r.dp, r.mdp) for r in rows] == [
        ("I10", "Z769"), ("Z51", "I10"), ("Z51", None), (None, "Z769"),
    ]


def test_clean_notes(spark):
    raw = spark.createDataFrame(
        [
            (1, "a", "{'I10': {'position': 'DP'}, 'J45': {'position': 'DAS'}, 'X': {'position': 'DAS'}}", "w"),
            (2, "b", "{'I10': {'position': 'DP'}, 'Z51': {'position': 'DR'}}", "w"),
            (3, "c", "{'Z51': {'position': 'DR'}}", "w"),
            (4, "d", "{'I10': {'position': 'DP'}}", None),
            (5, None, "{'I10': {'position': 'DP'}}", "w"),
            (6, "f", "{'X': {'position': 'DP'}}", "w"),
            (7, "g", "nothing", "w"),
            (8, "h", "{'': {'position': 'DP'}}", "w"),
        ],
        "note_id int, clinical_note string, annot_diagnostics_v2 string, ward string",
    )
    dp, das = codes(spark, "I10", "Z51", "Z769", ""), codes(spark, "I10", "J45")
    rows = cleaning.clean_notes(raw, dp, das).orderBy("note_id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "a", "I10", ["J45"], "Z769"),
        (2, "b", "Z51", [], "I10"),
    ]
    funnel = {r.stage: r.n for r in cleaning.cleaning_funnel(raw, dp).collect()}
    assert funnel == {"read": 8, "complete": 6, "with_dp": 4, "dp_valid": 3, "mdp_valid": 2}


def test_cleaning_computes_each_annotation_once(spark):
    raw = spark.createDataFrame([(1, "a", "{}", "w")], "note_id int, clinical_note string, annot_diagnostics_v2 string, ward string")
    cleaned = cleaning.clean_notes(raw, codes(spark, "I10"), codes(spark, "I10"))
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "AS _listed" not in plan  # the code table stays in the filter, no row carries it
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_array_codes(spark, broadcast_rows):
    notes = spark.createDataFrame(
        [(1, ["B", "X", "A", "B"]), (2, ["X"]), (3, []), (4, None)], "note_id int, das array<string>"
    )
    kept = cleaning.keep_valid_array_codes(
        notes, codes(spark, "A", "B", "B"), broadcast_rows=broadcast_rows
    )
    rows = {r.note_id: r.das for r in kept.collect()}
    assert rows == {1: ["B", "A", "B"], 2: [], 3: [], 4: None}


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_array_codes_of_repeated_and_missing_ids(spark, broadcast_rows):
    rows = [(1, ["A"]), (1, ["B", "X"]), (None, ["A"]), (None, ["X"]), (None, None)]
    notes = spark.createDataFrame(rows, "note_id int, das array<string>")
    kept = cleaning.keep_valid_array_codes(notes, codes(spark, "A", "B"), broadcast_rows=broadcast_rows)
    found = sorted((str(r.note_id), str(r.das)) for r in kept.collect())
    assert found == sorted([("1", "['A']"), ("1", "['B']"), ("None", "['A']"), ("None", "[]"), ("None", "None")])


def test_drop_denied(spark):
    notes = spark.createDataFrame([(1, "C09"), (2, "I10"), (3, None)], "note_id int, dp string")
    assert [r.note_id for r in cleaning.drop_denied(notes).collect()] == [2]
    assert [r.note_id for r in cleaning.drop_denied(notes, codes(spark, "I10")).collect()] == [1]


def test_text_functions(spark):
    def value(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).head()[0]

    assert value(strip_blanks, "\t\xa0 A00  \n") == "A00"
    assert [value(lenient_double, t) for t in ("0", " 1", "1.5e1", "abc", "1d", "", None)] == [
        0.0, 1.0, 15.0, None, None, None, None,
    ]
    assert [value(lambda c, g=g: truncate_code(c, g), "I100") for g in (3, -1, -9, 0, None)] == [
        "I10", "I10", "", "I100", "I100",
    ]
    assert [value(blank_to_null, t) for t in ("NA", "", "null", "x", " NA")] == [None, None, None, "x", " NA"]
    assert value(first_word, "  I10 J45") == "I10"
    assert value(first_word, "") is None
    assert value(word_count, " a  b\nc ") == 3
