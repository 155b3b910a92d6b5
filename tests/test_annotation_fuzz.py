"""Thousands of random annotation cells, valid and broken, against the Python reader."""

import random

from pyspark.sql import functions as F

from notecode.functions.annotations import _token_as_json, annotation_routes, fold_python_dict, parse_annotations

VALUES = [
    "1", "-1", "01", "1.", "-.5", "1e5", "None", "True", "null", "true", "NaN", "+1", "1_000", "0x1F", "'a' 'b'",
    "b'x'", "{}", "[]", "(1,)", "{1,2}", "[1,2,]", "[{'x': 1}]", "'é'", "\"it's\"", "'a\tb'", "'a\nb'", "'\\n'",
    "'\\u00e9'", "'\\/'", "'\\''", "INF", "'{\"position\": \"DP\"}'", "'''x'''", "/*c*/1", "1#c",
]
POSITIONS = ["'DP'", "\"DR\"", "'DAS'", "'XX'", "None", "1", "'D' 'P'", "['DP']", "'\\x44P'"]
KEYS = ["1", "None", "A", "'A' 'B'", "('a',1)", "true", "1.5", "b'A'", "''"]
ENDS = [" ", "\n", "x", "]", ", {}", ",", "}", " # c", ";", " {}"]


def quoted(rng, text):
    return rng.choice("'\"").join(["", text, ""]) if rng.random() < 0.5 else f"'{text}'"


def detail(rng):
    if rng.random() > 0.85:
        return rng.choice(VALUES)
    items = [f"{quoted(rng, 'position')}: {rng.choice(POSITIONS)}"]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        items.append(f"{rng.choice(['1', quoted(rng, 'desc'), quoted(rng, 'position')])}: {rng.choice(VALUES)}")
    rng.shuffle(items)
    return "{" + rng.choice([", ", ",", " , "]).join(items) + rng.choice(["", "", "", "", ","]) + "}"


def cell(rng):
    items = []
    for _ in range(rng.randint(0, 4)):
        key = rng.choice(KEYS) if rng.random() < 0.08 else quoted(rng, rng.choice(["I10", "J45", "A", "B"]))
        items.append(f"{key}: {detail(rng)}")
    text = "{" + ", ".join(items) + rng.choice([""] * 8 + [","]) + "}"
    change = rng.random()
    if change < 0.05:
        return rng.choice([" ", "\n", "\xa0", "x", "[", "(", "#"]) + text
    if change < 0.1:
        return text + rng.choice(ENDS)
    if change < 0.15:
        at = rng.randrange(len(text))
        return text[:at] + rng.choice("{}'\",:[]\\ ax0") + text[at + rng.randint(0, 1):]
    return text


def test_random_cells(spark):
    rng = random.Random(7)
    cells = [cell(rng) for _ in range(8000)]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    with_dp = 0
    for row in parse_annotations(df, "cell").collect():
        expected = fold_python_dict(cells[row.i])
        assert {"dp": row.dp, "dr": row.dr, "das": row.das} == expected, cells[row.i]
        with_dp += row.dp is not None
    assert with_dp > 800


def test_an_indented_cell_is_no_dict(spark):
    cells = ["\n\t{'A': {'position': 'DP'}}", "\n{'A': {'position': 'DP'}}", " {'A': {'position': 'DP'}}"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "n int, cell string")
    expected = {i: (fold_python_dict(c) or {}).get("dp") for i, c in enumerate(cells)}
    assert {r.n: r.dp for r in parse_annotations(rows, "cell").collect()} == expected


def test_python_notations_stay_in_the_jvm(spark):
    rng = random.Random(3)
    plain = ["None", "True", "False", "-1", "0.5", "1e5", "[]", "{}", "[1, 'a',]", "{'x': {'y': None,},}"]
    letters = ["a", "é", "😀", " ", "\t", '"', "'", "\\", "\n", "None", "true", "{", "}", "]", ",", ":", "#", "\\u0041"]

    def text():
        return repr("".join(rng.choice(letters) for _ in range(rng.randint(0, 6))))

    def one():
        items = []
        for _ in range(rng.randint(0, 5)):
            more = [f"{text()}: {rng.choice([*plain, text()])}" for _ in range(rng.randint(0, 2))]
            more.append("'position': " + rng.choice(["'DP'", "'DR'", "'DAS'", "None"]))
            rng.shuffle(more)
            items.append(f"{rng.choice(['\'A\'', '\'B\'', text()])}: {{{', '.join(more)}{rng.choice(['', ','])}}}")
        return "{" + ", ".join(items) + "}"

    cells = [one() for _ in range(3000)] + [None]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    for row in parse_annotations(df, "cell").collect():
        expected = fold_python_dict(cells[row.i]) or {"dp": None, "dr": None, "das": []}
        assert {"dp": row.dp, "dr": row.dr, "das": row.das} == expected, cells[row.i]
    routes = {r.route: r.n for r in annotation_routes(df, "cell").collect()}
    assert routes["missing"] == 1 and routes["tokens"] > 1500
    # Two equal details of one code are all that is left.
    assert routes.get("python", 0) < 150


def test_commas_quotes_and_repeats(spark):
    cells = [
        "{,}", "{'A': [,]}", "{'A': {'position': 'DP'},,}", "{'A': {'position': 'DP'}},", "''", "'''", "{'A", "\\",
        "{'A': {'position': 'DP'}, 'B': {'position': 'DAS'}, 'A': {'position': 'DAS'}, 'B': {'position': 'DP'}}",
        "{" + "'A': {'position': 'DAS'}, 'B': {'position': 'DAS'}, " * 5000 + "}",
        "{'" + "x\\'" * 20000 + "': {'position': 'DP'}}",
    ]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    for row in parse_annotations(df, "cell").collect():
        assert {"dp": row.dp, "dr": row.dr, "das": row.das} == fold_python_dict(cells[row.i]), cells[row.i][:80]
    assert {r.route for r in annotation_routes(df.filter("i >= 8"), "cell").collect()} <= {"json", "tokens"}


def test_tokens_that_json_reads_stay_as_they_are(spark):
    tokens = ["'a b'", '"it\'s"', "'it\\'s'", "'say \"x\"'", "'a\tb'", ": None, ", ": 1, "]
    written = ["'a b'", '"it\'s"', '"it\'s"', '"say \\"x\\""', '"a\\tb"', ": null, ", ": 1, "]
    df = spark.createDataFrame([(tokens,)], "tokens array<string>")
    assert df.select(F.transform("tokens", _token_as_json)).first()[0] == written
