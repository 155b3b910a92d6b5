"""Prefix trie, part codes and secret scan on small rows, against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from notecode.llm import part_codes, prefix_trie, secret_scan

TURNS = "conv_id bigint, turn bigint, role string, text string"
VECTORS = "vec_id bigint, embedding array<float>, label int"
TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sorted_rows(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def trie_expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [turn[-1] for turn in sorted(turns)] for c, turns in own.items()}
    whole, members, children = {}, {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, found = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.append((min(m), len(p), parent, len(m), len(children.get(p, [])), leaves[p], saved[p], digest))
    return sorted(found, key=str)


def random_turns(seed, n):
    draw = random.Random(seed)
    rows = [
        (c, draw.choice([None, *range(9)]), draw.choice(["u", "a", None]), draw.choice(["", None, "xy", "é☃"]))
        for c in draw.sample(range(3 * n), n)
        for _ in range(draw.randint(1, 9))
    ]
    return rows + [(200, k, "u", "long") for k in range(37)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(7, 0, "u", "a")],  # its base is absent, so it may lose all turns
        [(None, 0, "u", "a"), (100, None, None, None), (101, 1, None, "x"), (101, 1, None, "x")],
        [(c, t, "u", "same") for c in range(40) for t in range(7)],
        random_turns(1, 150),
    ],
    ids=["empty", "lone", "nulls", "equal", "random"],
)
def test_trie_equals_plain_python(spark, monkeypatch, rows):
    monkeypatch.setattr(prefix_trie, "IDS_PER_STRETCH", 16)
    monkeypatch.setattr(prefix_trie, "TURNS_PER_STRETCH", 8)
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", place int, key string")
    assert sorted_rows(prefix_trie.prefix_trie(given), TRIE) == trie_expected(rows)


def codes_expected(rows):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    whole = [[math.floor(256 * x) for x in r[1]] for r in kept]
    points = np.array(whole, np.int64).reshape(len(kept), 16, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:64]
    books = points[first].swapaxes(0, 1).copy()

    def squares(p):
        return ((points[:, p][:, None] - books[p][None]) ** 2).sum(2)

    for _ in range(2):
        for p in range(16):
            entry = squares(p).argmin(1)
            for e in set(entry):
                books[p, e] = points[entry == e, p].sum(0) // (entry == e).sum()
    codes = np.stack([squares(p).argmin(1) for p in range(16)], 1).astype(np.uint8)
    errors = sum(squares(p).min(1) for p in range(16)).tolist()
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = [(r[0], c.tobytes().hex(), e, by_label[r[2]], digest) for r, c, e in zip(kept, codes, errors)]
    return sorted(found, key=str)


def random_vectors():
    draw = random.Random(2)

    def component(coarse):
        return float(np.float32(draw.gauss(0, 1) if not coarse else draw.randint(-2, 2) / 2))

    rows = [
        (draw.randrange(500) if k % 40 else None, [component(k % 3) for _ in range(32)], draw.choice([None, 1, 2]))
        for k in range(400)
    ]
    return rows + [rows[5]] * 60


BROKEN = [
    (1, None, 1),
    (2, [None] * 32, 1),
    (3, [float("nan")] * 32, 1),
    (4, [float("-inf")] + [0.0] * 31, 1),
    (5, [], 1),
]


@pytest.mark.parametrize(
    "rows",
    [[], BROKEN, random_vectors()[:3] + BROKEN, [random_vectors()[0]] * 90, random_vectors() + BROKEN],
    ids=["empty", "broken", "few", "equal", "random"],
)
def test_codes_equal_plain_python(spark, monkeypatch, rows):
    monkeypatch.setattr(part_codes, "BLOCK_ROWS", 100)
    given = spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS + ", code int, v string")
    assert sorted_rows(part_codes.codes(given)) == codes_expected(rows)


def test_codes_refuse_odd_lengths(spark):
    given = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], VECTORS)
    with pytest.raises(ValueError, match="16 to 32 components"):
        part_codes.codes(given)


def test_balls_hold_their_points_and_prune():
    draw = np.random.default_rng(4)
    centres = draw.integers(-4000, 4000, (20, 4))
    points = (centres[draw.integers(0, 20, 1500)] + draw.integers(-30, 30, (1500, 4))).astype(np.int64)
    tree = part_codes.grown(points)
    assert sorted(tree.order) == list(range(1500))
    for i in range(len(tree.first)):
        assert (points[tree.order[tree.first[i] : tree.last[i]]].sum(0) == tree.sums[i]).all()
    again, size = part_codes.Tree.unpacked(tree.packed())
    assert size == len(tree.packed()) and (again.order == tree.order).all()
    owned = list(part_codes.owners(tree, points, centres.astype(np.int64)))
    whole = sum(len(numbers) for ball, numbers, _ in owned if ball >= 0)
    assert whole > 1000  # most points are never compared one by one
    nearest = np.zeros(1500, int)
    for _, numbers, entry in owned:
        nearest[numbers] = entry
    assert (nearest == ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()


def base_expected(text):
    """Base spans by trying every start, without the operator's patterns."""
    text, found = text or "", []
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")

    def run(at, allowed, most=None):
        end = at
        while end < len(text) and re.match(allowed, text[end]) and (most is None or end - at < most):
            end += 1
        return end

    at = 0
    while at < len(text):
        name = next((n for n in names if low.startswith(n, at)), None)
        if name:
            for quote in (1, 0):
                end = run(at + len(name), "[\"']", quote)
                end = run(end, "\x20")
                if end < len(text) and text[end] in ":=":
                    start = run(run(end + 1, "\x20"), "[\"']", 1)
                    end = run(start, "[A-Za-z0-9+/_.=-]")
                    if end > start:
                        if end - start >= 12:
                            found.append((at, 0, end))
                        at = end - 1
                        break
        at += 1
    for kind, start, allowed, least in ((1, "AKIA", "[A-Z0-9]", 18), (2, "", "[0-9a-f]", 16)):
        at = 0
        while at < len(text):
            end = run(at, allowed) if text.startswith(start, at) else at
            if end - at >= least and end > at + len(start):
                found.append((at, kind, end))
            at = max(end, at + 1)
    return found


def noise(seed):
    draw = random.Random(seed)
    parts = [
        "password", "PassWD", "secret", "toKen", "api_key", "APIkey", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "==",
        "AKIA", "AKIAAKIA", "Z0Z0Z0Z0Z0Z0Z0Z0", "deadbeef01234567", "abc", "-_./+", "é", "☃", "\n", "x1y2z3x1y2z3",
    ]
    return "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))


def test_base_spans_equal_plain_python(spark):
    texts = [None, "", *[noise(k) for k in range(400)], "token = " + "a" * 100_000, "f" * 100_000]
    texts += texts[:3]
    given = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, spans int")
    for row in secret_scan.digests(given).collect():
        expected = sorted(base_expected(texts[row.doc_id]))
        named = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in expected)
        assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest(), texts[row.doc_id]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == kind for _, k, _ in expected) for kind in range(3)]
        kept = [s for s in row.spans.split(",") if s and not s.startswith("literal")]
        assert ",".join(kept) == named


@pytest.mark.parametrize(
    "text, literals",
    [
        ('db_password = "hunter2Zq!"', ["hunter2Zq!"]),
        ('x = "s3cr3tV4lue!x"\npassword = x', ["s3cr3tV4lue!x"]),
        ('a = b\nb = a\ntoken = a\na = "Kj8#mN2p!q"', ["Kj8#mN2p!q"]),
        ('first = "Ab3#defGh1"\nPASSPHRASE = first + "9xYz!kL0q"', ["Ab3#defGh1", "9xYz!kL0q"]),
        ("postgres://bob:pa55w0rdXy@host/db", ["pa55w0rdXy"]),
        ("<password>Zx81!kkLm</password>", ["Zx81!kkLm"]),
        ("mysql --password=Qw34rty!uio -h x", ["Qw34rty!uio"]),
        ('set_password("Tr0ub4dor&3")', ["Tr0ub4dor&3"]),
        ('config["db_pwd"] = "Kj8#mN2p!"', ["Kj8#mN2p!"]),
        ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", ["wJalrXUtnFEMI/K7MDENG"]),
        ('password_file = "/etc/Foo1bar"', []),  # says where it is, not what it is
        ('x = "s3cr3tV4lue!x"\ny = x', []),  # no sensitive name
        ("the password: please ask someone", []),
        ("secret: ${DB_SECRET}", []),
        ("token: changeme-please", []),
        ('clientSecret = "dGhpc2lzYXNlY3JldA"', []),  # inside a base span
    ],
)
def test_literals_by_the_names_they_reach(text, literals):
    base = secret_scan.base_spans(text)
    assert [text[s:e] for s, e, _ in secret_scan.literal_spans(text, base)] == literals


def test_spans_are_rows_too(spark):
    texts = [None, "x", 'k = "s3cr3tV4lue!x"\npassword = k deadbeefdeadbeef', ""]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = secret_scan.secrets(given).orderBy("start").collect()
    assert [(r.doc_id, r.kind, r.start) for r in rows] == [(2, "literal", 5), (2, "hex", 33)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert secret_scan.secrets(empty).count() == secret_scan.digests(empty).count() == 0


def test_long_texts_take_time_in_proportion():
    for text in ('password = "x" ' * 30_000, "([" * 100_000, "a+b+" * 100_000 + "key", "http://a:" * 50_000):
        assert secret_scan.found_in(text)["n_access"] == 0
