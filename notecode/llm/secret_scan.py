"""Secrets: an assignment-aware lexer pairs names with literals, constants are propagated, and every
literal is scored by the sensitive names that it reaches.

The base kinds are found by their patterns alone. Besides, each text is read as source code or
configuration would be: `name = literal`, `name: literal`, `name := literal`, `name => literal`, keys
and literals in quotes or bare, `obj.name`, `map["name"]`, `--name literal`, `<name>literal</name>`,
`call_name("literal")` and `scheme://user:password@host`. A right side that is a sum of literals and
names is followed term by term; a name stands for the literals that it was assigned anywhere in the
text, directly or through other names. A literal's score is the weight of the most sensitive name that
it reaches, made smaller with every step in between, times how much the literal itself looks like a
secret; one of at least `THRESHOLD` outside the base spans is a span of kind `literal`.

Each text is read once, from left to right; all patterns take runs that cannot be entered twice, so
time is in proportion to the text. There is no shuffle.

Defined results: a NULL text is an empty one and has no spans; equal rows give equal spans; spans that
begin together go in the order of the kinds; names that are assigned to each other in a circle reach
the same literals; empty input gives no rows; other columns are not read.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from notecode.llm.batches import short_batches

# The base kinds in their order, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

KINDS = (*BASE_KINDS, "literal")
THRESHOLD = 0.5
STEP = 0.9  # what each name between a literal and a sensitive name leaves of the weight
MOST_TERMS = 16  # terms of one right side that are followed

# Parts of names and how much they tell.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "secretkey": 1.0,
    "signingkey": 1.0, "encryptionkey": 1.0, "bearer": 0.8,
}
BEFORE_KEY = {"api", "private", "access", "auth", "secret", "signing", "encryption", "master", "account"}
# Last parts after which a name holds something about a secret, not the secret.
HARMLESS_END = {
    "file", "path", "url", "uri", "name", "id", "type", "length", "len", "size", "count", "hint", "field", "label",
    "policy", "expiry", "expires", "ttl", "prefix", "env", "var", "header", "param", "limit", "limits", "index",
}
PLACEHOLDER = re.compile(
    r"(?i)\A(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|your.*|.*example.*|change.?me.*|.*placeholder.*|dummy.*"
    r"|test|none|null|nil|true|false|undefined|redacted|required|optional|default|string|todo)\Z",
    re.S,
)

SENSITIVE_HINT = re.compile(r"pass|pwd|secret|token|key|credential|bearer|://", re.I | re.A)
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

_NAME = r"[A-Za-z_][A-Za-z0-9_-]*+(?:\.[A-Za-z_][A-Za-z0-9_-]*+)*+"
_QUOTED = r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'"""
TOKEN = re.compile(
    rf"""
    (?P<url>[a-z][a-z0-9+.-]{{1,20}}://[^\s:@/"']{{1,256}}+:(?P<userinfo>[^\s@/"']{{1,256}}+)@)
  | <(?P<tag>{_NAME})>(?P<inner>[^<>\n]{{1,4096}}+)</(?P=tag)>
  | (?P<quoted>{_QUOTED})
  | --(?P<option>[A-Za-z][A-Za-z0-9-]*+)(?:=|\x20++)(?P<argument>[^\s"'-][^\s"']*+)
  | (?P<name>{_NAME})
  | (?P<value>[0-9][A-Za-z0-9+/_.=-]*+)
  | (?P<assign>:=|=>|={{1,3}}|:)
  | (?P<open>[(\[])
  | (?P<close>[)\]])
  | (?P<plus>\+)
  | (?P<end>[\n;,{{}}])
    """,
    re.X | re.A,
)
BARE = re.compile(r"[^\s\"';,()\[\]{}<>]++")


def weight(name: str) -> float:
    """How sensitive a target of this name is, from 0 to 1."""
    last = name.rpartition(".")[2]
    parts = [p.lower() for p in NAME_PARTS.findall(last)]
    if not parts or parts[-1] in HARMLESS_END:
        return 0.0
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    keyed = [1.0 for a, b in zip(parts, parts[1:]) if b == "key" and a in BEFORE_KEY]
    return max([SENSITIVE.get(p, 0.0) for p in (*parts, *pairs)] + keyed)


def strength(literal: str) -> float:
    """How much a literal looks like a secret, from 0 to 1: by length, kinds of characters, variety."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    classes = sum(any(map(test, literal)) for test in (str.islower, str.isupper, str.isdigit)) + (not literal.isalnum())
    variety = min(1.0, len(set(literal)) / min(len(literal), 10))
    length = min(1.0, 0.5 + (len(literal) - 6) / 12)
    return variety * length * (0.3, 0.4, 0.9, 1.0, 1.0)[classes]


@dataclass
class Reached:
    """What the lexer knows of a name: its literals and the names whose values it takes."""

    literals: list[tuple[int, int]] = field(default_factory=list)
    sources: set[str] = field(default_factory=set)


def pairs(text: str) -> dict[str, Reached]:
    """The name-literal and name-name pairs of a text."""
    found: dict[str, Reached] = {}
    name = spoken = None  # the last possible target, and the one whose right side is being read
    last, terms, called, at = "", 0, [], 0
    while token := TOKEN.search(text, at):
        at, kind = token.end(), token.lastgroup
        if kind in ("url", "userinfo"):
            found.setdefault("url.password", Reached()).literals.append(token.span("userinfo"))
        elif token["tag"]:
            found.setdefault(token["tag"], Reached()).literals.append(token.span("inner"))
        elif token["option"]:
            found.setdefault(token["option"], Reached()).literals.append(token.span("argument"))
        elif kind in ("quoted", "name", "value"):
            start, end = token.span()
            inner = (start + 1, end - 1) if kind == "quoted" else (start, end)
            fresh = last in ("assign", "plus") and spoken is not None
            if fresh and terms < MOST_TERMS:
                if kind != "quoted":
                    # Without quotes a literal may hold signs that names do not.
                    end = BARE.match(text, start).end()
                    inner, at = (start, end), end
                target = found.setdefault(spoken, Reached())
                if kind == "name" and text[start:end] == token.group():
                    target.sources.add(token.group())
                target.literals.append(inner)
                terms += 1
            elif last == "open" and called and called[-1] and kind == "quoted":
                found.setdefault(called[-1], Reached()).literals.append(inner)
            written = text[inner[0] : inner[1]]
            name = written if kind == "name" or re.fullmatch(_NAME, written) else None
        elif kind == "assign":
            spoken, terms = name, 0
        elif kind == "open":
            called.append(name if last == "name" and token.group() == "(" else None)
        elif kind == "close":
            # `map["name"] = literal` assigns to the name between the brackets.
            if called:
                called.pop()
        elif kind == "end":
            name = spoken = None
            called.clear()
        last = kind
    return found


def reached(found: dict[str, Reached]) -> dict[tuple[int, int], float]:
    """The greatest weight with which each literal reaches a sensitive name."""
    best: dict[str, float] = {}
    todo = [(weight(n), n) for n in found]
    while todo:  # from the most sensitive names to those they take their values from
        w, name = todo.pop()
        if w <= best.get(name, 0.0):
            continue
        best[name] = w
        todo += [(w * STEP, source) for source in found[name].sources if source in found]
    spans: dict[tuple[int, int], float] = {}
    for name, w in best.items():
        for span in found[name].literals:
            spans[span] = max(w, spans.get(span, 0.0))
    return spans


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each base kind, from left to right."""
    assigned = [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGNED]
    return [assigned, [m.span() for m in ACCESS.finditer(text)], [m.span() for m in HEX.finditer(text)]]


def literal_spans(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals beside the base spans."""
    if not SENSITIVE_HINT.search(text):
        return []
    taken = sorted(span for spans in base for span in spans)
    scored = []
    for (start, end), w in sorted(reached(pairs(text)).items()):
        score = w * strength(text[start:end])
        if score >= THRESHOLD:
            scored.append((start, end, score))
    free, k, held = [], 0, 0
    for start, end, score in scored:  # left out where they overlap a base span
        while k < len(taken) and taken[k][0] < end:
            held = max(held, taken[k][1])
            k += 1
        if held <= start:
            free.append((start, end, score))
    return free


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def found_in(text: str) -> dict:
    """The digest columns of a text."""
    base = base_spans(text)
    spans = [(start, kind, end) for kind, some in enumerate(base) for start, end in some]
    more = [(start, len(BASE_KINDS), end) for start, end, _ in literal_spans(text, base)]
    return {
        **{f"n_{name}": len(some) for name, some in zip(BASE_KINDS, base)},
        "base_sha256": sha256(listed(spans).encode()).hexdigest(),
        "spans": listed(spans + more),
    }


def secrets(documents: DataFrame) -> DataFrame:
    """(`doc_id`, `kind`, `start`, `end`, `score`) of every span; base spans score 1."""
    short_batches(documents.sparkSession)
    doc_id = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                base = base_spans(text)
                rows += [(at, KINDS[kind], s, e, 1.0) for kind, some in enumerate(base) for s, e in some]
                rows += [(at, KINDS[-1], *span) for span in literal_spans(text, base)]
            places, *columns = zip(*rows) if rows else ((), (), (), (), ())
            ids = batch.column("doc_id").take(pa.array(places, pa.int64()))
            kinds, starts, ends, scores = columns
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(scores, pa.float64())],
                ["doc_id", "kind", "start", "end", "score"],
            )

    schema = f"doc_id {doc_id}, kind string, start int, end int, score double"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def digests(documents: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans for every document."""
    short_batches(documents.sparkSession)
    doc_id = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: a batch of long texts is not copied as a whole.
            rows = [found_in(text.as_py() or "") for text in batch.column("text")]
            out = {"doc_id": batch.column("doc_id")}
            for name in (f"n_{kind}" for kind in BASE_KINDS):
                out[name] = pa.array([r[name] for r in rows], pa.int64())
            for name in ("base_sha256", "spans"):
                out[name] = pa.array([r[name] for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    counts = ", ".join(f"n_{kind} bigint" for kind in BASE_KINDS)
    schema = f"doc_id {doc_id}, {counts}, base_sha256 string, spans string"
    return documents.select("doc_id", "text").mapInArrow(run, schema)
