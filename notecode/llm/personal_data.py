"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame operations only. Offsets count code points; ends are exclusive. The patterns take runs
possessively and look behind instead of trying again inside a run, and long texts are searched in
pieces that no match can cross, so that time is in proportion to the text. Access keys and assigned
secrets are kinds of their own.

Defined results: a NULL text is an empty one and has no spans; equal rows give equal spans; spans of
different kinds may overlap (masking merges them); empty input gives no rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.operators.once import with_columns_once

# What is at the beginning of the base kinds, in their order.
BASE_KINDS = ("email", "ip", "card", "phone")

THRESHOLD = 0.5
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3

_LOCAL = "A-Za-z0-9._%+-"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. Texts without `hint` are skipped."""

    name: str
    hint: str
    pattern: str
    score: float
    context: str


KINDS = (
    Kind(
        "email",
        "@",
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        "e-?mail|contact|write|adresse",
    ),
    Kind(
        "ip",
        ".",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6,
        r"\bip\b|address|server|host",
    ),
    Kind(
        "card",
        "",
        r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){15})[0-9](?:[\x20-]?[0-9])++",
        0.8,
        "card|visa|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        "+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.6,
        "phone|call|mobile|fax|tel",
    ),
    Kind(
        "iban",
        "",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        0.8,
        "iban|bank|account|konto|compte|cuenta",
    ),
    Kind(
        "ssn",
        "-",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        0.3,
        r"\bssn\b|social security",
    ),
    Kind(
        "key",
        "AKIA",
        r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{14,}+(?![a-z])",
        0.8,
        "key|access|aws",
    ),
    Kind(
        "secret",
        "",
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20{0,64}[:=]\x20{0,64}["']?[A-Za-z0-9+/_.=-]{12,}+""",
        0.6,
        "password|passwd|secret|token|key",
    ),
)

_SPANS = "array<struct<start:int,end:int,found:string>>"

PIECE_CHARS = 2048
# The characters that a match of any kind may hold. No match goes on past another one, nor from a small
# letter over a space to a small letter, so a text may be cut there.
_INSIDE = r"""A-Za-z0-9._%+@\x20()\-:="'/"""
_PIECE = rf"(?s).{{{PIECE_CHARS}}}.*?(?:(?<=[^{_INSIDE}])|(?<=[a-z]\x20)(?=[a-z]))|.+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the text of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))

    def weighed(digit: Column, place: Column) -> Column:
        doubled = digit * 2
        return F.when(place % 2 == 0, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.transform(each, weighed), F.lit(0), lambda s, d: s + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the text, first four characters moved to its end and letters as numbers, is 1 mod 97."""
    moved = F.concat(F.expr("''"), F.substring(iban, 5, 1000), F.substring(iban, 1, 4))
    value = lambda c: F.when(c <= "9", c.cast("int")).otherwise(F.ascii(c) - 55)

    def step(rest: Column, c: Column) -> Column:
        return (rest * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    """Whether what the pattern found is valid."""
    if kind == "ip":
        return found.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = _digits(found)
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(found, " ", ""))
    return F.lit(True)


def proposed(text: Column, pattern: str) -> Column:
    """All matches with their offsets, from the texts between them and the texts they hold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(
        gaps, found, lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m"), m.alias("t"))
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(so_far: Column, s: Column) -> Column:
        start = so_far["at"] + s["g"]
        span = F.struct(start.alias("start"), (start + s["m"]).alias("end"), s["t"].alias("found"))
        return F.struct((start + s["m"]).alias("at"), F.concat(so_far["spans"], F.array(span)).alias("spans"))

    return F.aggregate(steps, begin, step, lambda r: r["spans"])


def with_pieces(documents: DataFrame) -> DataFrame:
    """`documents` with `_nc_pieces`: (`at`, `before`, `text`, `after`) of each piece of the text.

    A piece ends where no pattern can match across, so a long text costs as much as short ones of the
    same total length. `before` and `after` are what the context of a span may need of its neighbours.
    """
    parts = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(_PIECE), F.lit(0))
    rows = with_columns_once(documents, {"_nc_parts": parts})
    sizes = F.transform("_nc_parts", lambda p: F.char_length(p))
    begin = F.array(F.lit(0))
    at = F.aggregate(sizes, begin, lambda so_far, n: F.concat(so_far, F.array(F.element_at(so_far, -1) + n)))
    rows = with_columns_once(rows, {"_nc_at": at})

    def piece(text: Column, i: Column) -> Column:
        near = F.lit(CONTEXT_CHARS)
        return F.struct(
            F.get("_nc_at", i).alias("at"),
            F.coalesce(F.right(F.get("_nc_parts", i - 1), near), F.lit("")).alias("before"),
            text.alias("text"),
            F.coalesce(F.left(F.get("_nc_parts", i + 1), near), F.lit("")).alias("after"),
        )

    return with_columns_once(rows, {"_nc_pieces": F.transform("_nc_parts", piece)}).drop("_nc_parts", "_nc_at")


def _spans(piece: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind in a piece with their scores, those below the threshold left out."""
    text = piece["text"]
    nothing = F.array().cast(_SPANS)
    has_match = text.rlike(kind.pattern)
    if kind.hint:
        has_match = text.contains(kind.hint) & has_match
    spans = F.when(has_match, proposed(text, kind.pattern)).otherwise(nothing)
    spans = F.filter(spans, lambda s: confirmed(kind.name, s["found"]))

    def scored(s: Column) -> Column:
        shift = F.char_length(piece["before"])
        first = F.greatest(s["start"] + shift - CONTEXT_CHARS, F.lit(0))
        around = F.concat(piece["before"], text, piece["after"])
        near = F.lower(around.substr(first + 1, s["end"] + shift - first + CONTEXT_CHARS))
        bonus = F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(kind.score) + bonus)
        return F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score")
        )

    return F.filter(F.transform(spans, scored), lambda s: s["score"] >= THRESHOLD)


def find_in_pieces(documents: DataFrame) -> DataFrame:
    """`documents` with `_nc_pieces` and, for each of them, the spans of every kind in `_nc_found`."""
    found = F.transform("_nc_pieces", lambda p: F.struct(*[_spans(p, k).alias(k.name) for k in KINDS]))
    return with_columns_once(with_pieces(documents), {"_nc_found": found})


def find_personal_data(documents: DataFrame) -> DataFrame:
    """`documents` with one array of (`kind`, `start`, `end`, `score`) per kind, named `_nc_<kind>`."""

    def moved(kind: str) -> Column:
        def shifted(found: Column, piece: Column) -> Column:
            return F.transform(
                found[kind],
                lambda s: F.struct(
                    s["kind"].alias("kind"), (s["start"] + piece["at"]).alias("start"),
                    (s["end"] + piece["at"]).alias("end"), s["score"].alias("score"),
                ),
            )

        return F.flatten(F.zip_with("_nc_found", "_nc_pieces", shifted))

    rows = with_columns_once(find_in_pieces(documents), {f"_nc_{k.name}": moved(k.name) for k in KINDS})
    return rows.drop("_nc_found", "_nc_pieces")


def _listed(kinds: list[str]) -> Column:
    spans = F.flatten(F.array(*[F.col(f"_nc_{k}") for k in kinds]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(documents: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans for every document."""
    found = find_personal_data(documents.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"_nc_{k}").cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(list(BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        _listed([k.name for k in KINDS]).alias("spans"),
    )


def mask(documents: DataFrame) -> DataFrame:
    """The documents with `[KIND]` in place of each span; `n_chars`, if there, follows the new text.

    Overlapping spans are masked as one, under the kind that begins first.
    """
    found = find_in_pieces(documents)

    def masked(found: Column, piece: Column) -> Column:
        text = piece["text"]
        spans = F.array_sort(
            F.transform(
                F.flatten(F.array(*[found[k.name] for k in KINDS])),
                lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        )
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(so_far: Column, s: Column) -> Column:
            new = s["start"] >= so_far["at"]
            clear = text.substr(so_far["at"] + 1, s["start"] - so_far["at"])
            parts = F.concat(so_far["parts"], F.array(clear, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
            return F.struct(
                F.greatest(so_far["at"], s["end"]).alias("at"),
                F.when(new, parts).otherwise(so_far["parts"]).alias("parts"),
            )

        def joined(end: Column) -> Column:
            rest = text.substr(end["at"] + 1, F.char_length(text))
            return F.array_join(F.concat(end["parts"], F.array(rest)), "")

        return F.aggregate(spans, begin, step, joined)

    any_span = F.exists("_nc_found", lambda f: F.greatest(*[F.size(f[k.name]) for k in KINDS]) > 0)
    rows = with_columns_once(found, {"_nc_any": any_span})
    text = F.array_join(F.zip_with("_nc_found", "_nc_pieces", masked), "")
    rows = rows.withColumn("_nc_masked", F.when(F.col("_nc_any"), text).otherwise(F.col("text")))
    new = {"text": F.col("_nc_masked")}
    if "n_chars" in documents.columns:
        counted = F.when(F.col("_nc_any"), F.char_length("_nc_masked")).otherwise(F.col("n_chars"))
        new["n_chars"] = counted.cast(documents.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns])
