"""Language identification of spans in mixed-language text.

Training: letter trigrams inside words are counted per language, over all training documents, in a
hashed table of fixed size; so are the scripts of the letters. Prediction: a word's script narrows the
languages it can have, its trigrams score them, and a Viterbi pass with a penalty for each switch
labels the words of a text. A text gets the language with most letters; its score is their share times
how sure the trigrams of those words are.

The model has (languages x `BUCKETS`) numbers and at most `MOST_LANGUAGES` languages, so its size is
bounded whatever the input is; more languages are an error.

Defined results: a text that is NULL or has no letter is `und` with score 0; letters of a script that
no language was seen with fit all languages alike; with no training document every text is `und`; equal
rows give equal rows; rows with a NULL lang are not trained on; empty input gives no rows.
"""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.llm.batches import short_batches, trimmed
from notecode.llm.words import blocks, mixed
from notecode.sources.shared_folder import stored

UNKNOWN = "und"
BUCKETS = 1 << 15
MOST_LANGUAGES = 64
SWITCH_PENALTY = 12.0
OUT_OF_SCRIPT = 30.0
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
BLOCK_CHARS = 500_000
SEGMENT = 64  # words that one step of the Viterbi pass handles side by side

# Code point ranges of scripts, (name, first, last).
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ("other",)


def held_out(doc_id: Column) -> Column:
    """The documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter (or a mark on one), and its script."""
    size = 0x110000
    kind = np.zeros(size, bool)
    for c in [*range(0x30000), *range(0xE0100, 0xE01F0)]:
        kind[c] = unicodedata.category(chr(c))[0] in "LM"
    script = np.full(size, len(SCRIPT_NAMES) - 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return kind, script


def _lower(text: str) -> str:
    """The text in lower case, unless that moves its code points."""
    low = text.lower()
    return low if len(low) == len(text) else text


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in a row: their code points, which of them are letters, and each letter's trigram.

    A blank stands before each text and after the last one.
    """
    joined = " " + " ".join(map(_lower, texts)) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[0][points]
    plain = np.where(is_letter, points, 32).astype(np.uint64)
    places = np.flatnonzero(is_letter)
    key = (plain[places - 1] << np.uint64(42)) | (plain[places] << np.uint64(21)) | plain[places + 1]
    bucket = (mixed(key) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return points, is_letter, places, bucket


def count_trigrams(documents: DataFrame) -> DataFrame:
    """(`lang`, `bucket`, `n`) over all rows with text and lang; scripts have negative buckets.

    Each task adds up its counts before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        shift = len(SCRIPT_NAMES)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            order = sorted(range(len(texts)), key=langs.__getitem__)
            for a, b in blocks([len(texts[i]) for i in order], BLOCK_CHARS):
                part = order[a:b]
                for lang in dict.fromkeys(langs[i] for i in part):
                    points, _, places, bucket = _coded([texts[i] for i in part if langs[i] == lang])
                    scripts = _letters()[1][points[places]].astype(np.int64)
                    n = np.bincount(np.concatenate([bucket + shift, scripts]), minlength=BUCKETS + shift)
                    counts[lang] = counts.get(lang, 0) + n
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(some), pa.string()),
                    "bucket": pa.array(some - shift, pa.int64()),
                    "n": pa.array(n[some], pa.int64()),
                }
            )

    rows = documents.select("text", F.col("lang").cast("string").alias("lang")).dropna()
    return (
        rows.mapInArrow(trimmed(run), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )


class Model:
    """Scores per trigram bucket and the scripts of each language."""

    def __init__(self, langs: list[str], buckets: list[int], counts: list[int]):
        self.langs = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(self.langs)}
        rows = np.array([place[lang] for lang in langs], np.int64)
        table = np.zeros((len(self.langs), len(SCRIPT_NAMES) + BUCKETS))
        table[rows, np.array(buckets, np.int64) + len(SCRIPT_NAMES)] = counts
        scripts, n = table[:, : len(SCRIPT_NAMES)], table[:, len(SCRIPT_NAMES) :]
        chance = np.log(n + SMOOTHING) - np.log(n.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        self.scores = np.ascontiguousarray(chance.T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed = share >= SCRIPT_SHARE
        allowed[:, ~allowed.any(0)] = True
        self.cost = np.where(allowed.T, 0, -OUT_OF_SCRIPT).astype(np.float32)


def learn(documents: DataFrame) -> Model:
    short_batches(documents.sparkSession)
    counts = stored(count_trigrams(documents), "trigrams")
    n = counts.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages to learn, the model has room for {MOST_LANGUAGES}")
    table = counts.select("lang", "bucket", "n").toArrow()
    return Model(*(table.column(c).to_pylist() for c in ("lang", "bucket", "n")))


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word, for texts whose words lie between the bounds.

    Texts are cut into segments of `SEGMENT` words. A segment is first solved for each state it may be
    entered from, then the segments of a text are chained, then each is traced back; so the number of
    steps depends on the segments of the longest text, not on its words.
    """
    k = scores.shape[1]
    sizes = np.diff(bounds)
    per_text = -(-sizes // SEGMENT)
    text_of = np.repeat(np.arange(len(sizes)), per_text)
    first_segment = np.cumsum(per_text) - per_text
    number = np.arange(len(text_of)) - first_segment[text_of]
    begin = bounds[text_of] + number * SEGMENT
    size = np.minimum(bounds[text_of + 1] - begin, SEGMENT)
    place = begin[:, None] + np.arange(SEGMENT)
    inside = np.arange(SEGMENT) < size[:, None]
    emit = np.where(inside[..., None], scores[np.minimum(place, max(len(scores) - 1, 0))], 0).astype(np.float64)

    def step(best: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = best.argmax(-1)
        moved = np.take_along_axis(best, top[..., None], -1) - penalty
        stays = best >= moved
        return np.where(stays, best, moved), top, stays

    through = np.where(np.eye(k, dtype=bool), 0.0, -1e30)[None].repeat(len(text_of), 0)
    for t in range(SEGMENT):
        through = step(through, t)[0] + emit[:, t, None, :]

    # Chain: what each text's states are worth on entering its segments.
    entry = np.zeros((len(text_of), k))
    longest = int(per_text.max(initial=0))
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(longest + 1))
    for s in range(1, longest):
        now = order[cuts[s] : cuts[s + 1]]
        entry[now] = (entry[now - 1][:, :, None] + through[now - 1]).max(1)

    # Forwards once more from the known entries, keeping where each state comes from.
    best = entry
    tops, kept = np.empty((SEGMENT, len(text_of)), np.int16), np.empty((SEGMENT, len(text_of), k), bool)
    for t in range(SEGMENT):
        best, tops[t], kept[t] = step(best, t)
        best = best + emit[:, t]
    # Backwards: for each possible last state the state on entry, then the chain of real last states.
    state = np.arange(k)[None].repeat(len(text_of), 0)
    for t in range(SEGMENT - 1, -1, -1):
        state = np.where(np.take_along_axis(kept[t], state, 1), state, tops[t][:, None])
    final = best.argmax(1)
    for s in range(longest - 1, 0, -1):
        now = order[cuts[s] : cuts[s + 1]]
        final[now - 1] = state[now, final[now]]
    labels = np.empty((len(text_of), SEGMENT), np.int64)
    state = final
    row = np.arange(len(text_of))
    for t in range(SEGMENT - 1, -1, -1):
        labels[:, t] = state
        state = np.where(kept[t][row, state], state, tops[t])
    found = np.empty(len(scores), np.int64)
    found[place[inside]] = labels[inside]
    return found


def label_texts(model: Model, texts: list[str], penalty: float = SWITCH_PENALTY) -> list[tuple]:
    """(language, score, spans) of each text; spans are (start, end, language), blanks between words included."""
    if not model.langs:
        return [(UNKNOWN, 0.0, []) for _ in texts]
    points, is_letter, places, bucket = _coded(texts)
    edges = np.flatnonzero(np.diff(is_letter.astype(np.int8)))
    starts, ends = edges[0::2] + 1, edges[1::2] + 1
    lengths = (ends - starts).astype(np.float64)
    k = len(model.langs)
    if len(starts):
        first = np.searchsorted(places, starts)
        scores = np.add.reduceat(model.scores[bucket], first, axis=0)
        scores += model.cost[_letters()[1][points[starts]]]
    else:
        scores = np.zeros((0, k), np.float32)
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    labels = viterbi(scores, bounds, penalty)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    letters = np.bincount(text_of * k + labels, lengths, len(texts) * k).reshape(-1, k)
    winner = letters.argmax(1)
    share = letters[np.arange(len(texts)), winner] / np.maximum(letters.sum(1), 1)
    mine = labels == winner[text_of]
    # How sure the words of the winner are: their evidence against the next best language.
    sums = np.zeros((len(texts), k))
    for j in range(k):
        sums[:, j] = np.bincount(text_of[mine], scores[mine, j], len(texts))
    ahead = np.partition(sums, -2, axis=1)[:, -2] if k > 1 else sums[:, 0] - 50
    gap = np.clip(sums[np.arange(len(texts)), winner] - ahead, -50, 50)
    score = share / (1 + np.exp(-gap))
    change = np.flatnonzero(np.diff(np.concatenate([[-1], text_of * k + labels, [-1]])))
    out = [(UNKNOWN, 0.0, []) if a == b else (model.langs[winner[i]], float(score[i]), []) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    offset = np.concatenate([[0], text_ends]) + 1
    for a, b in zip(change, change[1:]):
        i = text_of[a]
        out[i][2].append((int(starts[a] - offset[i]), int(ends[b - 1] - offset[i]), model.langs[labels[a]]))
    return out


def label(documents: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """`documents` with `lang_pred`, `score` and, if asked for, `spans` of (start, end, lang).

    The model, of bounded size, goes to the executors as a broadcast variable; only the text goes to
    Python and comes back as labels.
    """
    short_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    spans = ", spans array<struct<start:int,end:int,lang:string>>" if with_spans else ""
    kinds = {"lang_pred": pa.string(), "score": pa.float64()}
    if with_spans:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        kinds["spans"] = pa.list_(span)

    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        most = max(BLOCK_CHARS * 16 // max(len(sent.value.langs), 4) ** 2, 10_000)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            found = []
            for a, b in blocks([len(t) for t in texts], most):
                for lang, score, places in label_texts(sent.value, texts[a:b]):
                    one = {"lang_pred": lang, "score": score}
                    if with_spans:
                        one["spans"] = [{"start": s, "end": e, "lang": x} for s, e, x in places]
                    found.append(one)
            yield pa.array(found, pa.struct(list(kinds.items())))

    @F.arrow_udf(f"lang_pred string, score double{spans}")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(labels)(batches)

    return documents.withColumn("_nc_label", run(F.col("text")))


def predictions(documents: DataFrame) -> DataFrame:
    """(`doc_id`, `held_out`, `lang_pred`, `score`, `n_spans`); learned from the rows not held out."""
    model = learn(documents.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = label(documents.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "_nc_label.lang_pred",
        "_nc_label.score",
        F.size("_nc_label.spans").alias("n_spans"),
    )
