"""A quality classifier by co-training of two views: a document's text and its metadata.

The text view sees words, word endings and repeated words; the metadata view sees source, lang and
length. Both are logistic regressions on hashed features. They are fitted on a bounded sample of the
labelled documents, drawn per class by a hash of the id. In each round both views score all unlabelled
documents on Spark; those that a view is surest of, by turns of source and lang, join the training rows
of the other view. On labelled documents that were kept aside per class, each view is calibrated to the
shares of the classes in all labels, and the two are weighed. The result scores every document by its
whole text.

Defined results: NULL texts, sources, langs and lengths are values like others; labels without
quality are not used, and of several labels of a document the lowest holds; without labelled
documents of both kinds every score is the share of good labels, 1 if there are none; equal rows give equal scores;
empty input gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notecode.llm.words import blocks, hashed_words, word_places
from notecode.sources.shared_folder import stored

LABELLED = 8_000  # labelled documents that are fitted or kept aside, half of them for each class
ROUNDS = 3
PER_ROUND = 400  # documents that a view labels in a round
SURE = 0.9
TEXT_BUCKETS = 1 << 13
ENDINGS = 1 << 10
META_BUCKETS = 512
KEEP = 0.5
BLOCK_BYTES = 2_000_000
SCALE = 20.0
STEPS = 150

_WIDTH = TEXT_BUCKETS + ENDINGS + 1
_FEATURES = "doc_id {}, text_at array<int>, text_x array<float>, meta_at array<int>, quality int"


def metadata(documents: DataFrame) -> Column:
    """The places of a document's metadata features."""
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("source", "lang"))
    length = F.coalesce(F.floor(F.log2(F.col("n_chars") + 1) * 2).cast("string"), F.lit("\0"))
    parts = [F.concat_ws("=", F.lit(n), c) for n, c in (("source", source), ("lang", lang), ("length", length))]
    parts.append(F.concat_ws("=", F.lit("both"), source, lang))
    return F.array(*[F.pmod(F.xxhash64(p), F.lit(META_BUCKETS)).cast("int") for p in parts])


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Three feature places per word (the last is -1 unless it repeats the word before), and bounds."""
    hashes, bounds = hashed_words(texts)
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    _, ends = word_places(joined)
    ending = joined[ends - 1].astype(np.int64) * 31 + joined[np.maximum(ends - 2, 0)]
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[:-1][bounds[:-1] < len(hashes)]] = False
    places = np.stack(
        [
            (hashes >> np.uint64(51)).astype(np.int64),
            TEXT_BUCKETS + ending % ENDINGS,
            np.where(again, TEXT_BUCKETS + ENDINGS, -1),
        ],
        1,
    )
    return places, bounds


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def features(rows: DataFrame) -> DataFrame:
    """Sparse features of (`doc_id`, `text`, `meta_at`, `quality`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _encoded(batch.column("text"))
            for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
                places, bounds = _tokens(texts[a:b])
                at, x = [], []
                for i in range(b - a):
                    own = places[bounds[i] : bounds[i + 1]]
                    n = np.bincount(own[own >= 0], minlength=_WIDTH)
                    some = np.flatnonzero(n)
                    at.append(some.astype(np.int32))
                    x.append((n[some] * (SCALE / max(len(own), 1))).astype(np.float32))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "text_at": pa.array(at, pa.list_(pa.int32())),
                        "text_x": pa.array(x, pa.list_(pa.float32())),
                        "meta_at": part.column("meta_at"),
                        "quality": part.column("quality"),
                    }
                )

    return rows.mapInArrow(run, _FEATURES.format(rows.schema["doc_id"].dataType.simpleString()))


class Sparse:
    """Rows of sparse features."""

    def __init__(self, at: list, x: list | None):
        self.n = len(at)
        self.row = np.repeat(np.arange(self.n), [len(a) for a in at])
        self.at = np.concatenate([*map(np.asarray, at), np.zeros(0)]).astype(np.int64)
        self.x = np.ones(len(self.at)) if x is None else np.concatenate([*map(np.asarray, x), np.zeros(0)])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.x, self.n) + w[-1]

    def fit(self, y: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
        """Logistic regression with a small ridge, by accelerated gradient steps; the last is the bias.

        `weight` is 0 for rows that are not used.
        """
        used = weight[self.row] > 0
        row, at, x = self.row[used], self.at[used], self.x[used]
        total = weight.sum()
        w, momentum, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
        for step in range(1, STEPS + 1):
            z = np.bincount(row, w[at] * x, self.n) + w[-1]
            error = weight * (1 / (1 + np.exp(-z)) - y) / total
            g = np.append(np.bincount(at, error[row] * x, width), error.sum())
            g[:-1] += 1e-5 * w[:-1]
            momentum = 0.9 * momentum + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            w -= 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return w


@dataclass
class Views:
    """The weights of both views, and how their calibrated scores are put together."""

    text: np.ndarray
    meta: np.ndarray
    text_line: np.ndarray
    meta_line: np.ndarray
    joint: np.ndarray

    def combine(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text view, metadata view and both together, as probabilities."""
        t = self.text_line[0] * text + self.text_line[1]
        m = self.meta_line[0] * meta + self.meta_line[1]
        return tuple(1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (t, m, self.joint @ np.stack([t, m, np.ones_like(t)])))


def _calibrated(columns: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression on a few dense columns by Newton steps; weights, then the bias."""
    x = np.stack([*columns, np.ones(len(y))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-2 * np.eye(len(w))
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (p - y)) + 1e-2 * w)
    return w


def fitted_views(known: "Rows", given: dict[str, "Rows"]) -> Views:
    """Fit both views on the labelled rows and those the other view has labelled; calibrate them aside."""
    weights, z = {}, {}
    for v, width in (("text", _WIDTH), ("meta", META_BUCKETS)):
        rows = known.joined(given[v])
        weight = np.append(known.fitted.astype(float), np.full(given[v].n, 0.5))
        weights[v] = rows.sparse(v).fit(rows.quality.astype(float), weight, width)
        z[v] = known.sparse(v).scores(weights[v])[known.aside]
    y, weight = known.quality[known.aside], known.weight[known.aside]
    lines = {v: _calibrated([z[v]], y, weight) for v in z}
    joint = _calibrated([lines[v][0] * z[v] + lines[v][1] for v in ("text", "meta")], y, weight)
    return Views(weights["text"], weights["meta"], lines["text"], lines["meta"], joint)


class Rows:
    """Features and labels of documents on the driver."""

    def __init__(self, text_at: list, text_x: list, meta_at: list, quality: np.ndarray):
        self.columns = text_at, text_x, meta_at
        self.quality, self.n = quality, len(quality)

    @classmethod
    def read(cls, table: pa.Table) -> "Rows":
        flat = lambda c: [v.values.to_numpy() for v in table.column(c)]
        return cls(flat("text_at"), flat("text_x"), flat("meta_at"), table.column("quality").to_numpy())

    def joined(self, other: "Rows") -> "Rows":
        columns = (a + b for a, b in zip(self.columns, other.columns))
        return Rows(*columns, np.append(self.quality, other.quality).astype(int))

    def sparse(self, view: str) -> Sparse:
        return Sparse(*self.columns[:2]) if view == "text" else Sparse(self.columns[2], None)

    def split(self, place: np.ndarray, sizes: dict[int, int]) -> None:
        """Keep a quarter of each class aside, by the hash `place`; a single document serves both ways.

        Calibration weighs the rows of a class by its `sizes` among all labels.
        """
        self.aside, self.fitted = np.zeros(self.n, bool), np.zeros(self.n, bool)
        self.weight = np.zeros(self.n)
        for value in (0, 1):
            own = self.quality == value
            hashes = np.unique(place[own])
            cut = hashes[max(1, len(hashes) // 4) - 1]
            self.aside |= own & (place <= cut)
            self.fitted |= own & ((place > cut) | (len(hashes) == 1))
            self.weight[own] = sizes[value] / (self.aside & own).sum()
        self.weight *= self.aside.sum() / sum(sizes.values())


def _sampled(known: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """About half of `LABELLED` labels of each class at most, drawn by a hash of the id."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    most = {value: int(min(1.0, LABELLED / 2 / n) * (1 << 40)) for value, n in sizes.items()}
    return known.filter(place < F.when(F.col("quality") == 0, most[0]).otherwise(most[1]))


def _surest(scored: DataFrame, chosen: DataFrame, good: float) -> DataFrame:
    """(`doc_id`, `view`, `quality`): what each view labels for the other, named `view`.

    Sources and langs take turns, the surest document of each first.
    """
    each = [
        F.struct(F.lit(other).alias("view"), F.lit(value).alias("quality"), (p if value else 1 - p).alias("sure"))
        for other, p in (("meta", F.col("p_text")), ("text", F.col("p_meta")))
        for value in (0, 1)
    ]
    rows = scored.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("c"))
    rows = rows.select("doc_id", "source", "lang", "c.*").filter(F.col("sure") >= SURE)
    rows = rows.join(F.broadcast(chosen), ["doc_id", "view"], "left_anti")  # of bounded size
    order = [F.desc("sure"), F.xxhash64("doc_id"), "doc_id"]
    turn = F.row_number().over(Window.partitionBy("view", "quality", "source", "lang").orderBy(*order))
    rows = rows.withColumn("turn", turn).filter(F.col("turn") <= PER_ROUND)
    number = F.row_number().over(Window.partitionBy("view", "quality").orderBy("turn", *order))
    most = {value: int(PER_ROUND * max(0.1, share)) for value, share in ((0, 1 - good), (1, good))}
    rows = rows.withColumn("number", number).filter(F.col("number") <= PER_ROUND)
    rows = rows.filter(F.col("number") <= F.when(F.col("quality") == 0, most[0]).otherwise(most[1]))
    return rows.select("doc_id", "view", "quality")


def learn(documents: DataFrame, labels: DataFrame) -> Views | float:
    """The fitted views, or the share of good labels if they are not of both kinds."""
    known = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    ids = documents.select("doc_id").dropna().distinct()
    known = stored(known.join(ids, "doc_id", "left_semi"), "known-labels")
    sizes = {0: 0, 1: 0} | {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    good = sizes[1] / max(sum(sizes.values()), 1)
    if not (sizes[0] and sizes[1]):
        return good if sum(sizes.values()) else 1.0
    rows = documents.select("doc_id", "text", metadata(documents).alias("meta_at"))

    def read(wanted: DataFrame) -> pa.Table:
        found = rows.join(F.broadcast(wanted), "doc_id")  # of bounded size
        table = stored(features(found.select("doc_id", "text", "meta_at", "quality")), "sample-features")
        place = F.xxhash64("doc_id", F.lit("aside"))
        return table.withColumn("place", place).orderBy("doc_id", F.hash("text_at", "text_x", "meta_at")).toArrow()

    table = read(stored(_sampled(known, sizes), "sampled-labels"))
    sample = Rows.read(table)
    sample.split(table.column("place").to_numpy(), sizes)
    nothing = Rows([], [], [], np.zeros(0, int))
    given = {"text": nothing, "meta": nothing}
    chosen = documents.sparkSession.createDataFrame([], f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, view string")
    for number in range(ROUNDS + 1):
        model = fitted_views(sample, given)
        if number == ROUNDS:
            return model
        free = scores(documents, model).join(known, "doc_id", "left_anti").filter(F.col("doc_id").isNotNull())
        new = stored(_surest(free, chosen, good), "pseudo-labels")
        chosen = chosen.union(new.select("doc_id", "view"))
        for v in given:
            given[v] = given[v].joined(Rows.read(read(new.filter(F.col("view") == v).dropDuplicates(["doc_id"]))))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(`doc_id`, `p_text`, `p_meta`, `score`, `kept`) of every document."""
    documents = documents.select("doc_id", "text", "source", "lang", "n_chars")
    model = learn(documents, labels.select("doc_id", "quality"))
    return scores(documents, model).drop("source", "lang")


def scores(documents: DataFrame, model: Views | float) -> DataFrame:
    """(`doc_id`, `source`, `lang`, `p_text`, `p_meta`, `score`, `kept`) of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    same = ["doc_id", "source", "lang"]
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = _encoded(batch.column("text"))
            for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
                part = batch.slice(a, b - a)
                if isinstance(model, float):
                    columns = [np.full(b - a, model)] * 3
                else:
                    places, bounds = _tokens(texts[a:b])
                    weights = np.append(model.text, 0.0)  # place -1 is no feature
                    each = weights[places].sum(1) if len(places) else np.zeros(0)
                    sums = np.concatenate([[0.0], np.cumsum(each)])
                    n = np.maximum(np.diff(bounds), 1)
                    text = (sums[bounds[1:]] - sums[bounds[:-1]]) * SCALE / n + model.text[-1]
                    meta = np.array(part.column("meta_at").to_pylist())
                    columns = model.combine(text, model.meta[meta].sum(1) + model.meta[-1])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in same), *map(pa.array, columns), pa.array(columns[2] >= KEEP)],
                    [*same, "p_text", "p_meta", "score", "kept"],
                )

    rows = documents.select(*same, "text", metadata(documents).alias("meta_at"))
    return rows.mapInArrow(run, f"{kinds}, p_text double, p_meta double, score double, kept boolean")
