"""Codes of vectors: one byte per part, by k-means over metric trees of the parts.

Vectors are cut into equal parts. Each block of vectors gets, for every part position, a metric tree
grown by the anchors hierarchy: some square root of the block's points become anchors, each new one the
point farthest from its anchor, and takes over points that are nearer to it (those whose distance to
their anchor is below half the distance of the anchors cannot be, and are not looked at). The balls are
split further by the same step and merged upwards, nearest pair first: the tree grows from its middle
outwards. A ball keeps its centre, its radius, the sum and the number of its points.

A round hands every ball the list of codebook entries that may own some of it. Entries farther from the
centre than the nearest one by more than twice the radius cannot, so the list shrinks on the way down;
a ball with one entry left is wholly owned and adds its cached sum and count. The trees are stored and
used by all rounds. What a round sends through Spark are sums per (part, entry), added up before the
shuffle; the driver gets no more than parts x entries of them. Numbers are integers throughout; centres
and radii are rounded outwards, so ties are decided by exact distances only.

Defined results: rows whose vector is NULL, empty or holds NULL or non-finite components are left out;
equal rows give equal rows; entries of the codebook that tie go by their index; vec_ids that tie in the
choice of the first codebook go by their components, and a NULL one comes last; an empty table gives no
rows; vectors of differing lengths, of a length that the number of parts does not divide, or with
components beyond 2^26 after scaling, are errors; other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.llm.batches import short_batches
from notecode.operators.joins import lookup_join
from notecode.sources.shared_folder import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_ROWS = 2048
LEAF_POINTS = 64
MOST_COMPONENT = 1 << 26


@dataclass
class Tree:
    """Balls in arrays. Ball `i` holds the points `order[first[i]:last[i]]`; leaves have no children."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray

    def packed(self) -> bytes:
        head = np.array([len(self.order), len(self.first), self.sums.shape[1]], np.int64)
        parts = (head, self.order, self.first, self.last, self.left, self.right, self.sums.ravel())
        return b"".join(p.astype(np.int64).tobytes() for p in parts)

    @staticmethod
    def unpacked(data: bytes) -> tuple["Tree", int]:
        """The tree at the beginning of the bytes, and how many it takes."""
        points, balls, width = (int(n) for n in np.frombuffer(data, np.int64, 3))
        sizes = [points, balls, balls, balls, balls, balls * width]
        ends = 3 + np.cumsum(sizes)
        numbers = np.frombuffer(data, np.int64, int(ends[-1]))
        cut = [numbers[end - size : end] for end, size in zip(ends, sizes)]
        return Tree(*cut[:5], cut[5].reshape(balls, width)), int(ends[-1]) * 8


def anchors(points: np.ndarray, n_anchors: int) -> list[np.ndarray]:
    """The points' numbers by anchor, in an anchors hierarchy of up to `n_anchors` of them."""
    pivots = np.zeros((n_anchors, points.shape[1]))
    pivots[0] = points[0]
    distance = np.sqrt(((points - points[0]) ** 2).sum(1))
    order = np.argsort(-distance, kind="stable")
    owned, far = [order], [distance[order]]
    reach = np.zeros(n_anchors)  # how far the farthest point of each anchor is
    reach[0] = distance[order[0]]
    while len(owned) < n_anchors:
        n = len(owned)
        widest = int(np.argmax(reach[:n]))
        if reach[widest] == 0:
            break
        pivot = points[owned[widest][0]]
        half = np.sqrt(((pivots[:n] - pivot) ** 2).sum(1)) / 2
        taken, taken_far = [], []
        for k in np.flatnonzero(reach[:n] >= half).tolist():
            # Sorted from far to near: what follows is nearer to its anchor than half way.
            some = int(np.searchsorted(-far[k], -half[k], side="right"))
            new = np.sqrt(((points[owned[k][:some]] - pivot) ** 2).sum(1))
            moves = new < far[k][:some]
            if moves.any():
                taken.append(owned[k][:some][moves])
                taken_far.append(new[moves])
                stay = np.concatenate([~moves, np.ones(len(far[k]) - some, bool)])
                owned[k], far[k] = owned[k][stay], far[k][stay]
                reach[k] = far[k][0] if len(far[k]) else 0
        mine, mine_far = np.concatenate(taken), np.concatenate(taken_far)
        order = np.argsort(-mine_far, kind="stable")
        pivots[n], reach[n] = pivot, mine_far[order[0]]
        owned.append(mine[order])
        far.append(mine_far[order])
    return [numbers for numbers in owned if len(numbers)]


def grown(points: np.ndarray) -> Tree:
    """The metric tree of the points, from the middle outwards."""
    balls: list[tuple] = []  # children as ball numbers, or the points of a leaf
    exact = points.astype(np.int64)
    sums: list[np.ndarray] = []
    counts: list[int] = []

    def ball(left: int, right: int, numbers: np.ndarray | None) -> int:
        balls.append((left, right, numbers))
        sums.append(exact[numbers].sum(0) if numbers is not None else sums[left] + sums[right])
        counts.append(len(numbers) if numbers is not None else counts[left] + counts[right])
        return len(balls) - 1

    def built(numbers: np.ndarray) -> int:
        here = points[numbers]
        if len(numbers) <= LEAF_POINTS or (here == here[0]).all():
            return ball(-1, -1, numbers)
        roots = [built(numbers[own]) for own in anchors(here, int(np.ceil(np.sqrt(len(numbers)))))]
        return merged(roots)

    def merged(roots: list[int]) -> int:
        centres = np.array([sums[r] / counts[r] for r in roots])
        apart = ((centres[:, None] - centres[None]) ** 2).sum(2)
        np.fill_diagonal(apart, np.inf)
        roots = list(roots)
        for _ in range(len(roots) - 1):
            a, b = divmod(int(np.argmin(apart)), len(roots))
            roots[a] = ball(roots[a], roots[b], None)
            centres[a] = sums[roots[a]] / counts[roots[a]]
            apart[b], apart[:, b] = np.inf, np.inf
            gone = np.isinf(apart[a])
            new = ((centres - centres[a]) ** 2).sum(1)
            new[gone] = np.inf
            apart[a], apart[:, a] = new, new
        return len(balls) - 1

    root = built(np.arange(len(points)))
    order: list[np.ndarray] = []
    first, last = np.zeros(len(balls), np.int64), np.zeros(len(balls), np.int64)
    place, todo = 0, [root]
    while todo:  # points in the order of the leaves, so that each ball is a stretch
        i = todo.pop()
        left, right, numbers = balls[i]
        if numbers is not None:
            order.append(numbers)
            first[i], place = place, place + len(numbers)
            last[i] = place
        else:
            todo += [right, left]
    for i, (left, right, numbers) in enumerate(balls):  # children come before their parents
        if numbers is None:
            first[i], last[i] = first[left], last[right]
    pointers = np.array([b[:2] for b in balls], np.int64).reshape(-1, 2)
    return Tree(np.concatenate(order), first, last, pointers[:, 0], pointers[:, 1], np.array(sums, np.int64))


def owners(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The stretches of the tree with their owner: (ball or -1, points' numbers, an entry for each)."""
    counts = (tree.last - tree.first)[:, None]
    centres = tree.sums / counts
    apart = np.sqrt(((centres[:, None, :] - entries[None]) ** 2).sum(2))
    radius = np.zeros(len(centres))
    for i in range(len(centres)):
        if tree.left[i] < 0:
            own = points[tree.order[tree.first[i] : tree.last[i]]]
            radius[i] = np.sqrt(((own - centres[i]) ** 2).sum(1).max())
        else:
            kids = [tree.left[i], tree.right[i]]
            radius[i] = (np.sqrt(((centres[kids] - centres[i]) ** 2).sum(1)) + radius[kids]).max()
    slack = 1e-9 * (1 + np.abs(centres).max() + np.abs(entries).max())
    todo = [(len(centres) - 1, np.arange(len(entries)))]
    while todo:
        i, candidates = todo.pop()
        near = apart[i][candidates]
        candidates = candidates[near <= near.min() + 2 * radius[i] + slack]
        numbers = tree.order[tree.first[i] : tree.last[i]]
        if len(candidates) == 1:
            yield i, numbers, candidates
        elif tree.left[i] >= 0:
            todo += [(tree.left[i], candidates), (tree.right[i], candidates)]
        else:
            squares = ((points[numbers][:, None, :] - entries[candidates][None]) ** 2).sum(2)
            yield -1, numbers, candidates[squares.argmin(1)]  # the first of equal ones


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """Whole-number components, or NULL where the vector is left out."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.exists(embedding, lambda x: F.abs(x) * scale >= MOST_COMPONENT)
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    kept = F.when(large, F.raise_error(F.lit("a component is too large")).cast("array<int>")).otherwise(whole)
    return F.when(~bad & (F.size(embedding) > 0), kept)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in blocks of `BLOCK_ROWS`, whatever the size of the batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while rows + batch.num_rows >= BLOCK_ROWS:
            take = BLOCK_ROWS - rows
            yield pa.Table.from_batches([*held, batch.slice(0, take)])
            batch, held, rows = batch.slice(take), [], 0
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _planted(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[pa.RecordBatch]:
    """One row per block of vectors: ids, labels, components and the trees of all parts."""
    for block in _blocks(batches):
        flat = np.concatenate([c.flatten().to_numpy() for c in block.column("v").chunks])
        points = flat.reshape(block.num_rows, parts, width).astype(np.int64)
        trees = [grown(np.ascontiguousarray(points[:, p])).packed() for p in range(parts)]
        yield pa.RecordBatch.from_pydict(
            {
                "ids": pa.array([block.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                "labels": pa.array([block.column("label").to_pylist()], pa.list_(pa.string())),
                "points": pa.array([points.astype(np.int32).tobytes()]),
                "trees": pa.array([b"".join(trees)]),
            }
        )


def _opened(row: dict, parts: int, width: int) -> Iterator[tuple[int, np.ndarray, Tree]]:
    points = np.frombuffer(row["points"], np.int32).reshape(-1, parts, width)
    data = memoryview(row["trees"])
    for p in range(parts):
        tree, size = Tree.unpacked(data)
        data = data[size:]
        yield p, points[:, p].astype(np.int64), tree


def _summed(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sums and counts that each entry owns, over all blocks of the task."""
    parts, n_entries, width = books.shape
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            for p, points, tree in _opened(row, parts, width):
                for ball, numbers, entry in owners(tree, points, books[p]):
                    if ball >= 0:
                        sums[p, entry[0]] += tree.sums[ball]
                        counts[p, entry[0]] += len(numbers)
                    else:
                        np.add.at(sums[p], entry, points[numbers])
                        np.add.at(counts[p], entry, 1)
    part, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_pydict(
        {
            "part": pa.array(part, pa.int32()),
            "entry": pa.array(entry, pa.int32()),
            "n": pa.array(counts[part, entry], pa.int64()),
            "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
        }
    )


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The code and the error of every vector."""
    parts, _, width = books.shape
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["ids"])
            codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, points, tree in _opened(row, parts, width):
                for _, numbers, entry in owners(tree, points, books[p]):
                    codes[numbers, p] = entry
                    errors[numbers] += ((points[numbers] - books[p][entry]) ** 2).sum(1)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": pa.array(row["ids"], pa.int64()),
                    "code": pa.array([c.tobytes().hex() for c in codes]),
                    "error": pa.array(errors),
                    "label": pa.array(row["labels"], pa.string()),
                }
            )


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """The stored blocks with their trees, and the codebooks (parts, entries, width); None if empty."""
    spark = vectors.sparkSession
    lengths = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if lengths[0] is None:
        return None
    if lengths[0] != lengths[1] or lengths[0] % parts:
        raise ValueError(f"vectors have {lengths[0]} to {lengths[1]} components; one multiple of {parts} is needed")
    width = lengths[0] // parts
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).swapaxes(0, 1)
    short_batches(spark)  # a worker holds some blocks with their trees
    labelled = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "v")
    schema = "ids array<bigint>, labels array<string>, points binary, trees binary"
    blocks = stored(labelled.mapInArrow(partial(_planted, parts=parts, width=width), schema), "code-blocks")
    for _ in range(rounds):
        sums = blocks.mapInArrow(partial(_summed, books=books), "part int, entry int, n bigint, sums array<bigint>")
        place = F.posexplode("sums").alias("place", "x")
        added = sums.select("part", "entry", "n", place).groupBy("part", "entry", "place")
        books = books.copy()  # at most parts x entries x width numbers come back
        for r in added.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            books[r.part, r.entry, r.place] = r.x // r.n
    return blocks, books


def codes(embeddings: DataFrame) -> DataFrame:
    """(`vec_id`, `code`, `error`, `label_error`, `codebooks_sha256`) of every kept vector."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", scaled(F.col("embedding")).alias("v"))
    vectors = stored(rows.filter(F.col("v").isNotNull()), "code-vectors")
    found = trained(vectors)
    if found is None:
        return spark.createDataFrame(
            [], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        )
    blocks, books = found
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    schema = "vec_id bigint, code string, error bigint, label string"
    coded = stored(blocks.mapInArrow(partial(_coded, books=books), schema), "codes")
    discard(vectors, blocks)
    # NULL labels are one group; a letter in front keeps other labels apart from it.
    coded = coded.withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null")))
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    joined = lookup_join(coded, sums, ["label"], "left", salt_by=["vec_id"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
