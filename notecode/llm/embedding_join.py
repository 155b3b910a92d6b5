"""Near-duplicate vectors: an epsilon grid order join.

Vectors of a label are scaled to length one, where a cosine of at least t is a distance of at most
sqrt(2 - 2t). They are projected on their leading principal directions, put into grid cells as wide as
that distance, and sorted by label and cells. Stretches of that sequence are blocks; blocks have
boxes in the leading directions, and so have stretches of blocks. The join goes down from the stretches
of a label to its blocks, and drops pairs whose boxes are farther apart than the distance, which is
safe as a projection never lengthens a distance. The pairs of blocks left are compared in full in
double precision.

Equal vectors of a label are one class. A pair of blocks yields the number of links per class and a
tree of links for each of its components, never all pairs.

Defined results: a vector that is NULL, zero or empty, or holds a NULL or a non-finite number, or has
no label, links with nothing; vectors of different lengths do not link; rows with a NULL `vec_id` are
left out of links and components; repeated rows count as vectors of their own that have the same
id; empty input gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from notecode.llm.components import components
from notecode.operators.once import with_columns_once
from notecode.sources.shared_folder import stored

THRESHOLD = 0.93
DIRECTIONS = 8
BLOCK = 1024
FAN_OUT = 4
MOST_TASKS = 10_000
SLACK = 1e-9


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(`vec_id`, `label`, `dim`, `unit`); `unit` is NULL for vectors that link with nothing."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", "label", vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    # Divided by the largest number first, so that squares neither overflow nor vanish.
    largest = F.array_max(F.transform("v", F.abs))
    rows = with_columns_once(rows, {"largest": F.when(largest > 0, largest)})
    rows = with_columns_once(
        rows, {"v": F.when(F.col("largest").isNotNull(), F.transform("v", lambda x: x / F.col("largest")))}
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = with_columns_once(rows, {"norm": norm})
    return rows.select(
        "vec_id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("norm")).alias("unit")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def principal_directions(classes: DataFrame, dim: int) -> np.ndarray:
    """The leading principal directions of all vectors of this length, from their second moments.

    Each task adds up its moments; dim x dim numbers come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("unit"))
                total += m.T @ m
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(dim), pa.int32()), "row": pa.array(total.tolist(), pa.list_(pa.float64()))}
        )

    parts = classes.select("unit").mapInArrow(run, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    moments = np.zeros((dim, dim))
    table = sums.toArrow()
    moments[table.column("i").to_numpy(), table.column("j").to_numpy()] = table.column("x").to_numpy()
    values, vectors = np.linalg.eigh((moments + moments.T) / 2)
    return vectors[:, np.argsort(values)[::-1][:DIRECTIONS]]


def sorted_blocks(classes: DataFrame, directions: np.ndarray, threshold: float) -> DataFrame:
    """Blocks of the grid order: (`label`, `task`, `number`, `ids`, `counts`, `vectors`, `low`, `high`).

    Tasks hold ranges of the order, so that equal or close vectors of a frequent label spread.
    """
    width = float(np.sqrt(2 - 2 * threshold))
    sent = np.ascontiguousarray(directions)
    leading = sent.shape[1]
    id_type = classes.schema["vec_id"].dataType.simpleString()
    label_type = classes.schema["label"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(_matrix(batch.column("unit")) @ sent / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *[pa.array(cells[:, k]) for k in range(leading)]],
                    [*batch.schema.names, *[f"cell_{k}" for k in range(leading)]],
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list = []
        number = 0

        def out() -> pa.RecordBatch:
            vectors = np.array([h[3] for h in held])
            places = vectors @ sent
            return pa.RecordBatch.from_pydict(
                {
                    "label": pa.array([held[0][0]], label),
                    "task": pa.array([task], pa.int64()),
                    "number": pa.array([number], pa.int64()),
                    "ids": pa.array([[h[1] for h in held]], pa.list_(ids)),
                    "counts": pa.array([[h[2] for h in held]], pa.list_(pa.int64())),
                    "vectors": pa.array([vectors.tobytes()], pa.binary()),
                    "low": pa.array([places.min(0).tolist()], pa.list_(pa.float64())),
                    "high": pa.array([places.max(0).tolist()], pa.list_(pa.float64())),
                }
            )

        for batch in batches:
            label, ids = batch.column("label").type, batch.column("vec_id").type
            vectors = _matrix(batch.column("unit")) if batch.num_rows else []
            rows = zip(*(batch.column(c).to_pylist() for c in ("label", "vec_id", "n")), vectors)
            for row in rows:
                if held and (len(held) == BLOCK or held[0][0] != row[0]):
                    yield out()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield out()

    cells = ", ".join(f"cell_{k} int" for k in range(leading))
    schema = f"vec_id {id_type}, label {label_type}, n long, unit array<double>, {cells}"
    order = ["label", *[f"cell_{k}" for k in range(leading)], "vec_id"]
    rows = classes.select("vec_id", "label", "n", "unit").mapInArrow(project, schema)
    blocks = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            gather,
            f"label {label_type}, task long, number long, ids array<{id_type}>, counts array<long>, "
            "vectors binary, low array<double>, high array<double>",
        )
    )
    return stored(blocks, "grid-blocks")


def _apart(a: str, b: str) -> Column:
    """The squared distance of two boxes."""
    gap = F.zip_with(f"low_{a}", f"high_{b}", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    back = F.zip_with(f"low_{b}", f"high_{a}", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    each = F.zip_with(gap, back, lambda x, y: F.greatest(x, y))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x * x)


def block_pairs(boxes: DataFrame, threshold: float) -> DataFrame:
    """(`a`, `b`), a <= b, of the blocks (`label`, `place`, `low`, `high`) that may hold links.

    From one interval per label down to blocks, each pair of intervals is replaced by the pairs of
    their parts that are close enough.
    """
    limit = 2 - 2 * threshold + SLACK
    longest = boxes.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    levels = [boxes]
    while longest > 0:
        longest //= FAN_OUT
        inner = levels[-1]
        low = F.array(*[F.coalesce(F.min(F.get("low", F.lit(k))), F.lit(0.0)) for k in range(DIRECTIONS)])
        high = F.array(*[F.coalesce(F.max(F.get("high", F.lit(k))), F.lit(0.0)) for k in range(DIRECTIONS)])
        outer = inner.groupBy("label", F.floor(F.col("place") / FAN_OUT).alias("place"))
        outer = outer.agg(low.alias("low"), high.alias("high"))
        levels.append(stored(outer, "grid-intervals"))
    top = levels[-1]
    pairs = top.select("label", F.col("place").alias("a"), F.col("place").alias("b"))
    for inner in reversed(levels[:-1]):

        def side(name: str, inner: DataFrame = inner) -> DataFrame:
            return inner.select(
                "label",
                F.floor(F.col("place") / FAN_OUT).alias(f"of_{name}"),
                F.col("place").alias(name),
                F.col("low").alias(f"low_{name}"),
                F.col("high").alias(f"high_{name}"),
            )

        pairs = pairs.select("label", F.col("a").alias("of_a"), F.col("b").alias("of_b"))
        pairs = pairs.join(side("a"), ["label", "of_a"]).join(side("b"), ["label", "of_b"])
        pairs = pairs.filter((F.col("a") <= F.col("b")) & (_apart("a", "b") <= limit)).select("label", "a", "b")
    return pairs


def _links_of_blocks(threshold: float, id_type: pa.DataType):
    def forest(mask: np.ndarray, rows: list, columns: list) -> list[tuple]:
        """For each component of the links between rows and columns, links of its members to one of them."""
        n = mask.shape[0]
        root = np.arange(n)
        column_root = np.full(mask.shape[1], n)
        hit = mask.any(0)
        while True:
            new_column = np.where(hit, np.where(mask, root[:, None], n).min(0), n)
            new_root = np.minimum(root, np.where(mask, new_column[None], n).min(1))
            if (new_root == root).all() and (new_column == column_root).all():
                break
            root, column_root = new_root, new_column
        links = [(rows[i], rows[root[i]]) for i in np.flatnonzero(root != np.arange(n)).tolist()]
        return links + [(columns[j], rows[column_root[j]]) for j in np.flatnonzero(hit).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, other, n = [], [], []
            for i in range(batch.num_rows):
                same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                side = {}
                for s in ("a", "b"):
                    names = batch.column(f"ids_{s}")[i].as_py()
                    counts = np.array(batch.column(f"counts_{s}")[i].as_py(), np.float64)
                    m = np.frombuffer(batch.column(f"vectors_{s}")[i].as_buffer(), np.float64)
                    side[s] = names, counts, m.reshape(len(names), -1)
                a, b = side["a"], side["b"]
                mask = a[2] @ b[2].T >= threshold
                if same:
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                links = forest(mask, a[0], b[0])
                weights = [(a[0], mask @ b[1])] + ([] if same else [(b[0], mask.T @ a[1])])
                for names, count in weights:
                    for k in np.flatnonzero(count).tolist():
                        ids.append(names[k])
                        other.append(None)
                        n.append(int(count[k]))
                for x, y in links:
                    ids.append(x)
                    other.append(y)
                    n.append(0)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": pa.array(ids, id_type), "other": pa.array(other, id_type), "n": pa.array(n, pa.int64())}
            )

    return run


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(`vec_id`, `other`, `n`): numbers of links per class (NULL `other`) and links of components."""
    id_type = classes.schema["vec_id"].dataType
    found = None
    for (dim,) in classes.select("dim").distinct().collect():
        own = classes.filter(F.col("dim") == dim)
        blocks = sorted_blocks(own, principal_directions(own, dim), threshold)
        # Blocks are numbered through all tasks; there is one count per task.
        starts, total = [], 0
        for task, n in blocks.groupBy("task").agg(F.max("number") + 1).orderBy("task").collect():
            starts.append((task, total))
            total += n
        offsets = F.broadcast(classes.sparkSession.createDataFrame(starts, "task long, start long"))
        numbered = blocks.join(offsets, "task").withColumn("place", F.col("start") + F.col("number"))
        pairs = stored(block_pairs(numbered.select("label", "place", "low", "high"), threshold), "grid-pairs")

        def side(s: str, numbered: DataFrame = numbered) -> DataFrame:
            return numbered.select(F.col("place").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "vectors")])

        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        # Few rows with much work each: spread them, whatever their size in bytes is.
        both = both.repartition(max(1, min(pairs.count(), MOST_TASKS)), "a", "b")
        schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("other", id_type), T.StructField("n", T.LongType())])
        rows = both.mapInArrow(_links_of_blocks(threshold, to_arrow_schema(schema).field("vec_id").type), schema)
        found = rows if found is None else found.union(rows)
    if found is None:
        return classes.select("vec_id", F.col("vec_id").alias("other"), F.lit(0).cast("long").alias("n"))
    return stored(found, "grid-links")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(`vec_id`, `n_links`, `component_id`, `kept`) for every row."""
    embeddings = embeddings.select("vec_id", "embedding", "label")
    digest = F.sha2(F.to_json(F.struct("unit")).cast("binary"), 256)
    units = stored(unit_vectors(embeddings).withColumn("digest", digest), "units")
    members = units.filter("unit is not null")
    classes = (
        members.groupBy("label", "digest")
        .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    )
    classes = stored(classes, "vector-classes")
    links = class_links(classes, threshold)
    counts = links.filter("other is null").groupBy("vec_id").agg(F.sum("n").alias("others"))
    of_node = components(links.filter("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), "vectors")
    own = (
        classes.select("label", "digest", "vec_id", "n")
        .join(counts, "vec_id", "left")
        .join(of_node.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
        .select(
            "label",
            "digest",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    own = stored(own, "vector-components")
    linked = members.select("vec_id", "label", "digest").join(own, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = units.filter("unit is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    rows = linked.union(alone)
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
