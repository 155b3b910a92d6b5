"""Near-duplicate documents: an exact Jaccard join in regions around pivots.

A document's set are the hashes of its distinct windows of five words. Documents with the same set are
one class. Jaccard distance is a metric, but unrelated documents all have distance 1, so pivots
alone cannot tell them apart. Regions are therefore seeded by the shingles that linked sets must share:
of two sets with similarity t or more, the first `size - ceil(t * size) + 1` shingles in one fixed
order have one in common. Shingles that many classes have come last in that order.

Each seed is a region. A small region's pairs are compared as they are. In a large one, all members meet
the region's pivot; the members within the link distance become one component. Members outside the
region's largest component go on: some of them are further pivots, the rest is cut into blocks that meet
the members of other components in slices. Links inside a component are never made, so no group is expanded into all its pairs.

Pivots of another metric come before each comparison of sets. In the symmetric difference, the parity
of each hash class and the size are distances to fixed pivots; by the triangle inequality they bound
the distance of two sets from below, and pairs beyond the link distance stop there.

Defined results: a NULL text or one without words has an empty set, which is linked with nothing; rows
with a NULL `doc_id` are linked with nothing and have a NULL component; rows that share a `doc_id` are
one document that has the links of all; ties between pivots are broken by id; empty input gives no
rows. Shingles are compared by 64-bit hashes.
"""

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.llm.batches import short_batches, trimmed
from notecode.llm.components import components
from notecode.llm.words import blocks, forget_powers, hashed_words, shingles
from notecode.sources.shared_folder import discard, stored

SHINGLE = 5
PERCENT = 80
BLOCK_BYTES = 500_000
FREQUENT = 16  # classes; a shingle with more comes late in the order
MOST_FREQUENT = 1 << 22  # bound of the broadcast table of frequent shingles
SMALL_REGION = 16
CLASSES = 1024
BROADCAST_IDS = 1_000_000
BLOCK_MEMBERS = 512
SLICE_MEMBERS = 8192
COMPARED_AT_ONCE = 256
MORE_PIVOTS = 16


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingles of each row of the batch."""
    texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower() for t in batch.column("text")]
    for a, b in blocks([len(t) for t in texts], BLOCK_BYTES):
        words, bounds = hashed_words(texts[a:b])
        for i in range(a, b):
            yield i, shingles(words[bounds[i - a] : bounds[i - a + 1]], SHINGLE)


def prefix_size(n: int) -> int:
    """How many first shingles of a set of n hold one of every set that it is linked with."""
    return n - -(-n * PERCENT // 100) + 1


def first_shingles(hashes: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, those that are late in the order apart."""
    size = prefix_size(len(hashes)) if len(hashes) else 0
    if not len(late):
        return hashes[:size], hashes[:0]
    place = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
    is_late = late[place] == hashes
    rare = hashes[~is_late][:size]
    return rare, hashes[is_late][: size - len(rare)]


def document_sets(documents: DataFrame) -> DataFrame:
    """(`doc_id`, `n_shingles`, `digest`, `first`, `sketch`) of each set, without the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for rows, hashes in _parts(_sets(batch)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        "n_shingles": pa.array([len(h) for h in hashes], pa.int64()),
                        "digest": pa.array([blake2b(h.tobytes(), digest_size=16).digest() for h in hashes], pa.binary()),
                        "first": _lists([first_shingles(h, none)[0] for h in hashes]),
                        "sketch": _lists([_sketch(h) for h in hashes]),
                    }
                )

    return documents.select("doc_id", "text").mapInArrow(
        trimmed(run, forget_powers), f"{_id_type(documents)}, n_shingles long, digest binary, first array<long>, sketch array<long>"
    )


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit per hash class: whether it has an odd number of the hashes.

    An element that two sets do not share changes one bit, so no more bits can differ than elements.
    """
    odd = np.bincount((hashes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _parts(sets: Iterator[tuple[int, np.ndarray]], most: int = 500_000) -> Iterator[tuple[list, list]]:
    """The sets in lists that hold some `most` hashes."""
    rows, hashes, held = [], [], 0
    for row, h in sets:
        rows.append(row)
        hashes.append(h)
        held += len(h)
        if held >= most:
            yield rows, hashes
            rows, hashes, held = [], [], 0
    if rows:
        yield rows, hashes


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _id_type(documents: DataFrame) -> str:
    return f"doc_id {documents.schema['doc_id'].dataType.simpleString()}"


def only(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows whose `column` is in the stored ids: by broadcast up to `BROADCAST_IDS`, else by shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, column, how)


def frequent_shingles(classes: DataFrame) -> DataFrame:
    """(`shingle`,) for those that more than `FREQUENT` classes have among their first.

    The counts cover all classes. The limit rises with their number so that no more than
    `MOST_FREQUENT` shingles can pass it; it changes the order of shingles, never the result.
    """
    total = classes.agg(F.coalesce(F.sum(F.size("first")), F.lit(0))).first()[0]
    limit = max(FREQUENT, total // MOST_FREQUENT)
    counts = classes.select(F.explode("first").alias("shingle")).groupBy("shingle").count()
    return counts.filter(F.col("count") > limit).select("shingle")


def reordered(documents: DataFrame, sent: Broadcast) -> DataFrame:
    """(`doc_id`, `n`, `first`, `late`): the first shingles when the sent ones come last in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, hashes in _parts(_sets(batch)):
                first, late = zip(*[first_shingles(h, sent.value) for h in hashes])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        "n": pa.array([len(h) for h in hashes], pa.int64()),
                        "first": _lists(list(first)),
                        "late": _lists(list(late)),
                    }
                )

    schema = f"{_id_type(documents)}, n long, first array<long>, late array<long>"
    return documents.select("doc_id", "text").mapInArrow(trimmed(run, forget_powers), schema)


def whole_sets(documents: DataFrame) -> DataFrame:
    """(`doc_id`, `hashes`, `repeated`) from (`doc_id`, `text`, `repeated`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, hashes in _parts(_sets(batch), 500_000):
                kept = {c: batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "repeated")}
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": kept["doc_id"], "hashes": _lists(hashes), "repeated": kept["repeated"]}
                )

    schema = f"{_id_type(documents)}, hashes array<long>, repeated boolean"
    return documents.select("doc_id", "text", "repeated").mapInArrow(trimmed(run, forget_powers), schema)


def small_regions(seeds: DataFrame) -> DataFrame:
    """Pairs of small regions and members of large ones, from (`shingle`, `doc_id`, `n`).

    Rows come sorted, and at most `SMALL_REGION` members are held at a time: (`shingle`, `a`, `b`)
    with NULL `b` for a member of a large region. Pairs whose sizes are too different are left out.
    """
    kind = seeds.schema["doc_id"].dataType.simpleString()

    def pairs(ids: list, sizes: list) -> Iterator[tuple]:
        for i in range(len(ids)):
            for j in range(i):
                low, high = min(sizes[i], sizes[j]), max(sizes[i], sizes[j])
                if 100 * low >= PERCENT * high and ids[i] != ids[j]:
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # shingle, ids, sizes of the run that may go on in the next batch

        def out(rows: list, id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[], [], []]
            types = (pa.int64(), id_type, id_type)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shingle", "a", "b"])

        id_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.column("doc_id").type
            shingle = batch.column("shingle").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shingle)) + 1, [len(shingle)]])
            runs = np.flatnonzero(np.diff(cuts) > 1).tolist()
            if kept is not None or (runs[:1] != [0]):
                runs = [0, *[r for r in runs if r]]
            if runs[-1] != len(cuts) - 2:
                runs.append(len(cuts) - 2)
            rows: list = []
            for r in runs:
                a, b = int(cuts[r]), int(cuts[r + 1])
                value = int(shingle[a])
                ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                sizes = batch.column("n").slice(a, b - a).to_pylist()
                if kept is not None and kept[0] == value:
                    if kept[1] is None:  # known to be large
                        rows += [(value, i, None) for i in ids]
                        continue
                    ids, sizes = kept[1] + ids, kept[2] + sizes
                elif kept is not None and kept[1]:
                    rows += [(kept[0], *p) for p in pairs(kept[1], kept[2])]
                if len(ids) > SMALL_REGION:
                    rows += [(value, i, None) for i in ids]
                    kept = (value, None, None)
                else:
                    kept = (value, ids, sizes)
            yield out(rows, id_type)
        if kept is not None and kept[1]:
            yield out([(kept[0], *p) for p in pairs(kept[1], kept[2])], id_type)

    return (
        seeds.repartition("shingle")
        .sortWithinPartitions("shingle", "doc_id")
        .mapInArrow(trimmed(run), f"shingle long, a {kind}, b {kind}")
    )


def _numbered(sets: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return sets.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(`a`, `b`, `linkable`): whether the triangle inequality leaves a link possible."""
    rows = pairs.join(_numbered(sketches, "a", ["n", "sketch"]), "a")
    rows = rows.join(_numbered(sketches, "b", ["n", "sketch"]), "b")
    bits = [F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(CLASSES // 64)]
    apart = F.greatest(reduce(lambda x, y: x + y, bits).cast("long"), F.abs(F.col("n_a") - F.col("n_b")))
    rows = rows.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"), apart.alias("apart"))
    # With d elements in one set only: similarity = (both - d) / (both + d).
    linkable = 100 * (F.col("both") - F.col("apart")) >= PERCENT * (F.col("both") + F.col("apart"))
    return rows.select("a", "b", linkable.alias("linkable"))


def exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(`a`, `b`, `far`) from the sets themselves."""
    rows = pairs.join(_numbered(sets, "a", ["hashes"]), "a").join(_numbered(sets, "b", ["hashes"]), "b")
    shared = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    rows = rows.select("a", "b", shared.alias("shared"), (F.size("hashes_a") + F.size("hashes_b")).alias("both"))
    union = F.col("both") - F.col("shared")
    return rows.select(
        "a",
        "b",
        (100 * F.col("shared") < PERCENT * union).alias("far"),
    )


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members (`shingle`, `doc_id`) with their `component` by the links so far."""
    of_node = components(links, "regions").select(F.col("node").alias("doc_id"), "component")
    return members.join(of_node, "doc_id", "left").select(
        "shingle", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )


def verified(documents: DataFrame, pairs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Stored links (`a`, `b`) among the pairs, by the whole sets of the documents in them.

    Only the sets of ids that several rows share (`repeated`) have to be made distinct.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = wanted.join(repeated.withColumn("repeated", F.lit(True)), "doc_id", "left")
    wanted = stored(wanted.withColumn("repeated", F.col("repeated").isNotNull()), "wanted")
    sets = stored(whole_sets(only(documents, wanted, "doc_id", "inner")).filter(F.size("hashes") > 0), "whole-sets")
    once = sets.filter("not repeated").select("doc_id", "hashes")
    sets_of_ids = once.union(sets.filter("repeated").select("doc_id", "hashes").distinct())
    links = stored(exact(pairs, sets_of_ids).filter("not far").select("a", "b"), "links")
    discard(wanted, sets)
    return links


def _regions(placed: DataFrame) -> DataFrame:
    """The regions with members of several components, and the largest of these components."""
    sizes = placed.groupBy("shingle", "component").count()
    regions = sizes.groupBy("shingle").agg(
        F.max(F.struct("count", "component")).alias("largest"), F.count(F.lit(1)).alias("n"), F.sum("count").alias("all")
    )
    regions = regions.filter("n > 1").select(
        "shingle",
        F.col("largest.component").alias("largest"),
        F.ceil((F.col("all") - F.col("largest.count")) / BLOCK_MEMBERS).cast("int").alias("n_blocks"),
        F.ceil(F.col("all") / SLICE_MEMBERS).cast("int").alias("n_slices"),
    )
    return stored(regions, "open-regions")


def pivot_pairs(members: DataFrame) -> DataFrame:
    """Each region's pivot, its least member, with its other members."""
    pivots = stored(members.groupBy("shingle").agg(F.min("doc_id").alias("a")), "pivots")
    return members.join(pivots, "shingle").select("a", F.col("doc_id").alias("b")).filter("a < b").distinct()


def more_pivot_pairs(placed: DataFrame) -> DataFrame:
    """Up to `MORE_PIVOTS` members outside the largest component, with the members of other components."""
    outside = placed.join(_regions(placed), "shingle").filter("component != largest")
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(MORE_PIVOTS))
    drawn = outside.groupBy("shingle", cell.alias("cell")).agg(F.min(F.struct("doc_id", "component")).alias("p"))
    pivots = stored(drawn.select("shingle", F.col("p.doc_id").alias("pivot"), F.col("p.component").alias("own")), "pivots")
    met = placed.join(pivots, "shingle").filter("component != own")
    return met.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()


def remaining_pairs(placed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of a member outside the largest component and one of another component that may be links.

    Blocks of the former meet slices of the region, both of bounded size, so that a large region takes
    many tasks.
    """
    open_ = placed.join(_regions(placed), "shingle")
    block = F.pmod(F.hash("doc_id"), F.col("n_blocks"))
    part = F.pmod(F.hash(F.lit(1), "doc_id"), F.col("n_slices"))
    all_blocks = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    all_parts = F.sequence(F.lit(0), F.col("n_slices") - 1)
    rows = ["shingle", "doc_id", "component"]
    outside = open_.filter("component != largest").select(
        *rows, F.lit(False).alias("member"), block.alias("block"), F.explode(all_parts).alias("part")
    )
    inside = open_.select(*rows, F.lit(True).alias("member"), F.explode(all_blocks).alias("block"), part.alias("part"))
    found = (
        outside.union(inside)
        .join(sketches, "doc_id")
        .repartition("shingle", "block", "part")
        .sortWithinPartitions("shingle", "block", "part", "member")
        .mapInArrow(trimmed(_compare), f"a {_kind(placed)}, b {_kind(placed)}")
    )
    return stored(found.distinct(), "remaining-pairs")


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible links between the block rows and the member rows of each (`shingle`, `block`, `part`).

    Block rows come first and are held; member rows only pass by.
    """
    key, held, block = None, [], None
    for batch in batches:
        names = ("shingle", "block", "part", "member", "doc_id", "component", "n")
        table = {c: batch.column(c).to_pylist() for c in names}
        keys = list(zip(table["shingle"], table["block"], table["part"]))
        marks = batch.column("sketch").flatten().to_numpy().view(np.uint64).reshape(len(keys), -1)
        pairs: list[tuple] = []
        i = 0
        while i < len(keys):
            if keys[i] != key:
                key, held, block = keys[i], [], None
            if not table["member"][i]:
                held.append((table["doc_id"][i], table["component"][i], table["n"][i], marks[i]))
                i += 1
                continue
            if block is None:
                block = np.array([h[3] for h in held]).reshape(len(held), -1), np.array([h[2] for h in held], np.int64)
            j = i
            while j < len(keys) and keys[j] == key and j - i < COMPARED_AT_ONCE:
                j += 1
            if held:
                n = np.array(table["n"][i:j], np.int64)
                apart = np.bitwise_count(block[0][:, None] ^ marks[None, i:j]).sum(-1, dtype=np.int64)
                apart = np.maximum(apart, np.abs(block[1][:, None] - n[None]))
                both = block[1][:, None] + n[None]
                for u, m in np.argwhere(100 * (both - apart) >= PERCENT * (both + apart)).tolist():
                    if held[u][1] != table["component"][i + m]:
                        x, y = held[u][0], table["doc_id"][i + m]
                        pairs.append((min(x, y), max(x, y)))
            i = j
        kind = batch.column("doc_id").type
        columns = list(zip(*set(pairs))) if pairs else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], ["a", "b"])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(`doc_id`, `n_shingles`, `component_id`) for every row of the documents."""
    short_batches(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    sets = stored(document_sets(documents), "sets")
    filled = sets.filter("doc_id is not null and n_shingles > 0")
    classes = stored(filled.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "classes")
    ids = stored(classes.select("doc_id").distinct(), "class-ids")
    representatives = only(filled, ids, "doc_id").select("doc_id", F.col("n_shingles").alias("n"), "first", "sketch")
    sketches = stored(representatives.select("doc_id", "n", "sketch").distinct(), "sketches")
    # Counted over the rows with the id of a class: those are the texts that are read again.
    repeated = stored(representatives.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    late = frequent_shingles(representatives).toArrow().column("shingle").to_numpy().view(np.uint64)
    seeds, large, again = _seeds(documents, representatives, late)
    found = stored(small_regions(seeds), "regions")
    members = found.filter("b is null").select("shingle", F.col("a").alias("doc_id"))
    members = stored(members.union(large.select("shingle", "doc_id")).distinct(), "members")
    discard(*again)

    def possible(pairs: DataFrame) -> DataFrame:
        return stored(bounded(pairs, sketches).filter("linkable").select("a", "b").distinct(), "possible")

    small = found.filter("b is not null").select("a", "b").distinct()
    links = verified(documents, possible(small.union(pivot_pairs(members))), repeated)
    placed = stored(_placed(members, links), "placed")
    links = links.union(verified(documents, possible(more_pivot_pairs(placed)), repeated))
    placed = stored(_placed(members, links), "placed")
    links = links.union(verified(documents, remaining_pairs(placed, sketches), repeated))
    links = links.union(_same_id(filled, classes))
    of_node = components(links, "documents").select(F.col("node").alias("doc_id"), "component")
    # Rows that share an id share its component, whichever class they are of.
    own = classes.select("digest", "doc_id").join(of_node, "doc_id", "left")
    own = stored(own.select("digest", F.coalesce("component", "doc_id").alias("component_id")), "class-components")
    with_set = filled.join(own, "digest").select("doc_id", "n_shingles", "component_id")
    empty = sets.filter("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return with_set.union(empty)


def _same_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (`a`, `b`) between the classes that rows of one id are in, as a star for each id."""
    digests = filled.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    several = stored(digests.filter("least != most").select("doc_id"), "ids-of-several")
    rows = only(filled.select("doc_id", "digest"), several, "doc_id").distinct()
    of_class = classes.select("digest", F.col("doc_id").alias("a"))
    rows = stored(rows.join(of_class, "digest").select("doc_id", "a"), "classes-of-ids")
    least = rows.groupBy("doc_id").agg(F.min("a").alias("b"))
    return rows.join(least, "doc_id").filter("a != b").select("b", F.col("a").alias("other")).toDF("a", "b")


def _seeds(
    documents: DataFrame, classes: DataFrame, late: np.ndarray
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(`shingle`, `doc_id`, `n`) of the rare first shingles and, apart, of the frequent ones.

    The third value are the stored tables that both come from. Classes with a frequent shingle among their first get their first shingles anew.
    """
    rows = classes.select("doc_id", "n", "first")
    late = np.sort(late)
    sent = documents.sparkSession.sparkContext.broadcast(late)

    @F.arrow_udf("boolean")
    def has_late(first: pa.Array) -> pa.Array:
        flat = first.flatten().to_numpy().view(np.uint64)
        place = np.minimum(np.searchsorted(sent.value, flat), len(sent.value) - 1)
        hit = np.concatenate([[0], np.cumsum(sent.value[place] == flat)])
        ends = np.cumsum(first.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.array(np.diff(hit[np.concatenate([[0], ends])]) > 0)

    def exploded(rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.explode(column).alias("shingle"), "doc_id", "n")

    if not len(late):
        return exploded(rows, "first"), exploded(rows.filter(F.lit(False)), "first"), []
    marks = stored(rows.select("doc_id", has_late("first").alias("late")).filter("late").select("doc_id").distinct(), "late-ids")
    again = stored(reordered(only(documents, marks, "doc_id"), sent).filter("n > 0"), "reordered")
    same = rows.join(F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks, "doc_id", "left_anti")
    return exploded(same, "first").union(exploded(again, "first")), exploded(again, "late"), [marks, again]
