"""The trie of conversation prefixes by a van Emde Boas recursion on rows.

The depths are cut at half: segments of 2^k turns of equal start and content are one row, which is cut
into its first half (the upper trie) and its second half (the lower forest below the node that the
first half ends at). The cut prefix gets a name, a digest of the segment's start and the half. Both
halves go on in the same table, so all tries of a size are built side by side and the number of steps
is the logarithm of the longest conversation. What was summed up in the lower forests is then grafted
to the upper tries: once upward (the total of a forest goes to its root) and once downward (the total
of a cut node goes to all nodes above it in its segment).

No step holds a conversation, a node's members or its children in one row: halves are joined by
(conversation, block), counts are summed per partition before the shuffle, and the member lists behind
the digests are cut into stretches of ids, which are streamed through the hash in order. A digest of
one node's members is sequential by nature: it is made in one task, with one stretch in memory.

Defined results: rows without conv_id belong to no conversation; NULL role or text is empty; a NULL
turn comes first; turns of equal number go by the digest of role and text, so repeated rows are turns
of their own; conversations without rows do not exist, those that lose all turns stay as members of
the root; an empty table has no nodes; other columns are not read.
"""

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecode.operators.joins import lookup_join
from notecode.operators.ranking import rank_in_group
from notecode.sources.shared_folder import discard, stored

TURNS_PER_STRETCH = 4096
IDS_PER_STRETCH = 4096
SHARED_BY, MOST_SHARED = 100, 5

_ROOT = bytes(16)


def _digest(kind: str, *parts: Column) -> Column:
    """16 bytes that name their parts; `kind` tells names of different uses apart."""
    joined = F.concat(F.lit(kind.encode()), *[p.cast("binary") for p in parts])
    return F.unhex(F.substring(F.sha2(joined, 256), 1, 32))


def turn_digest(role: Column, text: Column) -> Column:
    return _digest("", F.char_length(role).cast("string"), F.lit(":"), role, text)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(`conv_id`, `place` from 0, `key`, `chars`) of every turn, texts replaced by their digests."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint"),
        "turn",
        turn_digest(role, text).alias("key"),
        F.char_length(text).cast("bigint").alias("chars"),
    )
    narrow = stored(narrow, "trie-turns")
    # Turns without a number are told apart by their digest, so that they are no single stretch.
    stretch = F.struct(
        F.coalesce(F.floor(F.col("turn") / TURNS_PER_STRETCH), F.lit(-(1 << 62))).alias("at"),
        F.when(F.col("turn").isNull(), F.substring(F.hex("key"), 1, 2)).otherwise("").alias("part"),
    )
    ranked = rank_in_group(narrow, ["conv_id"], stretch, ["turn", "key"], "place")
    numbered = stored(ranked.select("conv_id", "place", "key", "chars"), "trie-numbered")
    discard(narrow)
    return numbered


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("bigint")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and the ids of all conversations."""
    base = F.col("conv_id") - F.col("conv_id") % SHARED_BY
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", base)
    sizes = stored(sizes.withColumn("h", shared_turns(F.col("conv_id"))), "trie-sizes")
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.join(of_base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    )
    convs = stored(convs, "trie-conversations")
    gaps = convs.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("gap"))
    own = numbered.filter(F.col("place") >= shared_turns(F.col("conv_id")))
    own = lookup_join(own, gaps, ["conv_id"], "left", salt_by=["place"])
    own = own.withColumn("place", F.col("place") - F.coalesce("gap", F.lit(0))).drop("gap")
    first = numbered.filter((F.col("conv_id") % SHARED_BY == 0) & (F.col("place") < MOST_SHARED))
    first = first.withColumnRenamed("conv_id", "base").join(convs.filter("taken > 0"), "base")
    first = first.filter("place < taken").select(own.columns)
    turns = stored(own.unionByName(first).withColumnRenamed("place", "j"), "trie-rebuilt")
    discard(sizes)
    return turns, convs.select("conv_id")


def doubled(blocks: DataFrame) -> DataFrame:
    """Blocks of twice as many turns, with the digests of their halves."""
    even = F.col("j") % 2 == 0
    pairs = blocks.groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(
        F.max(F.when(even, F.col("key"))).alias("left"),
        F.max(F.when(even, F.col("full"))).alias("left_full"),
        F.max(F.when(~even, F.col("key"))).alias("right"),
        F.max(F.when(~even, F.col("full"))).alias("right_full"),
    )
    both = _digest("b", F.col("left"), F.col("right"))
    return pairs.withColumns(
        {
            "key": F.when(F.col("right").isNull(), _digest("p", F.col("left"))).otherwise(both),
            "full": F.col("left_full") & F.coalesce("right_full", F.lit(False)),
        }
    )


def halved(cut: DataFrame) -> DataFrame:
    """The segments of half the length: the distinct first halves, and the second halves."""
    upper = cut.groupBy("start", "left", "left_full", "cut").agg(
        F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min(F.col("j") * 2).alias("j")
    )
    upper = upper.select(
        "start", "conv_id", "j", "n", F.col("cut").alias("end"), F.col("left_full").alias("full"), F.lit(True).alias("upper")
    )
    lower = cut.filter(F.col("right").isNotNull()).select(
        F.col("cut").alias("start"),
        "conv_id",
        (F.col("j") * 2 + 1).alias("j"),
        "n",
        "end",
        F.col("right_full").alias("full"),
        F.lit(False).alias("upper"),
    )
    return upper.unionByName(lower)


def cut_in_half(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """The segments with the digests of their halves and the name of the prefix that the cut ends."""
    halves = blocks.select("conv_id", "j", "left", "left_full", "right", "right_full")
    name = F.when(F.col("left_full"), _digest("n", F.col("start"), F.col("left")))
    return segments.join(halves, ["conv_id", "j"]).withColumn("cut", name)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per class from its stretches, which come in order."""
    now, state, least = None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([least], pa.int64()), "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("class", "least", "ids"))
        for name, first, ids in zip(*columns):
            if name != now:
                if state:
                    yield row()
                now, state, least = name, sha256(), first
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield row()


def member_digests(classes: DataFrame) -> DataFrame:
    """(`conv_id`, `ends_sha256`): the least member and the digest of all member ids, per `class`."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    stretches = classes.groupBy("class", F.floor(F.col("conv_id") / IDS_PER_STRETCH).alias("stretch"))
    stretches = stored(
        stretches.agg(F.min("conv_id").alias("least"), F.array_join(ids, ",").alias("ids")), "trie-members"
    )
    counted = stretches.groupBy("class").agg(
        F.count("*").alias("n"), F.min(F.struct("least", "ids")).alias("first")
    )
    counted = stored(counted.select("class", "n", "first.*"), "trie-classes")
    short = counted.filter("n = 1").select(
        F.col("least").alias("conv_id"), F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256")
    )
    long = stretches.join(counted.filter("n > 1").select("class"), "class", "left_semi")
    ordered = long.repartition("class").sortWithinPartitions("class", "stretch").select("class", "least", "ids")
    return short.unionByName(ordered.mapInArrow(_stream_digests, "conv_id bigint, ends_sha256 string"))


def _summed(totals: DataFrame, *by: str) -> DataFrame:
    return totals.groupBy(*by).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def grafted(cuts: list[DataFrame], spans: list[DataFrame], own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What lies below every node, and below the root, from (`start`, `leaves`, `saved`) of the nodes.

    `cuts[k]` holds (`start`, `end`) of the full upper segments of 2^k turns, `spans[k]` (`end`, `cut`)
    of the full segments of 2^k turns.
    """
    forests = [stored(_summed(own, "start"), "trie-forest-0")]
    for k, level in enumerate(cuts):
        above = level.select(F.col("start").alias("above"), F.col("end").alias("start"))
        raised = forests[-1].join(above, "start", "left").withColumn("start", F.coalesce("above", "start"))
        forests.append(stored(_summed(raised, "start"), f"trie-forest-{k + 1}"))
    below = None
    for k in reversed(range(len(cuts))):
        nodes = cuts[k].select(F.col("end").alias("start")).join(forests[k], "start")
        nodes = nodes.withColumnRenamed("start", "node")
        if below is not None:
            over = below.join(spans[k + 1].withColumnRenamed("end", "node"), "node")
            over = over.select(F.col("cut").alias("node"), "leaves", "saved")
            nodes = nodes.unionByName(below).unionByName(over)
        before, below = below, stored(_summed(nodes, "node"), f"trie-below-{k}")
        discard(*[t for t in (before, forests[k]) if t is not None])
    return below, forests[-1]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the empty one on."""
    numbered = numbered_turns(conversations)
    turns, convs = rebuilt(numbered)
    discard(numbered)
    levels = int(turns.agg(F.coalesce(F.max("j") + 1, F.lit(0))).first()[0]).bit_length()
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = stored(root, "trie-root")
    nobody = sha256(b"").hexdigest()
    empty = F.lit(bytes(1)).alias("class")
    if not levels:
        ended = member_digests(convs.select("conv_id", empty))
        rows = root.join(ended, "conv_id").select(
            "conv_id", F.lit(0).alias("depth"), F.lit(None).alias("parent_conv_id"), "n_convs",
            F.lit(0).alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), "ends_sha256",
        )
        return rows.select(*[F.col(c).cast("bigint") for c in rows.columns[:-1]], "ends_sha256")

    blocks = [turns.withColumn("full", F.lit(True))]
    for k in range(levels):
        blocks.append(stored(doubled(blocks[-1].select("conv_id", "j", "key", "full")), f"trie-blocks-{k + 1}"))

    # The top block is longer than any conversation, so each of its contents is a class of equal ones.
    classes = blocks[levels].select("conv_id", F.col("key").alias("class"))
    turnless = stored(convs.join(classes.select("conv_id"), "conv_id", "left_anti"), "trie-turnless")
    turnless = turnless.select("conv_id", empty)
    ended = stored(member_digests(classes.unionByName(turnless)), "trie-digests")
    segments = blocks[levels].groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    segments = segments.select(
        F.lit(_ROOT).alias("start"), "conv_id", F.lit(0).cast("bigint").alias("j"), "n",
        F.lit(None).cast("binary").alias("end"), F.lit(False).alias("full"), F.lit(True).alias("upper"),
    )
    cut: dict[int, DataFrame] = {}
    for k in range(levels, 0, -1):
        cut[k] = stored(cut_in_half(segments, blocks[k]), f"trie-cut-{k}")
        discard(blocks[k])
        segments = halved(cut[k])

    # Segments of one turn are the nodes: each begins at its parent and ends at itself.
    edges = stored(segments, "trie-edges")
    children = edges.groupBy(F.col("start").alias("end")).agg(F.count("*").alias("n_children"))
    nodes = edges.join(turns.select("conv_id", "j", "chars"), ["conv_id", "j"]).join(children, "end", "left")
    nodes = nodes.select(
        "start",
        "end",
        "conv_id",
        (F.col("j") + 1).alias("depth"),
        "n",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n") - 1) * F.col("chars")).alias("saved"),
    )
    nodes = stored(nodes, "trie-nodes")
    at = {0: edges, **{k: t for k, t in cut.items() if k < levels}}
    cuts = [at[k].filter("upper and full").select("start", "end") for k in range(levels)]
    spans = [edges.limit(0)] + [cut[k].filter("full").select("end", "cut") for k in range(1, levels)]
    below, all_below = grafted(cuts, spans, nodes.select("start", "leaves", "saved"))

    ends = [t.filter("left_full and right is null").select("conv_id", F.col("cut").alias("end")) for t in cut.values()]
    ending = ends[0]
    for more in ends[1:]:
        ending = ending.unionByName(more)
    ending = ending.join(ended, "conv_id").select("end", "ends_sha256")
    parents = stored(nodes.select(F.col("end").alias("start"), F.col("conv_id").alias("parent")), "trie-parents")
    found = nodes.join(ending, "end", "left").join(below.select(
        F.col("node").alias("end"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")
    ), "end", "left")
    under_root = found.filter(F.col("start") == F.lit(_ROOT)).join(F.broadcast(root.select(F.col("conv_id").alias("parent"))))
    others = lookup_join(found.filter(F.col("start") != F.lit(_ROOT)), parents, ["start"], "left", salt_by=["end"])
    rows = others.unionByName(under_root).select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )
    at_root = ended.join(turnless.agg(F.min("conv_id").alias("conv_id")), "conv_id").select("ends_sha256")
    top = root.join(F.broadcast(all_below)).join(
        F.broadcast(children.filter(F.col("end") == F.lit(_ROOT)).select("n_children"))
    ).join(F.broadcast(at_root), how="left")  # each of them has one row
    top = top.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )
    return rows.unionByName(top)
