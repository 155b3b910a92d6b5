"""Connected components of a graph of links, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.sources.shared_folder import stored

MOST_ROUNDS = 60


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(`node`, `component`) for every node of the links (`a`, `b`); the component is its least node.

    In each round a node joins the neighbour (or itself) that comes first in an order drawn anew, and
    loops and repeated links are dropped. The drawn order lets the number of links fall by a factor
    each round whatever the ids are. Minima are aggregated before they are shuffled and each round's
    tables are stored, so frequent nodes are no burden and nothing depends on earlier rounds.
    """
    links = links.filter(F.col("a") != F.col("b"))
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(links, f"{name}-links")
    roots: DataFrame | None = None
    for number in range(MOST_ROUNDS):
        if links.isEmpty():
            break
        near = F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x in "ab" for y in "ab"])
        ends = links.select(F.inline(near))
        drawn = F.struct(F.xxhash64("other", F.lit(number)), F.col("other").alias("other"))
        parent = ends.groupBy("node").agg(F.min(drawn).alias("first"))
        parent = stored(parent.select("node", F.col("first.other").alias("parent")), f"{name}-parents")
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        moved = links.join(of_a, "a").join(of_b, "b").filter("root_a != root_b")
        moved = moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        links = stored(moved.distinct(), f"{name}-links")
        if roots is None:
            roots = parent.select("node", F.col("parent").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), "parent")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
            roots = stored(roots, f"{name}-roots")
    else:
        raise RuntimeError(f"links are left after {MOST_ROUNDS} rounds")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = stored(roots.groupBy("root").agg(F.min("node").alias("component")), f"{name}-least")
    return roots.join(least, "root").select("node", "component")
