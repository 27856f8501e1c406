"""Connected components of an edge list, by alternating large and small stars.

Every round replaces edges by edges to smaller nodes and leaves the components as they are; it
ends with one star per component, after about log(n) rounds. A hub that a third of all edges
touch only meets them in joins, which Spark may split, and in minima, which combine before the
shuffle. Each round is written to the checkpoint folder.
"""

from pyspark.sql import functions as F

from towerlens.session import materialise


def _state(edges):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"))
    return tuple(row.first())


def components(edges):
    """(node, component) of every node that has an edge; ``edges`` are (a, b) of longs.

    A component is named by its smallest node, which has a row of its own too.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = materialise(pairs.filter("hi != lo").distinct())
    state = _state(pairs)
    while state[0]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo")
        pairs = materialise(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = _state(pairs)
        if now == state:
            break
        state = now
    found = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionAll(roots)
