"""Connected components of a link table that no machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import discard, durable


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node with a link.

    Large-star and small-star steps by turns: each node's neighbours are joined
    to the smallest of them, which halves distances.  A hub is only ever a
    minimum over rows, which is combined before it is shuffled.  Every round is
    written to the shared folder, and the one before it goes; rounds end when
    the links no longer change.
    """
    edges = durable(_once(links.select(F.col("a").alias("x"), F.col("b").alias("y"))), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _star(both, F.col("y") > F.col("x"))
        small = durable(_star(_once(large), F.lit(True)), "links")
        state = small.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0))).first()
        discard(edges)
        if state == before:
            break
        before, edges = state, small
    # at rest every link runs from a node to the smallest of its component
    low = small.select(F.col("x").alias("node"), F.col("y").alias("component"))
    found = low.unionByName(low.select(F.col("component").alias("node"), "component")).distinct()
    found._durable_path = small._durable_path  # the one table it reads, for its owner to discard
    return found


def _once(pairs: DataFrame) -> DataFrame:
    """Links with the larger end first, each once."""
    return pairs.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def _star(pairs: DataFrame, which) -> DataFrame:
    """Join the neighbours y of each x, those that ``which`` picks, and x itself to the smallest of them and x."""
    low = pairs.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("low"))
    joined = pairs.join(low, "x")
    moved = joined.filter(which).select(F.col("y").alias("x"), F.col("low").alias("y"))
    own = low.select("x", F.col("low").alias("y"))
    return moved.unionByName(own).filter("x <> y").distinct()
