"""Connected components of a link table by alternating star steps, each step a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, label): the smallest node that each node reaches.

    Large-star and small-star steps in turn: every node passes the smallest of its neighbours on
    to the others, so that the table ends as one star per component. A star's centre is only ever
    the key of an aggregate or of a join that can be split, and the number of steps grows with the
    logarithm of the longest chain. Self links and repeated links count once; null ends are ignored.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    centre = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(centre)


def _state(edges: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: equal when a step has changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
