"""Connected components of a link table by alternating large and small stars; every round is joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.sources.shared import cut, free


def _directed(edges: DataFrame) -> DataFrame:
    """Each link from its larger to its smaller end, once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of all ids in ``edges(a, b)`` that are not their own component.

    A large star joins the larger neighbours of each id to its smallest neighbour, a small star the smaller ones and
    itself; links then form stars after few rounds (logarithmic in the longest path).  No id's neighbours are ever
    collected: each round takes a minimum by id and joins it back.
    """
    now = cut(_directed(edges), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join shuffles both sides anew and the engine can split the links of a hub
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(_directed(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))), "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select("u", "v", "m")
        small = small.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("v").alias("a"), F.col("m").alias("b")))
        after = cut(_directed(small), "links")
        free(after.sparkSession, now, least, large)
        # exact sums over the links: equal ones before and after a round mean that nothing moved
        found = after.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            return after.select(F.col("u").alias("id"), F.col("v").alias("component"))
        now, mark = after, found
