"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node in ``links`` (columns ``a``, ``b``).

    Alternates two steps until nothing changes: each node hands its larger
    neighbours to the smallest one around it, then its smaller ones. The table
    never grows, each step reduces per node before it joins, and paths halve, so
    the number of rounds is logarithmic. Every round is written to the shared folder.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links)

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(links)
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # every b is below its a
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("s"))
        links = stored(small.select(F.col("s.x").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct())
        before, now = now, state(links)
        if before == now:
            break
    out = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(links.select("b", "b").distinct())
