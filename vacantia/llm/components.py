"""Connected components of a link table by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of that node and its neighbours."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    near = links.select(F.inline(ends))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them. links: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, label: str = "links", rounds: int = 60) -> DataFrame:
    """node, root: the least node that each node of `links` (a, b: long) reaches; nodes without a link aren't listed.

    Links of a node to itself and repeated links don't matter; nulls must be left out; no links give no rows. Each
    round is written, so a lost executor costs no earlier round; the end is reached when a round changes no link.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        edges = written(_small_star(_large_star(edges)), label)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
