"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stash, unstash


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node long, component long): for every node that is not the smallest of its component, that smallest node.

    Alternates large-star and small-star steps until the edges are stars around the smallest nodes; the number of rounds
    grows with the logarithm of the size. Each round is joins and partial aggregates over node ids, so a node with very
    many edges is split like any other skewed join key; each round ends in a table in the shared folder.
    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stash(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, mark = mark, _mark(after)
        unstash(now)
        now = after
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
