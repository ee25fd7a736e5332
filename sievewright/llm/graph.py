"""Connected components of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, partitions

#: Edges of a partition between rounds, about.
EDGES = 200_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that links (a, b) name; component: the least node reachable.

    Alternates the large-star and small-star steps until the edges stay the same; raises if they don't within the
    rounds, whose number grows with the logarithm of the longest path. The large step is a minimum per node and a join,
    so a node of very many links is neither collected nor kept to one task; the small step looks at smaller neighbours
    alone, of which there are few.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = cut_lineage(edges)
    n = edges.count()
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    many, state = max(1, min(partitions(links.sparkSession), n // EDGES)), None
    smaller = Window.partitionBy("u")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.withColumn("m", F.min("v").over(smaller)).select(F.explode(ends).alias("e")).select("e.*")
        edges = cut_lineage(small.filter("u <> v").distinct().coalesce(many))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"components don't settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
