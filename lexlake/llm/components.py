"""Connected components of a link table, as DataFrame joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored_with


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link: root is the smallest node that it reaches.

    Alternates two steps until nothing changes, in a number of rounds that grows as the logarithm of the longest
    chain: every node hands its smallest neighbour to its larger ones, then to itself and its smaller ones.
    Minima are summed up before the shuffle, and joins with a frequent node are split by adaptive execution. Each
    round is stored in the shared folder, so lineage stays short. Loops, repeated and null links do no harm.
    """
    measures = {"n": F.count("*"), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, was = stored_with(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and u is not null and v is not null").distinct(), **measures)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # A node that hands on its larger neighbours stays linked to its own smallest.
        large = large.union(least.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.select(F.col("u").alias("n"), "m"), F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges, now = stored_with(small, **measures)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
