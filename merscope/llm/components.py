"""Connected components of a graph of pairs, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merscope.llm.scratch import saved


def large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node on the smallest of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them; u > v in each edge."""
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m")))
    near = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def near_labels(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` after two steps of passing on the smallest label.

    Nodes of one label are connected; connected nodes may differ. A hub and
    its neighbours get one label, which is what most groups need.
    """
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
    return both.join(least, "v").groupBy(F.col("u").alias("node")).agg(F.min("m").alias("component"))


def components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of each node in ``pairs`` ``(u, v)`` but the smallest of its component.

    ``component`` is the smallest node reachable. Alternates the star steps of
    Kiveris et al. (2014) until the edges stay the same. A node with very many
    neighbours is combined before each shuffle; the smallest neighbours are
    written, so that Spark can split its joins.
    """
    edges = saved(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        edges = saved(small_star(large_star(edges)))
