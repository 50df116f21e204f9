"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.session import staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for links ``a``, ``b`` of whole numbers.

    Alternates large and small star steps: each node's greater, then its
    lesser neighbours are linked to the least node it knows, until nothing
    changes. Roots themselves and nodes without links have no row. Each step
    is a minimum per node and a join, written once; no component is gathered.
    """
    edges = _oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    edges, before = staged(edges, "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _oriented(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(_oriented(small.unionByName(least.select("u", F.col("m").alias("v")))), "small-star")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
