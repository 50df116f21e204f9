"""Groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.session import staged


def _pointed_to_the_end(parent: DataFrame) -> DataFrame:
    """``node``, ``parent`` with every node pointing to the end of its chain; each round halves the chains."""
    parent = staged(parent, "parents")
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        longer = staged(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        if longer.where("moved").isEmpty():
            return longer.select("node", "parent")
        parent = longer.drop("moved")


def linked_groups(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that links ``a``, ``b`` reach; nodes without links have no row.

    Round by round every node that has a lesser neighbour points to the least
    of them, chains are shortened, and links are drawn between the ends that
    are left. At least half of the nodes with a link go in a round.
    """
    edge = lambda u, v: [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]
    edges = staged(links.where("a <> b").select(*edge("a", "b")).distinct(), "links")
    roots = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct().withColumn("root", F.col("node"))
    roots = staged(roots, "roots")
    while not edges.isEmpty():
        parent = _pointed_to_the_end(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")))
        ends = parent.select(F.col("node").alias("root"), "parent")
        roots = staged(roots.join(ends, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        above = lambda column: parent.select(F.col("node").alias(column), F.col("parent").alias(f"{column}_end"))
        moved = edges.join(above("u"), "u").join(above("v"), "v", "left").select(F.col("u_end").alias("a"), F.coalesce("v_end", "v").alias("b"))
        edges = staged(moved.where("a <> b").select(*edge("a", "b")).distinct(), "links")
    return roots
