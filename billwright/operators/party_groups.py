"""Vendors and customers that are stored more than once, as groups.

A group holds all rows that are reached by duplicates: equal values, equal
names at one address, similar names at one address. Pairs are not listed. Names
share a block if they could be similar: short names by the words they share,
long ones by a rare word. Each name of a block is compared with three of its
names, which links nearly all of it; then names that are still apart in a block
are compared with all of it, so no similar pair is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.functions.similarity import name_similarity
from billwright.functions.text import strip, word_set
from billwright.operators.groups import linked_groups
from billwright.operators.party_duplicates import _links
from billwright.operators.skew import attach
from billwright.session import staged

#: Up to this many words in both together, similar names meet in what is left of them without a word or two.
SHORT_UNION = 15

_BLOCK = ["tenant_id", "address", "block"]


def _without_words(words: Column, most: int, threshold: float) -> Column:
    """The words, and what is left without up to ``most`` of them, as far as that is similar enough."""
    left, size = [F.array(words)], F.size(words)
    for d in range(1, most + 1):
        one_less = F.transform(
            left[-1], lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.filter(ws, lambda w, k: k != i))
        )
        nothing = F.array().cast("array<array<string>>")
        left.append(F.when((size - d) / size > threshold, F.array_distinct(F.flatten(one_less))).otherwise(nothing))
    return F.flatten(F.array(*left))


def name_blocks(names: DataFrame, threshold: float) -> DataFrame:
    """tenant_id, address, block and the name, for every block of a name (tenant_id, address, name, first_id).

    Two names above the threshold have a block in common: with at most
    ``SHORT_UNION`` words together, the words they share are what is left of
    both; otherwise both are long and share one of their rarest words.
    """
    n = names.withColumn("words", word_set(F.col("name"))).withColumn("size", F.size("words")).where("size > 0")
    n = staged(n, "names")
    most = math.ceil(round((1 - threshold) * SHORT_UNION, 6)) - 1
    short = n.where(F.col("size") <= SHORT_UNION)
    cores = F.transform(_without_words(F.col("words"), most, threshold), lambda ws: F.concat(F.lit("all "), F.array_join(ws, " ")))
    of_short = short.select("*", F.explode(cores).alias("block"))

    long = n.where(F.col("size") >= math.ceil(round(threshold * (SHORT_UNION + 1), 6)))
    words = long.select("tenant_id", "address", "first_id", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    ranked = words.join(counts, "word").groupBy("first_id").agg(F.sort_array(F.collect_list(F.struct("rows", "word"))).getField("word").alias("rare"))
    prefix = F.slice("rare", F.lit(1), F.col("size") - F.ceil(F.round(F.col("size") * threshold, 6)).cast("int") + 1)
    of_long = long.join(ranked, "first_id").select("*", F.explode(prefix).alias("word")).withColumn("block", F.concat(F.lit("one "), "word"))
    columns = [*_BLOCK, "first_id", "name", "words"]
    return of_short.select(*columns).unionByName(of_long.select(*columns))


def similar_links(names: DataFrame, threshold: float, containment: bool) -> DataFrame:
    """Links a, b between the first ids of similar names, enough to join all that belong together."""
    blocks = staged(name_blocks(names, threshold), "blocks")
    one = F.struct("first_id", "name", "words")
    mixed = F.struct(F.xxhash64("name").alias("mix"), one.alias("one"))
    pivots = blocks.groupBy(*_BLOCK).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(F.min(F.struct(F.size("words").alias("size"), one.alias("one"))).getField("one"), F.min(mixed).getField("one"), F.max(mixed).getField("one")).alias("pivots"),
    )
    pivots = staged(pivots.where(F.col("n") > 1), "pivots")
    score = lambda x, y: name_similarity(F.col(f"{x}name"), F.col(f"{y}name"), F.col(f"{x}words"), F.col(f"{y}words"), containment)
    with_pivots = attach(blocks, pivots, _BLOCK, F.col("first_id")).where(F.col("n").isNotNull()).drop("n")
    tested = with_pivots.withColumn("p", F.explode(F.array_distinct("pivots"))).where(F.col("first_id") != F.col("p.first_id"))
    tested = tested.select("first_id", "name", "words", F.col("p.first_id").alias("p_id"), F.col("p.name").alias("p_name"), F.col("p.words").alias("p_words"))
    near = staged(tested.where(score("", "p_") > threshold).select(F.col("first_id").alias("a"), F.col("p_id").alias("b")).distinct(), "near")

    # blocks whose names are not all in one group yet
    roots = linked_groups(near).withColumnRenamed("node", "first_id")
    rooted = staged(blocks.join(roots, "first_id", "left").withColumn("root", F.coalesce("root", "first_id")), "rooted")
    per_root = rooted.groupBy(*_BLOCK, "root").agg(F.count(F.lit(1)).alias("n"))
    apart = per_root.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).getField("root").alias("main"))
    apart = staged(apart.where("roots > 1").drop("roots"), "apart")
    open_blocks = rooted.join(apart, _BLOCK)
    fields = ["first_id", "name", "words", "root"]
    few = open_blocks.where("root <> main").select(*_BLOCK, *[F.col(c).alias(f"a_{c}") for c in fields])
    every = open_blocks.select(*_BLOCK, "main", *[F.col(c).alias(f"b_{c}") for c in fields])
    pairs = few.join(every, _BLOCK).where((F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("main")) | (F.col("a_root") < F.col("b_root"))))
    between = pairs.where(score("a_", "b_") > threshold).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    return near.unionByName(staged(between, "between"))


def duplicate_groups(rows: DataFrame, same: dict[str, Column], address: list[str], threshold: float, containment: bool) -> DataFrame:
    """tenant_id, id, group_id (its least id), members: every row (id, tenant_id, name, address) that has a duplicate.

    Rows without a name are not compared by it.
    """
    place = F.to_json(F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(address)]))
    base = rows.withColumns({"_name": F.lower(strip(F.col("name"))), "_place": place})
    base = base.select("id", "tenant_id", "_name", "_place", *[v.alias(f"_same_{k}") for k, v in same.items()])
    links = [_links(base.withColumn("_key", F.col(f"_same_{rule}")), ["tenant_id", "_key"], rule) for rule in same]
    links.append(_links(base, ["tenant_id", "_place", "_name"], "name_and_address"))
    names = base.groupBy("tenant_id", F.col("_place").alias("address"), F.col("_name").alias("name")).agg(F.min("id").alias("first_id"))
    edges = similar_links(names, threshold, containment)
    for one in links:
        edges = edges.unionByName(one.select(F.col("id").alias("a"), F.col("duplicate_of").alias("b")))
    roots = staged(linked_groups(edges), "groups")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    tenants = rows.select("id", "tenant_id")
    return roots.join(sizes, "root").join(tenants, roots["node"] == tenants["id"]).select("tenant_id", "id", F.col("root").alias("group_id"), "members")


def vendor_groups(companies: DataFrame) -> DataFrame:
    same = {"name": F.lower("name"), "tax_id": F.col("tax_id")}
    return duplicate_groups(companies, same, ["address_line1", "city", "postal_code"], threshold=0.8, containment=True)


def customer_groups(customers: DataFrame) -> DataFrame:
    same = {"email": F.lower("email"), "tax_id": F.col("tax_id")}
    return duplicate_groups(customers, same, ["address_line1", "city", "postal_code"], threshold=0.9, containment=False)
