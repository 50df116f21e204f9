"""Vendors and customers stored more than once.

The result is a list of links, not of all pairs: each row of a group of equal
values links to the group's first row, and two groups with similar names link
through their first rows. Two rows are duplicates exactly when they share a
group or their groups are linked, so nothing is lost and a group of a million
copies gives a million links.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.functions.similarity import name_similarity
from billwright.functions.text import strip, word_set
from billwright.operators.skew import attach, first_per_key
from billwright.session import staged


def _links(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Links from every row of a group to its first row."""
    usable = rows
    for k in keys:
        usable = usable.where(F.col(k).isNotNull() & (F.col(k) != ""))
    firsts = staged(first_per_key(usable, keys, ["id"]).where(F.col("n") > 1), "groups")
    return (
        attach(usable, firsts, keys, F.col("id"))
        .where(F.col("id") > F.col("first.id"))
        .select("tenant_id", "id", F.col("first.id").alias("duplicate_of"), F.lit(rule).alias("rule"))
    )


def _similar_names(names: DataFrame, threshold: float, containment: bool) -> DataFrame:
    """Pairs of different names at one address with similarity above ``threshold``.

    Word sets above the threshold are equal, or one holds the other and one
    word more, or (only when both are long) differ in more words. The first
    two are equality joins on the set and on the set without one word. The
    last is found on the rarest words, where such pairs must meet.
    """
    n = names.select("tenant_id", "address", "name", "first_id", word_set(F.col("name")).alias("words"))
    n = n.withColumns({"size": F.size("words"), "word_key": F.array_join("words", " ")}).where(F.col("size") > 0)
    place = ["tenant_id", "address"]
    fields = ["name", "first_id", "words"]
    side = lambda df, s: df.select(*place, *[F.col(c).alias(f"{c}_{s}") for c in fields], *[c for c in df.columns if c.startswith("_")])

    keyed = n.withColumn("_key", F.col("word_key"))
    same_set = side(keyed, "a").join(side(keyed, "b"), [*place, "_key"]).where("name_a < name_b")

    ratio = F.col("size") - 1
    larger = n.where(ratio / F.col("size") > threshold).withColumn(
        "_key",
        F.explode(F.transform("words", lambda w: F.array_join(F.filter("words", lambda x: x != w), " "))),
    )
    one_more = side(keyed, "a").join(side(larger, "b"), [*place, "_key"])

    # With at most this many words in both together, one word is all they can differ by.
    short_union = math.floor(round(2 / (1 - threshold), 6))
    long = n.where(F.col("size") >= math.ceil(round(threshold * (short_union + 1), 6)))
    words = long.select(*place, "name", "first_id", "words", "size", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    ranked = (
        words.join(counts, "word")
        .groupBy(*place, "name", "first_id", "words", "size")
        .agg(F.sort_array(F.collect_list(F.struct("rows", "word"))).getField("word").alias("by_rarity"))
    )
    prefix = F.slice("by_rarity", F.lit(1), F.col("size") - F.ceil(F.round(F.col("size") * threshold, 6)).cast("int") + 1)
    rare = ranked.withColumn("_key", F.explode(prefix)).select(*place, *fields, "_key")
    several = side(rare, "a").join(side(rare, "b"), [*place, "_key"]).where("name_a < name_b")
    differing = F.size(F.array_union("words_a", "words_b")) - F.size(F.array_intersect("words_a", "words_b"))
    several = several.where(differing > 1).drop("_key").distinct()

    pairs = same_set.drop("_key").unionByName(one_more.drop("_key")).unionByName(several)
    score = name_similarity(F.col("name_a"), F.col("name_b"), F.col("words_a"), F.col("words_b"), containment)
    return pairs.where(score > threshold)


def duplicate_links(
    rows: DataFrame, same: dict[str, Column], address: list[str], threshold: float, containment: bool
) -> DataFrame:
    """tenant_id, id, duplicate_of, rule for rows(id, tenant_id, name, address columns)."""
    place = F.to_json(F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(address)]))
    base = rows.withColumns({"_name": F.lower(strip(F.col("name"))), "_place": place})
    out = [_links(base.withColumn("_key", value), ["tenant_id", "_key"], rule) for rule, value in same.items()]
    out.append(_links(base, ["tenant_id", "_place", "_name"], "name_and_address"))
    names = base.groupBy("tenant_id", F.col("_place").alias("address"), F.col("_name").alias("name")).agg(F.min("id").alias("first_id"))
    pairs = _similar_names(staged(names, "names"), threshold, containment)
    out.append(
        pairs.select(
            "tenant_id",
            F.greatest("first_id_a", "first_id_b").alias("id"),
            F.least("first_id_a", "first_id_b").alias("duplicate_of"),
            F.lit("similar_name").alias("rule"),
        )
    )
    result = out[0]
    for one in out[1:]:
        result = result.unionByName(one)
    return result


def vendor_duplicates(companies: DataFrame) -> DataFrame:
    return duplicate_links(
        companies,
        {"name": F.lower("name"), "tax_id": F.col("tax_id")},
        ["address_line1", "city", "postal_code"],
        threshold=0.8,
        containment=True,
    )


def customer_duplicates(customers: DataFrame) -> DataFrame:
    return duplicate_links(
        customers,
        {"email": F.lower("email"), "tax_id": F.col("tax_id")},
        ["address_line1", "city", "postal_code"],
        threshold=0.9,
        containment=False,
    )
