"""Exact duplicates by deterministic block naming, with DataFrame functions only.

Texts are cut into blocks of a fixed size. The distinct blocks are sorted, by a hash
and then by content, and numbered: equal blocks get one number, unequal ones never do. Then adjacent
numbers are paired and the distinct pairs sorted and numbered, level by level,
until each text has one number, its identity. Texts of unlike length or
checksum are unlike, so only texts that share both are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.llm import common
from billwright.session import staged

#: Characters of a block.
BLOCK = 4096


def _named(values: DataFrame, columns: list[str], level: int) -> DataFrame:
    """The distinct values in sorted order with an integer name each.

    Written, so that the numbers stay the same if tasks are run again.
    """
    distinct = values.select(*columns).distinct().withColumn("_hash", F.xxhash64(*columns))
    # ranges are of a hash: the driver samples numbers, not blocks
    ordered = distinct.repartitionByRange("_hash").sortWithinPartitions("_hash", *columns)
    return staged(ordered.withColumn("name", F.monotonically_increasing_id()).drop("_hash"), f"names-{level}")


def identities(texts: DataFrame, max_chars: int) -> DataFrame:
    """``_doc`` and its identity ``name``, for rows of ``_doc`` and ``_text``."""
    block = F.posexplode_outer(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    blocks = texts.select("_doc", block.alias("pos", "block")).select(
        "_doc", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("block", F.lit("")).alias("block")
    )
    rows = staged(blocks.join(_named(blocks, ["block"], 0), "block").select("_doc", "pos", "name"), "level-0")
    left, level = -(-max_chars // BLOCK), 0
    while left > 1:
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = rows.groupBy("_doc", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("second"),
        )
        names = _named(pairs, ["first", "second"], level)
        rows = staged(pairs.join(names, ["first", "second"]).select("_doc", "pos", "name"), f"level-{level}")
        left = -(-left // 2)
    return rows.select("_doc", "name").distinct()


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row the id of the row that stays of its group of equal texts.

    Texts are equal if they are the same after A-Z are lower-cased; null
    counts as empty. Of a group the row with the largest id stays. Gives the
    id column, ``keep_id``, ``group_size`` (rows), ``kept``, ``text_sha256``
    and ``row_key``, one row for each row. Repeated rows each count and share
    their fate; rows that share an id but not the text are apart (``row_key``
    tells them). A null id is less than any other; if all ids of a group are
    null, all its rows stay. Other columns are not read.
    """
    text = common.folded(F.col(text_col).cast("string"))
    key = F.xxhash64(F.col(id_col), text)
    doc = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), key.cast("string"))
    profile = staged(
        docs.select(
            F.col(id_col).alias("_id"),
            doc.alias("_doc"),
            key.alias("row_key"),
            F.length(text).alias("_chars"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.sha2(text, 256).alias("text_sha256"),
        ),
        "profiles",
    )
    # aggregates that rows are joined with are written, so that the rows of a hot group can be split
    shared = staged(profile.groupBy("_chars", "_crc").count().where("count > 1").select("_chars", "_crc"), "shared")
    alike = staged(profile.join(shared, ["_chars", "_crc"], "left_semi"), "alike")
    most = alike.agg(F.max("_chars")).first()[0] or 0
    rows = docs.select(key.alias("row_key"), doc.alias("_doc"), text.alias("_text"))
    wanted = common.semi_by_id(rows, alike.select("row_key").distinct(), "row_key")
    named = staged(alike.join(identities(wanted, most), "_doc"), "identities")
    groups = named.groupBy("_chars", "_crc", "name").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = named.join(staged(groups, "groups"), ["_chars", "_crc", "name"])
    single = profile.join(shared, ["_chars", "_crc"], "left_anti")
    columns = [F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", "row_key"]
    return (
        single.withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long")})
        .unionByName(grouped.select("_id", "_doc", "row_key", "_chars", "_crc", "text_sha256", "keep_id", "group_size"))
        .withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
        .select(*columns)
    )
