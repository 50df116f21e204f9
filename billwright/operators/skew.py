"""Joining rows to one value per key when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may hold; a key with more is spread over more tasks.
ROWS_A_TASK = 100_000


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], row_id: Column, min_rows: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` left-joined to ``per_key``, which holds one row per key and its row count ``n``.

    A key with at least ``min_rows`` rows is spread by ``row_id`` over one
    task for each ``min_rows`` of them, and its one ``per_key`` row is copied
    to each. Which keys these are is broadcast, so that rows are shuffled once;
    there are at most as many as rows by ``min_rows``. Null keys join nothing.
    ``n`` is kept.
    """
    salts = F.ceil(F.col("n") / min_rows).cast("long")
    heavy = per_key.where(F.col("n") >= min_rows).select(*keys, salts.alias("_salts"))
    salted = rows.join(F.broadcast(heavy), keys, "left")
    # Rows without a full key are spread too: they would all hash to one task.
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    spread = F.coalesce("_salts", F.when(no_key, F.lit(64).cast("long")), F.lit(1).cast("long"))
    left = salted.withColumn("_salt", F.pmod(F.xxhash64(row_id), spread)).drop("_salts")
    copies = F.sequence(F.lit(0).cast("long"), F.when(F.col("n") >= min_rows, salts).otherwise(1).cast("long") - 1)
    right = per_key.withColumn("_salt", F.explode(copies))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str], alias: str = "first") -> DataFrame:
    """One row per key: struct ``alias`` of the smallest ``order`` values and the count ``n``.

    An aggregate, so each task sends one row per key however many it read.
    """
    if len(order) == 1:  # a plain minimum can be kept in a hash aggregate
        plain = rows.groupBy(*keys).agg(F.min(order[0]).alias("_least"), F.count(F.lit(1)).alias("n"))
        return plain.select(*keys, F.struct(F.col("_least").alias(order[0])).alias(alias), "n")
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias(alias), F.count(F.lit(1)).alias("n"))
