"""Repeated files in a stream of headers, with bounded state and nothing lost.

Spark's state remembers a file for as long as ``window`` after it came. It goes
by the time of arrival, which a trigger has one of and which never runs
backwards, so no row is late and none is dropped, whatever its own times say. A
file that comes again after its window passes the state; it is then found among
the stored ones and goes to the side output instead. Every trigger writes the
folders of its own number and reads those of earlier ones only, so it may run
twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.sources import store as stored
from billwright.streaming import jobs

FILES = "tenant_id string, file_hash string"
KEYS = ["tenant_id", "file_hash"]


def _matched(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    named = others.select(*[F.col(k).alias(f"_other_{k}") for k in KEYS])
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in KEYS], how)


def take_batch(arrived: DataFrame, batch: int, path: str) -> None:
    """Store what passed the state in one trigger (tenant_id, file_hash; each once) as new files or as repeats.

    The stored files that match are looked up first: a trigger is small beside
    them, so Spark sends the trigger's rows to them and does not shuffle them.
    """
    spark = arrived.sparkSession
    stored.write_batch(arrived.select(*KEYS), f"{path}/arrived", batch)
    came = spark.read.schema(FILES).parquet(f"{path}/arrived/{stored.BATCH}={batch}")
    known = _matched(stored.batches(spark, f"{path}/files", FILES, before=batch).select(*KEYS), came, "left_semi")
    stored.write_batch(_matched(came, known, "left_semi"), f"{path}/repeats", batch)
    stored.write_batch(_matched(came, known, "left_anti"), f"{path}/files", batch)


def run(headers: DataFrame, path: str, checkpoint: str, window: str = "1 hour") -> list[dict]:
    """Work off what has arrived of a header stream (invoice_key, tenant_id, file_hash); the rows of state after each trigger."""
    arriving = headers.withColumn("created_at", F.current_timestamp())
    query = (
        jobs.new_files(arriving, window)
        .writeStream.foreachBatch(lambda rows, batch: take_batch(rows, batch, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [{"batch": p["batchId"], "rows": [s["numRowsTotal"] for s in p["stateOperators"]]} for p in query.recentProgress]


def files(spark: SparkSession, path: str) -> DataFrame:
    """Every file once, with ``batch``, the trigger it first came in."""
    return stored.batches(spark, f"{path}/files", FILES)


def repeats(spark: SparkSession, path: str) -> DataFrame:
    """Files that came again when the state had forgotten them, with ``batch``: input of ``duplicates.duplicate_files``."""
    return stored.batches(spark, f"{path}/repeats", FILES)
