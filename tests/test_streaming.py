"""Streams fed by several files in several triggers give the batch result."""

import pytest
from pyspark.sql import functions as F

from billwright.session import shared_folder
from billwright.sources.derived import table
from billwright.streaming import jobs
from billwright.streaming.lockouts import lockouts, stream_lockouts

SF_DIR = "/root/testdata/sf0.001"


def arriving(spark, rows, order, parts=4):
    """``rows`` as a stream of ``parts`` files read one per trigger in the order of ``order``."""
    path = shared_folder(spark, "inbox")
    total = rows.count()
    ranked = rows.orderBy(order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    df = spark.createDataFrame(ranked, rows.schema.add("n", "long")).cache()
    for i in range(parts):
        piece = df.where(F.floor(F.col("n") * parts / total) == i).drop("n")
        piece.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(path)


def access_log(spark):
    return table(spark, SF_DIR, "access_log").withColumn("ts", F.col("ts").cast("timestamp"))


def test_lockouts(spark):
    stream = stream_lockouts(arriving(spark, access_log(spark), "ts"))
    got = jobs.run_append(stream, shared_folder(spark, "out"), shared_folder(spark, "state"))
    expected = lockouts(access_log(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert expected.count() > 0


def test_requests_per_user_in_any_order(spark):
    """A table, and a stream of many files out of time order, both count every row."""
    calls = access_log(spark).where("action = 'api_request'")
    expected = calls.groupBy(F.window("ts", "1 hour").start.alias("start"), "user_id").count()
    expected = sorted(map(tuple, expected.collect()))
    stored = jobs.requests_per_user(access_log(spark)).select("window.start", "user_id", "requests")
    assert sorted(map(tuple, stored.collect())) == expected
    shuffled = arriving(spark, access_log(spark), F.xxhash64("event_id"), parts=12)
    state = jobs.run_update(jobs.requests_per_user(shuffled), shared_folder(spark, "state"))
    counted = state.select("key.window.start", "key.user_id", F.col("value.count").alias("requests"))
    assert sorted(map(tuple, counted.collect())) == expected


def test_a_watermark_bounds_the_state(spark):
    stream = jobs.requests_per_user(arriving(spark, access_log(spark), "ts"), late="1 hour")
    closed = jobs.run_append(stream, shared_folder(spark, "out"), shared_folder(spark, "state"))
    calls = access_log(spark).where("action = 'api_request'")
    every = {tuple(r) for r in calls.groupBy(F.window("ts", "1 hour").start.alias("start"), "user_id").count().collect()}
    got = {tuple(r) for r in closed.select("window.start", "user_id", "requests").collect()}
    assert got and got < every


def test_latest_status(spark):
    logs = table(spark, SF_DIR, "processing_logs").withColumn("created_at", F.col("created_at").cast("timestamp"))
    state = jobs.run_update(jobs.latest_status(arriving(spark, logs, "id")), shared_folder(spark, "state"))
    got = {r.invoice_key: (r.process_stage, r.n) for r in state.select("key.invoice_key", "value.max.process_stage", F.col("value.count").alias("n")).collect()}
    batch = jobs.latest_status(logs).select("invoice_key", "last.process_stage", "logs").collect()
    assert got == {r.invoice_key: (r.process_stage, r.logs) for r in batch}


@pytest.mark.parametrize("order", ["invoice_key", "file_hash"])
def test_new_files(spark, order):
    rows = spark.range(400).select(
        F.col("id").alias("invoice_key"),
        F.lit("t").alias("tenant_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 90).cast("string")).alias("file_hash"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("created_at"),
    )
    stream = jobs.new_files(arriving(spark, rows, order))
    got = jobs.run_append(stream, shared_folder(spark, "out"), shared_folder(spark, "state"))
    assert sorted(r.file_hash for r in got.collect()) == sorted(r.file_hash for r in rows.select("file_hash").distinct().collect())
