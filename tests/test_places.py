"""Regions by a grid, pages by ranges, folders of files, repeated arrivals."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from billwright.operators import ranges, regions
from billwright.session import shared_folder
from billwright.sources import store, uploads
from billwright.streaming import arrivals


def plan(df):
    return df._jdf.queryExecution().toString()


BLOCKS = "doc_id long, template_id long, block_index int, x double, y double, width double, height double, text string, confidence double"
REGIONS = "template_id long, region string, x double, y double, width double, height double"


def test_regions_equal_brute_force(spark):
    rng = random.Random(5)
    place = lambda: rng.choice([rng.uniform(-500, 3000), float(rng.randrange(-4, 40) * 32)])
    blocks = [
        (d, d % 4 if d % 9 else None, i, place(), place(), rng.choice([0.0, 10.0, 64.0]), rng.choice([0.0, 7.5, 32.0]),
         rng.choice(["a", " b ", "", "c d", None]), rng.choice([0.5, 0.25, 1.0]))
        for d in range(30) for i in range(25)
    ] + [(1, 1, 99, None, 5.0, 1.0, 1.0, "lost", 0.5)]
    shapes = [
        (t, f"r{t}_{i}", place(), place(), rng.choice([0.0, -5.0, 1.0, 32.0, 33.0, 64.0, 900.0, 5000.0]), rng.choice([1.0, 32.0, 700.0, 1e6]))
        for t in range(4) for i in range(60)
    ] + [(0, "nowhere", None, 1.0, 10.0, 10.0)]
    want = {}
    for d, t, i, x, y, w, h, text, confidence in blocks:
        if x is None or not (text or "").strip():
            continue
        for rt, name, rx, ry, rw, rh in shapes:
            if rt == t and rx is not None and rx <= x + w / 2 < rx + rw and ry <= y + h / 2 < ry + rh:
                want.setdefault((d, name), []).append((i, text.strip(), confidence))
    want = {k: (" ".join(t for _, t, _ in sorted(v)), pytest.approx(sum(c for *_, c in v) / len(v)), len(v)) for k, v in want.items()}
    for cell in (regions.CELL, 3.0, 1e5):
        found = regions.region_text(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(shapes, REGIONS), cell)
        assert {(r.doc_id, r.region): (r.text, r.confidence, r.block_count) for r in found.collect()} == want
    assert len(want) > 150


def test_regions_that_share_a_name_are_one(spark):
    blocks = [(d, t, i, 40.0 * i, 0.0, 2.0, 2.0, f"t{i}", c) for d, t in ((1, 0), (1, 1), (2, 1), (None, 1)) for i, c in ((0, 0.5), (1, None), (3, 0.25))]
    shapes = [(0, "a", 0.0, 0.0, 50.0, 9.0), (1, "a", 0.0, 0.0, 300.0, 9.0), (1, "a", 0.0, 0.0, 300.0, 9.0), (1, None, 30.0, 0.0, 20.0, 9.0), (1, "b", 0.0, 0.0, 9.0, 9.0)]
    rows = regions.region_text(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(shapes, REGIONS)).collect()
    twice, mean = "t0 t0 t1 t1 t3 t3", 1.5 / 6
    assert {(r.doc_id, r.region): (r.text, r.confidence, r.block_count) for r in rows} == {
        (1, "a"): ("t0 t0 t0 t1 t1 t1 t3 t3", 2.0 / 8, 8),
        **{(d, "a"): (twice, mean, 6) for d in (2, None)},
        **{(d, None): ("t1", None, 1) for d in (1, 2, None)},
        **{(d, "b"): ("t0", 0.5, 1) for d in (1, 2, None)},
    }
    assert len(rows) == 9


def test_what_regions_hold_is_not_shuffled(spark):
    blocks = spark.range(200).select(
        (F.col("id") % 4).alias("doc_id"), F.lit(0).alias("template_id"), F.col("id").cast("int").alias("block_index"),
        *[F.lit(1.0).alias(k) for k in ("x", "y", "width", "height")], F.lit("t").alias("text"), F.lit(0.5).alias("confidence"),
    )
    shapes = spark.range(500).select(
        F.lit(0).alias("template_id"), F.col("id").cast("string").alias("region"),
        *[F.lit(0.0).alias(k) for k in ("x", "y")], *[F.lit(9.0).alias(k) for k in ("width", "height")],
    )
    found = regions.region_text(blocks, shapes)
    assert found.agg(F.count("*"), F.sum("block_count")).first() == (2000, 100_000)
    alone = found._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert "Aggregate" not in alone


def test_regions_join_by_cells(spark):
    found = regions.region_text(spark.createDataFrame([], BLOCKS), spark.createDataFrame([], REGIONS))
    assert found.collect() == []
    shapes = spark.range(3000).select(
        (F.col("id") % 3).alias("template_id"), F.col("id").cast("string").alias("region"), *[(F.col("id") % 90 + 1).alias(k) for k in ("x", "y", "width", "height")]
    )
    assert regions.in_cells(shapes).groupBy("template_id", "region").count().agg(F.max("count")).first()[0] <= 4
    joined = plan(regions.blocks_in_regions(spark.createDataFrame([], BLOCKS), shapes))
    assert "NestedLoop" not in joined and "Cartesian" not in joined


def numbered(spark):
    """Rows with a time that half of them share, missing times and numbers of both signs."""
    base = datetime(2001, 1, 1)
    rows = [
        (i, None if i % 11 == 0 else base if i % 2 else base + timedelta(microseconds=(i * 7919) % 10**9), (i * 31) % 1000 - 500, base.date() + timedelta(days=i % 3))
        for i in range(1200)
    ]
    return spark.createDataFrame(rows, "id long, at timestamp_ntz, n int, day date").withColumn("ts", F.expr("cast(at as timestamp)"))


@pytest.mark.parametrize(
    "order",
    [
        [ranges.Key("at", True), ranges.Key("id")],
        [ranges.Key("ts"), ranges.Key("n", True), ranges.Key("id", True)],
        [ranges.Key("day", True), ranges.Key("n"), ranges.Key("id")],
    ],
)
def test_pages_equal_a_sort(spark, order):
    rows = numbered(spark).repartition(5).cache()
    sorted_ids = [r.id for r in rows.orderBy(*[k.order() for k in order]).collect()]
    for number, per_page in ((1, 20), (7, 100), (30, 33)):
        page = ranges.page_by_ranges(rows, order, number, per_page, ranges=8, few=15).collect()
        assert [r.id for r in page] == sorted_ids[(number - 1) * per_page : number * per_page]
        for r in page:
            assert (r.total, r.page, r.pages) == (1200, number, -(-1200 // per_page))
            assert (r.has_prev, r.has_next) == (number > 1, number * per_page < 1200)
    assert ranges.page_by_ranges(rows, order, 999, 20).collect() == []
    assert ranges.page_by_ranges(rows.limit(0), order, 1, 20).collect() == []


def test_pages_of_extreme_numbers_and_equal_rows(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**63 - 2, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in ends], "v long")
    for descending in (False, True):
        for number in (1, 4, 7):
            page = ranges.page_by_ranges(rows, [ranges.Key("v", descending)], number, 1, few=1).collect()
            assert [r.v for r in page] == [sorted(ends, reverse=descending)[number - 1]]
    same = spark.range(50).select(F.lit(3).alias("v"))
    assert ranges.page_by_ranges(same, [ranges.Key("v")], 3, 20, few=5).count() == 10
    with pytest.raises(ValueError):
        ranges.page_by_ranges(spark.createDataFrame([("a",)], "v string"), [ranges.Key("v")])
    with pytest.raises(ValueError):
        ranges.page_by_ranges(same, [ranges.Key("v")], 0)


def test_pages_push_the_range_to_the_scan(spark):
    folder = shared_folder(spark, "sorted")
    spark.range(20000).select("id", F.timestamp_seconds("id").alias("at")).repartitionByRange(4, "at").write.parquet(folder)
    stored = spark.read.parquet(folder)
    page = ranges.page_by_ranges(stored, [ranges.Key("at", True), ranges.Key("id")], 150, 100, few=300)
    assert [r.id for r in page.collect()] == list(range(20000 - 14901, 20000 - 15001, -1))
    assert "GreaterThanOrEqual(at," in plan(page) and "LessThanOrEqual(at," in plan(page)


def test_blocks_are_shuffled_before_they_are_copied_into_cells(spark):
    blocks = spark.createDataFrame([(d, d % 2, i, "t", 0.5, 5.0, 10.0 * i) for d in range(4) for i in range(6)], "doc_id long, template_id long, block_index int, text string, confidence double, cx double, cy double")
    physical = plan(regions._documents_in_cells(blocks, [0, 1], regions.CELL)).split("Physical Plan")[-1]
    dealt = [x for x in physical.split("\n") if "Exchange" in x]
    assert len(dealt) == 1 and "level" not in dealt[0] and physical.index("Generate") < physical.index("Exchange")


def test_refused_files_are_listed_only(spark):
    folder = shared_folder(spark, "files")
    rows = [
        ("t 1", "a.pdf", b"12"), ("t 1", "b.PnG", b"12345"), ("t 1", "c", b"1"), ("t/2", "d.pdf.txt", b"1"), ("t/2", "e.jpeg", b""),
        ("t/2", "f.jpg", None), (None, "g.pdf", b"12"), ("t 1", "", b"1"), ("7", "h.jpgx", b"1"), ("7", "my scan%20.JPG", b"9"),
    ]
    files = spark.createDataFrame(rows, "tenant_id string, filename string, content binary")
    uploads.write_files(files, folder)
    uploads.write_files(files, folder)  # a task that runs twice
    found = {(r.tenant_id, r.original_filename): r for r in uploads.ingest_files(spark, folder, date(2024, 1, 2), max_bytes=4).collect()}
    assert len(found) == 9
    reasons = {k: r.reject_reason for k, r in found.items() if r.reject_reason}
    kind = "File type not allowed"
    assert reasons == {("t 1", "b.PnG"): "File too large", ("t 1", "c"): kind, ("t/2", "d.pdf.txt"): kind, ("7", "h.jpgx"): kind}
    assert found["t 1", "a.pdf"].file_hash == found[None, "g.pdf"].file_hash and found["t/2", "e.jpeg"].file_size == 0
    assert all((r.file_hash is None) == (r.reject_reason is not None) for r in found.values())
    scan = plan(uploads.accepted_files(spark, folder, max_bytes=4).select("content"))
    assert "LessThanOrEqual(length,4)" in scan
    # the names alone decide what is opened: a listing does not read contents
    scans = [x for x in plan(uploads.refused_files(spark, folder)).split("Physical Plan")[-1].split("\n") if "FileScan binaryFile" in x]
    assert scans and not any("content" in x for x in scans)


def test_no_extension_matches_in_part(spark):
    assert uploads.name_pattern(("pdf", "7z")) == "*.{[pP][dD][fF],7[zZ]}"


HEADERS = "invoice_key long, tenant_id string, file_hash string"


def test_arrivals_keep_every_file_once_with_bounded_state(spark):
    folder = shared_folder(spark, "headers")
    triggers = [[(100 * b + i, f"t{i % 2}", f"h{(b * 5 + i) % 30}") for i in range(20)] + [(100 * b + 50, None, "n"), (100 * b + 51, "t0", None)] for b in range(5)]
    for rows in triggers:
        spark.createDataFrame(rows, HEADERS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(HEADERS).option("maxFilesPerTrigger", 1).parquet(folder)
    path = shared_folder(spark, "arrivals")
    progress = arrivals.run(stream, path, shared_folder(spark, "arrivals-state"), "0 seconds")
    every = {(t, h) for rows in triggers for _, t, h in rows}
    got = [(r.tenant_id, r.file_hash) for r in arrivals.files(spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == every
    again = [(r.tenant_id, r.file_hash) for r in arrivals.repeats(spark, path).collect()]
    assert set(again) <= every and (None, "n") in again and len(again) > 10
    # the state holds what came last, not every file there is
    assert max(p["rows"][-1] for p in progress) < len(every)


def test_arrivals_may_run_a_trigger_twice(spark):
    path = shared_folder(spark, "arrivals")
    frame = lambda *rows: spark.createDataFrame(rows, arrivals.FILES)
    for _ in range(2):
        arrivals.take_batch(frame(("a", "1"), ("a", None)), 0, path)
    for _ in range(2):
        arrivals.take_batch(frame(("a", "1"), ("b", "1"), ("a", None)), 1, path)
    arrivals.take_batch(frame(("a", "1"), ("a", None)), 0, path)
    seen = lambda rows: sorted((r.tenant_id, r.file_hash or "", r[store.BATCH]) for r in rows.collect())
    assert seen(arrivals.files(spark, path)) == [("a", "", 0), ("a", "1", 0), ("b", "1", 1)]
    assert seen(arrivals.repeats(spark, path)) == [("a", "", 1), ("a", "1", 1)]
