"""Batches of texts into stored tables: replays, several batches, failures, untouched partitions."""

import json
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from billwright.config import RuleSet
from billwright.operators import intake, match
from billwright.session import batch_settings, shared_folder
from billwright.sources import store
from billwright.sources.derived import table
from billwright.streaming import intake as stream

SF_DIR = "/root/testdata/sf0.001"
DAY, RULES = date(2000, 6, 30), RuleSet()
COMPANY = (
    "id string, tenant_id string, name string, tax_id string, email string, phone string, address_line1 string, website string,"
    " city string, state_province string, postal_code string, country string, confidence_score double, currency string, is_active boolean, notes string"
)
CUSTOMER = (
    "id string, tenant_id string, name string, email string, phone string, billing_address_line1 string, billing_city string,"
    " confidence_score double, customer_type string, is_active boolean"
)


def text(number, vendor, customer="Jane Doe", extra="", total="6.00"):
    return (
        f"{vendor}\nPhone: (555) 123-4567\n12 Main Street\nSpringfield, IL 10001\nInvoice #: {number}\nDate: 01/02/2000\nBill To: {customer}\n9 Elm Ave\n\n"
        f"Description Quantity Price Amount\nwidget 2 3.00 6.00\nSubtotal: $6.00\nTotal: ${total}\n{extra}"
    )


def batch(spark, rows):
    rows = [(k, t, datetime(2000, 1, 1, 0, 0, k % 60), x) for k, t, x in rows]
    return spark.createDataFrame(rows, "invoice_key long, tenant_id string, created_at timestamp, text string")


def headers(spark, rows):
    columns = [c.split()[0] for c in intake.HEADER.split(", ")]
    return spark.createDataFrame([tuple({"processing_status": "pending", "requires_review": False} .get(c, r.get(c)) for c in columns) for r in rows], intake.HEADER)


def parties(spark):
    company = [("c1", "t1", "Acme Tools", "", "", "", "", "", "", "", "", "", 0.5, "EUR", True, "kept"), ("c2", "t2", "Other", "", "", "", "", "", "", "", "", "", 0.5, "USD", True, None)]
    customer = [("u1", "t1", "Jane Doe", "", "", "", "", 0.5, "business", True)]
    return spark.createDataFrame(company, COMPANY), spark.createDataFrame(customer, CUSTOMER)


FIRST = [
    (1, "t1", text("A-1001", "Acme Tools")),
    (2, "t1", text("A-1002", "Fresh Farm", "New Buyer")),
    (3, "t1", text("B" * 120, "Acme Tools")),
    (4, "t1", None),
    (5, "t2", text("A-1005", "Fresh Farm", extra="Shipping: $9999999999999.99")),
    (6, "t2", ""),
]
SECOND = [(7, "t1", text("A-1007", "Fresh Farm", "New Buyer") + "Email: info@fresh.example.com"), (2, "t1", text("A-2002", "Fresh Farm", "New Buyer").replace("widget 2 3.00 6.00\n", ""))]


def stored(spark):
    return headers(spark, [
        {"invoice_key": 2, "tenant_id": "t1", "invoice_number": "PENDING", "invoice_date": DAY, "po_number": "PO-77", "due_date": date(2000, 3, 3), "original_filename": "two.pdf", "file_size": 12},
        {"invoice_key": 3, "tenant_id": "t1", "invoice_number": "OLD-3", "po_number": "PO-3"},
        {"invoice_key": 99, "tenant_id": "t1", "invoice_number": "OLD-99"},
    ])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_batch_and_its_failures(spark):
    done = intake.process_batch(batch(spark, FIRST), stored(spark), *parties(spark), DAY, RULES)
    got = {r.invoice_key: r for r in done.headers.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and done.counts == {"texts": 6, "failed": 3, "review": sum(r.requires_review for r in got.values())}
    assert (got[1].invoice_number, got[1].company_id, got[1].customer_id, got[1].processing_status) == ("A-1001", "c1", "u1", "completed")
    # found values replace what was stored, values that were not found stay
    assert (got[2].invoice_number, got[2].po_number, got[2].due_date, got[2].company_id) == ("A-1002", "PO-77", date(2000, 3, 3), "CO-new-2")
    assert (got[2].original_filename, str(got[2].total_amount), got[2].line_items_count) == ("two.pdf", "6.00", 1)
    # failed rows keep everything and are marked
    assert (got[3].invoice_number, got[3].po_number, got[3].processing_status, got[3].requires_review) == ("OLD-3", "PO-3", "failed", True)
    assert (got[4].invoice_number, got[4].invoice_date, got[4].company_id, str(got[4].total_amount)) == ("PENDING", DAY, None, "0.00")
    assert got[5].processing_status == "failed" and got[6].processing_status == "failed" and got[6].invoice_number == "PENDING"

    logs = {}
    for r in sorted(done.logs.collect(), key=lambda r: r.step):
        logs.setdefault(r.invoice_key, []).append(r)
    stages = ["upload", "processing_start", "ocr", "extraction", "validation", "completion"]
    assert [r.process_stage for r in logs[1]] == stages and {r.log_level for r in logs[1]} == {"INFO"}
    assert [r.process_stage for r in logs[3]] == [*stages[:3], "error"] and [r.process_stage for r in logs[4]] == [*stages[:2], "error"]
    details = {k: (v[-1].log_level, v[-1].error_code, v[-1].error_details) for k, v in logs.items() if v[-1].process_stage == "error"}
    assert details == {
        3: ("ERROR", "PROCESSING_FAILED", "value too long for invoice_number: 120 of 100"),
        4: ("ERROR", "PROCESSING_FAILED", "no recognised text"),
        5: ("ERROR", "PROCESSING_FAILED", "value out of range for total_amount"),
    }
    assert logs[2][0].message == "Invoice uploaded: two.pdf (12 bytes)" and logs[6][-1].message.endswith("status: failed")
    assert json.loads(logs[1][3].metadata)["total_line_items"] == 1 and json.loads(logs[1][4].metadata)["is_valid"] is True
    assert rows_of(done.lines.select("invoice_key", "line_number", "description", F.col("unit_price").cast("string"), "unit_of_measure")) == [
        (1, 1, "widget", "3.0000", "each"),
        (2, 1, "widget", "3.0000", "each"),
    ]
    vendors = {r.id: r for r in done.vendors.collect()}
    assert set(vendors) == {"c1", "CO-new-2"}  # neither c2, which no text names, nor rows of failed texts
    assert (vendors["c1"].phone, vendors["c1"].city, vendors["c1"].currency, vendors["c1"].notes, vendors["c1"].confidence_score) == ("(555) 123-4567", "Springfield", "EUR", "kept", 0.5)
    assert (vendors["CO-new-2"].name, vendors["CO-new-2"].currency, vendors["CO-new-2"].state_province) == ("Fresh Farm", "USD", "IL")
    assert {r.id: r.customer_type for r in done.customers.collect()} == {"u1": "business", "CU-new-2": "individual"}


def tables(spark, path):
    return {k: rows_of(v) for k, v in stream.current(spark, path, COMPANY, CUSTOMER).items()}


def seeded(spark):
    path = shared_folder(spark, "store")
    stream.seed(path, stored(spark), *parties(spark))
    return path


def test_batches_run_again_change_nothing_and_follow_each_other(spark):
    path = seeded(spark)
    take = lambda n, rows: stream.take_batch(batch(spark, rows), n, path, DAY, COMPANY, CUSTOMER, RULES)
    assert tables(spark, path)["headers"] == rows_of(stored(spark))
    take(0, FIRST)
    once = tables(spark, path)
    take(0, FIRST)
    assert tables(spark, path) == once and len(once["headers"]) == 7
    take(1, SECOND)
    twice = tables(spark, path)
    take(0, FIRST)  # also when later batches are there
    take(1, SECOND)
    assert tables(spark, path) == twice
    kept = {r[0]: r for r in twice["headers"]}
    assert kept[2][2] == "A-2002" and kept[7][6] == kept[2][6] == "CO-new-2"  # found in the second batch as stored
    assert [r[0] for r in twice["lines"]] == [1, 7]  # the new text of invoice 2 has no line
    assert [r[4] for r in twice["vendors"] if r[0] == "CO-new-2"] == ["info@fresh.example.com"]
    assert sum(r[0] == 2 for r in twice["logs"]) == 12


def test_a_batch_without_its_last_table_is_not_seen(spark):
    path = seeded(spark)
    done = intake.process_batch(batch(spark, FIRST), stored(spark), *parties(spark), DAY, RULES)
    for name in ("headers", "lines"):
        store.write_batch(getattr(done, name), f"{path}/{name}", 0)
    assert tables(spark, path)["headers"] == rows_of(stored(spark)) and tables(spark, path)["lines"] == []


def test_the_stream_gives_what_its_batches_give(spark):
    texts = table(spark, SF_DIR, "invoice_texts").where("invoice_key < 400")
    companies, customers = table(spark, SF_DIR, "companies"), table(spark, SF_DIR, "customers")
    schemas = [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) for d in (companies, customers)]
    nothing = spark.createDataFrame([], intake.HEADER)
    inbox = shared_folder(spark, "inbox")
    parts = [texts.where(f"invoice_key % 2 = {i}") for i in range(2)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(inbox)
    paths = [shared_folder(spark, "store") for _ in range(2)]
    for path in paths:
        stream.seed(path, nothing, companies, customers)
    arriving = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    stream.run(arriving, paths[0], shared_folder(spark, "state"), DAY, *schemas, RULES)
    for n, part in enumerate(parts):
        stream.take_batch(part, n, paths[1], DAY, *schemas, RULES)
    got = [{k: rows_of(v) for k, v in stream.current(spark, p, *schemas).items()} for p in paths]
    assert got[0] == got[1] and len(got[0]["counts"]) == 2 and len(got[0]["headers"]) == texts.count()


def files(path, part):
    return {f.name: (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path, part).glob("*.parquet")}


def test_merges_write_touched_partitions_only(spark):
    path = shared_folder(spark, "merged")
    schema = "tenant_id string, k int, a string, n int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    store.merge(frame([("t1", 1, "x", 1), ("t1", 2, "y", 2), ("t2", 1, "z", 3), (None, 1, "w", 4), ("t=/3", 1, "v", 5)]), path, ["tenant_id", "k"])
    before = {p: files(path, p) for p in ("tenant_id=t1", "tenant_id=t2", "tenant_id=__HIVE_DEFAULT_PARTITION__")}
    new = frame([("t1", 2, None, 9), ("t1", 3, "q", 9), ("t=/3", 1, "u", 9), ("t4", 1, "p", 9)])
    for _ in range(2):  # again gives the same
        store.merge(new, path, ["tenant_id", "k"], combine={"a": lambda now, was: F.coalesce(now, was)})
        read = rows_of(spark.read.schema(schema).parquet(path).select("tenant_id", "k", "a", "n"))
        want = [("t1", 1, "x", 1), ("t1", 2, "y", 9), ("t1", 3, "q", 9), ("t2", 1, "z", 3), (None, 1, "w", 4), ("t=/3", 1, "u", 9), ("t4", 1, "p", 9)]
        assert read == sorted(want, key=repr)
    assert files(path, "tenant_id=t2") == before["tenant_id=t2"] and files(path, "tenant_id=t1") != before["tenant_id=t1"]
    assert files(path, "tenant_id=__HIVE_DEFAULT_PARTITION__") == before["tenant_id=__HIVE_DEFAULT_PARTITION__"]
    store.merge(frame([(None, 1, "new", 6)]), path, ["tenant_id", "k"])
    assert spark.read.schema(schema).parquet(path).where("tenant_id IS NULL").collect()[0].a == "new"
    with pytest.raises(ValueError):
        store.merge(new, path, ["k"])


def test_details_are_replaced_by_owner(spark):
    path = shared_folder(spark, "details")
    schema = "tenant_id string, k int, line int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    owners = lambda rows: spark.createDataFrame(rows, "tenant_id string, k int")
    store.replace_details(frame([("t1", 1, 1), ("t1", 1, 2), ("t1", 2, 1), ("t2", 1, 1), ("t 3", 1, 1)]), owners([("t1", 1)]), path, ["tenant_id", "k"])
    untouched = files(path, "tenant_id=t2")
    store.replace_details(frame([("t1", 1, 7)]), owners([("t1", 1), ("t 3", 1)]), path, ["tenant_id", "k"])
    assert rows_of(spark.read.schema(schema).parquet(path).select("tenant_id", "k", "line")) == [("t1", 1, 7), ("t1", 2, 1), ("t2", 1, 1)]
    assert files(path, "tenant_id=t2") == untouched


def test_a_customer_is_found_by_tax_id_before_its_name(spark):
    dim = spark.createDataFrame(
        [("a", "t", "Jane Doe", "j@x.com", "ID-1", True), ("b", "t", "Other", "", "ID-2", True), ("c", "t", "Gone", "", "ID-3", False)],
        "id string, tenant_id string, name string, email string, tax_id string, is_active boolean",
    )
    asked = [(1, "Jane Doe", "", "ID-2"), (2, "Jane Doe", "J@X.com", "ID-2"), (3, "Jane", "", "ID-3"), (4, "Nobody", None, None), (5, "", "", "ID-2")]
    invoices = spark.createDataFrame([(k, "t", *r) for k, *r in asked], "invoice_key long, tenant_id string, customer_name string, customer_email string, customer_tax_id string")
    got = {r.invoice_key: (r.existing_customer_id, r.matched_by) for r in match.resolve_customers(invoices, dim).collect()}
    assert got == {1: ("b", "tax_id"), 2: ("a", "email"), 3: ("a", "name"), 4: (None, None), 5: ("b", "tax_id")}


def test_a_trigger_is_planned_as_a_batch_and_leaves_its_session_as_it_was(spark):
    seen, inbox = [], shared_folder(spark, "settings")
    spark.range(10).write.parquet(inbox)

    def one(rows, batch):
        session = rows.sparkSession
        small = session.range(5).withColumnRenamed("id", "k")
        before = session.conf.get("spark.sql.adaptive.enabled")
        with batch_settings(session):
            plan = rows.groupBy("id").count().join(small, F.col("id") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
        seen.append((before, plan, session.conf.get("spark.sql.adaptive.enabled")))

    rows = spark.readStream.schema("id long").parquet(inbox)
    rows.writeStream.foreachBatch(one).option("checkpointLocation", shared_folder(spark, "settings-state")).trigger(availableNow=True).start().awaitTermination()
    [(before, plan, after)] = seen
    assert before == after
    assert plan.startswith("AdaptiveSparkPlan") and "BroadcastExchange" not in plan
