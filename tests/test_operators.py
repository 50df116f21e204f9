"""Operators against brute force on small inputs, with skew paths forced."""

import itertools
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from billwright.functions import checks, money
from billwright.functions.similarity import name_similarity
from billwright.functions.text import word_set
from billwright.operators import blocks, duplicates, listing, match, party_duplicates, process, skew
from billwright.sources import files
from billwright.streaming.lockouts import _login, lockouts


def overlap(a, b, containment):
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    if containment and (a in b or b in a):
        return 0.8
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("containment, threshold", [(True, 0.8), (False, 0.9)])
def test_duplicate_links_give_the_brute_force_pairs(spark, containment, threshold):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(260):
        n = rng.choice([1, 2, 3, 5, 6, 9, 11, 12, 13])
        name = " ".join(rng.sample(words, n)) if rng.random() < 0.8 or not rows else rng.choice(rows)[2]
        if rng.random() < 0.3:
            name = name.upper()
        rows.append((f"id{i:04d}", rng.choice(["t1", "t2"]), name, rng.choice(["", None, f"x{i % 60}"]), rng.choice(["a", None])))
    df = spark.createDataFrame(rows, "id string, tenant_id string, name string, code string, address string")
    same = {"name": F.lower("name"), "code": F.col("code")} if containment else {"code": F.col("code")}
    links = party_duplicates.duplicate_links(df, same, ["address"], threshold, containment).collect()
    assert all(r.duplicate_of < r.id for r in links)

    # A row stands for its groups; linked groups make all their members duplicates.
    group = lambda r: (r[1], r[4], r[2].lower().strip())
    first = {}
    for r in sorted(rows):
        first.setdefault(group(r), r[0])
    linked = {(r.duplicate_of, r.id) for r in links if r.rule == "similar_name"}
    got, expected = set(), set()
    by_rule = {}
    for r in links:
        by_rule.setdefault((r.rule, r.duplicate_of), {r.duplicate_of}).add(r.id)
    for (rule, _), members in by_rule.items():
        if rule != "similar_name":
            got |= set(itertools.combinations(sorted(members), 2))
    for a, b in itertools.combinations(sorted(rows), 2):
        if a[1] != b[1]:
            continue
        fa, fb = first[group(a)], first[group(b)]
        if (min(fa, fb), max(fa, fb)) in linked:
            got.add((a[0], b[0]))
        same_code = a[3] and a[3] == b[3]
        same_name = containment and a[2].lower() == b[2].lower()
        if same_name or same_code or (overlap(a[2], b[2], containment) > threshold and a[4] == b[4]):
            expected.add((a[0], b[0]))
    assert got == expected
    assert any(r.rule == "similar_name" for r in links)


def test_a_million_copies_are_linear(spark):
    rows = spark.range(3000).select(
        F.format_string("id%05d", "id").alias("id"),
        F.lit("t").alias("tenant_id"),
        F.lit("Same Name").alias("name"),
        F.lit(None).cast("string").alias("tax_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("address_line1", "city", "postal_code")],
    )
    assert party_duplicates.vendor_duplicates(rows).count() == 2 * 2999


def test_name_similarity(spark):
    rows = [("Acme Ltd", "acme ltd"), ("Acme", "Acme Ltd"), ("a b c", "c b d"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"a": F.lower("a"), "b": F.lower("b")})
    score = name_similarity(F.col("a"), F.col("b"), word_set(F.col("a")), word_set(F.col("b")), True)
    assert [r[0] for r in df.select(score).collect()] == [1.0, 0.8, 0.5, 0.8]


def test_attach_salts_heavy_keys(spark):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("k")
    )
    per_key = skew.first_per_key(rows.where("k is not null"), ["k"], ["id"])
    got = skew.attach(rows, per_key, ["k"], F.col("id"), min_rows=10)
    assert got.count() == 2000
    firsts = {r.k: r.f for r in rows.where("k is not null").groupBy("k").agg(F.min("id").alias("f")).collect()}
    for r in got.collect():
        assert (r["first"].id if r["first"] else None) == firsts.get(r.k)


def test_match_parties_like_a_lookup(spark):
    stored = [
        ("c3", "t", "Big Acme Tools", "T1", True),
        ("c1", "t", "ACME", "T2", True),
        ("c2", "t", "Other", "T3", False),
        ("c4", "u", "Acme", "T1", True),
        ("c5", "t", "50% off_shop", "", True),
    ]
    dim = spark.createDataFrame(stored, "id string, tenant_id string, name string, tax_id string, is_active boolean")
    asked = [("t", "acme", ""), ("t", "Acme", "T1"), ("t", "Other", "T3"), ("t", "Acme Tools", "none"), ("u", "cm", ""), ("t", "", "T1"), ("t", "50%", ""), ("t", "5_", "")]
    parties = spark.createDataFrame(asked, "tenant_id string, vendor_name string, vendor_tax_id string")
    got = {(r.tenant_id, r.vendor_name, r.vendor_tax_id): (r.match_id, r.matched_by) for r in match.match_parties(parties, dim, match.VENDOR).collect()}
    assert got == {
        ("t", "acme", ""): ("c1", "name"),
        ("t", "Acme", "T1"): ("c3", "tax_id"),
        ("t", "Other", "T3"): (None, None),
        ("t", "Acme Tools", "none"): ("c3", "name"),
        ("u", "cm", ""): ("c4", "name"),
        ("t", "", "T1"): (None, None),
        ("t", "50%", ""): ("c5", "name"),
        ("t", "5_", ""): (None, None),
    }


def test_upsert_takes_newest_values_and_collapses_new_names(spark):
    dim = spark.createDataFrame(
        [("c1", "t", "Acme", "T1", "old@x.com", "", "1 Road", True)],
        "id string, tenant_id string, name string, tax_id string, email string, phone string, address_line1 string, is_active boolean",
    )
    invoices = spark.createDataFrame(
        [
            (1, "t", date(2020, 1, 2), "Acme", "T1", "new@x.com", "111", ""),
            (2, "t", date(2020, 1, 1), "Acme", "T1", "older@x.com", "222", "2 Road"),
            (3, "t", date(2020, 1, 3), "Acme", "T1", "", "", ""),
            (9, "t", date(2020, 1, 1), "Fresh Co", "", "b@x.com", "", ""),
            (5, "t", date(2020, 1, 1), " fresh co ", "", "a@x.com", "", ""),
        ],
        "invoice_key int, tenant_id string, created_at date, vendor_name string, vendor_tax_id string, vendor_email string, vendor_phone string, vendor_address_line1 string",
    )
    got = {r.id: r for r in match.upsert(invoices, dim, match.VENDOR).collect()}
    assert set(got) == {"c1", "CO-new-5"}
    c1, new = got["c1"], got["CO-new-5"]
    assert (c1.email, c1.phone, c1.address_line1, c1.is_new) == ("new@x.com", "111", "2 Road", False)
    assert (new.name, new.email, new.is_new) == (" fresh co ", "a@x.com", True)


def test_an_invoice_has_one_document_whatever_its_lines(spark):
    lines = spark.range(2500).select(
        F.when(F.col("id") < 2400, 1).otherwise(2).alias("invoice_key"),
        F.format_string("%05d", "id").alias("line_id"),
        F.col("id").cast("int").alias("line_number"),
        F.lit("d").alias("description"),
        F.lit("i").alias("item_code"),
        *[F.lit(1).cast("decimal(15,2)").alias(c) for c in ("quantity", "unit_price", "total_price")],
        *[F.lit(0.0).alias(c) for c in ("tax_rate", "discount_rate")],
    )
    rows = {r.invoice_key: r.line_items for r in listing.nested_lines(lines).collect()}
    assert {k: len(v) for k, v in rows.items()} == {1: 2400, 2: 100}
    assert [x.line_number for x in rows[1]] == list(range(2400))


def _checked(spark, texts):
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "invoice_key long, tenant_id string, text string")
    return process.checked_records(df.withColumn("created_at", F.current_timestamp()), date(2000, 6, 1))


def test_no_text_ends_a_job(spark):
    head = "ACME Tools Inc\n12 Main Street\nINVOICE\nInvoice Number: INV-1\nDate: 2000-01-02\n"
    texts = [
        head + "Subtotal: $1.00\nTax: $250.00\nTotal: $251.00",
        head + "Description Qty Price Total\nwidget 2 3.00 6.00\nTax Rate: 2000000%\nTotal: $6.00",
        head + "Description Qty Price Total\nwidget 9999999 99999999999 0\nTotal: $5.00",
        head + "Subtotal: $9999999999999.99\nTax: $9999999999999.99\nTotal: $1.00",
        "",
    ]
    rows = {r.invoice_key: r for r in _checked(spark, texts).collect()}
    assert len(rows) == 5
    assert (rows[0].tax_rate, str(rows[0].final_total)) == (25000.0, "251.00")
    assert rows[2].final_total is None and rows[2].processing_status == "failed"
    assert rows[3].errors == 1


def test_money_is_exact_until_it_is_stored(spark):
    dec = lambda v, t: F.lit(v).cast(t)
    amount = lambda v: dec(v, "decimal(15,2)")
    line = money.line_total(dec("1", "decimal(10,3)"), dec("10.0050", "decimal(15,4)"), F.lit(10.0), F.lit(0.0))
    kept = money.line_total(dec("3", "decimal(10,3)"), dec("1.1111", "decimal(15,4)"), F.lit(0.0), F.lit(0.0), amount("0.50"), amount("0.25"))
    got = spark.range(1).select(
        money.share(amount("400000.00"), F.lit(8.333333)).alias("a"),
        money.share(amount("300000.00"), F.lit(25000 / 300000 * 100)).alias("b"),
        line["line_total"].alias("c"),
        kept["line_total"].alias("d"),
        money.share(amount("9999999999999.99"), F.lit(5000.0)).alias("e"),
    )
    assert [None if v is None else str(v) for v in got.first()] == ["33333.33", "25000.00", "9.00", "3.08", None]


@pytest.mark.parametrize("tax_id", [None, ""])
def test_parties_with_null_keys_are_matched(spark, tax_id):
    columns = "invoice_key long, tenant_id string, vendor_name string, vendor_tax_id string, vendor_email string, vendor_phone string, vendor_address_line1 string"
    invoices = spark.createDataFrame([(1, "t", "Acme", tax_id, None, None, None), (2, "t", "co", tax_id, None, None, None)], columns)
    stored = "id string, tenant_id string, name string, tax_id string, email string, phone string, address_line1 string, is_active boolean"
    dim = spark.createDataFrame([("c2", "t", "ACME Tools Co", "", "", "", "", True), ("c1", "u", "Acme", "", "", "", "", True)], stored)
    got = {r.invoice_key: r.existing_company_id for r in match.resolve_vendors(invoices, dim).collect()}
    assert got == {1: "c2", 2: "c2"}


def test_names_are_found_inside_names(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abc ") for _ in range(n))
    stored = [(f"s{i:03d}", f"t{i % 2}", word(rnd.randint(0, 12)), True) for i in range(120)]
    asked = sorted({(f"t{rnd.randint(0, 1)}", word(rnd.randint(1, 7))) for _ in range(80)})
    dim = spark.createDataFrame(stored, "id string, tenant_id string, name string, is_active boolean")
    names = spark.createDataFrame(asked, "tenant_id string, part string")
    got = sorted(map(tuple, match.name_hits(dim, names).collect()))
    assert got == sorted((t, p, i) for t, p in asked for i, u, n, _ in stored if t == u and p in n)


def test_duplicates_never_point_at_themselves_or_across_tenants(spark):
    rows = [
        (1, "t", "c", "N1", "h1", False, date(2020, 1, 1)),
        (2, "t", "c", "N2", "h1", False, date(2020, 1, 2)),
        (3, "u", "c", "N1", "h1", False, date(2020, 1, 3)),
        (4, "t", "c", "N2", "h4", False, date(2020, 1, 4)),
        (5, "t", "d", "N9", "h5", True, date(2020, 1, 1)),
        (6, "t", "d", "N9", "h5", False, date(2020, 1, 5)),
        (7, "t", "c", "N7", "", False, date(2020, 1, 5)),
        (8, "t", "c", "N8", "", False, date(2020, 1, 6)),
    ]
    df = spark.createDataFrame(
        rows, "id int, tenant_id string, company_id string, invoice_number string, file_hash string, is_archived boolean, created_at date"
    ).withColumns({"processing_status": F.lit("pending"), "requires_review": F.lit(False)})
    got = {r.id: (r.duplicate_of, r.matched_by) for r in duplicates.duplicate_invoices(df, "id").collect()}
    none = (None, None)
    assert got == {1: none, 2: (1, "file"), 3: none, 4: (2, "number"), 5: none, 6: none, 7: none, 8: none}


def test_pages_are_disjoint_and_bad_dates_ignored(spark):
    rows = spark.range(95).select(
        F.col("id").alias("invoice_key"),
        F.lit("t").alias("tenant_id"),
        F.lit(False).alias("is_archived"),
        F.lit("completed").alias("processing_status"),
        F.lit(date(2020, 1, 1)).alias("invoice_date"),
        (F.col("id") % 7).alias("created_at"),
    )
    pages = [listing.list_invoices(rows, "t", status="completed", date_from="not a day", number=n, per_page=40).collect() for n in (1, 2, 3)]
    keys = [[r.invoice_key for r in page] for page in pages]
    assert [len(k) for k in keys] == [40, 40, 15] and len(set(sum(keys, []))) == 95
    assert (pages[2][0].pages, pages[2][0].has_prev, pages[2][0].has_next, pages[2][0].total) == (3, True, False, 95)


def test_files_from_a_folder(spark, tmp_path):
    for name, data in {"a.pdf": b"x" * 10, "b.PNG": b"y" * 10, "c.txt": b"z", "noext": b"n", "big.jpg": b"b" * 200}.items():
        (tmp_path / name).write_bytes(data)
    found = files.read_files(spark, str(tmp_path))
    taken = {r.original_filename: r for r in files.pending_headers(found, date(2020, 1, 1), max_bytes=100).collect()}
    assert set(taken) == {"a.pdf", "b.PNG"}
    assert taken["a.pdf"].file_hash == __import__("hashlib").sha256(b"x" * 10).hexdigest()
    assert taken["a.pdf"].retention_until == date(2026, 12, 30)
    refused = {r.filename: r.reject_reason for r in files.rejected_files(found, max_bytes=100).collect()}
    assert refused == {"c.txt": "File type not allowed", "noext": "File type not allowed", "big.jpg": "File too large"}


def test_checks(spark):
    def ok(fn, *texts):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(1).sortWithinPartitions("i")
        return [r[0] for r in df.select(fn(F.col("x"))).collect()]

    assert ok(checks.email_ok, "a@b.com", "a..b@c.com", "a@b", "a b@c.com", "x@y.invalid", ".a@b.com", "ü@b.de", "a@1.2.3.4") == [
        True, False, False, False, False, False, True, False,
    ]
    assert ok(checks.phone_ok, "123-4567", "123456", "1" * 16) == [True, False, False]
    assert ok(checks.amount_ok, "0", "-1", "x", "12.5") == [True, False, False, True]
    assert ok(checks.date_ok, "2024-02-29", "2023-02-29", "2024-1-5", "01/02/2024") == [True, False, True, False]
    assert ok(checks.invoice_number_ok, "A_1", "A1", "A 12") == [True, False, False]
    assert ok(checks.tax_id_ok, "12-34", "1 2", "a!b") == [True, False, False]
    assert ok(checks.postal_code_ok, "SW1A 1AA", "12345678901") == [True, False]
    assert ok(checks.tenant_id_ok, "tenant_1", "a-b", "ab") == [True, False, False]


def test_lock_steps(spark):
    hour = 3600 * 1_000_000
    state = (0, 0)
    for at in range(1, 5):
        failures, until, locked = _login(*state, at, True)
        state = (failures, until)
        assert not locked
    assert _login(*state, 5, False) == (0, 0, False)
    assert _login(*state, 5, True) == (5, 5 + hour, True)
    assert _login(5, 5 + hour, 5 + hour - 1, False) == (5, 5 + hour, False)  # ignored while locked
    assert _login(5, 5 + hour, 5 + hour, True) == (1, 0, False)


def test_lockouts_reset_between_users(spark):
    rows = [(u, i, f"2024-01-01 00:00:{i:02d}", "login_failed") for u in (1, 2) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id long, event_id int, ts string, action string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert lockouts(df.coalesce(1)).count() == 0


def _locks(rows):
    """Every login in order, user by user."""
    out, state = [], {}
    for user, at, event, failed in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:3]):
        failures, until, locked = _login(*state.get(user, (0, 0)), at, failed)
        state[user] = (failures, until)
        if locked:
            out.append((user, at, until, failures))
    return sorted(out)


@pytest.mark.parametrize("many", [10_000, 3, 0])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_locks_are_those_of_reading_in_order(spark, many, parts):
    rng = random.Random(many + parts)
    rows, event = [], 0
    for user, n in enumerate([300, 200, 60, 5, 4, 3, 100, 60], 1):
        at, gap = 1, [900, 60, 5000, 1][user % 4]
        for _ in range(n):
            at += rng.choice([0, 0, 1, rng.randint(0, 2 * gap)]) * 1_000_000
            event += 1
            rows.append((user, at, event, rng.random() < 0.8))
    rows += [(None, k, 9_000 + k, True) for k in range(8)]
    schema = "user_id long, at long, event_id long, failed boolean"
    log = spark.createDataFrame(rng.sample(rows, len(rows)), schema).select(
        "user_id", "event_id", F.timestamp_micros("at").alias("ts"), F.when(F.col("failed"), "login_failed").otherwise("login_ok").alias("action")
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lockouts(log, many=many).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == _locks(rows) and len(got) > 5


def test_one_user_with_most_logins_is_spread(spark):
    """Failures every ten seconds for weeks: runs start at nearly every login, locks one after another."""
    n = 200_000
    log = spark.range(n).select(
        F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit("login_failed").alias("action")
    )
    got = sorted(r.locked_at_us // 10_000_000 for r in lockouts(log).collect())
    want, at = [], 0
    while at + 4 < n:  # locked at the fifth, free again an hour of 360 logins later
        want.append(at + 4)
        at += 4 + 360
    assert got == want


def test_blocks(spark):
    rows = [(1, 1, " b ", 0.9), (1, 0, "a", 0.5), (1, 2, "  ", 0.9), (2, 0, "", 0.1)]
    df = spark.createDataFrame(rows, "doc_id int, block_index int, text string, confidence double")
    got = {r.doc_id: r for r in blocks.assemble_text(df).collect()}
    assert (got[1].full_text, got[1].high_confidence_text, got[1].average_confidence) == ("a b", "b", 0.9)
    assert got[1].overall_confidence == pytest.approx(2 / 3)
    assert (got[2].full_text, got[2].overall_confidence) == ("", 0.0)


def test_attach_shuffles_the_rows_once(spark):
    rows = spark.range(50).select("id", (F.col("id") % 5).alias("k"))
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("v")).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.attach(rows, per_key, ["k"], F.col("id"), min_rows=10)
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert sorted((r.id, r.v) for r in joined.collect()) == [(i, 45 + i % 5) for i in range(50)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
