"""Literal texts through the extractors, in both presets."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from billwright.config import CORRECTED, REFERENCE
from billwright.functions import fields as f
from billwright.functions import patterns as p
from billwright.functions import text as t
from billwright.operators import extract


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").repartition(1)
    return [r[0] for r in rows.sortWithinPartitions("i").select(column).collect()]


def one(spark, column, text):
    return values(spark, column, [text])[0]


T = F.col("text")


def test_clean_text(spark):
    raw = "  INV-00001001 \t |tem\n\n $  5 0 "
    assert one(spark, t.clean_text(T, REFERENCE), raw) == "INV-O0001001 Item $5 0"
    assert one(spark, t.clean_text(T, CORRECTED), raw) == "INV-00001001 Item\n\n $5 0"
    assert values(spark, t.clean_text(T, REFERENCE), [None, "", "a  b", "x\x1cy"]) == ["", "", "a b", "x y"]


@pytest.mark.parametrize(
    "text, plain, iso_first",
    [
        ("2024-01-15", date(2015, 1, 24), date(2024, 1, 15)),
        ("on 03/04/2021 x", date(2021, 3, 4), date(2021, 3, 4)),
        ("25/12/99", date(1999, 12, 25), date(1999, 12, 25)),
        ("12-31-49", date(2049, 12, 31), date(2049, 12, 31)),
        ("5 Mar 2020", date(2020, 3, 5), date(2020, 3, 5)),
        ("feb 3, 2021", date(2021, 2, 3), date(2021, 2, 3)),
        ("March 3, 2021", None, None),
        ("31/31/2020 then 7 Jun 2019", date(2019, 6, 7), date(2019, 6, 7)),
        ("no date", None, None),
        ("", None, None),
    ],
)
def test_parse_date(spark, text, plain, iso_first):
    assert one(spark, t.parse_date(T), text) == plain
    assert one(spark, t.parse_date(T, iso_first=True), text) == iso_first


@pytest.mark.parametrize(
    "choices, text, expected",
    [
        (p.INVOICE_NUMBER, "Invoice # : AB-12", ("AB-12", 0.9)),
        (p.INVOICE_NUMBER, "Invoice Number: X", ("Number", 0.9)),
        (p.INVOICE_NUMBER, "invoice.", ("oice", 0.7)),
        (p.INVOICE_NUMBER, "receipt: 77", ("77", 0.7)),
        (p.INVOICE_NUMBER, "ref #A1B", ("A1B", 0.7)),
        (p.INVOICE_NUMBER, "nothing", None),
        (p.PO_NUMBER, "P.O. # 55", ("55", 0.7)),
        (p.PO_NUMBER, "ABC Corporation", ("ration", 0.7)),
        (p.PO_NUMBER, "purchase order: K9", ("K9", 0.8)),
        (p.TAX_ID, "Tax ID: 12-3456789", ("12-3456789", 0.8)),
        (p.TAX_ID, "EIN 12-3456789", ("12-3456789", 0.8)),
        (p.TAX_ID, "VAT: GB1", ("GB1", 0.8)),
    ],
)
def test_first_hit(spark, choices, text, expected):
    hit = one(spark, t.first_hit(T, choices), text)
    assert (tuple(hit) if hit else None) == expected


def test_contacts(spark):
    assert one(spark, f.phone(T), "call +1 (555) 123-4567 now") == "(555) 123-4567"
    assert one(spark, f.phone(T), "call 44 1234 5678 9012") == "44 1234 5678 9012"
    assert one(spark, f.phone(T), "call 44-1234-567-890") == "44-1234-567-890"
    assert one(spark, f.phone(T, as_printed=True), "tel:555.123.4567") == "555.123.4567"
    assert one(spark, f.phone(T), "123-4567") is None
    assert one(spark, f.email(T), "mail me john.smith@email.com.") == "john.smith@email.com"
    sites = ["mail john.smith@email.com", "see https://www.abc-corp.com/x?y z", "xhttp://a.org", "v 1.25 only", "www.shop.co.uk"]
    assert values(spark, f.website(T), sites) == ["john.smith", "https://www.abc-corp.com/x?y", "http://a.org", None, "www.shop.co.uk"]


def test_amounts_in_both_presets(spark):
    text = "Subtotal: $100.00 Tax: $8.00 Total: $108.00"
    assert float(one(spark, f.amount(T, "total", REFERENCE), text)) == 100.0
    assert float(one(spark, f.amount(T, "total", CORRECTED), text)) == 108.0
    assert float(one(spark, f.amount(T, "tax", REFERENCE), text)) == 8.0
    assert float(one(spark, f.amount(T, "total", REFERENCE), "Total: 1250.75")) == 1250.0
    assert float(one(spark, f.amount(T, "total", CORRECTED), "Total: 1250.75")) == 1250.75
    assert float(one(spark, f.amount(T, "total", CORRECTED), "Amount due: 1,234,567.8")) == 1234567.8
    assert float(one(spark, f.amount(T, "shipping", CORRECTED), "Freight $5")) == 5.0
    assert one(spark, f.amount(T, "discount", CORRECTED), "none") is None


def test_rate_terms_currency(spark):
    assert one(spark, f.tax_rate(T), "Tax rate: 8.25%") == 8.25
    assert one(spark, f.tax_rate(T), "incl. 19% tax") == 19.0
    assert one(spark, f.tax_rate(T), "tax 5") is None
    terms = ["NET 45", "due on receipt", "within 14 days", "Cash on Delivery", "code 7", "none"]
    got = [tuple(x) if x else None for x in values(spark, f.payment_terms(T), terms)]
    assert got == [
        ("Net 45", 0.9),
        ("Due on receipt", 0.9),
        ("14 days", 0.8),
        ("Cash on Delivery", 0.7),
        ("Cash on delivery", 0.8),
        None,
    ]
    assert values(spark, f.currency(T), ["€5 and $6", "12 gbp", "plain"]) == ["USD", "GBP", None]


def test_company_name_and_address(spark):
    text = "INVOICE\n12 Main Street\nbilling@abc.com\nABC Corporation\nNew York, NY 10001-1234"
    hit = one(spark, f.company_name_hit(f.stripped_lines(T)), text)
    assert (hit["i"], hit["value"]) == (3, "ABC Corporation")
    parts = f.address(F.col("h"))
    rows = spark.createDataFrame([(text,), ("x 54321 y\nz 99999",), ("",)], "text string").select(
        f.address_hits(f.stripped_lines(T)).alias("h")
    )
    got = [tuple(r) for r in rows.select(*parts.values()).collect()]
    assert got == [("12 Main St", "New York", "NY", "10001-1234"), ("", "", "", "54321"), ("", "", "", "")]


def test_customer_block_keeps_digit_lines_only(spark):
    text = "Bill To: Ann Lee\n45 Oak Ave\nann@x.com\n\nrest"
    assert one(spark, f.customer_block(T), text) == "Ann Lee\n45 Oak Ave"
    assert one(spark, f.customer_block(T), "Sold to Bob") == "Bob"
    assert one(spark, f.customer_block(T), "nobody") is None


def items(spark, text, semantics):
    rows = spark.createDataFrame([(1, "t", text)], "invoice_key int, tenant_id string, text string")
    record = extract.extract_invoices(rows, semantics).select("line_items").collect()[0][0]
    return [(x["line_number"], x["description"], float(x["quantity"]), float(x["unit_price"]), float(x["total_price"]), x["confidence"]) for x in record]


TABLE = "Description Quantity Price Amount\nred widget 3 5.00 15.00\n2 blue rod 10.00 20.00\n\nSubtotal: $35.00"


def test_line_items_in_both_presets(spark):
    assert items(spark, TABLE, CORRECTED) == [
        (1, "red widget", 3.0, 5.0, 15.0, 0.8),
        (2, "blue rod", 2.0, 10.0, 20.0, 0.8),
    ]
    assert items(spark, TABLE, REFERENCE) == [(1, "blue rod", 2.0, 10.0, 20.0, 0.8)]


def test_line_items_without_header(spark):
    text = "Shop\nblue rod 2 1.50 0\nextra note\ngift wrap 1 2.00 2.00\n\nafter 1 1.00 1.00"
    assert items(spark, text, CORRECTED) == [
        (1, "blue rod", 2.0, 1.5, 3.0, 0.8),
        (2, "extra note", 1.0, 0.0, 0.0, 0.3),
        (3, "gift wrap", 1.0, 2.0, 2.0, 0.8),
    ]
    assert items(spark, "only words here", CORRECTED) == []


def test_whole_record(spark):
    text = (
        "ABC Corporation\n123 Business St\nNew York, NY 10001\n(555) 123-4567\nbilling@abc-corp.com\n"
        "Tax ID: 12-3456789\nInvoice #: INV-2024-001\nDate: 2024-01-15\nDue Date: 2024-02-14\n"
        "Bill To: John Smith\n\n" + TABLE.replace("\n\n", "\n") + "\nTax: $3.50\nTotal: $40.00\nNet 30"
    )
    rows = spark.createDataFrame([(1, "t", text)], "invoice_key int, tenant_id string, text string")
    h = extract.header_table(extract.extract_invoices(rows)).collect()[0]
    assert (h.invoice_number, h.invoice_date, h.due_date) == ("INV-2024-001", date(2024, 1, 15), date(2024, 2, 14))
    assert (h.vendor_name, h.vendor_phone, h.vendor_tax_id) == ("ABC Corporation", "(555) 123-4567", "12-3456789")
    assert (h.vendor_city, h.vendor_postal_code, h.customer_name) == ("New York", "10001", "John Smith")
    # The printed total is off, so it is worked out again and kept beside.
    assert (float(h.total_amount), float(h.total_as_printed), h.calculated_total) == (38.5, 40.0, True)
    assert (h.tax_rate, h.payment_terms, h.total_line_items) == (10.0, "Net 30", 2)


def test_text_counts(spark):
    counts = t.text_counts(T)
    rows = spark.createDataFrame([("a b\nx@y.com 12/01/2020 $5 7 EUR 12345678",), ("",), (None,)], "text string")
    got = [tuple(r) for r in rows.select(*counts.values()).collect()]
    assert got[0] == (40, 8, 2, 6, 1, 1, 1, 2)
    assert got[1] == got[2] == (0,) * 8


def test_sanitize_and_json(spark):
    assert one(spark, t.sanitize(T, 3), "  a\x00b\tc d ") == "ab\t"
    assert values(spark, t.json_map(T), ['{"k": 1}', "bad", None, ""]) == [{"k": "1"}, {}, {}, {}]
    assert one(spark, t.word_set(T), " The the  Big\tCo ") == ["big", "co", "the"]


def test_a_text_is_searched_once_for_its_lines_and_contacts(spark):
    texts = spark.createDataFrame(
        [(1, "a", None, "ACME Corp\nDescription Quantity Price Amount\nBolt 2 1.50 3.00\nTotal: $3.00"), (2, "a", None, "nothing"), (3, "a", None, None)],
        "invoice_key long, tenant_id string, created_at timestamp, text string",
    )
    records = extract.extract_invoices(texts)
    lines = extract.line_table(records)
    assert [(r.invoice_key, r.line_number, r.description) for r in lines.collect()] == [(1, 1, "Bolt")]
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized(lines).count(p.ITEM_SECTIONS[0]) == 1
    found = spark.createDataFrame([("a@b.example",), (None,)], "text string").select(f.email(T).alias("email"))
    assert [r.email for r in found.collect()] == ["a@b.example", None]
    assert optimized(found).count("regexp_extract") == 1


def test_words_looked_for_first_change_no_hit(spark):
    texts = ["İNV: A1", "ınv B2", "Tax ıd: T-9", "ſhippıng: $5", "DİSCOUNT 7", "caſh on delivery", "no words", "", None, "Vat: X1", "P.O. 7", "Kasse"]
    small = t.folded(T)
    pairs = [
        (t.first_hit(T, p.INVOICE_NUMBER), t.first_hit(T, p.INVOICE_NUMBER, small)),
        (t.first_hit(T, p.PO_NUMBER), t.first_hit(T, p.PO_NUMBER, small)),
        (f.tax_id(T), f.tax_id(T, small)),
        (f.amount(T, "shipping", CORRECTED), f.amount(T, "shipping", CORRECTED, small)),
        (f.amount(T, "discount", CORRECTED), f.amount(T, "discount", CORRECTED, small)),
        (f.payment_terms(T), f.payment_terms(T, small)),
    ]
    for every, guarded in pairs:
        assert values(spark, every, texts) == values(spark, guarded, texts)
    assert values(spark, f.amount(T, "shipping", CORRECTED, small), ["ſhippıng: $5"])[0] == 5


def test_a_text_is_searched_once_for_its_customer(spark):
    texts = spark.createDataFrame([(1, "t", None, "Acme\nBill To: Ann\n")], "invoice_key long, tenant_id string, created_at timestamp, text string")
    plan = extract.extract_invoices(texts)._jdf.queryExecution().optimizedPlan().toString()
    # one search of the text, one of what it found
    assert plan.count("bill\\s+to") == 2


def test_searches_that_look_first_miss_nothing(spark):
    """The quick looks before a search are passed by every text that the search finds something in."""
    texts = [
        "+44 20 7946 0958", "44 1234 5678 9012", "44-1234-567-890", "1234567890", "x123.456.789.012", "17 2447.30 41604.11", "٤٤ ١٢٣٤ ٥٦٧٨ ٩٠١٢",
        "15551234567", "+1 (555) 123-4567", "000000123 4567 8901", "9 555\n123\n4567", "1 2 3 4 5 6 7 8 9 0", "", "call 123 4567",
    ]
    rng = random.Random(3)
    texts += ["".join(rng.choice("0123456789012345678 .-+()x\n") for _ in range(rng.randrange(40))) for _ in range(400)]
    plainly = F.coalesce(
        F.when(T.rlike(p.PHONE_AREA_CORE), F.regexp_replace(f.match_text(T, p.PHONE_AREA), p.PHONE_AREA, "($1) $2-$3")), f.match_text(T, p.PHONE_COUNTRY)
    )
    assert values(spark, f.phone(T), texts) == values(spark, plainly, texts)
    as_printed = F.coalesce(f.match_text(T, p.PHONE_AREA), f.match_text(T, p.PHONE_COUNTRY))
    assert values(spark, f.phone(T, as_printed=True), texts) == values(spark, as_printed, texts)
    first = F.regexp_extract(T, p.ITEM_QUANTITY_FIRST, 0) != ""
    rows = ["5 blue bolt 3.00 15.00", "a 7 x 3.50 24.50", "5   3.00 15.00", "gear 17 2.30 41.11", *texts]
    assert not any(a and not b for a, b in values(spark, F.array(first, T.rlike(p.ITEM_TEXT_AFTER_DIGIT)), rows))


def test_an_address_is_looked_for_once(spark):
    """Before, every part of an address looked for its street again, and for each line."""
    texts = spark.createDataFrame([(1, "t", "A Co")], "invoice_key long, tenant_id string, text string")
    analyzed = extract.extract_invoices(texts)._jdf.queryExecution().analyzed().toString()
    assert analyzed.count("array_position(transform(company_hits") == 1
