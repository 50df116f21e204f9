"""Queries on files, duplicates, pages, documents and status."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from billwright.config import AS_OF
from billwright.operators import duplicates, listing, rollup
from billwright.plans.registry import dates_as_text, query
from billwright.session import shared_folder
from billwright.sources import files
from billwright.sources.derived import table

_TODAY = f"DATE '{AS_OF.isoformat()}'"
_MAX_BYTES = 20000


def document_files(spark, sf_dir):
    """Documents as uploaded files, with names of several types."""
    doc = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 7
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("tenant_id"),
        F.when(kind == 0, F.concat(F.lit("doc_"), doc, F.lit(".PDF")))
        .when(kind == 1, F.concat(F.lit("doc_"), doc, F.lit(".jpeg")))
        .when(kind == 2, F.concat(F.lit("doc_"), doc))
        .when(kind == 3, F.concat(F.lit("doc_"), doc, F.lit(".png.txt")))
        .when(kind == 4, F.lit(""))
        .otherwise(F.concat(F.lit("doc."), doc, F.lit(".png")))
        .alias("filename"),
        F.octet_length("text").cast("bigint").alias("file_size"),
        F.encode("text", "UTF-8").alias("content"),
    )


_FILES = """SELECT doc_id, source AS tenant_id, text, strlen(text) AS file_size,
                   CASE doc_id % 7 WHEN 0 THEN concat('doc_', doc_id, '.PDF') WHEN 1 THEN concat('doc_', doc_id, '.jpeg')
                        WHEN 2 THEN concat('doc_', doc_id) WHEN 3 THEN concat('doc_', doc_id, '.png.txt') WHEN 4 THEN ''
                        ELSE concat('doc.', doc_id, '.png') END AS filename,
                   CASE WHEN doc_id % 7 = 4 THEN 'No file provided' WHEN doc_id % 7 IN (2, 3) THEN 'File type not allowed'
                        WHEN strlen(text) > 20000 THEN 'File too large' END AS reason
            FROM {documents}"""


@query(
    "ingest_documents",
    f"""WITH f AS ({_FILES})
        SELECT doc_id, tenant_id, CASE WHEN reason IS NULL THEN 'PENDING' END AS invoice_number,
               CASE WHEN reason IS NULL THEN '2001-12-31' END AS invoice_date,
               CASE WHEN reason IS NULL THEN 'pending' END AS processing_status, filename AS original_filename, file_size,
               CASE WHEN reason IS NULL THEN sha256(text) END AS file_hash,
               CASE WHEN reason IS NULL THEN cast({_TODAY} + 2555 as string) END AS retention_until, reason AS reject_reason
        FROM f""",
)
def ingest_documents(spark, sf_dir):
    rows = document_files(spark, sf_dir)
    taken = files.pending_headers(rows, AS_OF, max_bytes=_MAX_BYTES)
    refused = files.rejected_files(rows, max_bytes=_MAX_BYTES).withColumnRenamed("filename", "original_filename")
    return dates_as_text(taken.unionByName(refused, allowMissingColumns=True))


@query(
    "ingest_rejects",
    f"WITH f AS ({_FILES}) SELECT tenant_id, reason AS reject_reason, count(*) AS files FROM f WHERE reason IS NOT NULL GROUP BY ALL",
)
def ingest_rejects(spark, sf_dir):
    refused = files.rejected_files(document_files(spark, sf_dir), max_bytes=_MAX_BYTES)
    return refused.groupBy("tenant_id", "reject_reason").agg(F.count(F.lit(1)).alias("files"))


@query(
    "dedupe_files",
    """WITH d AS (SELECT doc_id, source AS tenant_id, sha256(text) AS file_hash FROM {documents}),
            f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY tenant_id, file_hash ORDER BY doc_id) AS first_id FROM d)
       SELECT doc_id, tenant_id, file_hash, first_id < doc_id AS is_duplicate,
              CASE WHEN first_id < doc_id THEN first_id END AS duplicate_of FROM f""",
)
def dedupe_files(spark, sf_dir):
    headers = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("tenant_id"),
        F.sha2("text", 256).alias("file_hash"),
        F.lit(False).alias("is_archived"),
        F.lit(AS_OF).alias("created_at"),
    )
    return duplicates.duplicate_files(headers, "doc_id").drop("is_archived", "created_at")


@query(
    "duplicate_invoices",
    """WITH a AS (SELECT *, created_at::timestamp AS arrived FROM {header_arrivals}),
            f AS (SELECT tenant_id, file_hash, min(row(arrived, arrival_id)) AS first FROM a WHERE NOT is_archived GROUP BY ALL),
            g AS (SELECT tenant_id, company_id, invoice_number, min(row(arrived, arrival_id)) AS first FROM a WHERE NOT is_archived GROUP BY ALL),
            m AS (SELECT a.*, CASE WHEN f.first < row(arrived, arrival_id) THEN f.first[2] END AS same_file,
                         CASE WHEN g.first < row(arrived, arrival_id) THEN g.first[2] END AS same_number
                  FROM a LEFT JOIN f USING (tenant_id, file_hash) LEFT JOIN g USING (tenant_id, company_id, invoice_number))
       SELECT arrival_id, tenant_id, coalesce(same_file, same_number) IS NOT NULL AS is_duplicate,
              coalesce(same_file, same_number) AS duplicate_of,
              CASE WHEN same_file IS NOT NULL THEN 'file' WHEN same_number IS NOT NULL THEN 'number' END AS matched_by,
              CASE WHEN coalesce(same_file, same_number) IS NOT NULL THEN 'completed' ELSE processing_status END AS processing_status,
              coalesce(same_file, same_number) IS NOT NULL OR requires_review AS requires_review
       FROM m""",
)
def duplicate_invoices(spark, sf_dir):
    return duplicates.duplicate_invoices(table(spark, sf_dir, "header_arrivals"), "arrival_id")


@query(
    "unique_violations",
    """SELECT invoice_number, company_id, tenant_id, count(*) AS rows FROM {header_arrivals}
       GROUP BY ALL HAVING count(*) > 1""",
)
def unique_violations(spark, sf_dir):
    return duplicates.unique_violations(table(spark, sf_dir, "header_arrivals"))


@query(
    "duplicate_line_items",
    """WITH l AS (SELECT invoice_key, line_id, line_number, lower(trim(description)) AS description,
                         row_number() OVER (PARTITION BY invoice_key, lower(trim(description)) ORDER BY line_id) AS n
                  FROM {line_items} WHERE trim(description) <> '')
       SELECT invoice_key, line_id, line_number, description FROM l WHERE n > 1""",
)
def duplicate_line_items(spark, sf_dir):
    return duplicates.repeated_lines(table(spark, sf_dir, "line_items"))


@query(
    "list_invoices",
    """WITH h AS (SELECT * FROM {invoice_headers} WHERE tenant_id = 'tenant_1' AND NOT is_archived AND processing_status = 'completed'
                         AND invoice_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'),
            n AS (SELECT count(*) AS total FROM h)
       SELECT invoice_key, invoice_number, cast(invoice_date as string) AS invoice_date, company_id, customer_id,
              cast(total_amount as double) AS total_amount, cast(created_at as string) AS created_at, total, 2 AS page,
              cast(ceil(total / 20) as bigint) AS pages, true AS has_prev, total > 40 AS has_next
       FROM h, n ORDER BY h.created_at DESC, invoice_key LIMIT 20 OFFSET 20""",
)
def list_invoices(spark, sf_dir):
    rows = listing.list_invoices(
        table(spark, sf_dir, "invoice_headers"),
        "tenant_1",
        status="completed",
        date_from="1997-01-01",
        date_to="2000-12-31",
        number=2,
    )
    facts = ["total", "page", "pages", "has_prev", "has_next"]
    shown = ["invoice_key", "invoice_number", "invoice_date", "company_id", "customer_id", "total_amount", "created_at"]
    return dates_as_text(rows.select(*shown, *facts))


@query(
    "list_companies",
    """WITH c AS (SELECT * FROM {companies} WHERE tenant_id = 'tenant_2' AND is_active), n AS (SELECT count(*) AS total FROM c)
       SELECT id, name, total, 2 AS page, cast(ceil(total / 15) as bigint) AS pages, true AS has_prev, total > 30 AS has_next
       FROM c, n ORDER BY id LIMIT 15 OFFSET 15""",
)
def list_companies(spark, sf_dir):
    rows = listing.list_dimension(table(spark, sf_dir, "companies"), "tenant_2", number=2, per_page=15)
    return rows.select("id", "name", "total", "page", "pages", "has_prev", "has_next")


@query(
    "list_customers",
    """WITH c AS (SELECT * FROM {customers} WHERE tenant_id = 'tenant_3' AND is_active), n AS (SELECT count(*) AS total FROM c)
       SELECT id, name, email, total, 1 AS page, cast(ceil(total / 100) as bigint) AS pages, false AS has_prev, total > 100 AS has_next
       FROM c, n ORDER BY id LIMIT 100""",
)
def list_customers(spark, sf_dir):
    rows = listing.list_dimension(table(spark, sf_dir, "customers"), "tenant_3", number=1, per_page=500)
    return rows.select("id", "name", "email", "total", "page", "pages", "has_prev", "has_next")


@query(
    "invoice_documents",
    f"""WITH l AS (SELECT invoice_key, count(*) AS n, sum(total_price) AS s,
                          arg_min(description, line_id) AS first_description FROM {{line_items}} GROUP BY invoice_key),
             r AS (SELECT *, row_number() OVER (PARTITION BY invoice_key ORDER BY created_at DESC, id) AS rank FROM {{processing_logs}}),
             g AS (SELECT invoice_key, string_agg(process_stage, ',' ORDER BY rank) AS stages FROM r WHERE rank <= 10 GROUP BY invoice_key)
        SELECT h.invoice_key, h.invoice_number, cast(h.total_amount as double) AS total,
               cast(h.total_amount - h.paid_amount as double) AS outstanding,
               {_TODAY} > due_date AND payment_status <> 'paid' AS is_overdue,
               cast(invoice_date + 2555 as string) AS retention_until, h.file_hash,
               CASE WHEN c.legal_name <> '' THEN c.legal_name ELSE c.name END AS vendor,
               CASE WHEN u.customer_type = 'business' AND u.company_name <> '' THEN u.company_name ELSE u.name END AS buyer,
               coalesce(l.n, 0) AS lines, coalesce(cast(l.s as double), 0.0) AS lines_total, l.first_description,
               coalesce(g.stages, '') AS stages
        FROM {{invoice_headers}} h LEFT JOIN l USING (invoice_key) LEFT JOIN g USING (invoice_key)
        LEFT JOIN {{companies}} c ON c.id = h.company_id LEFT JOIN {{customers}} u ON u.id = h.customer_id""",
)
def invoice_documents(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    docs = listing.invoice_documents(
        t("invoice_headers"), AS_OF, t("line_items"), t("processing_logs"), t("companies"), t("customers")
    )
    # Read back from the document text, so that the text itself is what is checked.
    shape = (
        "invoice_number string, amounts struct<total double, outstanding double>, flags struct<is_overdue boolean>,"
        " retention_until string, file_info struct<file_hash string>, company struct<display_name string>,"
        " customer struct<display_name string>,"
        " line_items array<struct<line_id string, description string, total_price decimal(15,2)>>,"
        " processing_logs array<struct<process_stage string>>"
    )
    read = docs.select("invoice_key", F.from_json("document", shape).alias("d"))
    zero = F.lit(0).cast("decimal(25,2)")
    return read.select(
        "invoice_key",
        F.col("d.invoice_number"),
        F.col("d.amounts.total"),
        F.col("d.amounts.outstanding"),
        F.col("d.flags.is_overdue"),
        F.col("d.retention_until"),
        F.col("d.file_info.file_hash"),
        F.col("d.company.display_name").alias("vendor"),
        F.col("d.customer.display_name").alias("buyer"),
        F.array_join("d.processing_logs.process_stage", ",").alias("stages"),
        F.size("d.line_items").alias("lines"),
        F.aggregate("d.line_items", zero, lambda a, x: (a + x["total_price"]).cast("decimal(25,2)")).cast("double").alias("lines_total"),
        F.get("d.line_items", F.lit(0))["description"].alias("first_description"),
    )


@query(
    "company_documents",
    """WITH s AS (SELECT company_id, count(*) AS n, cast(sum(total_amount) as double) AS total FROM {invoice_headers} GROUP BY company_id)
       SELECT id, tenant_id, CASE WHEN legal_name <> '' THEN legal_name ELSE name END AS display_name,
              concat_ws(', ', address_line1, city, state_province, postal_code, country) AS full_address,
              coalesce(n, 0) AS invoice_count, coalesce(total, 0.0) AS total_amount
       FROM {companies} LEFT JOIN s ON company_id = id""",
)
def company_documents(spark, sf_dir):
    companies = table(spark, sf_dir, "companies")
    stats = rollup.vendor_statistics(table(spark, sf_dir, "invoice_headers"), companies)
    shape = "display_name string, address struct<full_address string>, statistics struct<invoice_count bigint, total_amount double>"
    docs = listing.company_documents(companies, stats).select("id", "tenant_id", F.from_json("document", shape).alias("d"))
    return docs.select("id", "tenant_id", "d.display_name", "d.address.full_address", "d.statistics.invoice_count", "d.statistics.total_amount")


@query(
    "customer_documents",
    """WITH s AS (SELECT customer_id, cast(sum(total_amount) - sum(paid_amount) as double) AS rest FROM {invoice_headers} GROUP BY customer_id)
       SELECT id, tenant_id, CASE WHEN customer_type = 'business' AND company_name <> '' THEN company_name ELSE name END AS display_name,
              concat_ws(', ', billing_address_line1, billing_city, billing_state_province, billing_postal_code, billing_country) AS billing_address,
              CASE WHEN shipping_address_line1 <> '' OR shipping_city <> '' THEN concat_ws(', ', shipping_address_line1, shipping_city) END AS shipping_address,
              coalesce(rest, 0.0) AS outstanding_balance
       FROM {customers} LEFT JOIN s ON customer_id = id""",
)
def customer_documents(spark, sf_dir):
    customers = table(spark, sf_dir, "customers")
    stats = rollup.customer_statistics(table(spark, sf_dir, "invoice_headers"), customers)
    shape = (
        "display_name string, billing_address struct<full_address string>, shipping_address struct<full_address string>,"
        " statistics struct<outstanding_balance double>"
    )
    docs = listing.customer_documents(customers, stats).select("id", "tenant_id", F.from_json("document", shape).alias("d"))
    return docs.select(
        "id",
        "tenant_id",
        "d.display_name",
        F.col("d.billing_address.full_address").alias("billing_address"),
        F.col("d.shipping_address.full_address").alias("shipping_address"),
        "d.statistics.outstanding_balance",
    )


@query(
    "processing_status",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY invoice_key ORDER BY created_at DESC, id) AS rank FROM {processing_logs}),
            g AS (SELECT invoice_key, count(*) AS n, string_agg(process_stage, ',' ORDER BY rank) AS stages,
                         arg_min(json_extract_string(metadata, '$.k'), rank) AS latest_k FROM r WHERE rank <= 5 GROUP BY invoice_key)
       SELECT invoice_key, tenant_id, processing_status AS status, extraction_confidence AS confidence, requires_review,
              cast(created_at as string) AS created_at, coalesce(n, 0) AS logs, stages, latest_k
       FROM {invoice_headers} LEFT JOIN g USING (invoice_key)""",
)
def processing_status(spark, sf_dir):
    rows = listing.processing_status(table(spark, sf_dir, "invoice_headers"), table(spark, sf_dir, "processing_logs"))
    return dates_as_text(
        rows.select(
            "*",
            F.coalesce(F.size("recent_logs"), F.lit(0)).alias("logs"),
            F.array_join("recent_logs.process_stage", ",").alias("stages"),
            F.get("recent_logs", F.lit(0))["metadata"]["k"].alias("latest_k"),
        ).drop("recent_logs")
    )


@query(
    "tenant_access",
    """WITH t AS (SELECT tenant_id, count(*) AS own FROM {invoice_headers} GROUP BY tenant_id)
       SELECT user_id, u.tenant_id, role, role IN ('admin', 'super_admin') AS is_admin,
              CASE WHEN role = 'super_admin' THEN (SELECT count(*) FROM {invoice_headers}) ELSE coalesce(own, 0) END AS visible_invoices
       FROM {users} u LEFT JOIN t ON t.tenant_id = u.tenant_id""",
)
def tenant_access(spark, sf_dir):
    return listing.tenant_access(table(spark, sf_dir, "users"), table(spark, sf_dir, "invoice_headers"))


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows FROM {{{n}}}"
        for n in ("users", "companies", "customers", "invoice_headers", "line_items", "processing_logs")
    ),
)
def table_counts(spark, sf_dir):
    names = ("users", "companies", "customers", "invoice_headers", "line_items", "processing_logs")
    return listing.table_counts({n: table(spark, sf_dir, n) for n in names})


_EXPORTED = ["invoice_key", "invoice_number", "invoice_date", "company_id", "customer_id", "total_amount", "payment_terms", "tenant_id"]
_EXPORT_SQL = """SELECT invoice_key, invoice_number, cast(invoice_date as string) AS invoice_date, company_id, customer_id,
                        cast(total_amount as double) AS total_amount, payment_terms, tenant_id
                 FROM {invoice_headers} WHERE invoice_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'"""


def _export(spark, sf_dir, fmt):
    rows = table(spark, sf_dir, "invoice_headers").select(*_EXPORTED)
    return dates_as_text(files.export(rows, shared_folder(spark, f"export-{fmt}"), fmt, date(1998, 1, 1), date(1999, 12, 31)))


@query(
    "write_records",
    """SELECT invoice_key, invoice_number, cast(invoice_date as string) AS invoice_date, company_id, customer_id,
              cast(total_amount as double) AS total_amount, payment_terms, tenant_id FROM {invoice_headers}""",
)
def write_records(spark, sf_dir):
    rows = table(spark, sf_dir, "invoice_headers").select(*_EXPORTED)
    stored = files.store(rows, shared_folder(spark, "records"))
    return dates_as_text(stored)


@query("export_invoices_csv", _EXPORT_SQL)
def export_invoices_csv(spark, sf_dir):
    return _export(spark, sf_dir, "csv")


@query("export_invoices_json", _EXPORT_SQL)
def export_invoices_json(spark, sf_dir):
    return _export(spark, sf_dir, "json")
