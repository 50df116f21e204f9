"""Nested documents read back field by field, one stored invoice, and checks of customers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from billwright.config import AS_OF
from billwright.operators import check_tables as ct
from billwright.operators import listing, rollup
from billwright.plans.registry import dates_as_text, query
from billwright.sources.derived import table

_TODAY = f"DATE '{AS_OF.isoformat()}'"
_PLACE = "line1 string, line2 string, city string, state_province string, postal_code string, country string, full_address string"


def _leaves(shape: T.StructType, path: str) -> list:
    """The fields of a document, those inside named by their way through it."""
    out = []
    for field in shape:
        at = f"{path}.{field.name}"
        out += _leaves(field.dataType, at) if isinstance(field.dataType, T.StructType) else [F.col(at).alias("_".join(at.split(".")[1:]))]
    return out


def _read_back(documents, keys: list[str], shape: str):
    """The documents' text as columns, so that the text itself is what is checked."""
    read = documents.select(*keys, F.from_json("document", shape).alias("d"))
    return read.select(*keys, *_leaves(T.StructType.fromDDL(shape), "d"))


def _sql_place(prefix: str, name: str, shown: str = "true") -> str:
    fields = ["address_line1", "address_line2", "city", "state_province", "postal_code", "country"]
    one = [f"CASE WHEN {shown} THEN {prefix}{f} END AS {name}_{f.removeprefix('address_')}" for f in fields]
    whole = ", ".join(f"nullif({prefix}{f}, '')" for f in fields)
    return ", ".join([*one, f"CASE WHEN {shown} THEN concat_ws(', ', {whole}) END AS {name}_full_address"])


@query(
    "company_record_documents",
    f"""WITH s AS (SELECT company_id, count(*) AS n, cast(sum(total_amount) as double) AS total, max(invoice_date) AS last FROM {{invoice_headers}} GROUP BY company_id)
        SELECT id, name, legal_name, CASE WHEN legal_name <> '' THEN legal_name ELSE name END AS display_name, registration_number, tax_id, email, phone,
               website, {_sql_place("", "address")}, industry, company_size, currency, tenant_id, confidence_score, is_verified, verification_source,
               is_active, is_preferred_vendor, payment_terms_days, cast(created_at as string) AS created_at, cast(updated_at as string) AS updated_at,
               coalesce(n, 0) AS statistics_invoice_count, coalesce(total, 0.0) AS statistics_total_amount, cast(last as string) AS statistics_last_invoice_date
        FROM {{company_records}} LEFT JOIN s ON company_id = id""",
)
def company_record_documents(spark, sf_dir):
    companies = table(spark, sf_dir, "company_records")
    stats = rollup.vendor_statistics(table(spark, sf_dir, "invoice_headers"), companies)
    shape = (
        "name string, legal_name string, display_name string, registration_number string, tax_id string, email string, phone string,"
        f" website string, address struct<{_PLACE}>, industry string, company_size string, currency string, tenant_id string,"
        " confidence_score double, is_verified boolean, verification_source string, is_active boolean, is_preferred_vendor boolean,"
        " payment_terms_days int, created_at string, updated_at string,"
        " statistics struct<invoice_count bigint, total_amount double, last_invoice_date string>"
    )
    return _read_back(listing.company_documents(companies, stats).drop("tenant_id"), ["id"], shape)


@query(
    "customer_record_documents",
    f"""WITH s AS (SELECT customer_id, count(*) AS n, cast(sum(total_amount) as double) AS billed, cast(sum(paid_amount) as double) AS paid,
                          cast(sum(total_amount) - sum(paid_amount) as double) AS rest, max(invoice_date) AS last, max(payment_date) AS last_paid
                   FROM {{invoice_headers}} GROUP BY customer_id),
             c AS (SELECT *, coalesce(shipping_address_line1, '') <> '' OR coalesce(shipping_city, '') <> '' OR shipping_postal_code <> ''
                          OR coalesce(shipping_country, '') <> '' AS shipped FROM {{customer_records}})
        SELECT id, name, company_name, CASE WHEN customer_type = 'business' AND company_name <> '' THEN company_name ELSE name END AS display_name,
               customer_type, email, phone, mobile, {_sql_place("billing_", "billing_address")}, {_sql_place("shipping_", "shipping_address", "shipped")},
               tax_id, registration_number, website, tenant_id, confidence_score, is_verified, verification_source,
               cast(customer_since as string) AS customer_since, customer_segment, nullif(cast(credit_limit as double), 0) AS credit_limit,
               payment_terms_days, is_active, is_vip, allow_credit, preferred_contact_method, send_invoice_copy, marketing_consent,
               cast(created_at as string) AS created_at, cast(updated_at as string) AS updated_at, coalesce(n, 0) AS statistics_invoice_count,
               coalesce(billed, 0.0) AS statistics_total_billed, coalesce(paid, 0.0) AS statistics_total_paid,
               coalesce(rest, 0.0) AS statistics_outstanding_balance, cast(last as string) AS statistics_last_invoice_date,
               cast(last_paid as string) AS statistics_last_payment_date
        FROM c LEFT JOIN s ON customer_id = id""",
)
def customer_record_documents(spark, sf_dir):
    customers = table(spark, sf_dir, "customer_records")
    stats = rollup.customer_statistics(table(spark, sf_dir, "invoice_headers"), customers)
    shape = (
        "name string, company_name string, display_name string, customer_type string, email string, phone string, mobile string,"
        f" billing_address struct<{_PLACE}>, shipping_address struct<{_PLACE}>, tax_id string, registration_number string, website string,"
        " tenant_id string, confidence_score double, is_verified boolean, verification_source string, customer_since string,"
        " customer_segment string, credit_limit double, payment_terms_days int, is_active boolean, is_vip boolean, allow_credit boolean,"
        " preferred_contact_method string, send_invoice_copy boolean, marketing_consent boolean, created_at string, updated_at string,"
        " statistics struct<invoice_count bigint, total_billed double, total_paid double, outstanding_balance double,"
        " last_invoice_date string, last_payment_date string>"
    )
    return _read_back(listing.customer_documents(customers, stats).drop("tenant_id"), ["id"], shape)


_LINE = (
    "id string, invoice_id bigint, line_number int, description string, item_code string, quantity double, unit_of_measure string,"
    " unit_price double, total_price double, tax_rate double, tax_amount double, discount_rate double, discount_amount double,"
    " category string, product_type string, confidence_score double, created_at string, updated_at string"
)
_LOG = (
    "id bigint, invoice_id bigint, user_id bigint, log_level string, process_stage string, message string, processing_time_ms int,"
    " confidence_score double, error_code string, error_details string, ip_address string, user_agent string, created_at string"
)
_AMOUNTS = ("subtotal", "tax", "discount", "shipping", "total", "paid")


@query(
    "invoice_record_documents",
    f"""WITH l AS (SELECT invoice_key, count(*) AS n, arg_min(r, line_id) AS f FROM {{line_records}} r GROUP BY invoice_key),
             g AS (SELECT invoice_key, least(count(*), 10) AS n, arg_max(r, row(created_at, -id)) AS f FROM {{log_records}} r GROUP BY invoice_key)
        SELECT h.invoice_key, h.invoice_key AS id, invoice_number, cast(invoice_date as string) AS invoice_date, cast(due_date as string) AS due_date, po_number,
               company_id, customer_id, user_id, tenant_id, currency, {", ".join(f"cast({a}_amount as double) AS amounts_{a}" for a in _AMOUNTS)},
               tax_rate AS amounts_tax_rate, cast(total_amount - paid_amount as double) AS amounts_outstanding, payment_terms AS payment_terms,
               payment_method, payment_status, cast(payment_date as string) AS payment_date, payment_reference, invoice_type, invoice_category,
               processing_status, extraction_confidence AS processing_confidence, requires_review AS processing_requires_review,
               reviewed_by AS processing_reviewed_by, cast(reviewed_at as string) AS processing_reviewed_at,
               original_filename AS file_info_original_filename, file_size AS file_info_file_size, file_hash AS file_info_file_hash,
               is_duplicate AS flags_is_duplicate, duplicate_of AS flags_duplicate_of,
               {_TODAY} > due_date AND payment_status <> 'paid' AS flags_is_overdue,
               cast(CASE WHEN {_TODAY} > due_date AND payment_status <> 'paid' THEN {_TODAY} - due_date ELSE 0 END as int) AS flags_days_overdue,
               payment_status = 'paid' AND total_amount - paid_amount <= 0 AS flags_is_fully_paid, is_archived AS flags_is_archived,
               line_items_count, cast(invoice_date + 2555 as string) AS retention_until, cast(created_at as string) AS created_at,
               cast(updated_at as string) AS updated_at, coalesce(l.n, 0) AS lines, l.f.line_id AS line_id, l.f.invoice_key AS line_invoice_id,
               l.f.line_number AS line_line_number, l.f.description AS line_description, l.f.item_code AS line_item_code,
               cast(l.f.quantity as double) AS line_quantity, CASE WHEN l.n > 0 THEN coalesce(l.f.unit_of_measure, 'each') END AS line_unit_of_measure,
               cast(l.f.unit_price as double) AS line_unit_price, cast(l.f.total_price as double) AS line_total_price, l.f.tax_rate AS line_tax_rate,
               CASE WHEN l.n > 0 THEN coalesce(cast(l.f.tax_amount as double), 0.0) END AS line_tax_amount, l.f.discount_rate AS line_discount_rate,
               CASE WHEN l.n > 0 THEN coalesce(cast(l.f.discount_amount as double), 0.0) END AS line_discount_amount, l.f.category AS line_category,
               CASE WHEN l.n > 0 THEN coalesce(l.f.product_type, 'product') END AS line_product_type, l.f.confidence_score AS line_confidence_score,
               cast(l.f.created_at as string) AS line_created_at, cast(l.f.updated_at as string) AS line_updated_at, coalesce(g.n, 0) AS logs,
               g.f.id AS log_id, g.f.invoice_key AS log_invoice_id, {", ".join(f"g.f.{c} AS log_{c}" for c in ("user_id", "log_level", "process_stage", "message", "processing_time_ms", "confidence_score", "error_code", "error_details", "ip_address", "user_agent"))},
               cast(g.f.created_at as string) AS log_created_at, json_extract_string(g.f.metadata, '$.k') AS log_k
        FROM {{header_records}} h LEFT JOIN l USING (invoice_key) LEFT JOIN g USING (invoice_key)""",
)
def invoice_record_documents(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    docs = listing.invoice_documents(t("header_records"), AS_OF, t("line_records"), t("log_records"))
    amounts = ", ".join(f"{a} double" for a in (*_AMOUNTS, "tax_rate", "outstanding"))
    shape = (
        "id bigint, invoice_number string, invoice_date string, due_date string, po_number string, company_id string, customer_id string,"
        f" user_id bigint, tenant_id string, currency string, amounts struct<{amounts}>,"
        " payment struct<terms string, method string, status string, date string, reference string>, invoice_type string,"
        " invoice_category string, processing struct<status string, confidence double, requires_review boolean, reviewed_by bigint,"
        " reviewed_at string>, file_info struct<original_filename string, file_size bigint, file_hash string>,"
        " flags struct<is_duplicate boolean, duplicate_of bigint, is_overdue boolean, days_overdue int, is_fully_paid boolean,"
        " is_archived boolean>, line_items_count bigint, retention_until string, created_at string, updated_at string"
    )
    nested = f", line_items array<struct<{_LINE}>>, processing_logs array<struct<{_LOG}, metadata map<string, string>>>"
    read = docs.select("invoice_key", F.from_json("document", shape + nested).alias("d"))
    line, log = F.get("d.line_items", F.lit(0)), F.get("d.processing_logs", F.lit(0))
    return read.select(
        "invoice_key",
        *_leaves(T.StructType.fromDDL(shape), "d"),
        F.size("d.line_items").alias("lines"),
        *[line[f.name].alias(f"line_{f.name}") for f in T.StructType.fromDDL(_LINE)],
        F.size("d.processing_logs").alias("logs"),
        *[log[f.name].alias(f"log_{f.name}") for f in T.StructType.fromDDL(_LOG)],
        log["metadata"]["k"].alias("log_k"),
    )


@query(
    "get_invoice",
    """WITH k AS (SELECT max(invoice_key) AS k FROM {invoice_headers} WHERE tenant_id = 'tenant_1')
       SELECT invoice_key, tenant_id, invoice_number, cast(invoice_date as string) AS invoice_date, cast(total_amount as double) AS total_amount
       FROM {invoice_headers}, k WHERE invoice_key = k AND tenant_id = 'tenant_1'""",
)
def get_invoice(spark, sf_dir):
    """A tenant's newest invoice by its id; another tenant's id finds nothing."""
    headers = table(spark, sf_dir, "invoice_headers")
    newest = headers.where("tenant_id = 'tenant_1'").agg(F.max("invoice_key")).first()[0]
    mine, others = (listing.get_by_id(headers, newest, t) for t in ("tenant_1", "tenant_2"))
    shown = ["invoice_key", "tenant_id", "invoice_number", "invoice_date", "total_amount"]
    return dates_as_text(mine.unionByName(others).select(*shown))


@query(
    "check_customers",
    """WITH c AS (SELECT * FROM {checked_customers}),
            f AS (SELECT tenant_id, 'name' AS field, 'Customer name is required' AS message FROM c WHERE name = ''
                  UNION ALL SELECT tenant_id, 'name', 'Customer name must be at least 2 characters' FROM c WHERE name = ' Z '
                  UNION ALL SELECT tenant_id, 'email', 'Invalid email format' FROM c WHERE email = 'no at sign'
                  UNION ALL SELECT tenant_id, 'phone', 'Invalid phone number format' FROM c WHERE phone = '12-34')
       SELECT 'customers' AS table_name, tenant_id, field, message, count(*) AS rows FROM f GROUP BY ALL""",
)
def check_customers(spark, sf_dir):
    return ct.failures(table(spark, sf_dir, "checked_customers"), "customers", ct.checks.check_customer())


@query(
    "check_codes",
    """SELECT id, 'billing_postal_code' AS field, billing_postal_code AS value FROM {checked_customers}
       WHERE billing_postal_code <> '' AND NOT regexp_full_match(replace(replace(billing_postal_code, ' ', ''), '-', ''), '[A-Za-z0-9]{3,10}')
       UNION ALL SELECT id, 'tenant_id', tenant_id FROM {checked_customers} WHERE NOT regexp_full_match(tenant_id, '[A-Za-z0-9_]{3,50}')""",
)
def check_codes(spark, sf_dir):
    return ct.bad_codes(table(spark, sf_dir, "checked_customers"))
