"""Queries that check, validate and process invoices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from billwright.config import REFERENCE, RuleSet
from billwright.operators import check_tables as ct
from billwright.operators import process, validate
from billwright.plans.registry import dates_as_text, query
from billwright.plans.texts import _SOURCE
from billwright.sources.derived import table

_DAY = date(2000, 6, 30)
#: No stored total reaches the published limit, so these queries lower it.
_RULES = RuleSet(max_total_amount="400000.00", max_line_items=8)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "line_items_noisy").withColumn("confidence", F.lit(0.8))


_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

_L = """l AS (SELECT *, abs(total_price - quantity * unit_price) > 0.02 AND quantity > 0 AND unit_price > 0 AS off FROM {line_items_noisy}),
    g AS (SELECT invoice_key, count(*) AS n, cast(sum(total_price) as decimal(15,2)) AS line_sum,
                 sum((quantity <= 0)::int + (total_price < 0)::int) AS e, sum((description = '')::int + off::int) AS q,
                 count(*) FILTER (WHERE description <> '') - count(DISTINCT CASE WHEN description <> '' THEN lower(trim(description)) END) AS w
          FROM l GROUP BY invoice_key)"""

# (rule, severity, condition, message) of a header x with line sums.
_RULES_SQL = [
    ("required_fields", "error", "invoice_number = ''", "'Missing required field: invoice_metadata.invoice_number'"),
    ("required_fields", "error", "vendor_name = ''", "'Missing required field: company_data.name'"),
    ("required_fields", "error", "total_amount = 0", "'Missing required field: financial_data.total_amount'"),
    *[
        (
            "confidence_thresholds",
            "warning",
            f"{col} < {least}",
            f"concat('Low confidence in {section}: ', cast(cast(round({col}, 2) as decimal(5,2)) as string), ' < {least}0')",
        )
        for section, col, least in (
            ("invoice_metadata", "metadata_confidence", "0.6"),
            ("company_data", "company_confidence", "0.5"),
            ("customer_data", "customer_confidence", "0.4"),
            ("financial_data", "financial_confidence", "0.7"),
            ("line_items", "CASE WHEN n > 0 THEN 0.8 ELSE 0.0 END", "0.5"),
        )
    ],
    ("metadata_rules", "issue", "invoice_number <> '' AND length(invoice_number) < 3", "'Invoice number appears too short'"),
    ("metadata_rules", "issue", "regexp_matches(invoice_number, '[^a-zA-Z0-9_-]')", "'Invoice number contains unusual characters'"),
    (
        "metadata_rules",
        "violation",
        "invoice_date - DATE '2000-06-30' > 30",
        "concat('Invoice date is ', invoice_date - DATE '2000-06-30', ' days in the future (max: 30)')",
    ),
    ("metadata_rules", "warning", "invoice_date < DATE '1998-06-30'", "'Invoice date is more than 2 years old'"),
    ("metadata_rules", "error", "due_date < invoice_date", "'Due date cannot be before invoice date'"),
    ("company_rules", "issue", "length(vendor_name) = 1", "'Company name appears too short'"),
    (
        "company_rules",
        "warning",
        "length(vendor_name) > 10 AND upper(vendor_name) = vendor_name AND lower(vendor_name) <> vendor_name",
        "'Company name is all uppercase - possible OCR issue'",
    ),
    (
        "company_rules",
        "issue",
        f"vendor_email <> '' AND NOT regexp_matches(vendor_email, '{_EMAIL}')",
        "concat('Invalid email format: ', vendor_email)",
    ),
    (
        "company_rules",
        "issue",
        r"vendor_phone <> '' AND length(regexp_replace(vendor_phone, '\D', '', 'g')) NOT BETWEEN 7 AND 15",
        "concat('Phone number appears invalid: ', vendor_phone)",
    ),
    ("company_rules", "issue", "vendor_address_line1 = ''", "'Company address is incomplete'"),
    ("customer_rules", "issue", "length(customer_name) = 1", "'Customer name appears too short'"),
    (
        "customer_rules",
        "issue",
        f"NOT regexp_matches(customer_email, '{_EMAIL}')",
        "concat('Invalid customer email format: ', customer_email)",
    ),
    *[
        ("financial_rules", "error", f"{c} < 0", f"concat('{c} cannot be negative: ', {c})")
        for c in ("subtotal_amount", "tax_amount", "total_amount", "discount_amount", "shipping_amount")
    ],
    ("financial_rules", "violation", "total_amount < 0.01", "concat('Total amount too small: $', total_amount, ' < $0.01')"),
    ("financial_rules", "violation", "total_amount > 400000", "concat('Total amount too large: $', total_amount, ' > $400000.00')"),
    (
        "financial_rules",
        "violation",
        "tax_rate > 50",
        "concat('Tax rate too high: ', cast(tax_rate as decimal(9,2)), '% > 50.00%')",
    ),
    ("financial_rules", "error", "tax_rate < 0", "concat('Tax rate cannot be negative: ', cast(tax_rate as decimal(9,2)), '%')"),
    (
        "financial_consistency",
        "issue",
        "abs(total_amount - subtotal_amount - tax_amount) > 0.02",
        "concat('Total amount calculation inconsistent: Expected $', cast(subtotal_amount + tax_amount as decimal(15,2)), ', Found $', total_amount)",
    ),
    (
        "financial_consistency",
        "issue",
        "tax_rate > 0 AND subtotal_amount > 0 AND abs(tax_amount - tax_due) > 0.02",
        "concat('Tax calculation inconsistent: Expected $', cast(round(tax_due, 2) as decimal(20,2)), ', Found $', tax_amount)",
    ),
    ("financial_rules", "warning", "currency = 'XXX'", "concat('Unusual currency detected: ', currency)"),
    ("line_item_rules", "violation", "n > 8", "concat('Too many line items: ', n, ' > 8')"),
    (
        "line_item_rules",
        "issue",
        "n > 0 AND subtotal_amount > 0 AND abs(line_sum - subtotal_amount) > 0.02",
        "concat('Line items total ($', line_sum, ') doesn''t match invoice subtotal ($', subtotal_amount, ')')",
    ),
    ("business_rules", "warning", "payment_terms = 'Net 400'", "concat('Unusual payment terms: ', payment_terms)"),
]
_X = f"""WITH {_L},
    x AS (SELECT h.*, coalesce(n, 0) AS n, coalesce(line_sum, 0) AS line_sum, coalesce(e, 0) AS e, coalesce(q, 0) AS q, coalesce(w, 0) AS w,
                 cast(cast(subtotal_amount as decimal(22,2)) * cast(cast(tax_rate as string) as decimal(12,8)) * cast(0.01 as decimal(3,2)) as decimal(38,12)) AS tax_due
          FROM {{headers_to_check}} h LEFT JOIN g USING (invoice_key))"""


def _sum(severity: str) -> str:
    return " + ".join(f"coalesce(({c})::int, 0)" for _, s, c, _ in _RULES_SQL if s == severity)




@query(
    "validate_invoices",
    f"""{_X},
        s AS (SELECT *, {_sum('error')} + e AS errors, {_sum('warning')} + w AS warnings, {_sum('violation')} AS violations,
                     {_sum('issue')} + q AS issues FROM x),
        z AS (SELECT *, greatest(0.0::double, least(1.0::double, 1.0::double - errors * 0.2::double - violations * 0.15::double
                     - issues * 0.1::double - warnings * 0.05::double)) AS confidence_score,
                     metadata_confidence < 0.6 OR company_confidence < 0.5 OR n = 0 AS low FROM s)
        SELECT invoice_key, tenant_id, invoice_number <> '' AND vendor_name <> '' AND total_amount <> 0 AS is_valid,
               low OR errors > 0 OR violations > 0 OR confidence_score < 0.7 OR issues >= 3 AS requires_review, confidence_score,
               cast(errors as bigint) AS errors, cast(warnings as bigint) AS warnings, cast(violations as bigint) AS violations,
               cast(issues as bigint) AS issues,
               concat_ws('; ', CASE WHEN abs(total_amount - subtotal_amount - tax_amount) > 0.02 THEN '{validate.CHECK_SUMS}' END,
                         CASE WHEN errors > 0 OR violations > 0 THEN '{validate.REVIEW_ERRORS}' END,
                         CASE WHEN confidence_score < 0.7 THEN '{validate.REVIEW_SCORE}' END,
                         CASE WHEN issues >= 3 THEN '{validate.REVIEW_QUALITY}' END,
                         CASE WHEN NOT (low OR errors > 0 OR violations > 0 OR confidence_score < 0.7 OR issues >= 3) THEN '{validate.READY}' END) AS recommendations
        FROM z""",
)
def validate_invoices(spark, sf_dir):
    rows = validate.with_line_summary(table(spark, sf_dir, "headers_to_check"), _lines(spark, sf_dir), _RULES)
    return _verdict_columns(validate.verdicts(rows, _DAY, _RULES))


def _verdict_columns(rows):
    return rows.select(
        "invoice_key",
        "tenant_id",
        "is_valid",
        "requires_review",
        "confidence_score",
        *[F.col(c).cast("bigint").alias(c) for c in ("errors", "warnings", "violations", "issues")],
        F.array_join("recommendations", "; ").alias("recommendations"),
    )


@query(
    "validate_invoices_reference_preset",
    """SELECT invoice_key, tenant_id, false AS is_valid, true AS requires_review, 0.0::double AS confidence_score, 1::bigint AS errors,
              ((metadata_confidence < 0.6)::int + (company_confidence < 0.5)::int + (financial_confidence < 0.7)::int)::bigint AS warnings,
              0::bigint AS violations, 0::bigint AS issues, '' AS recommendations
       FROM {headers_to_check}""",
)
def validate_invoices_reference_preset(spark, sf_dir):
    rows = validate.with_line_summary(table(spark, sf_dir, "headers_to_check"), _lines(spark, sf_dir), _RULES)
    return _verdict_columns(validate.verdicts(rows, _DAY, _RULES, REFERENCE))


_FINDINGS = f"""{_X},
    f AS ({' UNION ALL '.join(f"SELECT invoice_key, tenant_id, '{r}' AS rule, '{s}' AS severity, {m} AS message FROM x WHERE {c}" for r, s, c, m in _RULES_SQL)}
        UNION ALL SELECT l.invoice_key, tenant_id, 'line_item_rules', 'issue', concat('Line ', line_number, ': Missing description') FROM l JOIN x USING (invoice_key) WHERE description = ''
        UNION ALL SELECT l.invoice_key, tenant_id, 'line_item_rules', 'error', concat('Line ', line_number, ': Invalid quantity: ', quantity) FROM l JOIN x USING (invoice_key) WHERE quantity <= 0
        UNION ALL SELECT l.invoice_key, tenant_id, 'line_item_rules', 'error', concat('Line ', line_number, ': Negative total price: $', total_price) FROM l JOIN x USING (invoice_key) WHERE total_price < 0
        UNION ALL SELECT l.invoice_key, tenant_id, 'line_item_rules', 'issue',
               concat('Line ', line_number, ': Price calculation inconsistent: Expected $', cast(round(quantity * unit_price, 2) as decimal(20,2)), ', Found $', total_price)
               FROM l JOIN x USING (invoice_key) WHERE off
        UNION ALL SELECT d.invoice_key, tenant_id, 'business_rules', 'warning', concat('Possible duplicate line item: ', d.name)
               FROM (SELECT invoice_key, lower(trim(description)) AS name, row_number() OVER (PARTITION BY invoice_key, lower(trim(description)) ORDER BY line_id) AS k
                     FROM l WHERE trim(description) <> '') d JOIN x USING (invoice_key) WHERE k > 1)"""


@query("validation_findings", f"{_FINDINGS} SELECT * FROM f")
def validation_findings(spark, sf_dir):
    return validate.findings(table(spark, sf_dir, "headers_to_check"), _lines(spark, sf_dir), _DAY, _RULES)


@query(
    "validation_finding_counts",
    f"{_FINDINGS} SELECT tenant_id, rule, severity, count(*) AS findings, count(DISTINCT invoice_key) AS invoices FROM f GROUP BY ALL",
)
def validation_finding_counts(spark, sf_dir):
    rows = validate.findings(table(spark, sf_dir, "headers_to_check"), _lines(spark, sf_dir), _DAY, _RULES)
    # Counted per invoice first, so distinct invoices need no second pass over findings.
    per_invoice = rows.groupBy("tenant_id", "rule", "severity", "invoice_key").agg(F.count(F.lit(1)).alias("n"))
    return per_invoice.groupBy("tenant_id", "rule", "severity").agg(
        F.sum("n").alias("findings"), F.count(F.lit(1)).alias("invoices")
    )


_CHECKS = [
    ("companies", "checked_companies", "name", "name = ''", "Company name is required"),
    ("companies", "checked_companies", "name", "name = ' X '", "Company name must be at least 2 characters"),
    ("companies", "checked_companies", "email", "email LIKE 'billing.%' OR email LIKE 'a..b%'", "Invalid email format"),
    ("companies", "checked_companies", "phone", "phone = '12-34'", "Invalid phone number format"),
    ("companies", "checked_companies", "tax_id", "tax_id = 'T!'", "Invalid tax ID format"),
    ("invoice_headers", "checked_headers", "invoice_number", "invoice_number = ''", "Invoice number is required"),
    ("invoice_headers", "checked_headers", "invoice_number", "invoice_number IN ('A1', 'INV 17')", "Invalid invoice number format"),
    ("invoice_headers", "checked_headers", "invoice_date", "invoice_date = '2001-13-45'", "Invalid invoice date format"),
    ("invoice_headers", "checked_headers", "due_date", "due_date = '01/02/2001'", "Invalid due date format"),
    ("invoice_headers", "checked_headers", "total_amount", "total_amount IN ('-1.50', 'abc')", "Invalid total amount"),
    ("line_items", "line_items_noisy", "description", "description = ''", "Line item description is required"),
    ("line_items", "line_items_noisy", "quantity", "quantity <= 0", "Quantity must be greater than zero"),
    ("line_items", "line_items_noisy", "total_price", "total_price < 0", "Invalid total price format"),
]


@query(
    "check_tables",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {chr(39) * 2 if t.startswith('line') else 'tenant_id'} AS tenant_id, '{field}' AS field,"
        f" '{text}' AS message, count(*) AS rows FROM {{{t}}} WHERE {cond} GROUP BY ALL"
        for name, t, field, cond, text in _CHECKS
    ),
)
def check_tables(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return ct.check_tables(t("checked_companies"), t("customers"), t("checked_headers"), t("line_items_noisy"))


_PROCESSED = f"""{_SOURCE},
    l AS (SELECT invoice_key, count(*) AS n, cast(sum(total_price) as decimal(15,2)) AS line_sum,
                 sum((abs(total_price - quantity * cast(round(unit_price, 2) as decimal(15,2))) > 0.02)::int) AS q,
                 count(*) - count(DISTINCT lower(description)) AS w FROM {{line_items}} GROUP BY invoice_key),
    ac AS (SELECT * FROM {{companies}} WHERE is_active), au AS (SELECT * FROM {{customers}} WHERE is_active),
    vn AS (SELECT d.tenant_id, d.vendor_name, min(ac.id) AS id FROM (SELECT DISTINCT tenant_id, vendor_name FROM x) d
           JOIN ac ON ac.tenant_id = d.tenant_id AND contains(lower(ac.name), lower(d.vendor_name)) GROUP BY ALL),
    un AS (SELECT d.tenant_id, d.customer_name, min(au.id) AS id FROM (SELECT DISTINCT tenant_id, customer_name FROM x) d
           JOIN au ON au.tenant_id = d.tenant_id AND contains(lower(au.name), lower(d.customer_name)) GROUP BY ALL),
    r AS (SELECT x.*, coalesce(l.n, 0) AS n, l.line_sum, coalesce(l.q, 0) AS lq, coalesce(l.w, 0) AS lw,
                 coalesce(vt.id, vn.id) AS vid, un.id AS uid, (m + c + 0.75 + f) / 4 AS overall,
                 CASE WHEN x.total_amount = 0 OR abs(x.total_amount - expected) > 0.01 THEN expected ELSE x.total_amount END AS total,
                 CASE WHEN subtotal_amount > 0 AND tax_amount > 0 THEN cast(tax_amount as double) / cast(subtotal_amount as double) * 100 ELSE 0.0 END AS rate
          FROM x LEFT JOIN l ON l.invoice_key = x.invoice_key
          LEFT JOIN ac vt ON vt.tenant_id = x.tenant_id AND vt.tax_id = x.vendor_tax_id
          LEFT JOIN vn ON vn.tenant_id = x.tenant_id AND vn.vendor_name = x.vendor_name
          LEFT JOIN un ON un.tenant_id = x.tenant_id AND un.customer_name = x.customer_name),
    k AS (SELECT *, (total = 0)::int AS errors, (n = 0)::int + (invoice_date < DATE '1998-06-30')::int + lw AS warnings,
                 (total < 0.01)::int + (invoice_date - DATE '2000-06-30' > 30)::int + (total > 400000)::int + (n > 8)::int AS violations,
                 (vendor_street = '')::int + lq AS issues,
                 CASE WHEN vid IS NULL THEN min(invoice_key) OVER (PARTITION BY tenant_id, lower(vendor_name), vid IS NULL) END AS vnew,
                 CASE WHEN uid IS NULL THEN min(invoice_key) OVER (PARTITION BY tenant_id, lower(customer_name), uid IS NULL) END AS unew FROM r),
    z AS (SELECT *, greatest(0.0::double, least(1.0::double, 1.0::double - errors * 0.2::double - violations * 0.15::double
                 - issues * 0.1::double - warnings * 0.05::double)) AS confidence_score FROM k),
    v AS (SELECT *, n = 0 OR errors > 0 OR violations > 0 OR confidence_score < 0.7 OR issues >= 3 AS review,
                 CASE WHEN n > 0 THEN line_sum ELSE subtotal_amount END AS fs,
                 cast(CASE WHEN n > 0 AND rate > 0 THEN round(cast(line_sum as decimal(20,2)) * cast(cast(rate as string) as decimal(18,12)) * cast(0.01 as decimal(3,2)), 2)
                           ELSE tax_amount END as decimal(15,2)) AS ft FROM z)"""


@query(
    "process_invoices",
    f"""{_PROCESSED}
    SELECT invoice_key, tenant_id, invoice_number, cast(invoice_date as string) AS invoice_date, cast(due_date as string) AS due_date,
           coalesce(vid, concat('CO-new-', vnew)) AS company_id, coalesce(uid, concat('CU-new-', unew)) AS customer_id,
           cast(fs as double) AS subtotal_amount, cast(ft as double) AS tax_amount,
           cast(CASE WHEN n > 0 THEN fs + ft ELSE total END as double) AS total_amount, n AS line_items_count, overall AS extraction_confidence,
           CASE WHEN total = 0 THEN 'failed' ELSE 'completed' END AS processing_status, review OR total = 0 AS requires_review,
           total <> 0 AS is_valid, confidence_score, cast(errors as int) AS errors, cast(warnings as int) AS warnings,
           cast(violations as int) AS violations, cast(issues as int) AS issues
    FROM v""",
)
def process_invoices(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return dates_as_text(process.process_invoices(t("invoice_texts"), t("companies"), t("customers"), _DAY, _RULES))


_LOGS = f"""{_PROCESSED}
    SELECT invoice_key, tenant_id, 1 AS step, 'processing_start' AS process_stage, 'Starting invoice processing' AS message, 'INFO' AS log_level,
           NULL::double AS confidence_score FROM v
    UNION ALL SELECT invoice_key, tenant_id, 2, 'extraction', concat('Data extraction completed with ', n, ' line items'), 'INFO', overall FROM v
    UNION ALL SELECT invoice_key, tenant_id, 3, 'validation', concat('Validation completed - Valid: ', CASE WHEN total <> 0 THEN 'True' ELSE 'False' END), 'INFO', confidence_score FROM v
    UNION ALL SELECT invoice_key, tenant_id, 4, 'completion',
              concat('Invoice processing completed with status: ', CASE WHEN total = 0 THEN 'failed' ELSE 'completed' END), 'INFO', overall FROM v"""


@query("stage_logs", _LOGS)
def stage_logs(spark, sf_dir):
    return process.stage_logs(process.checked_records(table(spark, sf_dir, "invoice_texts"), _DAY, _RULES))
