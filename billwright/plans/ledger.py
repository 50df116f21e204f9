"""Queries on stored headers and lines: totals, payment state, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from billwright.config import AS_OF
from billwright.operators import rollup
from billwright.plans.registry import dates_as_text, query
from billwright.sources.derived import table

_TODAY = f"DATE '{AS_OF.isoformat()}'"


@query(
    "vendor_statistics",
    """SELECT c.id AS company_id, c.tenant_id, c.name, count(h.invoice_key) AS invoice_count,
              cast(coalesce(sum(h.total_amount), 0) as double) AS total_amount,
              cast(max(h.invoice_date) as string) AS last_invoice_date
       FROM {companies} c LEFT JOIN {invoice_headers} h ON h.company_id = c.id GROUP BY ALL""",
)
def vendor_statistics(spark, sf_dir):
    return dates_as_text(rollup.vendor_statistics(table(spark, sf_dir, "invoice_headers"), table(spark, sf_dir, "companies")))


@query(
    "customer_statistics",
    """SELECT c.id AS customer_id, c.tenant_id, count(h.invoice_key) AS invoice_count,
              cast(coalesce(sum(h.total_amount), 0) as double) AS total_billed,
              cast(coalesce(sum(h.paid_amount), 0) as double) AS total_paid,
              cast(coalesce(sum(h.total_amount), 0) - coalesce(sum(h.paid_amount), 0) as double) AS outstanding_balance,
              cast(max(h.invoice_date) as string) AS last_invoice_date, cast(max(h.payment_date) as string) AS last_payment_date
       FROM {customers} c LEFT JOIN {invoice_headers} h ON h.customer_id = c.id GROUP BY ALL""",
)
def customer_statistics(spark, sf_dir):
    return dates_as_text(rollup.customer_statistics(table(spark, sf_dir, "invoice_headers"), table(spark, sf_dir, "customers")))


@query(
    "invoice_totals",
    """WITH s AS (SELECT invoice_key, cast(sum(total_price) as decimal(15,2)) AS line_sum, count(*) AS n
                  FROM {line_items_noisy} GROUP BY invoice_key),
            t AS (SELECT h.*, n, coalesce(line_sum, subtotal_amount) AS sub,
                         cast(CASE WHEN n IS NULL OR tax_rate <= 0 THEN tax_amount
                              ELSE round(cast(line_sum as decimal(20,2)) * cast(cast(tax_rate as string) as decimal(18,12)) * cast(0.01 as decimal(3,2)), 2) END
                              as decimal(15,2)) AS tax
                  FROM {invoice_headers} h LEFT JOIN s ON s.invoice_key = h.invoice_key)
       SELECT invoice_key, tenant_id, cast(sub as double) AS subtotal_amount, cast(tax as double) AS tax_amount,
              cast(CASE WHEN n IS NULL THEN total_amount ELSE sub + tax + shipping_amount - discount_amount END as double) AS total_amount,
              coalesce(n, 0) AS line_items_count
       FROM t""",
)
def invoice_totals(spark, sf_dir):
    return dates_as_text(rollup.invoice_totals(table(spark, sf_dir, "invoice_headers"), table(spark, sf_dir, "line_items_noisy")))


@query(
    "line_totals",
    """WITH b AS (SELECT invoice_key, line_id, cast(quantity * unit_price as decimal(20,7)) AS base,
                         cast(cast(discount_rate as string) as decimal(9,6)) AS dr, cast(cast(tax_rate as string) as decimal(9,6)) AS tr
                  FROM {line_items}),
            d AS (SELECT *, base - base * dr * cast(0.01 as decimal(3,2)) AS net FROM b),
            t AS (SELECT *, cast(net as decimal(28,15)) * cast(tr as decimal(8,4)) * cast(0.01 as decimal(3,2)) AS tax FROM d)
       SELECT invoice_key, line_id, cast(round(base - net, 2) as double) AS discount_amount, cast(round(tax, 2) as double) AS tax_amount,
              cast(round(net + tax, 2) as double) AS line_total FROM t""",
)
def line_totals(spark, sf_dir):
    return dates_as_text(rollup.line_totals(table(spark, sf_dir, "line_items")))


_STATES = f"""SELECT *, CASE WHEN total_amount <= 0 THEN 'paid'
                             WHEN paid_amount <= 0 THEN CASE WHEN {_TODAY} > due_date AND payment_status <> 'paid' THEN 'overdue' ELSE 'unpaid' END
                             WHEN paid_amount >= total_amount THEN 'paid' ELSE 'partial' END AS status
              FROM {{invoice_headers}}"""


@query(
    "payment_state",
    f"""WITH s AS ({_STATES})
        SELECT invoice_key, tenant_id, company_id, cast(total_amount - paid_amount as double) AS outstanding_amount,
               {_TODAY} > due_date AND status <> 'paid' AS is_overdue,
               CASE WHEN {_TODAY} > due_date AND status <> 'paid' THEN {_TODAY} - due_date ELSE 0 END AS days_overdue,
               status = 'paid' AND total_amount - paid_amount <= 0 AS is_fully_paid, status AS payment_status
        FROM s""",
)
def payment_state(spark, sf_dir):
    return dates_as_text(rollup.payment_state(table(spark, sf_dir, "invoice_headers"), AS_OF))


@query(
    "payment_totals",
    f"""WITH s AS ({_STATES})
        SELECT tenant_id, status AS payment_status, count(*) AS invoices,
               cast(sum(total_amount - paid_amount) as double) AS outstanding_amount,
               count(*) FILTER (WHERE {_TODAY} > due_date AND status <> 'paid') AS overdue_invoices,
               max(CASE WHEN {_TODAY} > due_date AND status <> 'paid' THEN {_TODAY} - due_date ELSE 0 END) AS max_days_overdue,
               count(*) FILTER (WHERE status = 'paid' AND total_amount <= paid_amount) AS fully_paid_invoices
        FROM s GROUP BY tenant_id, status""",
)
def payment_totals(spark, sf_dir):
    return dates_as_text(rollup.payment_totals(rollup.payment_state(table(spark, sf_dir, "invoice_headers"), AS_OF)))


@query(
    "retention_sweep",
    f"""SELECT tenant_id, count(*) AS invoices, cast(min(invoice_date + 2555) as string) AS oldest_retention,
               cast(sum(total_amount) as double) AS total_amount
        FROM {{invoice_headers}} WHERE NOT is_archived AND invoice_date + 2555 < DATE '2004-06-30' GROUP BY tenant_id""",
)
def retention_sweep(spark, sf_dir):
    from datetime import date

    return dates_as_text(rollup.retention_sweep(table(spark, sf_dir, "invoice_headers"), date(2004, 6, 30)))


@query(
    "reconcile_totals",
    """WITH e AS (SELECT *, subtotal_amount + tax_amount + shipping_amount - discount_amount AS expected FROM {invoice_headers}),
            w AS (SELECT *, total_amount = 0 OR abs(total_amount - expected) > 0.01 AS wrong,
                         tax_rate = 0 AND subtotal_amount > 0 AND tax_amount > 0 AS norate FROM e)
       SELECT invoice_key, tenant_id, cast(CASE WHEN wrong THEN expected ELSE total_amount END as double) AS total_amount,
              cast(total_amount as double) AS total_as_printed,
              CASE WHEN norate THEN cast(tax_amount as double) / cast(subtotal_amount as double) * 100 ELSE tax_rate END AS tax_rate,
              wrong AS calculated_total, norate AS calculated_tax_rate
       FROM w""",
)
def reconcile_totals(spark, sf_dir):
    return dates_as_text(rollup.reconcile_totals(table(spark, sf_dir, "invoice_headers")))


@query(
    "reconcile_summary",
    """SELECT tenant_id, count(*) AS invoices,
              count(*) FILTER (WHERE total_amount = 0 OR abs(total_amount - (subtotal_amount + tax_amount)) > 0.01) AS corrected
       FROM {invoice_headers} GROUP BY tenant_id""",
)
def reconcile_summary(spark, sf_dir):
    fixed = rollup.reconcile_totals(table(spark, sf_dir, "invoice_headers"))
    return fixed.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("invoices"), F.count_if("calculated_total").alias("corrected"))
