"""Totals per invoice, per vendor and per customer."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.functions import money as m


#: Sums of money over many invoices.
SUM = "decimal(25,2)"


def invoice_totals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Amounts worked out again from the lines; an invoice without lines keeps its own."""
    sums = lines.groupBy("invoice_key").agg(
        F.sum("total_price").try_cast(m.MONEY).alias("line_sum"), F.count(F.lit(1)).alias("line_items_count")
    )
    has_lines = F.col("line_sum").isNotNull()
    tax = F.when(F.col("tax_rate") > 0, m.share(F.col("line_sum"), F.col("tax_rate"))).otherwise(m.money(F.col("tax_amount")))
    joined = headers.join(sums, "invoice_key", "left")
    priced = joined.withColumns(
        {
            "new_subtotal": F.when(has_lines, F.col("line_sum")).otherwise(F.col("subtotal_amount")),
            "new_tax": F.when(has_lines, tax).otherwise(F.col("tax_amount")),
        }
    )
    total = F.col("new_subtotal") + m.money(F.col("new_tax")) + m.money(F.col("shipping_amount")) - m.money(F.col("discount_amount"))
    return priced.select(
        "invoice_key",
        "tenant_id",
        F.col("new_subtotal").alias("subtotal_amount"),
        F.col("new_tax").alias("tax_amount"),
        F.when(has_lines, total.try_cast(m.MONEY)).otherwise(F.col("total_amount")).alias("total_amount"),
        F.coalesce("line_items_count", F.lit(0)).alias("line_items_count"),
    )


def line_totals(lines: DataFrame) -> DataFrame:
    amount = lambda k: F.col(k) if k in lines.columns else None
    rates = (F.col("quantity"), F.col("unit_price"), F.col("discount_rate"), F.col("tax_rate"))
    parts = m.line_total(*rates, amount("discount_amount"), amount("tax_amount"))
    return lines.select("invoice_key", "line_id", *[c.alias(k) for k, c in parts.items()])


def vendor_statistics(headers: DataFrame, companies: DataFrame) -> DataFrame:
    """Count, sum and last date per vendor; every vendor appears."""
    stats = headers.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.sum("total_amount").alias("total_amount"),
        F.max("invoice_date").alias("last_invoice_date"),
    )
    return companies.join(stats, companies.id == stats.company_id, "left").select(
        companies.id.alias("company_id"),
        "tenant_id",
        "name",
        F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"),
        F.coalesce(F.col("total_amount"), F.lit(0)).cast(SUM).alias("total_amount"),
        "last_invoice_date",
    )


def customer_statistics(headers: DataFrame, customers: DataFrame) -> DataFrame:
    """Billed, paid and outstanding per customer; every customer appears."""
    stats = headers.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.sum("total_amount").alias("billed"),
        F.sum("paid_amount").alias("paid"),
        F.max("invoice_date").alias("last_invoice_date"),
        F.max("payment_date").alias("last_payment_date"),
    )
    billed, paid = F.coalesce("billed", F.lit(0)), F.coalesce("paid", F.lit(0))
    return customers.join(stats, customers.id == stats.customer_id, "left").select(
        customers.id.alias("customer_id"),
        "tenant_id",
        F.coalesce("invoice_count", F.lit(0)).alias("invoice_count"),
        billed.cast(SUM).alias("total_billed"),
        paid.cast(SUM).alias("total_paid"),
        (billed - paid).cast(SUM).alias("outstanding_balance"),
        "last_invoice_date",
        "last_payment_date",
    )


def payment_state(headers: DataFrame, as_of: date) -> DataFrame:
    """Outstanding amount, lateness and status of each invoice on a day."""
    c = F.col
    status = m.payment_status(c("total_amount"), c("paid_amount"), c("due_date"), c("payment_status"), as_of)
    return headers.select("*", status.alias("new_status")).select(
        "invoice_key",
        "tenant_id",
        "company_id",
        m.outstanding(c("total_amount"), c("paid_amount")).alias("outstanding_amount"),
        m.is_overdue(c("due_date"), c("new_status"), as_of).alias("is_overdue"),
        m.days_overdue(c("due_date"), c("new_status"), as_of).alias("days_overdue"),
        ((c("new_status") == "paid") & (m.outstanding(c("total_amount"), c("paid_amount")) <= 0)).alias("is_fully_paid"),
        c("new_status").alias("payment_status"),
    )


def payment_totals(states: DataFrame) -> DataFrame:
    """Payment state summed per tenant and status."""
    return states.groupBy("tenant_id", "payment_status").agg(
        F.count(F.lit(1)).alias("invoices"),
        F.sum("outstanding_amount").cast("decimal(25,2)").alias("outstanding_amount"),
        F.count_if("is_overdue").alias("overdue_invoices"),
        F.max("days_overdue").alias("max_days_overdue"),
        F.count_if("is_fully_paid").alias("fully_paid_invoices"),
    )


def retention_sweep(headers: DataFrame, as_of: date) -> DataFrame:
    """Invoices past their retention day and not archived, per tenant."""
    until = m.retention_until(F.lit(None).cast("date"), F.col("invoice_date"), as_of)
    due = headers.where(~F.col("is_archived")).withColumn("retention_until", until).where(F.col("retention_until") < F.lit(as_of))
    return due.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("invoices"),
        F.min("retention_until").alias("oldest_retention"),
        F.sum("total_amount").cast("decimal(25,2)").alias("total_amount"),
    )


def reconcile_totals(headers: DataFrame) -> DataFrame:
    """The printed total is replaced when it is missing or off by more than a cent."""
    c = F.col
    expected = (
        m.money(c("subtotal_amount")) + m.money(c("tax_amount")) + m.money(c("shipping_amount")) - m.money(c("discount_amount"))
    ).try_cast(m.MONEY)
    wrong = (m.money(c("total_amount")) == 0) | (F.abs(m.money(c("total_amount")) - expected) > F.lit("0.01").cast(m.MONEY))
    missing_rate = (F.coalesce("tax_rate", F.lit(0.0)) == 0) & (c("subtotal_amount") > 0) & (c("tax_amount") > 0)
    rate = c("tax_amount").cast("double") / c("subtotal_amount").cast("double") * 100
    return headers.select(
        "invoice_key",
        "tenant_id",
        F.when(wrong, expected).otherwise(c("total_amount")).alias("total_amount"),
        c("total_amount").alias("total_as_printed"),
        F.when(missing_rate, rate).otherwise(c("tax_rate")).alias("tax_rate"),
        wrong.alias("calculated_total"),
        missing_rate.alias("calculated_tax_rate"),
    )
