"""Failed checks counted over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.functions import checks


def failures(table: DataFrame, name: str, check: Column) -> DataFrame:
    """table_name, tenant_id (when the table has one), field, message, rows."""
    tenant = F.col("tenant_id") if "tenant_id" in table.columns else F.lit("")
    rows = table.select(F.lit(name).alias("table_name"), tenant.alias("tenant_id"), F.inline(check))
    return rows.groupBy("table_name", "tenant_id", "field", "message").agg(F.count(F.lit(1)).alias("rows"))


def check_tables(companies: DataFrame, customers: DataFrame, headers: DataFrame, lines: DataFrame) -> DataFrame:
    parts = [
        failures(companies, "companies", checks.check_company()),
        failures(customers, "customers", checks.check_customer()),
        failures(headers, "invoice_headers", checks.check_invoice()),
        failures(lines, "line_items", checks.check_line_item()),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def bad_codes(customers: DataFrame) -> DataFrame:
    """id, field and value of the postal codes and tenant names that are given and not well formed."""
    given = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    postal, tenant = F.col("billing_postal_code"), F.col("tenant_id")
    found = F.array(
        F.when(given(postal) & ~checks.postal_code_ok(postal), F.struct(F.lit("billing_postal_code").alias("field"), postal.alias("value"))),
        F.when(~F.coalesce(checks.tenant_id_ok(tenant), F.lit(False)), F.struct(F.lit("tenant_id").alias("field"), tenant.alias("value"))),
    )
    return customers.select("id", F.inline(F.filter(found, lambda f: f.isNotNull())))
