"""Amounts and payment state of invoices and lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from billwright.config import RETENTION_DAYS

MONEY = "decimal(15,2)"
#: Percentages in money math; what does not fit is null, and amounts from it can't be stored.
RATE = "decimal(20,12)"


def money(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast(MONEY)


def share(amount: Column, percent: Column) -> Column:
    """``percent`` of ``amount``, null if it is too large to be stored."""
    return stored(_exact_share(amount, percent))


def stored(amount: Column) -> Column:
    """An amount rounded once to what a table holds, null if it is too large."""
    return F.round(amount, 2).try_cast(MONEY)


def _exact_share(amount: Column, percent: Column) -> Column:
    return amount * percent.cast("string").try_cast(RATE) * F.lit("0.01").cast("decimal(3,2)")


def line_total(
    quantity: Column,
    price: Column,
    discount_rate: Column,
    tax_rate: Column,
    discount_amount: Column | None = None,
    tax_amount: Column | None = None,
) -> dict[str, Column]:
    """discount_amount, tax_amount and total of a line, discount before tax.

    Without a positive rate the stored amount holds. Amounts are exact until
    they are stored.
    """
    kept = lambda c: F.lit(0).cast(MONEY) if c is None else money(c)
    # narrow enough that products keep 13 places and more
    base = (quantity * price).try_cast("decimal(20,7)")
    discount = F.when(discount_rate > 0, _exact_share(base, discount_rate)).otherwise(kept(discount_amount))
    net = (base - discount).try_cast("decimal(27,13)")
    tax = F.when(tax_rate > 0, _exact_share(net, tax_rate)).otherwise(kept(tax_amount))
    return {"discount_amount": stored(discount), "tax_amount": stored(tax), "line_total": stored(net + tax)}


def outstanding(total: Column, paid: Column) -> Column:
    return (money(total) - money(paid)).cast(MONEY)


def is_overdue(due: Column, status: Column, as_of: date) -> Column:
    return F.coalesce(due.isNotNull() & (status != "paid") & (F.lit(as_of) > due), F.lit(False))


def days_overdue(due: Column, status: Column, as_of: date) -> Column:
    return F.when(is_overdue(due, status, as_of), F.datediff(F.lit(as_of), due)).otherwise(0)


def payment_status(total: Column, paid: Column, due: Column, old_status: Column, as_of: date) -> Column:
    late = is_overdue(due, old_status, as_of)
    return (
        F.when(money(total) <= 0, "paid")
        .when(money(paid) <= 0, F.when(late, "overdue").otherwise("unpaid"))
        .when(money(paid) >= money(total), "paid")
        .otherwise("partial")
    )


def retention_until(stored: Column, invoice_date: Column, as_of: date) -> Column:
    return F.coalesce(stored, F.date_add(F.coalesce(invoice_date, F.lit(as_of)), RETENTION_DAYS))
