"""Checks of stored records; each gives ARRAY<STRUCT<field, message>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billwright.functions.text import sanitize

# The syntax of an address and the names no mail goes to.
_LOCAL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\x{80}-\x{10FFFF}-]+"
_LABEL = r"[A-Za-z0-9\x{80}-\x{10FFFF}](?:[A-Za-z0-9\x{80}-\x{10FFFF}-]{0,61}[A-Za-z0-9\x{80}-\x{10FFFF}])?"
EMAIL = rf"\A(?=[^@]{{1,64}}@.{{1,253}}\z){_LOCAL}(?:\.{_LOCAL})*@(?:{_LABEL}\.)+(?=[^.]*[^0-9.]){_LABEL}\z"
RESERVED_DOMAIN = r"(?i)[@.](?:arpa|invalid|local|localhost|onion|test)\z"


def email_ok(c: Column) -> Column:
    return c.rlike(EMAIL) & ~c.rlike(RESERVED_DOMAIN)


def phone_ok(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\D", "")).between(7, 15)


def amount_ok(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("decimal(38,6)") >= 0, F.lit(False))


def date_ok(c: Column) -> Column:
    return c.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z") & F.try_to_date(c, "yyyy-M-d").isNotNull()


def invoice_number_ok(c: Column) -> Column:
    return (F.length(c) >= 3) & c.rlike(r"\A[A-Za-z0-9\-_]+\n?\z")


def _code_ok(c: Column, most: int) -> Column:
    bare = F.regexp_replace(c, r"(?U)[\s\-]", "")
    return bare.rlike(r"\A[A-Za-z0-9]+\z") & F.length(bare).between(3, most)


def tax_id_ok(c: Column) -> Column:
    return _code_ok(c, 20)


def postal_code_ok(c: Column) -> Column:
    return _code_ok(c, 10)


def tenant_id_ok(c: Column) -> Column:
    return c.rlike(r"\A[a-zA-Z0-9_]+\n?\z") & F.length(c).between(3, 50)


def _given(name: str) -> Column:
    return F.length(F.coalesce(F.col(name).cast("string"), F.lit(""))) > 0


def _failures(*checks: tuple[str, Column, str]) -> Column:
    entries = [F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(text).alias("message"))) for field, bad, text in checks]
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def _name(what: str) -> list[tuple[str, Column, str]]:
    short = _given("name") & (F.length(sanitize(F.col("name"))) < 2)
    return [
        ("name", ~_given("name"), f"{what} name is required"),
        ("name", short, f"{what} name must be at least 2 characters"),
    ]


def _contacts() -> list[tuple[str, Column, str]]:
    return [
        ("email", _given("email") & ~email_ok(F.col("email")), "Invalid email format"),
        ("phone", _given("phone") & ~phone_ok(F.col("phone")), "Invalid phone number format"),
    ]


def check_company() -> Column:
    bad_tax_id = _given("tax_id") & ~tax_id_ok(F.col("tax_id"))
    return _failures(*_name("Company"), *_contacts(), ("tax_id", bad_tax_id, "Invalid tax ID format"))


def check_customer() -> Column:
    return _failures(*_name("Customer"), *_contacts())


def check_invoice() -> Column:
    """Of a header as it came in, with dates and total as text."""
    number = F.col("invoice_number")
    bad_date = lambda name: _given(name) & ~date_ok(F.col(name))
    total = F.col("total_amount")
    return _failures(
        ("invoice_number", ~_given("invoice_number"), "Invoice number is required"),
        ("invoice_number", _given("invoice_number") & ~invoice_number_ok(number), "Invalid invoice number format"),
        ("invoice_date", bad_date("invoice_date"), "Invalid invoice date format"),
        ("due_date", bad_date("due_date"), "Invalid due date format"),
        ("total_amount", total.isNotNull() & ~amount_ok(total), "Invalid total amount"),
    )


def check_line_item() -> Column:
    desc, qty = F.col("description"), F.col("quantity")
    bad = lambda name: F.col(name).isNotNull() & ~amount_ok(F.col(name))
    return _failures(
        ("description", ~_given("description"), "Line item description is required"),
        ("description", _given("description") & (F.length(sanitize(desc)) < 1), "Line item description cannot be empty"),
        ("quantity", qty.isNotNull() & (qty <= 0), "Quantity must be greater than zero"),
        ("unit_price", bad("unit_price"), "Invalid unit price format"),
        ("total_price", bad("total_price"), "Invalid total price format"),
    )
