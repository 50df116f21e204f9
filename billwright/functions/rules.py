"""Invoice rules as lists of findings over flat header columns.

Header columns: invoice_number, invoice_date, due_date, vendor_name,
vendor_email, vendor_phone, vendor_address_line1, vendor_city,
vendor_postal_code, customer_name, customer_email, currency, subtotal_amount,
tax_amount, discount_amount, shipping_amount, total_amount, tax_rate,
payment_terms, the section confidences, and of the lines: line_count,
line_sum, line_items_confidence.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from billwright.config import RuleSet
from billwright.functions import patterns as p
from billwright.functions.money import MONEY, RATE, money, stored

ERROR, WARNING, VIOLATION, ISSUE = "error", "warning", "violation", "issue"
SEVERITIES = (ERROR, WARNING, VIOLATION, ISSUE)
SECTION_CONFIDENCE = {
    "invoice_metadata": "metadata_confidence",
    "company_data": "company_confidence",
    "customer_data": "customer_confidence",
    "financial_data": "financial_confidence",
    "line_items": "line_items_confidence",
}


@dataclass(frozen=True)
class Finding:
    rule: str
    severity: str
    when: Column
    message: Column


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])


def _cents(c: Column) -> Column:
    return F.coalesce(F.round(c, 2).try_cast("decimal(20,2)").cast("string"), F.lit("too large"))


def _given(name: str) -> Column:
    return F.length(F.coalesce(F.col(name), F.lit(""))) > 0


def _too_far(a: Column, b: Column, rules: RuleSet) -> Column:
    return F.abs(a - b) > F.lit(rules.amount_tolerance).cast(MONEY)


def required_fields() -> list[Finding]:
    missing = {
        "invoice_metadata.invoice_number": ~_given("invoice_number"),
        "company_data.name": ~_given("vendor_name"),
        "financial_data.total_amount": money(F.col("total_amount")) == 0,
    }
    return [Finding("required_fields", ERROR, c, _say(f"Missing required field: {k}")) for k, c in missing.items()]


def confidence_thresholds(rules: RuleSet) -> list[Finding]:
    out = []
    for section, least in rules.min_confidence.items():
        conf = F.coalesce(F.col(SECTION_CONFIDENCE[section]), F.lit(0.0))
        text = _say(f"Low confidence in {section}: ", _cents(conf), f" < {least:.2f}")
        out.append(Finding("confidence_thresholds", WARNING, conf < least, text))
    return out


def metadata_rules(rules: RuleSet, as_of: date) -> list[Finding]:
    number, day, today = F.col("invoice_number"), F.col("invoice_date"), F.lit(as_of)
    ahead = F.datediff(day, today)
    given, limit = _given("invoice_number"), rules.future_invoice_date_days
    rule = "metadata_rules"
    return [
        Finding(rule, ISSUE, given & (F.length(number) < 3), _say("Invoice number appears too short")),
        Finding(rule, ISSUE, given & number.rlike(r"(?U)[^\w\-_]"), _say("Invoice number contains unusual characters")),
        Finding(rule, VIOLATION, ahead > limit, _say("Invoice date is ", ahead, f" days in the future (max: {limit})")),
        Finding(rule, WARNING, day < F.add_months(today, -24), _say("Invoice date is more than 2 years old")),
        Finding(rule, ERROR, F.col("due_date") < day, _say("Due date cannot be before invoice date")),
    ]


def company_rules() -> list[Finding]:
    name, email, phone = F.col("vendor_name"), F.col("vendor_email"), F.col("vendor_phone")
    parts = [_given(c) for c in ("vendor_address_line1", "vendor_city", "vendor_postal_code")]
    some, every = parts[0] | parts[1] | parts[2], parts[0] & parts[1] & parts[2]
    upper = (F.upper(name) == name) & (F.lower(name) != name)
    digits = F.length(F.regexp_replace(phone, r"(?U)\D", ""))
    rule = "company_rules"
    return [
        Finding(rule, ISSUE, _given("vendor_name") & (F.length(name) < 2), _say("Company name appears too short")),
        Finding(rule, WARNING, upper & (F.length(name) > 10), _say("Company name is all uppercase - possible OCR issue")),
        Finding(rule, ISSUE, _given("vendor_email") & ~email.rlike(p.SYNTAX_EMAIL), _say("Invalid email format: ", email)),
        Finding(rule, ISSUE, _given("vendor_phone") & ~digits.between(7, 15), _say("Phone number appears invalid: ", phone)),
        Finding(rule, ISSUE, some & ~every, _say("Company address is incomplete")),
    ]


def customer_rules() -> list[Finding]:
    name, email = F.col("customer_name"), F.col("customer_email")
    bad_mail = _given("customer_email") & ~email.rlike(p.SYNTAX_EMAIL)
    return [
        Finding("customer_rules", ISSUE, _given("customer_name") & (F.length(name) < 2), _say("Customer name appears too short")),
        Finding("customer_rules", ISSUE, bad_mail, _say("Invalid customer email format: ", email)),
    ]


def financial_rules(rules: RuleSet) -> list[Finding]:
    rule = "financial_rules"
    out = []
    for name in ("subtotal_amount", "tax_amount", "total_amount", "discount_amount", "shipping_amount"):
        out.append(Finding(rule, ERROR, F.col(name) < 0, _say(f"{name} cannot be negative: ", F.col(name))))
    total, rate = money(F.col("total_amount")), F.coalesce("tax_rate", F.lit(0.0))
    least, most = (F.lit(x).cast(MONEY) for x in (rules.min_total_amount, rules.max_total_amount))
    return [
        *out,
        Finding(rule, VIOLATION, total < least, _say("Total amount too small: $", total, " < $", least)),
        Finding(rule, VIOLATION, total > most, _say("Total amount too large: $", total, " > $", most)),
        Finding(rule, VIOLATION, rate > rules.max_tax_rate, _say("Tax rate too high: ", _cents(rate), f"% > {rules.max_tax_rate:.2f}%")),
        Finding(rule, ERROR, rate < 0, _say("Tax rate cannot be negative: ", _cents(rate), "%")),
    ]


def expected_total() -> Column:
    c = lambda k: money(F.col(f"{k}_amount"))
    return (c("subtotal") + c("tax") + c("shipping") - c("discount")).try_cast(MONEY)


def total_is_off(rules: RuleSet) -> Column:
    return _too_far(money(F.col("total_amount")), expected_total(), rules)


def financial_consistency(rules: RuleSet) -> list[Finding]:
    total, tax = money(F.col("total_amount")), money(F.col("tax_amount"))
    rate = F.col("tax_rate").cast("string").try_cast(RATE)
    due = F.col("subtotal_amount") * rate * F.lit("0.01").cast("decimal(3,2)")
    taxed = (F.col("tax_rate") > 0) & (F.col("subtotal_amount") > 0)
    rule = "financial_consistency"
    return [
        Finding(rule, ERROR, expected_total().isNull(), _say("Amounts are too large to be added up")),
        Finding(
            rule,
            ISSUE,
            total_is_off(rules),
            _say("Total amount calculation inconsistent: Expected $", expected_total(), ", Found $", total),
        ),
        Finding(
            rule,
            ISSUE,
            taxed & _too_far(tax, due, rules),
            _say("Tax calculation inconsistent: Expected $", _cents(due), ", Found $", tax),
        ),
    ]


def currency_rule(rules: RuleSet) -> list[Finding]:
    odd = _given("currency") & ~F.col("currency").isin(*rules.currencies)
    return [Finding("financial_rules", WARNING, odd, _say("Unusual currency detected: ", F.col("currency")))]


def line_sum_rules(rules: RuleSet) -> list[Finding]:
    n, subtotal = F.col("line_count"), F.col("subtotal_amount")
    lines = money(F.col("line_sum"))
    return [
        Finding("line_item_rules", ERROR, (n > 0) & F.col("line_sum").isNull(), _say("Line items total is too large to be stored")),
        Finding(
            "line_item_rules", VIOLATION, n > rules.max_line_items, _say("Too many line items: ", n, f" > {rules.max_line_items}")
        ),
        Finding(
            "line_item_rules",
            ISSUE,
            (n > 0) & (subtotal > 0) & _too_far(lines, subtotal, rules),
            _say("Line items total ($", lines, ") doesn't match invoice subtotal ($", subtotal, ")"),
        ),
    ]


def terms_rule(rules: RuleSet) -> list[Finding]:
    days = F.regexp_extract("payment_terms", r"(\d+)", 1).try_cast("decimal(38,0)")
    return [
        Finding("business_rules", WARNING, days > rules.max_terms_days, _say("Unusual payment terms: ", F.col("payment_terms")))
    ]


def header_rules(rules: RuleSet, as_of: date) -> list[Finding]:
    """Every rule of a header, in the order findings are listed."""
    return [
        *required_fields(),
        *confidence_thresholds(rules),
        *metadata_rules(rules, as_of),
        *company_rules(),
        *customer_rules(),
        *financial_rules(rules),
        *financial_consistency(rules),
        *currency_rule(rules),
        *line_sum_rules(rules),
        *terms_rule(rules),
    ]


def line_rules(rules: RuleSet, line: Column | None = None) -> list[Finding]:
    """Rules of one line; ``line`` is a struct, or None for columns of a line table."""
    c = (lambda k: line[k]) if line is not None else F.col
    number, qty, price, total = c("line_number"), c("quantity"), c("unit_price"), c("total_price")
    qty0 = F.coalesce(qty, F.lit(0))
    due = qty * price
    off = (qty > 0) & (price > 0) & _too_far(total, due, rules)
    start = ("Line ", number, ": ")
    rule = "line_item_rules"
    return [
        Finding(rule, ISSUE, F.length(F.coalesce(c("description"), F.lit(""))) == 0, _say(*start, "Missing description")),
        Finding(rule, ERROR, qty0 <= 0, _say(*start, "Invalid quantity: ", qty0)),
        Finding(rule, ERROR, price < 0, _say(*start, "Negative unit price: $", _cents(price))),
        Finding(rule, ERROR, total < 0, _say(*start, "Negative total price: $", total)),
        Finding(rule, ERROR, due.isNotNull() & stored(due).isNull(), _say(*start, "Amount is too large to be stored")),
        Finding(
            rule,
            ISSUE,
            off,
            _say(*start, "Price calculation inconsistent: Expected $", _cents(due), ", Found $", total),
        ),
    ]


def count(findings: list[Finding], severity: str) -> Column:
    """How many findings of one severity a row has."""
    total = F.lit(0)
    for f in findings:
        if f.severity == severity:
            total = total + F.coalesce(f.when, F.lit(False)).cast("int")
    return total


def listed(findings: list[Finding]) -> Column:
    """The findings of a row as ARRAY<STRUCT<rule, severity, message>>."""
    entries = [
        F.when(f.when, F.struct(F.lit(f.rule).alias("rule"), F.lit(f.severity).alias("severity"), f.message.alias("message")))
        for f in findings
    ]
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def score(errors: Column, violations: Column, issues: Column, warnings: Column) -> Column:
    s = F.lit(1.0) - errors * F.lit(0.2) - violations * F.lit(0.15) - issues * F.lit(0.1) - warnings * F.lit(0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
