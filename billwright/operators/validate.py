"""Verdicts and findings for invoices.

Verdicts need counts only, so lines are summed per invoice with a plain
aggregate; the messages of lines are rows of the findings table and are never
gathered into one value.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.config import CORRECTED, RuleSet, Semantics
from billwright.functions import rules as r
from billwright.functions.money import MONEY
from billwright.functions.text import strip
from billwright.operators.duplicates import repeated_lines
from billwright.operators.skew import attach
from billwright.session import staged

REVIEW_ERRORS = "Manual review required due to validation errors"
REVIEW_SCORE = "Manual review recommended due to low confidence score"
REVIEW_QUALITY = "Manual review recommended due to data quality concerns"
CHECK_SUMS = "Review financial calculations for accuracy"
READY = "Invoice data appears valid and ready for processing"
SYSTEM_ERROR = "Validation system error: 'list' object has no attribute 'get'"


def summarize_lines(lines: DataFrame, rules: RuleSet) -> DataFrame:
    """Per invoice: line_count, line_sum, line_items_confidence and counts of line findings."""
    checks = r.line_rules(rules)
    named = F.lower(strip(F.coalesce("description", F.lit(""))))
    per_text = lines.select(
        "invoice_key",
        named.alias("named"),
        "total_price",
        F.col("confidence").cast("decimal(9,4)").alias("confidence"),
        r.count(checks, r.ERROR).alias("errors"),
        r.count(checks, r.ISSUE).alias("issues"),
    ).groupBy("invoice_key", "named").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_price").alias("total"),
        F.sum("confidence").alias("confidence"),
        F.sum("errors").alias("errors"),
        F.sum("issues").alias("issues"),
    )
    repeats = F.when(F.col("named") != "", F.col("n") - 1).otherwise(0)
    return per_text.groupBy("invoice_key").agg(
        F.sum("n").alias("line_count"),
        F.sum("total").try_cast(MONEY).alias("line_sum"),
        (F.sum("confidence").cast("double") / F.sum("n")).alias("line_items_confidence"),
        F.sum("errors").alias("line_errors"),
        F.sum("issues").alias("line_issues"),
        F.sum(repeats).alias("line_repeats"),
    )


def summarize_nested_lines(items: Column, rules: RuleSet) -> dict[str, Column]:
    """The same summary for lines held in the invoice row itself."""
    def total(severity: str) -> Column:
        return F.aggregate(items, F.lit(0), lambda acc, x: acc + r.count(r.line_rules(rules, x), severity))

    names = F.filter(F.transform(items, lambda x: F.lower(strip(x["description"]))), lambda d: d != "")
    zero = F.lit(0).cast("decimal(25,2)")
    return {
        "line_count": F.size(items),
        "line_sum": F.aggregate(items, zero, lambda acc, x: (acc + x["total_price"]).cast("decimal(25,2)")).try_cast(MONEY),
        "line_errors": total(r.ERROR),
        "line_issues": total(r.ISSUE),
        "line_repeats": F.size(names) - F.size(F.array_distinct(names)),
    }


def with_line_summary(headers: DataFrame, lines: DataFrame, rules: RuleSet) -> DataFrame:
    zero = ("line_count", "line_errors", "line_issues", "line_repeats")
    joined = headers.join(summarize_lines(lines, rules), "invoice_key", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def verdicts(summarized: DataFrame, as_of: date, rules: RuleSet = RuleSet(), semantics: Semantics = CORRECTED) -> DataFrame:
    """One verdict per invoice row that carries its line summary; its columns pass through."""
    checks = r.header_rules(rules, as_of)
    counts = summarized.select(
        "*",
        (r.count(checks, r.ERROR) + F.col("line_errors")).alias("errors"),
        (r.count(checks, r.WARNING) + F.col("line_repeats")).alias("warnings"),
        r.count(checks, r.VIOLATION).alias("violations"),
        (r.count(checks, r.ISSUE) + F.col("line_issues")).alias("issues"),
        (r.count(r.required_fields(), r.ERROR) == 0).alias("is_valid"),
        (r.count(r.confidence_thresholds(rules), r.WARNING) > 0).alias("low_confidence"),
        r.total_is_off(rules).alias("total_off"),
    )
    if not semantics.line_item_confidence:
        return _system_error(counts, rules)
    scored = counts.withColumn("confidence_score", r.score(*[F.col(c) for c in ("errors", "violations", "issues", "warnings")]))
    bad, low, poor = (
        (F.col("errors") > 0) | (F.col("violations") > 0),
        F.col("confidence_score") < 0.7,
        F.col("issues") >= 3,
    )
    review = F.col("low_confidence") | bad | low | poor
    advice = [(F.col("total_off"), CHECK_SUMS), (bad, REVIEW_ERRORS), (low, REVIEW_SCORE), (poor, REVIEW_QUALITY), (~review, READY)]
    return scored.select(
        *summarized.columns,
        "is_valid",
        review.alias("requires_review"),
        "confidence_score",
        "errors",
        "warnings",
        "violations",
        "issues",
        F.filter(F.array(*[F.when(c, F.lit(text)) for c, text in advice]), lambda x: x.isNotNull()).alias("recommendations"),
    )


def _system_error(counts: DataFrame, rules: RuleSet) -> DataFrame:
    """The original check stops at the line section, which fails every invoice with one error."""
    before = [f for f in r.confidence_thresholds(rules)][:4]
    carried = [c for c in counts.columns if c not in ("errors", "warnings", "violations", "issues", "is_valid", "low_confidence", "total_off")]
    return counts.select(
        *carried,
        F.lit(False).alias("is_valid"),
        F.lit(True).alias("requires_review"),
        F.lit(0.0).alias("confidence_score"),
        F.lit(1).alias("errors"),
        r.count(before, r.WARNING).alias("warnings"),
        F.lit(0).alias("violations"),
        F.lit(0).alias("issues"),
        F.array().cast("array<string>").alias("recommendations"),
    )


def processing_outcome() -> dict[str, Column]:
    """Status and review flag of a processed invoice."""
    return {
        "processing_status": F.when(F.col("is_valid"), "completed").otherwise("failed"),
        "requires_review": F.col("requires_review") | ~F.col("is_valid"),
    }


def findings(headers: DataFrame, lines: DataFrame, as_of: date, rules: RuleSet = RuleSet()) -> DataFrame:
    """invoice_key, tenant_id, rule, severity, message: one row per finding."""
    with_lines = staged(with_line_summary(headers, lines, rules), "summarized")
    of_headers = with_lines.select(
        "invoice_key", "tenant_id", F.inline(r.listed(r.header_rules(rules, as_of)))
    )
    tenants = with_lines.where(F.col("line_count") > 0).select("invoice_key", "tenant_id", F.col("line_count").alias("n"))
    of_lines = lines.select("invoice_key", F.inline(r.listed(r.line_rules(rules))))
    repeats = repeated_lines(lines).select(
        "invoice_key",
        F.lit("business_rules").alias("rule"),
        F.lit(r.WARNING).alias("severity"),
        F.concat(F.lit("Possible duplicate line item: "), "description").alias("message"),
    )
    below = attach(of_lines.unionByName(repeats), tenants, ["invoice_key"], F.col("message")).drop("n")
    return of_headers.unionByName(below.where(F.col("tenant_id").isNotNull()))
