"""Behaviour switches and rule limits, passed to jobs as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Semantics:
    """Which known surprises of the original behaviour a job keeps.

    ``REFERENCE`` keeps all of them; ``CORRECTED`` is what the jobs use.
    """

    name: str
    keep_newlines: bool  # cleaning keeps line ends, so line based fields see lines
    swap_first_zero: bool  # the first 0 of a text is read as the letter O
    iso_dates_first: bool  # 2024-01-15 is read as a year-first date
    whole_word_total: bool  # "total" does not match inside "Subtotal"
    long_amounts: bool  # amounts without thousands separators keep all digits
    line_item_confidence: bool  # the line section has a confidence of its own


REFERENCE = Semantics("reference", False, True, False, False, False, False)
CORRECTED = Semantics("corrected", True, False, True, True, True, True)


@dataclass(frozen=True)
class RuleSet:
    """Limits of the invoice rules (fixed values of the published rules)."""

    min_confidence: dict = field(
        default_factory=lambda: {
            "invoice_metadata": 0.6,
            "company_data": 0.5,
            "customer_data": 0.4,
            "financial_data": 0.7,
            "line_items": 0.5,
        }
    )
    max_total_amount: str = "1000000.00"
    min_total_amount: str = "0.01"
    max_line_items: int = 100
    max_tax_rate: float = 50.0
    future_invoice_date_days: int = 30
    amount_tolerance: str = "0.02"
    currencies: tuple = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "INR")
    max_terms_days: int = 365


OCR_CONFIDENCE_THRESHOLD = 0.7
MAX_FILE_BYTES = 10 * 1024 * 1024
FILE_EXTENSIONS = ("pdf", "jpg", "jpeg", "png")
RETENTION_DAYS = 2555
MAX_PAGE_SIZE = 100
LOCK_AFTER_FAILURES = 5
LOCK_SECONDS = 3600

#: "today" for every registered query, so results do not move with the clock.
AS_OF = date(2001, 12, 31)
