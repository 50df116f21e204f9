"""The word lists and patterns that decide extraction results.

Written for Java's regex engine. ``(?idU)`` reads letters without case, ends
lines at newline only and takes blanks, digits and word characters as Unicode.
Where a scan could start a hopeless attempt at every character, a lookbehind
lets it start only at the head of a run, which finds the same first match. What
a place must hold itself is looked at before what stands behind it.
"""

I = "(?idU)"  # noqa: E741
BLANK = r"[\s\x1c-\x1f]"

INVOICE_NUMBER = [
    (I + r"invoice\s*+#?\s*+:?\s*+([A-Z0-9\-]+)", 0.9),
    (I + r"inv\s*+#?\s*+:?\s*+([A-Z0-9\-]+)", 0.7),
    (I + r"bill\s*+#?\s*+:?\s*+([A-Z0-9\-]+)", 0.7),
    (I + r"receipt\s*+#?\s*+:?\s*+([A-Z0-9\-]+)", 0.7),
    (I + r"#\s*+([A-Z0-9\-]{3,})", 0.7),
]
PO_NUMBER = [
    (I + r"p\.?o\.?\s*+#?\s*+:?\s*+([A-Z0-9\-]+)", 0.7),
    (I + r"purchase\s+order\s*+#?\s*+:?\s*+([A-Z0-9\-]+)", 0.8),
    (I + r"order\s*+#?\s*+:?\s*+([A-Z0-9\-]+)", 0.7),
]
TAX_ID = [
    (I + r"tax\s*+id\s*+:?\s*+([A-Z0-9\-]+)", 0.8),
    (I + r"ein\s*+:?\s*+(\d{2}-\d{7})", 0.8),
    (I + r"ssn\s*+:?\s*+(\d{3}-\d{2}-\d{4})", 0.8),
    (I + r"vat\s*+:?\s*+([A-Z0-9\-]+)", 0.8),
]

INVOICE_DATE_WORDS = ["invoice date", "date", "dated", "bill date"]
DUE_DATE_WORDS = ["due date", "due", "payment due", "payable by"]
AFTER_WORD = I + r"{word}\s*+:?\s*(.{{0,50}})"
DATE_FALLBACK_CHARS = 200

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MONTH = f"({'|'.join(MONTHS)})"
DATE_NUMBERS = I + r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"
DATE_LONG_FIRST = I + r"(\d{2,4})[/-](\d{1,2})[/-](\d{1,2})"
DATE_DAY_MONTH = I + r"(\d{1,2})\s+" + _MONTH + r"\s+(\d{2,4})"
DATE_MONTH_DAY = I + _MONTH + r"\s+(\d{1,2}),?\s+(\d{2,4})"
DATE_ISO = I + r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"

EMAIL = r"(?U)\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_AREA = r"(?U)\+?1?[-.\s]?\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})"
PHONE_COUNTRY = r"(?U)\+?(\d{1,3})[-.\s]?(\d{3,4})[-.\s]?(\d{3,4})[-.\s]?(\d{3,4})"
PHONE_PLAIN = r"(?U)(\d{3})[-.\s]?(\d{3})[-.\s]?(\d{4})"
# The same two without their optional heads: they occur in exactly the same texts.
PHONE_AREA_CORE = r"(?U)\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PHONE_COUNTRY_CORE = r"(?U)\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
# Every number with a country holds ten digits, at most one sign between two of them and three behind each sign.
PHONE_COUNTRY_DIGITS = r"(?U)(?=\d)(?<!\d)(?:\d(?:[-.\s](?=\d{3}))?+){9}\d"
WEBSITE = (
    r"(?U)(?:https?://(?:www\.)?|(?<![a-zA-Z0-9-])(?:www\.)?)"
    r"(?:[a-zA-Z0-9-]++\.)+[a-zA-Z]{2,}(?:/[^\s]*)?"
)
# Every website holds this.
WEBSITE_END = r"\.[a-zA-Z]{2}"

NAME_HEADINGS = ["invoice", "bill", "receipt"]
NAME_NOT_STREET = I + r"(?=\d)(?<!\d)\d+\s+[A-Za-z\s]+(?:St|Street|Ave|Avenue)"
STREET = (
    I + r"((?=\d)(?<!\d)\d+\s+[A-Za-z\s]+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Pl|Place)\.?)"
)
CITY_STATE_ZIP = I + r"((?<![A-Za-z\s])[A-Za-z\s]+),\s*+([A-Z]{2})\s+(\d{5}(?:-\d{4})?)"
ZIP = I + r"(\d{5}(?:-\d{4})?)"

_TO_BLOCK_END = r"\s*+:?\s*(.*?)(?=\n\n|\n[A-Z]|\z)"
CUSTOMER_BLOCKS = [
    "(?s)" + I + r"bill\s+to" + _TO_BLOCK_END,
    "(?s)" + I + r"customer" + _TO_BLOCK_END,
    "(?s)" + I + r"sold\s+to" + _TO_BLOCK_END,
]

CURRENCY_SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR")]
CURRENCY_CODE = I + r"\b(USD|EUR|GBP|JPY|INR|CAD|AUD)\b"

GROUPED_AMOUNT = r"\s*+:?\s*+\$?(\d{1,3}(?:,\d{3})*\.?\d{0,2})"
LONG_AMOUNT = r"\s*+:?\s*+\$?(\d+(?:,\d{3})*(?:\.\d{1,2})?)"
AMOUNT_WORDS = {
    "subtotal": [r"subtotal", r"sub\s*+total"],
    "tax": [r"tax", r"vat"],
    "total": [r"total", r"amount\s*+due"],
    "discount": [r"discount"],
    "shipping": [r"shipping", r"freight"],
}
WHOLE_WORD_TOTAL = r"total(?<=\btotal)"
TAX_RATE = [
    I + r"tax\s*+(?:rate)?\s*+:?\s*+(\d{1,2}(?:\.\d{1,2})?)%",
    I + r"(\d{1,2}(?:\.\d{1,2})?)%\s*+tax",
    I + r"vat\s*+:?\s*+(\d{1,2}(?:\.\d{1,2})?)%",
]
TERMS_NET = I + r"net\s+(\d+)"
TERMS_RECEIPT = I + r"due\s+on\s+receipt"
TERMS_DAYS = I + r"(?=\d)(?<!\d)(\d+)\s+days?"
TERMS_CASH = I + r"cash\s+on\s+delivery"
TERMS_COD = I + r"cod"

_ITEMS_END = r".*?)(?=\n\s*(?:subtotal|tax|total)|\z)"
ITEM_HEADERS = [
    r"description\s*quantity\s*price\s*amount",
    r"item\s*qty\s*price\s*total",
    r"qty\s*description\s*unit\s*price\s*total",
]
ITEM_SECTIONS = ["(?s)" + I + "(" + h + _ITEMS_END for h in ITEM_HEADERS]
ITEM_ROW = I + r"^.+\s+\d+(?:\.\d{1,3})?\s+\$?\d+(?:\.\d{2})?\s+\$?\d+(?:\.\d{2})?\n?\z"
ITEM_SECTION_STOP = I + r"subtotal|tax|total"
ITEM_QUANTITY_FIRST = (
    I + r"((?=\d)(?<!\d)\d+(?:\.\d{1,3})?)\s+([^\d$€£¥₹]+?)\s+\$?(\d+(?:\.\d{2})?)\s+\$?(\d+(?:\.\d{2})?)"
)
ITEM_TEXT_FIRST = (
    I + r"((?<![^\d$€£¥₹])[^\d$€£¥₹]+?)\s+(\d+(?:\.\d{1,3})?)\s+\$?(\d+(?:\.\d{2})?)\s+\$?(\d+(?:\.\d{2})?)"
)
# Every quantity that comes first is followed by this.
ITEM_TEXT_AFTER_DIGIT = r"(?U)\d\s[^\d$€£¥₹]"
ITEM_NOT_A_ROW = I + r"subtotal|tax|total|shipping|discount"

# Text statistics.
COUNT_NUMBERS = r"(?U)\b\d+\.?\d*\b"
COUNT_EMAILS = EMAIL
COUNT_PHONES = r"[\+]?[1-9]?[0-9]{7,15}"
COUNT_DATES = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{2,4}[/-]\d{1,2}[/-]\d{1,2}\b"
COUNT_CURRENCY = r"(?iU)[$€£¥₹]\s*\d+\.?\d*|\b\d+\.?\d*\s*(?:USD|EUR|GBP|JPY|INR)\b"

# Checks and rules.
SYNTAX_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
