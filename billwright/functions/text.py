"""Text columns: cleaning, counts, dates read from text, word sets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from billwright.config import Semantics
from billwright.functions import patterns as p


#: Every character that counts as blank at the ends of a text.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.trim(c, F.lit(BLANKS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(c: Column) -> Column:
    """Null for an empty value: both mean "missing" in extracted data."""
    return F.when(F.length(c) > 0, c)


def clean_text(c: Column, semantics: Semantics) -> Column:
    # A lone space stays as it is, so only other blanks and runs are replaced.
    any_blank = r"[^\S\n]" if semantics.keep_newlines else p.BLANK
    other = r"[^\S\n ]" if semantics.keep_newlines else r"[\s\x1c-\x1f&&[^ ]]"
    blanks = rf"(?U){any_blank}{{2,}}|{other}"
    # a text of printable characters, lone spaces and line ends is told by one quick look
    unusual = r"[^\x20-\x7e\n]" if semantics.keep_newlines else r"[^\x20-\x7e]"
    to_replace = lambda s: F.contains(s, F.lit("  ")) | s.rlike(unusual)
    t = let(strip(F.coalesce(c, F.lit(""))), lambda s: F.when(to_replace(s), F.regexp_replace(s, blanks, " ")).otherwise(s))
    t = F.replace(t, F.lit("|"), F.lit("I"))
    if semantics.swap_first_zero:
        t = F.regexp_replace(t, r"(?s)\A([^0]*)0", "$1O")
    # no blanks are left but spaces and line ends
    dollar_gap = lambda s: F.contains(s, F.lit("$ ")) | F.contains(s, F.lit("$\n"))
    return let(t, lambda s: F.when(dollar_gap(s), F.regexp_replace(s, r"(?U)[$]\s+", r"\$")).otherwise(s))


def folded(c: Column) -> Column:
    """The text in lower case, with the four letters that a pattern without case reads as i, k and s."""
    plain = c
    for special, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        plain = F.replace(plain, F.lit(special), F.lit(letter))
    one_byte_each = F.octet_length(c) == F.length(c)
    return F.lower(F.when(one_byte_each, c).otherwise(plain))


def sanitize(c: Column, max_length: int | None = None) -> Column:
    t = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.substring(t, 1, max_length) if max_length else t


def text_counts(c: Column) -> dict[str, Column]:
    t = F.coalesce(c, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "character_count": F.length(t),
        "word_count": F.regexp_count(t, F.lit(r"(?U)[^\s\x1c-\x1f]+")),
        "line_count": F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit("\n")) + 1),
        "number_count": count(p.COUNT_NUMBERS),
        "email_count": count(p.COUNT_EMAILS),
        "phone_count": count(p.COUNT_PHONES),
        "date_count": count(p.COUNT_DATES),
        "currency_count": count(p.COUNT_CURRENCY),
    }


def word_set(c: Column) -> Column:
    """Distinct lower-case words, sorted."""
    words = F.split(F.lower(strip(c)), rf"(?U){p.BLANK}+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def if_named(small: Column | None, pattern: str, found: Column) -> Column:
    """``found``, looked for only in texts that hold the letters which ``pattern`` begins with; ``small`` is the folded text."""
    word = re.match(r"(?:\(\?\w+\))*([a-z ]*)(?![?*{])", pattern).group(1)
    return found if small is None or not word else F.when(F.contains(small, F.lit(word)), found)


def first_hit(text: Column, choices: list[tuple[str, float]], small: Column | None = None) -> Column:
    """First pattern that occurs, as struct(value, confidence); null when none does.

    The first group of each pattern holds a character at least, so one search
    tells. With ``small``, the folded text, texts without a pattern's word are
    not searched.
    """
    hit = lambda conf: lambda v: F.when(v != "", F.struct(v.alias("value"), F.lit(conf).alias("confidence")))
    return F.coalesce(*[if_named(small, pattern, let(F.regexp_extract(text, pattern, 1), hit(conf))) for pattern, conf in choices])


def parse_date(text: Column, iso_first: bool = False) -> Column:
    """The first reading of ``text`` that is a calendar day, by ordered patterns; a pattern is tried if those before it give none."""
    two = lambda x: F.lpad(x.try_cast("int").cast("string"), 2, "0")
    names = F.array(*[F.lit(m.lower()) for m in p.MONTHS])
    named = lambda x: F.array_position(names, F.lower(x)).cast("string")

    def calendar_day(year: Column, month: Column, day: Column) -> Column:
        full_year = lambda y: F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
        padded = F.lpad(let(year.try_cast("int"), full_year).cast("string"), 4, "0")
        # four, two and two digits: the cast reads them as a pattern would, without one
        return F.concat_ws("-", padded, F.coalesce(two(month), F.lit("?")), F.coalesce(two(day), F.lit("?"))).try_cast("date")

    def numbers(a: Column, b: Column, c: Column) -> Column:
        day_first = a.try_cast("int") > 12
        return calendar_day(c, F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b))

    readings = [
        (p.DATE_NUMBERS, numbers),
        (p.DATE_LONG_FIRST, numbers),
        (p.DATE_DAY_MONTH, lambda a, b, c: calendar_day(c, named(b), a)),
        (p.DATE_MONTH_DAY, lambda a, b, c: calendar_day(c, named(a), b)),
    ]
    if iso_first:
        readings.insert(0, (p.DATE_ISO, lambda a, b, c: calendar_day(a, b, c)))

    def reading(pattern: str, day: Callable[[Column, Column, Column], Column]) -> Column:
        parts = lambda m: F.split(F.regexp_replace(m, pattern, "$1\x1d$2\x1d$3"), "\x1d")
        of_match = lambda m: F.when(m != "", let(parts(m), lambda g: day(*[F.get(g, F.lit(n)) for n in range(3)])))
        return let(F.regexp_extract(text, pattern, 0), of_match)

    return F.when(text != "", F.coalesce(*[reading(pattern, day) for pattern, day in readings]))


def json_map(c: Column) -> Column:
    """JSON text as a map of strings; unreadable or empty text is an empty map."""
    parsed = F.from_json(c, "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))
