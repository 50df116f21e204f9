"""Invoice fields as columns over a cleaned text or its lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from billwright.config import Semantics
from billwright.functions import patterns as p
from billwright.functions.text import first_hit, if_named, let, strip

MONEY = "decimal(15,2)"


def stripped_lines(c: Column) -> Column:
    return F.transform(F.split(c, "\n"), strip)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match of a pattern that matches no empty text; the text is searched once."""
    return let(F.regexp_extract(c, pattern, 0), lambda found: F.when(found != "", F.regexp_extract(found, pattern, group)))


def match_text(c: Column, pattern: str) -> Column:
    """The first match of a pattern that matches no empty text, by one search; null without one."""
    return let(F.regexp_extract(c, pattern, 0), lambda found: F.when(found != "", found))


def has_email(c: Column) -> Column:
    return F.contains(c, F.lit("@")) & c.rlike(p.EMAIL)


def email(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), match_text(c, p.EMAIL))


def website(c: Column) -> Column:
    return F.when(c.rlike(p.WEBSITE_END), match_text(c, p.WEBSITE))


def tax_id(c: Column, small: Column | None = None) -> Column:
    return first_hit(c, p.TAX_ID, small)["value"]


def has_phone(c: Column) -> Column:
    return c.rlike(p.PHONE_AREA_CORE) | (c.rlike(p.PHONE_COUNTRY_DIGITS) & c.rlike(p.PHONE_COUNTRY_CORE))


def phone(c: Column, as_printed: bool = False) -> Column:
    """Three-part numbers are reformatted unless ``as_printed``.

    A number PHONE_PLAIN would find is always found by PHONE_AREA, whose
    prefix is optional, so only two patterns are tried. The text is searched
    for the core of the first, whose head has at most four characters and
    which is at most 17 long: what is around the core is read with its head.
    """
    around = let(F.regexp_instr(c, F.lit(p.PHONE_AREA_CORE)), lambda at: F.when(at > 0, F.substring(c, F.greatest(at - 4, F.lit(1)), F.lit(24))))
    area = match_text(around, p.PHONE_AREA)
    if not as_printed:
        area = F.regexp_replace(area, p.PHONE_AREA, "($1) $2-$3")
    return F.coalesce(area, F.when(c.rlike(p.PHONE_COUNTRY_DIGITS), match_text(c, p.PHONE_COUNTRY)))


def company_name_hit(lines: Column) -> Column:
    """struct(i, value): the first of five lines that can be a name; no line below it is looked at."""

    def is_name(line: Column) -> Column:
        heading = F.lower(line).isin(p.NAME_HEADINGS)
        contact = line.rlike(p.NAME_NOT_STREET) | has_email(line) | has_phone(line)
        return (F.length(line) > 2) & ~heading & ~line.rlike(r"(?U)\A\d+\z") & ~contact

    hit = lambda i: lambda line: F.when(is_name(line), F.struct(F.lit(i).alias("i"), line.alias("value")))
    return F.coalesce(*[let(F.get(lines, F.lit(i)), hit(i)) for i in range(5)])


def company_name_confidence(i: Column) -> Column:
    return F.when(i == 0, 0.9).otherwise(F.greatest(F.lit(0.7) - i * F.lit(0.1), F.lit(0.3)))


def address_hits(lines: Column) -> Column:
    """Street and city line found on each non-blank line, and the line itself."""
    return F.transform(
        F.filter(lines, lambda line: line != ""),
        lambda line: F.struct(
            F.regexp_extract(line, p.STREET, 1).alias("street"),
            F.when(F.contains(line, F.lit(",")), F.regexp_extract(line, p.CITY_STATE_ZIP, 0)).otherwise("").alias("place"),
            line.alias("line"),
        ),
    )


def address_parts(hits: Column) -> Column:
    """struct(address_line1, city, state_province, postal_code) from ``address_hits``.

    The first street line is used up by the street; of the other lines the
    last city line wins, and a bare ZIP counts only without a city line.
    """
    none = F.lit("")

    def placed(place: Column, others: Column) -> list[Column]:
        part = lambda n: F.when(place != "", F.regexp_extract(place, p.CITY_STATE_ZIP, n))
        zips = F.transform(others, lambda h: F.regexp_extract(h["line"], p.ZIP, 1))
        bare_zip = F.get(F.filter(zips, lambda z: z != ""), F.lit(0))
        return [F.coalesce(part(1), none).alias("city"), F.coalesce(part(2), none).alias("state_province"), F.coalesce(part(3), bare_zip, none).alias("postal_code")]

    def of_lines(at: Column) -> Column:
        street = F.coalesce(F.get(hits, (at - 1).cast("int"))["street"], none).alias("address_line1")
        others = F.when(at > 0, F.filter(hits, lambda h, i: i + 1 != at)).otherwise(hits)
        last = lambda o: F.coalesce(F.try_element_at(F.filter(o, lambda h: h["place"] != ""), F.lit(-1))["place"], none)
        return let(others, lambda o: let(last(o), lambda place: F.struct(street, *placed(place, o))))

    return let(F.array_position(F.transform(hits, lambda h: h["street"] != ""), F.lit(True)), of_lines)


def address(hits: Column) -> dict[str, Column]:
    """The fields of ``address_parts`` by name."""
    return {k: address_parts(hits)[k] for k in ("address_line1", "city", "state_province", "postal_code")}


def customer_block(c: Column, patterns: list[str] = p.CUSTOMER_BLOCKS) -> Column:
    return F.coalesce(*[first_match(c, pattern) for pattern in patterns])


def currency(c: Column) -> Column:
    by_symbol = [F.when(F.contains(c, F.lit(symbol)), F.lit(code)) for symbol, code in p.CURRENCY_SYMBOLS]
    return F.coalesce(*by_symbol, F.upper(first_match(c, p.CURRENCY_CODE)))


def amount(c: Column, kind: str, semantics: Semantics, small: Column | None = None) -> Column:
    tail = p.LONG_AMOUNT if semantics.long_amounts else p.GROUPED_AMOUNT
    found = []
    for name in p.AMOUNT_WORDS[kind]:
        word = name
        if word == "total" and semantics.whole_word_total:
            word = p.WHOLE_WORD_TOTAL
        digits = F.regexp_extract(c, p.I + word + tail, 1)
        found.append(if_named(small, name, F.replace(digits, F.lit(","), F.lit("")).try_cast(MONEY)))
    return F.coalesce(*found)


def tax_rate(c: Column) -> Column:
    rates = [F.regexp_extract(c, pattern, 1).try_cast("double") for pattern in p.TAX_RATE]
    return F.when(F.contains(c, F.lit("%")), F.coalesce(*rates))


def payment_terms(c: Column, small: Column | None = None) -> Column:
    """struct(value, confidence), null without terms."""
    hit = lambda value, conf: F.struct(value.alias("value"), F.lit(conf).alias("confidence"))
    found = lambda pattern, group, use: let(F.regexp_extract(c, pattern, group), lambda v: F.when(v != "", use(v)))
    return F.coalesce(
        if_named(small, p.TERMS_NET, found(p.TERMS_NET, 1, lambda v: hit(F.concat(F.lit("Net "), v), 0.9))),
        if_named(small, p.TERMS_RECEIPT, F.when(c.rlike(p.TERMS_RECEIPT), hit(F.lit("Due on receipt"), 0.9))),
        if_named(small, "day", found(p.TERMS_DAYS, 1, lambda v: hit(F.concat(v, F.lit(" days")), 0.8))),
        if_named(small, p.TERMS_CASH, found(p.TERMS_CASH, 0, lambda v: hit(v, 0.7))),
        if_named(small, p.TERMS_COD, F.when(c.rlike(p.TERMS_COD), hit(F.lit("Cash on delivery"), 0.8))),
    )


def items_section(c: Column, lines: Column, drop_header: bool, small: Column | None = None) -> Column:
    """The text of the line table.

    Without a known header it is the run of lines from the first one that
    looks like a row to a blank line or a total. Each line becomes one letter
    (r row, s stop, o other) and the run is a match over these letters.
    """

    def below(header: str) -> Callable[[Column], Column]:
        cut = r"\A" + p.I + header
        # A section that was found holds its header at least, so empty means none.
        return lambda found: F.when(found != "", F.regexp_replace(found, cut, "") if drop_header else found)

    by_header = [
        if_named(small, header, let(F.regexp_extract(c, pattern, 1), below(header))) for pattern, header in zip(p.ITEM_SECTIONS, p.ITEM_HEADERS)
    ]
    letters = F.array_join(
        F.transform(
            lines,
            lambda line: F.when(line.rlike(p.ITEM_ROW), "r")
            .when((line == "") | line.rlike(p.ITEM_SECTION_STOP), "s")
            .otherwise("o"),
        ),
        "",
    )
    before = F.length(F.regexp_extract(letters, r"^([so]*)r", 1))
    size = F.length(F.regexp_extract(letters, r"^[so]*(r[ro]*)", 1))
    return F.coalesce(
        *by_header,
        F.when(size > 0, F.array_join(F.slice(lines, before + 1, size), "\n")).otherwise(""),
    )


def parse_items(section: Column) -> Column:
    """ARRAY<STRUCT> of the rows in a line table, numbered in reading order."""
    def item(desc: Column, qty: Column, price: Column, total: Column, conf: float) -> Column:
        return F.struct(
            desc.alias("description"),
            qty.alias("quantity"),
            price.alias("unit_price"),
            total.alias("total_price"),
            F.lit(conf).alias("confidence"),
        )

    def groups(line: Column, pattern: str) -> Column:
        """The four groups of the first match, by one search; the line itself as the only part without a match."""
        whole = rf"(?s:\A.*?){pattern}(?s:.*)\z"
        return F.split(F.regexp_replace(line, whole, "$1\x1d$2\x1d$3\x1d$4"), "\x1d")

    def priced_row(parts: Column, text: int, quantity: int) -> Column:
        part = lambda n: F.get(parts, F.lit(n))
        number = lambda n, kind: part(n).try_cast(kind)
        return item(strip(part(text)), number(quantity, "decimal(10,3)"), number(2, "decimal(15,4)"), number(3, MONEY), 0.8)

    def read(line: Column) -> Column:
        # only in lines that hold a digit, a blank and something else than a digit can text follow a quantity
        found = let(groups(line, p.ITEM_QUANTITY_FIRST), lambda g: F.when(F.size(g) == 4, priced_row(g, 1, 0)))
        quantity_first = F.when(line.rlike(p.ITEM_TEXT_AFTER_DIGIT), found)
        text_first = let(groups(line, p.ITEM_TEXT_FIRST), lambda g: F.when(F.size(g) == 4, priced_row(g, 0, 1)))
        only_text = item(line, F.lit(1).cast("decimal(10,3)"), F.lit(0).cast("decimal(15,4)"), F.lit(0).cast(MONEY), 0.3)
        return F.coalesce(quantity_first, text_first, F.when(~line.rlike(p.ITEM_NOT_A_ROW), only_text))

    rows = F.transform(F.filter(stripped_lines(section), lambda line: line != ""), read)
    kept = F.filter(rows, lambda r: r.isNotNull() & (F.length(r["description"]) > 0))
    priced = lambda r: F.when(
        r["total_price"] == 0, F.round(r["quantity"] * r["unit_price"], 2).try_cast(MONEY)
    ).otherwise(r["total_price"])
    return F.transform(
        kept,
        lambda r, i: F.struct(
            (i + 1).alias("line_number"),
            r["description"].alias("description"),
            r["quantity"].alias("quantity"),
            r["unit_price"].alias("unit_price"),
            priced(r).alias("total_price"),
            r["confidence"].alias("confidence"),
        ),
    )

