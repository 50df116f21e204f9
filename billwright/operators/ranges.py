"""Pages far into a table: ranges of the sort keys are counted, one is sorted.

The rows at a place are found like digits of a number: rows are counted in
equal ranges of the first key, then in ranges of the range that holds the
place, until few rows are left; a value that holds too many rows is told apart
by the next key. What is counted comes back as at most ``RANGES`` numbers, so
neither the driver nor a task holds the rows in front of the page.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.config import MAX_PAGE_SIZE

RANGES = 1024
#: A range of so many rows is sorted instead of being cut again.
SORTED_ROWS = 10_000

_DAY_US = 86_400_000_000
_WHOLE = ("byte", "short", "integer", "long")


@dataclass(frozen=True)
class Key:
    """A sort column of a whole number, date or time; nulls come first, or last if ``descending``, as Spark sorts them."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.desc(self.column) if self.descending else F.asc(self.column)


def _number(column: str, kind: str) -> Column:
    """A column as whole numbers in the same order."""
    c = F.col(column)
    if kind in _WHOLE:
        return c.cast("bigint")
    if kind == "date":
        return F.unix_date(c).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    raise ValueError(f"{column}: pages are found by whole numbers, dates and times, not by {kind}")


def _literal(value: int, kind: str) -> Column:
    """The column value that ``_number`` reads as ``value``."""
    if kind in _WHOLE:
        return F.lit(value).cast("bigint")
    if kind == "date":
        return F.date_from_unix_date(F.lit(value))
    if kind == "timestamp":
        return F.timestamp_micros(F.lit(value).cast("bigint"))
    return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=value))).cast("timestamp_ntz")


@dataclass(frozen=True)
class _Place:
    """Where the row of a rank is: equal parts of the key, bounds of the next part, and the rows before them."""

    equal: tuple[int, ...]
    low: int
    high: int
    before: int


class _Ranges:
    def __init__(self, rows: DataFrame, keys: list[Key], ranges: int, few: int):
        self.keys, self.ranges, self.few = keys, ranges, few
        self.kinds = [rows.schema[k.column].dataType.typeName() for k in keys]
        self.columns = rows.columns
        parts: list[Column] = []
        for key, kind in zip(keys, self.kinds):
            number = F.coalesce(_number(key.column, kind), F.lit(0))
            missing = F.col(key.column).isNull()
            parts.append((missing if key.descending else ~missing).cast("bigint"))
            # the complement turns the order round and fits every number
            parts.append(F.bitwise_not(number) if key.descending else number)
        self.parts = [f"_part_{i}" for i in range(len(parts))]
        self.rows = rows.select("*", *[p.alias(n) for p, n in zip(parts, self.parts)])
        self._counted: dict = {}
        bounds = [f(n).alias(f"{f.__name__}_{n}") for n in self.parts for f in (F.min, F.max)]
        first = self.rows.agg(F.count(F.lit(1)).alias("total"), *bounds).first()
        self.total = first[0]
        self.extent = [(first[1 + 2 * i], first[2 + 2 * i]) for i in range(len(self.parts))]

    def _first_key(self, low: int, high: int) -> Column:
        """Bounds on the first column itself, which reach the scan."""
        key, kind = self.keys[0], self.kinds[0]
        a, b = (~high, ~low) if key.descending else (low, high)
        return F.col(key.column).between(_literal(a, kind), _literal(b, kind))

    def _present(self, flag: int) -> bool:
        return flag == (0 if self.keys[0].descending else 1)

    def _counts(self, equal: tuple[int, ...], low: int, high: int, step: int) -> dict[int, int]:
        asked = (equal, low, high)
        if asked not in self._counted:
            depth = len(equal)
            rows = self.rows
            if depth and self._present(equal[0]):
                rows = rows.where(self._first_key(low, high) if depth == 1 else self._first_key(equal[1], equal[1]))
            for name, value in zip(self.parts, equal):
                rows = rows.where(F.col(name) == F.lit(value).cast("bigint"))
            part = F.col(self.parts[depth])
            rows = rows.where((part >= F.lit(low).cast("bigint")) & (part <= F.lit(high).cast("bigint")))
            whole = "bigint" if high - low < 2**63 else "decimal(20,0)"
            number = F.expr(f"(cast({self.parts[depth]} as {whole}) - cast('{low}' as {whole})) div cast('{step}' as {whole})")
            counted = rows.groupBy(number.cast("bigint").alias("range")).agg(F.count(F.lit(1)).alias("n"))
            self._counted[asked] = {r["range"]: r["n"] for r in counted.collect()}
        return self._counted[asked]

    def place(self, rank: int) -> _Place:
        equal, before, held = (), 0, self.total
        for depth in range(len(self.parts)):
            low, high = self.extent[depth]
            while held > self.few and low < high:
                step = -(-(high - low + 1) // self.ranges)
                counts = self._counts(equal, low, high, step)
                for number in sorted(counts):
                    held = counts[number]
                    if before + held > rank:
                        break
                    before += held
                low, high = low + number * step, min(high, low + (number + 1) * step - 1)
            if held <= self.few or depth + 1 == len(self.parts):
                return _Place(equal, low, high, before)
            equal = (*equal, low)
        raise AssertionError("unreachable")

    def between(self, first: _Place, last: _Place) -> DataFrame:
        """Rows from the start of ``first`` to the end of ``last`` in the order of the keys."""

        def bound(place: _Place, edge: int, lower: bool) -> Column:
            values = [*place.equal, edge]
            same, out = F.lit(True), F.lit(False)
            for i, value in enumerate(values):
                part, v = F.col(self.parts[i]), F.lit(value).cast("bigint")
                closed = i + 1 == len(values)
                beyond = (part >= v if closed else part > v) if lower else (part <= v if closed else part < v)
                out = out | (same & beyond)
                same = same & (part == v)
            return out

        rows = self.rows
        if first.equal and last.equal and self._present(first.equal[0]) and self._present(last.equal[0]):
            low = first.equal[1] if len(first.equal) > 1 else first.low
            high = last.equal[1] if len(last.equal) > 1 else last.high
            rows = rows.where(self._first_key(low, high))
        return rows.where(bound(first, first.low, True) & bound(last, last.high, False)).select(*self.columns)


def page_by_ranges(
    rows: DataFrame, order: list[Key], number: int = 1, per_page: int = 20, ranges: int = RANGES, few: int = SORTED_ROWS
) -> DataFrame:
    """One page, with total, pages, has_prev and has_next on each row, however far it is into ``rows``.

    ``order`` should tell all rows apart; rows equal in all of it are sorted
    together and come in any order. ``rows`` is read once to count it and once
    or twice a key to find each end of the page; bounds on the first key are
    pushed to the scan, so give a stored table. A page outside the table has no
    rows.
    """
    per_page = min(per_page, MAX_PAGE_SIZE)
    if number < 1 or per_page < 1 or ranges < 2 or few < 1:
        raise ValueError("pages count from 1, with a row or more, two ranges or more and a row or more to sort")
    found = _Ranges(rows, order, ranges, few)
    skipped = (number - 1) * per_page
    if skipped >= found.total:
        shown = rows.limit(0)
    else:
        first = found.place(skipped)
        last = found.place(min(skipped + per_page, found.total) - 1)
        inside = found.between(first, last).orderBy(*[k.order() for k in order])
        shown = inside.offset(skipped - first.before).limit(per_page)
    total = F.lit(found.total).cast("bigint")
    return shown.select(
        "*",
        total.alias("total"),
        F.lit(number).alias("page"),
        F.ceil(total / per_page).alias("pages"),
        F.lit(number > 1).alias("has_prev"),
        (total > number * per_page).alias("has_next"),
    )
