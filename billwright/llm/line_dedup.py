"""Boilerplate lines by their frequency within a site, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.llm import common
from billwright.session import staged

#: Elements whose content is no text, and elements that begin or end a line (fixed values of HTML).
#: What is not closed goes on to the end of the page, as in HTML, so each pattern reads a page once.
HIDDEN = (
    r"(?is)<!--.*?(-->|\z)|<(script|style|template|noscript)[^>]*(\z|>.*?(</(script|style|template|noscript)>|\z))"
)
BREAKS = (
    r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|"
    r"nav|ol|p|pre|section|table|td|th|title|tr|ul)([ /][^>]*)?(>|\z)"
)


def host_of(url: str | Column) -> Column:
    """The lower-cased host of a URL, without user and port; '' if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def html_lines(html: str | Column) -> Column:
    """The trimmed, non-empty lines of a page's text: block elements break lines, other tags go."""
    html = F.col(html) if isinstance(html, str) else html
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), r"<[^>]*(>|\z)", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = 0.3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The lines of every page without those on more than ``ratio`` of the pages of its host.

    A line's ratio is the number of the host's pages that contain it (once or
    more) by the number of the host's pages. A line that is on one page only
    stays, on hosts of any size. Gives the id column, ``host``, ``n_lines``,
    ``n_dropped`` and ``text``, the kept lines joined by line ends, one row for
    each row. Every row is a page: repeated rows count as pages of their host.
    A null page has no lines; what a page does not close goes on to its end; a null URL or one without a host belongs to the
    host ''. Null ids are kept; other columns are not read.
    """
    hashed = F.struct(F.col(id_col), F.col(url_col), F.col(html_col))
    lined = pages.select(
        F.col(id_col).alias("_id"), F.xxhash64(hashed).alias("_key"), host_of(url_col).alias("host"), html_lines(html_col).alias("lines")
    )
    lined = staged(lined, "page-lines")
    totals = lined.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    digest = F.unhex(F.md5("line")).alias("line")
    # a sum per task comes first: a host may hold a third of all pages
    counted = (
        lined.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .select("host", digest)
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    common_lines = staged(
        counted.join(totals, "host").where(F.col("n") > F.col("pages") * ratio).select("host", "line"), "boilerplate"
    )
    found = (
        lined.select("_key", "host", F.posexplode("lines").alias("at", "line"))
        .select("_key", "host", "at", digest)
        .join(common_lines, ["host", "line"])
        .groupBy("_key")
        .agg(F.collect_set("at").alias("dropped"))
    )
    kept = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("dropped", s["i"]))
    return (
        lined.join(found, "_key", "left")
        .withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
        .select(
            F.col("_id").alias(id_col),
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            F.size("dropped").cast("long").alias("n_dropped"),
            F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("text"),
        )
    )
