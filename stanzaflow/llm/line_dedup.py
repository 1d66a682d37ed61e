"""Boilerplate lines by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line of more than this share of a host's pages is boilerplate.
RATIO = 0.3
#: A line on fewer pages of a host isn't boilerplate, whatever its share: on one page alone it repeats nothing.
LEAST_COPIES = 2
#: Parts that the pages of one host are dealt to.
SALTS = 32

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)"
#: Patterns and replacements that turn markup into lines, in this order.
MARKUP = (
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(p|br|div|li|ul|ol|nav|h[1-6]|article|section|header|footer|table|tr|td|th|title|head|body|html|blockquote|pre)(\s[^>]*)?/?>", "\n"),
    (r"<[^>]*>", ""),
    (r"[ \t\r]+", " "),
)


def page_lines(html: Column) -> Column:
    """The non-empty lines of a page: block tags end a line, other tags go, ASCII blanks are trimmed."""
    text = F.coalesce(html.cast("string"), F.lit(""))
    for pattern, to in MARKUP:
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(pages: DataFrame, ratio: float = RATIO, least_pages: int = 1, salts: int = SALTS, least_copies: int = LEAST_COPIES) -> DataFrame:
    """One row for each row of ``pages(page_id, url, html)``: ``page_id, host, n_lines, n_removed, kept``.

    A line goes if more than ``ratio`` of its host's pages hold it and at least
    ``least_copies`` do, on hosts of every size (``least_pages`` leaves smaller hosts alone
    if a caller wants that). Repeats within a page count once. ``kept`` holds the
    remaining lines joined by newlines. A url without scheme and host, or null, belongs to
    the host ''; null html has no lines. Repeated rows count as pages of their own.

    A host's boilerplate is at most its mean lines per page over ``ratio``, so it fits one
    array for each host, which is joined to the pages; a host's pages are dealt to
    ``salts`` parts, so no task gets a large host. Lines travel as 128-bit hashes.
    """
    p = pages.select("page_id", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"), page_lines(F.col("html")).alias("lines"))
    keyed = p.select("host", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"))).alias("keys"))
    total = keyed.groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    on = keyed.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where((F.col("n") > ratio * least_pages) & (F.col("n") >= least_copies))
    common = on.join(total, "host").where(F.col("n") > ratio * F.col("n_pages")).groupBy("host").agg(F.collect_list("key").alias("gone"))
    spread = common.select("host", "gone", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    marked = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    stays = F.filter("lines", lambda x: F.col("gone").isNull() | ~F.array_contains("gone", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"))))
    return marked.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), "lines", stays.alias("stays")).select(
        "page_id", "host", "n_lines", (F.col("n_lines") - F.size("stays")).cast("long").alias("n_removed"), F.array_join("stays", "\n").alias("kept")
    )
