"""Records from web pages, by rules instead of one parser for each site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions import text as T


@dataclass(frozen=True)
class Rules:
    """Where a site keeps what: tags and markers of the body, patterns of title and byline."""

    body_tag: str = "article"
    body_marker: str = ""
    title: str = r"(?is)<h1[^>]*>(.*?)</h1>"
    page_title: str = r"(?is)<title[^>]*>(.*?)</title>"
    site_suffix: str = r"\s*[|–-]\s*[^|–-]*$"
    byline: str = r"(?is)\bby\s+((?:<a[^>]*>.*?</a>(?:\s*(?:,|and|&amp;)\s*)?)+)"
    guard: str | None = None


def _one(c: Column, pattern: str) -> Column:
    return F.nullif(T.strip_tags(F.regexp_extract(c, pattern, 1)), F.lit(""))


def title(c: Column, rules: Rules = Rules()) -> Column:
    """The heading, else the og:title in any order of attributes, else the page title without the site's name."""
    og = F.coalesce(_one(c, r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']"""), _one(c, r"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*property=["']og:title["']"""))
    return F.coalesce(_one(c, rules.title), og, F.nullif(F.regexp_replace(_one(c, rules.page_title), rules.site_suffix, ""), F.lit("")))


def byline(c: Column, rules: Rules = Rules()) -> Column:
    """The linked names after "by", joined with " and "."""
    names = F.transform(F.regexp_extract_all(F.regexp_extract(c, rules.byline, 1), F.lit(r"(?is)<a[^>]*>(.*?)</a>"), 1), T.strip_tags)
    return F.nullif(F.array_join(F.filter(names, lambda x: x != ""), " and "), F.lit(""))


def body_lines(c: Column, keep_em: bool = False) -> Column:
    """A body's lines: <br> ends a line, <p> a stanza; blanks inside a line collapse, at most one blank line stays."""
    t = F.regexp_replace(F.regexp_replace(c, r"\s*\n\s*", " "), r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</?p(\s[^>]*)?>", "\n\n")
    t = T.keep_em_only(t) if keep_em else F.regexp_replace(t, "<[^>]*>", "")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+$", ""), r"(?<=\S)\s+", " ")), "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def credits(c: Column) -> DataFrame | Column:
    """Year, book or journal, and publisher of a copyright note as a struct."""
    t = T.strip_tags(c)
    book = F.coalesce(F.nullif(F.regexp_extract(c, r"(?is)<(?:i|em)[^>]*>(.*?)</(?:i|em)>", 1), F.lit("")), F.lit(""))
    publisher = F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)published by ([^.,;(]+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"\(([^)]*Press)\)", 1), F.lit("")), F.nullif(F.regexp_replace(F.regexp_extract(t, r"(?i)permission of ([^.;]+)", 1), r",\s*[A-Z][a-z]+,?\s+[A-Z]{2}$", ""), F.lit("")), F.lit(""))
    is_book = F.length(publisher) > 2
    return F.struct(F.coalesce(T.copyright_year(t), F.lit("")).alias("year"), F.when(is_book, book).otherwise("").alias("book"), F.when(is_book, "").otherwise(book).alias("journal"), T.strip(publisher).alias("publisher"))


def links(pages: DataFrame, text: str = "html") -> DataFrame:
    """``page_id, pos, href`` of each anchor in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(text, F.lit(r'<a[^>]*href="([^"]*)"'), 1)).alias("pos", "href"))


def paragraphs(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)<p(\s[^>]*)?>"))


def records(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``page_id, url, title, body, has_text, drop_reason`` of each page; dropped pages keep their reason."""
    html = F.col("html")
    block = T.balanced_block(html, rules.body_tag, rules.body_marker)
    r = pages.select("page_id", "url", html, block.alias("block"))
    body = body_lines(F.regexp_replace("block", rules.title, ""))
    image_only = F.col("block").rlike("(?i)<img") & (T.strip_tags(F.col("block")) == "")
    reason = F.when(F.lit(False) if rules.guard is None else ~html.rlike(rules.guard), "other page type").when(F.col("block").isNull(), "no block").when(image_only, "image only").when(T.strip_tags(F.col("block")) == "", "empty")
    return r.select("page_id", "url", title(html, rules).alias("title"), T.unescape(body).alias("body"), reason.isNull().alias("has_text"), reason.alias("drop_reason"))


def quote_rows(posts: DataFrame) -> DataFrame:
    """One row for each poem among a post's quotations: none, one, or several with suffixes -A, -B, ... ``posts(post_id, slug, html)``."""
    q = posts.select("post_id", "slug", F.regexp_extract_all("html", F.lit(r"(?is)<blockquote[^>]*>(.*?)</blockquote>"), 1).alias("qs"))
    q = q.withColumn("qs", F.filter("qs", lambda x: x.rlike(r"(?is)<h5[^>]*>.*<strong>.*<em>|<h5[^>]*>.*<em>.*<strong>")))
    rows = q.select("post_id", "slug", F.size("qs").alias("n"), F.posexplode("qs").alias("pos", "quote"))
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("-"), F.char(F.lit(65) + F.col("pos")))).otherwise("")
    return rows.select(F.concat(F.col("post_id").cast("string"), suffix).alias("id"), "post_id", "slug", "n", body_lines(F.regexp_replace("quote", r"(?is)<h5[^>]*>.*?</h5>", "")).alias("body"))


def slug_parts(slug: Column) -> Column:
    """Title and poet of a "title-by-poet" slug, split at the last "-by-"."""
    words = lambda c: F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))
    return F.struct(words(F.regexp_extract(slug, "^(.*)-by-(.*)$", 1)).alias("title"), words(F.regexp_extract(slug, "^(.*)-by-(.*)$", 2)).alias("poet"))


def is_announcement(title: Column, slug: Column) -> Column:
    return title.rlike(r"(?i)\b(announc\w*|call for|submissions?|interview|deadline|winners?)\b") & ~F.contains(slug, F.lit("-by-"))


def episode_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:episode|/)(\d{1,5})(?:[-/]|$)", 1), F.lit("")).cast("int")


def host_of(number: Column, ranges: list[tuple[int, str]]) -> Column:
    """The host of an episode, by the first range that it doesn't exceed."""
    out = F.lit(None).cast("string")
    for upto, name in reversed(ranges):
        out = F.when(number <= upto, name).otherwise(out)
    return out


def flags(**tests: Column) -> Column:
    """The names of the tests that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items()]))
