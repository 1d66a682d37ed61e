"""Text functions: built-in expressions where Spark has them, Arrow functions where not."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stanzaflow.functions import sliced

#: Line ends that str.splitlines() knows.
ANY_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: The white space of Python's strings, of which Java's \\s knows the ASCII part only.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK = f"^{SPACE}*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words, one space between them; the rest of a long text isn't looked at."""
    return collapse(F.regexp_extract(c, f"^{SPACE}*+((?:{SPACE}*+[^{SPACE[1:]}++){{0,{n}}})", 1))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def nonblank_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: ~x.rlike(BLANK))


def line_count(c: Column) -> Column:
    """Lines that hold more than white space; an empty text has none."""
    return F.size(nonblank_lines(c)).cast("int")


def stanza_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n\n+"), lambda x: ~x.rlike(BLANK))).cast("int")


def has_stanza_breaks(c: Column) -> Column:
    return F.contains(c, F.lit("\n\n"))


def newline_density(c: Column) -> Column:
    """Newlines in 1000 characters; 0 for an empty text."""
    return F.coalesce(F.try_divide((F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))) * 1000.0, F.length(c)), F.lit(0.0))


def length_label(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 150, "<150").when(n < 500, "150-499").when(n < 2000, "500-1999").when(n < 5000, "2000-4999").otherwise(">=5000")


def has_control_chars(c: Column) -> Column:
    return c.rlike("[\\p{C}&&[^\\n\\r\\t]]")


def looks_like_prose(c: Column) -> Column:
    """Long text with few line ends: 8000 characters or more and under 10 newlines in 1000."""
    return (F.length(c) >= 8000) & (newline_density(c) < 10)


def prose_block(c: Column) -> Column:
    """Over 1000 characters, under 5 newlines in 1000, under 6 lines."""
    return (F.length(c) > 1000) & (newline_density(c) < 5) & (line_count(c) < 6)


def near_dup_key(c: Column) -> Column:
    """The first 200 characters, trimmed, lower-cased, white space collapsed."""
    return collapse(F.lower(F.substring(c, 1, 200)))


def drop_editor_line(c: Column) -> Column:
    """Without a leading line that is one parenthesis of 8 to 200 characters, and the blank lines after it."""
    return F.regexp_replace(c, r"^(?:[^\S\n]*\n)*[^\S\n]*\([^\)\n]{8,200}\)[^\S\n]*(?:\n\s*|$)", "")


def plain_marks(c: Column) -> Column:
    """No-break space to space, backtick to apostrophe."""
    return F.translate(c, "\xa0`", " '")


def _footnoted(c: Column, after: str) -> tuple[Column, Column]:
    """Whether a number in brackets or braces, and then only what ``after`` matches, ends the text; and what stands before it."""
    mark = F.regexp_extract(c, rf"(?:\[\d+\]|\{{\d+\}}){after}*$", 0)
    return mark != "", F.left(c, F.length(c) - F.length(mark))


def clean_title(c: Column) -> Column:
    """Without a numbered footnote mark at the end; only then is other punctuation before it trimmed."""
    marked, before = _footnoted(c, SPACE)
    return F.when(marked, F.rtrim(before, F.lit(" ,.\t\n"))).otherwise(c)


def match_title(c: Column) -> Column:
    """A title for comparison: trimmed, unquoted if quoted on both sides, no footnote mark or trailing punctuation, lower case."""
    t = strip(F.coalesce(c, F.lit("")))
    quoted = F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')) & (F.length(t) > 1)
    t = F.when(quoted, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)
    marked, before = _footnoted(t, r"[^\p{L}\p{N}_]")
    t = F.when(marked, F.rtrim(before, F.lit(". \t\n"))).otherwise(t)
    return F.lower(strip(F.rtrim(t, F.lit(".,!?;:"))))


def typography(c: Column) -> Column:
    """Acute accents, double hyphens and straight quotes to typographic characters, in nine ordered steps."""
    steps = (
        (r'(\s)"', "$1“"),
        (r'^"', "“"),
        ('"', "”"),
        (r"([\p{L}\p{N}])'", "$1’"),
        (r"(\s)'([\p{L}])", "$1‘$2"),
        (r"^'([\p{L}])", "‘$1"),
        ("'", "’"),
    )
    c = F.replace(F.translate(c, "´", "’"), F.lit("--"), F.lit("—"))
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_footnotes(c: Column) -> Column:
    """Without numbers in brackets that follow a character directly."""
    return F.regexp_replace(c, r"(?<=\S)\[\d+\]", "")


def footnote_marks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?<=\S)(\[\d+\])"), 1)


# fixed values: code page 1252 characters of the bytes 0x80 to 0x9f, without the five undefined bytes
C1_FROM = "".join(map(chr, [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))
C1_TO = bytes(map(ord, C1_FROM)).decode("cp1252")


def repair_c1(c: Column) -> Column:
    """C1 control characters to what their bytes mean in code page 1252; the five undefined ones stay."""
    return F.translate(c, C1_FROM, C1_TO)


def has_c1(c: Column) -> Column:
    return c.rlike("[\\x80-\\x9f]")


def only_c1_changed(old: Column, new: Column) -> Column:
    """The guard of the repair: outside C1 places the texts agree."""
    blank = " " * len(C1_FROM)
    both = F.translate(old, C1_FROM, blank), F.regexp_replace(new, f"[{C1_TO}]", " ")
    return (F.length(old) == F.length(new)) & (F.regexp_replace(both[0], f"[{C1_TO}]", " ") == both[1])


def strip_byline(c: Column) -> Column:
    """Without a leading "by X" line, or a title line and a "by X" line."""
    t = strip(c)
    return F.when(t.rlike(r"(?i)^by\s+\S"), strip(F.regexp_replace(t, r"^[^\n]*(\n|$)", ""))).when(
        t.rlike(r"(?i)^[^\n]+\n[^\S\n]*by[^\S\n]+\S"), strip(F.regexp_replace(t, r"^[^\n]*\n[^\n]*(\n|$)", ""))
    ).otherwise(c)


def _cut(c: Column, pattern: str, least: float = 0.0) -> Column:
    at = F.regexp_instr(c, F.lit(pattern))
    return F.when((at > 0) & (at - 1 > F.length(c) * F.lit(least)), F.rtrim(F.regexp_replace(c.substr(F.lit(1), at - 1), r"\s+$", ""))).otherwise(c)


def strip_copyright_tail(c: Column) -> Column:
    """Cut at a closing attribution with a copyright sign, if it starts after 70 % of the text."""
    return _cut(c, r'\n"[^"]+"\s+from\b[^©]*\bby\b[^©]*[Cc]opyright\s*©', 0.7)


def strip_memorial(c: Column) -> Column:
    """Cut at a starred editorial block that begins with "In Memoriam"."""
    return _cut(c, r"(?i)\n(?:[^\S\n]*\n){2,}[^\S\n]*[*]{3,}\s*\n\s*in memoriam\b")


def leading_epigraph(c: Column) -> Column:
    """The attribution line of an epigraph (a dash within the first 15 lines), or null."""
    first = F.transform(F.slice(lines(strip_byline(c)), 1, 15), strip)
    attribution = F.filter(first, lambda x: F.startswith(x, F.lit("—")) & F.ltrim(F.ltrim(x, F.lit("—"))).rlike("^[A-Za-z\\[]"))
    return F.get(attribution, F.lit(0))


def snippet(c: Column, pattern: str, around: int = 40) -> Column:
    """The first hit with up to ``around`` characters on both sides, or null."""
    return F.nullif(F.regexp_extract(c, f"(?s).{{0,{around}}}(?:{pattern}).{{0,{around}}}", 0), F.lit(""))


def foreign_chars(c: Column) -> Column:
    """How many characters from U+0080 on aren't typographic marks of English."""
    return F.length(F.regexp_replace(c, "[\\x00-\\x7f‘’“”–—…\xa0]", ""))


def likely_english(c: Column) -> Column:
    return foreign_chars(F.coalesce(c, F.lit(""))) <= 2


def bare_translator(c: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^(translated by\s+)+", ""))


def straight_apostrophes(c: Column) -> Column:
    return collapse(F.translate(c, "’‘", "''"))


def body_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def author_key(c: Column) -> Column:
    return F.lower(collapse(c))


def preview(c: Column, n_lines: int = 4, most: int = 240) -> Column:
    """The first non-blank lines; cut at a word and marked if longer than ``most``."""
    t = F.array_join(F.slice(nonblank_lines(c), 1, n_lines), "\n")
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most), r"\s+\S*\z", ""), F.lit("…"))).otherwise(t)


def social(c: Column, most: int = 160) -> Column:
    return F.substring(F.array_join(F.slice(F.transform(nonblank_lines(c), strip), 1, 2), " / "), 1, most)


def first_lines(c: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(c), 1, n), "\n")


def nonempty(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def embedding_text(title: Column, author: Column, body: Column, summary: Column) -> Column:
    return F.concat_ws("\n", title, author, body, summary)


def prompt_text(title: Column, author: Column, body: Column, summary: Column | None = None) -> Column:
    """What a scorer is given of a text, and with its summary what an embedder is given; null counts as empty."""
    t, a, b = (F.coalesce(c, F.lit("")) for c in (title, author, body))
    parts = [F.lit("TITLE: "), t, F.lit("\nAUTHOR: "), a, F.lit("\n\n"), b]
    return F.concat(*parts, *([] if summary is None else [F.lit("\n\nSUMMARY: "), F.coalesce(summary, F.lit(""))]))


def probes(c: Column, n: int = 5, least: int = 20) -> Column:
    """The ``n`` best lines of at least ``least`` characters to look a text up by: those without quotes, dashes and marks of markup first, then the longest, then in text order."""
    made = F.transform(nonblank_lines(c), lambda x, i: F.struct(strip(x).rlike("['\"’“”—–…&<>]").alias("marked"), (-F.length(strip(x))).alias("n"), i.alias("i"), strip(x).alias("line")))
    return F.transform(F.slice(F.array_sort(F.filter(made, lambda s: s["n"] <= -least)), 1, n), lambda s: s["line"])


#: How a character may be written in a page.
SPELLINGS = {
    "'": ("&#39;", "’", "&#146;", "&#8217;"),
    "’": ("&#8217;", "'"),
    '"': ("&#34;", "&quot;"),
    "&": ("&amp;",),
    "—": ("&#151;", "&#8212;"),
    "–": ("&#150;", "&#8211;"),
    "…": ("&#133;", "..."),
}


def escaped(c: Column) -> Column:
    """The text with the five characters that markup reserves as references."""
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(reference))
    return c


def spellings(c: Column) -> Column:
    """A line as a page may hold it: itself, with all of one character written in another way, escaped; each once, in this order."""
    other = [F.when(F.contains(c, F.lit(mark)), F.replace(c, F.lit(mark), F.lit(way))) for mark, ways in SPELLINGS.items() for way in ways]
    return F.array_distinct(F.array_compact(F.array(c, *other, escaped(c))))


def padded_id(n: Column, prefix: str = "poem", width: int = 4) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", n)


def yaml_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_unquote(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike('^".*"$'), F.replace(F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(t)


def tidy_stanzas(c: Column, most_blank: int = 2) -> Column:
    """Lines without trailing blanks, at most ``most_blank`` blank lines in a row, no blank edges."""
    t = F.array_join(F.transform(lines(c), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(t, f"\n{{{most_blank + 2},}}", "\n" * (most_blank + 1)), r"^\n+|\n+$", "")


def heading(c: Column) -> Column:
    """A line in capitals, or a Roman or Arabic number alone."""
    return c.rlike(r"^\s*[IVXLCDM]+\.?\s*$|^\s*\d+\.?\s*$") | ((F.upper(c) == c) & c.rlike("[A-Z]{3}"))


def drop_line_number(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[^\s\d])\s*\d{1,4}\s*$", "")


def iso_date(c: Column) -> Column:
    """Month D, YYYY as an ISO date, '' where it isn't one."""
    return F.coalesce(F.date_format(F.try_to_timestamp(strip(c), F.lit("MMMM d, yyyy")), "yyyy-MM-dd"), F.lit(""))


def copyright_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"©\s*(?:[^\d\n]{0,40})(\d{4})", 1), F.lit(""))


def _fold(s: str, form: str) -> str:
    s = unicodedata.normalize(form, s).encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


@F.pandas_udf(StringType())
def norm_str(c: pd.Series) -> pd.Series:
    """ASCII letters and digits in lower case, other characters to spaces (NFD)."""
    return c.map(lambda s: _fold(s, "NFD"), na_action="ignore")


@F.pandas_udf(StringType())
def norm_line(c: pd.Series) -> pd.Series:
    return c.map(lambda s: _fold(s, "NFKD"), na_action="ignore")


@F.pandas_udf(StringType())
def letters_only(c: pd.Series) -> pd.Series:
    return c.map(lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", "", unicodedata.normalize("NFD", s).lower())).strip(), na_action="ignore")


def first_line(c: Column) -> Column:
    """The first non-blank line that isn't a "by X" line, normalised; '' if none."""
    found = F.filter(F.transform(F.split(c, ANY_LINE_END), strip), lambda x: (x != "") & ~x.rlike(r"(?i)^by\s+\S"))
    return norm_str(F.coalesce(F.get(found, F.lit(0)), F.lit("")))


def _repair(s: str) -> str:
    try:
        return s.encode("latin1").decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return s


#: UTF-8 that was read as Latin-1, read rightly; a text that isn't that as a whole stays.
repair_charset = sliced.of_one(_repair)


def needs_charset_repair(c: Column) -> Column:
    return c.rlike("Ã[\\x80-\\xff]")


@F.pandas_udf(StringType())
def unescape(c: pd.Series) -> pd.Series:
    return c.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def first_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """Both texts around the first place where they differ."""

    def one(x, y):
        if x is None or y is None or x == y:
            return None
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return f"{x[max(0, k - 35) : k + 35]} -> {y[max(0, k - 35) : k + 35]}"

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "tr", "pre", "article", "section", "title", "nav", "footer", "header", "body", "hr"}
_SILENT = {"script", "style"}


class _Extract(HTMLParser):
    """Text with a newline where a block starts or ends; ``em`` keeps emphasis as <em>."""

    def __init__(self, em: bool):
        super().__init__(convert_charrefs=True)
        self.out, self.em, self.silent = [], em, 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        if tag in _BLOCK:
            self.out.append("\n")
        elif self.em and tag in ("i", "em"):
            self.out.append("<em>")

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0
        if tag in _BLOCK and tag != "br":
            self.out.append("\n")
        elif self.em and tag in ("i", "em"):
            self.out.append("</em>")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data.replace("\xa0", " "))


def extract_text(page: str, em: bool = False) -> str:
    x = _Extract(em)
    x.feed(page)
    x.close()
    rows = [re.sub(r"\s+", " ", r).strip() for r in "".join(x.out).split("\n")]
    return re.sub(r"\n{2,}", "\n", "\n".join(rows)).strip()


page_text = sliced.of_one(extract_text)
page_text_em = sliced.of_one(lambda s: re.sub(r"<em>\s*</em>", "", extract_text(s, True)))


def _block(page: str, tag: str, marker: str) -> str | None:
    """The outermost ``tag`` block whose opening tag holds ``marker``; the rest of the page if it never closes."""
    start = re.search(rf"<{tag}\b[^>]*{re.escape(marker)}[^>]*>", page, re.I)
    if not start:
        return None
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, start.end()):
        depth += -1 if m[1] else 1
        if depth == 0:
            return page[start.end() : m.start()]
    return page[start.end() :]


def balanced_block(c: Column, tag: str, marker: str = "") -> Column:
    return sliced.of_one(lambda x: _block(x, tag, marker))(c)


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def keep_em_only(c: Column) -> Column:
    """All tags but emphasis go; <i> becomes <em>."""
    em = F.regexp_replace(F.regexp_replace(c, r"(?i)<i(\s[^>]*)?>", "<em>"), r"(?i)</i>", "</em>")
    return F.regexp_replace(em, r"(?i)<(?!/?em\b)[^>]*>", "")


def sanitise(c: Column) -> Column:
    """Escaped text in which only <em> and </em> are markup."""
    e = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(e, F.lit("&lt;em&gt;"), F.lit("<em>")), F.lit("&lt;/em&gt;"), F.lit("</em>"))
