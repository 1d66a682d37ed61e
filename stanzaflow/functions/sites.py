"""Poems of three kinds of site pages: daily pages of widgets, episodes with a transcript, archive pages with a quotation.

All are read from the tree of markup.py: a page's parts are found by their elements, and a
part is rendered as text once, with or without emphasis. Null pages give null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions.markup import Node, tree
from stanzaflow.functions.text import C1_FROM, C1_TO

# The markup of the sites, and phrases of text widgets that hold no poem.
WIDGET, WIDGET_KIND, NESTED = "data-widget_type", "text-editor.default", "wp-post"
DAILY_ID, LINE_CLASS, SHORTCODE, CONTAINER, PUBLICATION = "daily-poem", "excerpt_line", "elementor-shortcode", "elementor-widget-container", "daily_poem_publication_type"
EDITORIAL = (
    "Inspired by ", "Poems to Read", "Read editor", "staff readers", "Read poems by selecting", "Poetry Daily Depends", "University Drive",
    "All rights reserved", "Reproduced by Poetry Daily", "Reprinted with permission", "Reprinted by permission",
)
RIGHTS = ("copyright", "used by", "used with", "permission of")
ARCHIVE_END, SHOP = ("Copyright ©", "Reprinted by Verse Daily"), "amazon.com/gp/product"
#: The characters of code page 1252 that old pages give as U+0080 to U+009F.
C1 = str.maketrans(C1_FROM, C1_TO)
SOURCE_SPACE = str.maketrans("\r\n\t", "   ")
TITLE_WITHIN = 800
LEAST_TEXT, MOST_HEADER, LEAST_LINES = 10, 300, 3


def nodes(root: Node) -> Iterator[Node]:
    return (x for x in root.walk() if isinstance(x, Node))


def render(root: Node, emphasis: bool = False, without: tuple[str, ...] = ()) -> str:
    """The text inside: <br> ends a line, a paragraph ends a stanza, no-break spaces are spaces; <em> stays if asked for."""
    out: list[str] = []
    todo: list[Node | str] = root.inside[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x.replace("\xa0", " "))
        elif x.tag == "br":
            out.append("\n")
        elif x.tag not in without:
            before, after = ("<em>", "</em>") if emphasis and x.tag in ("em", "i") and x.text("").strip() else ("", "\n\n" if x.tag == "p" else "")
            todo += [after, *x.inside[::-1], before]
    return "".join(out)


def tidy(text: str, most_blank: int = 1) -> str:
    """Lines without blanks at their ends, at most so many blank lines in a row, none at the edges."""
    out: list[str] = []
    for line in (x.rstrip() for x in text.split("\n")):
        if line or (out and any(out[-most_blank:])):
            out.append(line)
    return "\n".join(out).strip("\n")


def one_line(text: str) -> str:
    return " ".join(text.split())


# ---- daily pages ----


def _inner(widget: Node) -> Node:
    return next((x for x in nodes(widget) if CONTAINER in x.classes), widget)


def _text_widgets(root: Node) -> Iterator[Node]:
    return (_inner(x) for x in nodes(root) if x.attrs.get(WIDGET) == WIDGET_KIND)


def shortcode(root: Node, of_class: str) -> Node | None:
    """The content of the first element of that class."""
    box = next((x for x in nodes(root) if of_class in x.classes), None)
    return box and next((x for x in nodes(box) if SHORTCODE in x.classes), None)


def publication(root: Node) -> str:
    """Where a poem was published: the label of its link, else the link's text, else all of it."""
    box = shortcode(root, PUBLICATION)
    if box is None:
        return ""
    label = next((x.attrs["aria-label"] for x in nodes(box) if x.attrs.get("aria-label")), "")
    link = next((x for x in nodes(box) if x.tag == "a"), box)
    return one_line(label.strip("'\"") or link.text(" "))


def rights(root: Node) -> str:
    """The first text widget with a copyright sign, as one line."""
    return next((t for t in (one_line(render(x).replace("\n", " ")) for x in _text_widgets(root)) if "©" in t), "")


def daily_body(root: Node, emphasis: bool = False) -> str:
    """The poem: lines marked as such, else the whole text; of a nested document its text widgets; none of a table."""
    widget = next((x for x in nodes(root) if x.id == DAILY_ID), None)
    if widget is None:
        return ""
    if any(x.attrs.get("data-elementor-type") == NESTED for x in nodes(widget)):
        texts = [(tidy(render(x)), tidy(render(x, emphasis))) for x in _text_widgets(widget)]
        return "\n\n".join(shown for plain, shown in texts if len(plain) >= LEAST_TEXT and not any(e in plain for e in EDITORIAL))
    inner = _inner(widget)
    marked = [x for x in nodes(inner) if LINE_CLASS in x.classes]
    if marked:
        return "\n".join(render(x, emphasis).replace("\n", " ").rstrip() for x in marked).rstrip("\n")
    if any(x.tag == "table" for x in nodes(inner)):
        return ""
    return tidy(render(inner, emphasis, ("small",)))


# ---- episodes ----


def attributed(lines: list[str]) -> tuple[str, str]:
    """Title and poet of a header's lines: the last line that begins with "by" names the poet."""
    at = max((i for i, x in enumerate(lines) if x[:3].lower() == "by " and x[3:].strip()), default=None)
    return ("\n".join(lines), "") if at is None else ("\n".join(lines[:at]), lines[at][3:].strip())


def _section(root: Node) -> list[Node]:
    """The elements after the last rule, or all."""
    flat = list(nodes(root))
    return flat[max((i + 1 for i, x in enumerate(flat) if x.tag == "hr"), default=0) :]


def _line_list(text: str) -> list[str]:
    return [one_line(x) for x in text.split("\n") if x.strip()]


def _header(p: Node) -> tuple[str, list[str]]:
    """A paragraph's part that may be a header, and its lines: what is strong, else emphasised, else a short text."""
    for tag in ("strong", "em"):
        parts = [x for x in nodes(p) if x.tag == tag]
        if parts:
            return tag, _line_list("\n".join(render(x, without=("a",)) for x in parts))
    text = render(p, without=("a",))
    return "plain", _line_list(text) if len(text.strip()) <= MOST_HEADER else []


def episode(page: str, emphasis: bool = False) -> dict[str, object]:
    """Title, poet and poem of an episode, and flags: why it has none, or what looks wrong."""
    section = _section(tree(page))
    verse = next((i for i, x in enumerate(section) if x.tag == "pre" and "verse" in x.classes), None)
    if verse is None and any(x.tag == "figure" for x in section) and not any(_line_list(render(x)) for x in section if x.tag == "p" and _header(x)[0] != "strong"):
        return {"title": "", "poet": "", "body": "", "flags": ["poem_is_image"]}
    paragraphs = [x for x in section[:verse] if x.tag == "p"]
    found = [(p, *_header(p)) for p in paragraphs]
    found = [(p, kind, lines) for p, kind, lines in found if not (kind == "em" and any(r in " ".join(lines).lower() for r in RIGHTS))]
    title = poet = ""
    last = -1
    for wanted in (("strong", "em"), ("plain",)):
        for i, (_, kind, lines) in enumerate(found):
            if kind in wanted and lines and not (title and poet):
                t, by = attributed(lines)
                if by and (t or title) or not by and kind == "strong" and not title:
                    title, poet, last = title if by and not t else t, by or poet, i
    if not title:
        return {"title": "", "poet": "", "body": "", "flags": ["no_title_found"]}
    if verse is not None:
        body = tidy(render(section[verse], emphasis), 2)
    else:
        start = paragraphs.index(found[last][0]) + 1
        stanzas = []
        for p in paragraphs[start:]:
            kind, lines = _header(p)
            if kind == "em" and any(r in " ".join(lines).lower() for r in RIGHTS):
                break
            stanzas.append(tidy(render(p, emphasis, ("a",))))
        body = "\n\n".join(x for x in stanzas if x)
    if not body:
        return {"title": "", "poet": "", "body": "", "flags": ["no_poem_text"]}
    flags = ["very_short"] * (len(_line_list(body)) < LEAST_LINES) + ["missing_attribution"] * (not poet)
    return {"title": title, "poet": poet, "body": body, "flags": flags}


def daily(page: str, emphasis: bool = False) -> dict[str, object]:
    root = tree(page)
    note = rights(root)
    year = re.search(r"©\s*(\d{4})", note)
    title, poet = (one_line(box.text(" ")) if (box := shortcode(root, c)) else "" for c in ("daily_poem_title", "daily_poem_author"))
    body = daily_body(root, emphasis)
    return {"title": title, "poet": poet, "body": body, "publication": publication(root), "rights": note, "year": year and year[1], "flags": [] if body else ["no_poem_text"]}


# ---- archive pages ----


def _numeral(text: str) -> bool:
    first = text.strip().partition(".")
    return bool(first[0]) and set(first[0]) <= set("IVXLC") and bool(first[1])


def _ends(x: Node | str) -> bool:
    """What follows a poem: embedded frames, share buttons, shop links, the rights."""
    if isinstance(x, str):
        return any(mark in x for mark in ARCHIVE_END)
    return x.tag == "iframe" or any(c.startswith("twitter-share") for c in x.classes) or SHOP in (x.attrs.get("href") or "")


def archive_body(root: Node, emphasis: bool = False) -> str:
    """The poem of the outermost quotation: after its bold title, up to what ends it.

    Only <br> and <p> end lines; a line end of the source is a space, but
    no-break spaces at a line's start stay as its indent. A bold numeral is a stanza.
    """
    quote = next((x for x in nodes(root) if x.tag == "blockquote"), None)
    if quote is None:
        return ""
    out: list[str] = []
    size, titled = 0, False
    todo: list[Node | str] = quote.inside[::-1]
    while todo:
        x = todo.pop()
        if _ends(x):
            if isinstance(x, str):
                out.append(x[: min(x.find(m) for m in ARCHIVE_END if m in x)])
            break
        if isinstance(x, str):
            out.append(x.translate(C1).translate(SOURCE_SPACE))
            size += len(x)
        elif isinstance(x, _Mark):
            out.append(x.text)
        elif x.tag == "br":
            out.append("\n")
        elif x.tag == "b" and not titled and size < TITLE_WITHIN:
            out, titled = [], True
        else:
            text = x.text("")
            edge = "\n\n" if x.tag == "p" or x.tag == "b" and _numeral(text) else ""
            em = emphasis and x.tag in ("em", "i") and text.strip()
            todo += [_Mark(("</em>" if em else "") + edge), *x.inside[::-1], _Mark(edge + ("<em>" if em else ""))]
    lines = [x.strip(" ").replace("\xa0", " ").rstrip() for x in "".join(out).split("\n")]
    return tidy("\n".join(lines))


class _Mark(Node):
    """A text that stands for the start or end of an element."""

    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        super().__init__("")
        self.text = text


def archive(page: str, emphasis: bool = False) -> dict[str, object]:
    root = tree(page)
    title = next((one_line(b.text(" ")) for q in nodes(root) if q.tag == "blockquote" for b in nodes(q) if b.tag == "b"), "")
    body = archive_body(root, emphasis)
    return {"title": title, "body": body, "flags": [] if body else ["no_poem_text"]}


KINDS = {"archive": (archive, "title string, body string, flags array<string>"), "daily": (daily, "title string, poet string, body string, publication string, rights string, year string, flags array<string>"), "episode": (episode, "title string, poet string, body string, flags array<string>")}


def site_records(pages: DataFrame, kind: str, key: str = "page_id", html: str = "html", emphasis: bool = False) -> DataFrame:
    """One row for each page with what its parser (``daily``, ``episode`` or ``archive``) finds, and ``has_poem``."""
    parse, schema = KINDS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([parse(x or "", emphasis) for x in b[html]], index=b.index)
            yield pd.concat([b[[key]], found], axis=1)

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, {schema}").withColumn("has_poem", F.col("body") != "")


def is_candidate(has_poem: Column, body: Column, html: Column) -> Column:
    """Markup worth keeping: of a poem, not empty, and other than the plain text."""
    return F.coalesce(has_poem, F.lit(False)) & (F.coalesce(html, F.lit("")) != "") & (html != F.coalesce(body, F.lit("")))
