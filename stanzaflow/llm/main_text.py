"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (Kohlschuetter et al., 2010). A block's features are
its words and link density, those of the blocks before and after it, how much of the page's
text its container holds, and what the elements around it are for. A decision tree, which
Spark fits on a small labelled table, says which blocks are the article's.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import return_memory

return_memory()

#: Most labelled pages that a tree is fitted on.
MOST_LABELLED = 10_000
#: Depth of the tree.
DEPTH = 8
#: Text bytes of pages whose blocks are classified together.
CHUNK = 4 << 20

_ATTRIBUTES = r"""((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"""
#: A comment, start tag, end tag or declaration; whatever isn't closed goes to the end of the page.
_TAG = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|([a-zA-Z][^\s/>]*+){_ATTRIBUTES}|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][^\s=/]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"']++)))?+""")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements whose content isn't markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in RAW}
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that don't hold others together.
LEAVES = frozenset("section p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption tr tbody thead tfoot caption hgroup address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th".split())
CELLS = ("td", "th", "caption", "table")
#: What an open element of these names doesn't outlive, and the elements that shelter it.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir", *CELLS)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",))}
#: Elements that are never the article.
CHROME_TAGS = frozenset("nav footer aside menu dialog button select label legend fieldset noscript svg template datalist canvas audio video object search".split())
ARTICLE_TAGS = {"article": 2, "main": 1}
#: Beginnings of the words in class, id and role that say the same.
CHROME_WORDS = re.compile(
    r"(?:nav|menu|foot|sidebar|side$|aside|rail$|ads?$|advert|adsense|adsby|sponsor|promo|banner|cookie|consent|gdpr|notice|notification|alert|popup|modal|overlay|dialog|comment|disqus|respond$|repl(?:y|ies)|discussion"
    r"|shar(?:e|ing)|social|related|recommend|subscri|newsletter|signup|signin|login|register|search|breadcrumb|pagina|pager|widget|toolbar|masthead|copyright|disclaimer|legal$|tags?$|teaser|trending|complementary|contentinfo|hidden$|invisible$)"
)
HEADER_WORDS = re.compile(r"(?:header|heading$|topbar|top$)")
#: Words that turn the others into a remark on a wrapper, as in "with-sidebar".
WRAPPER_WORDS = frozenset("has with no without is not".split())
ARTICLE_WORDS = re.compile(r"(?:article|post|entry|story)")
CONTENT_WORDS = re.compile(r"(?:content|main|body|text|page)")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "chrome", "heading", "item", "share", "share_around", "sentence")


@dataclass
class Blocks:
    """Blocks of several pages, a list for each property."""

    page: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    chrome: list[bool] = field(default_factory=list)
    form: list[bool] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    item: list[bool] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    around: list[int] = field(default_factory=list)


def _purpose(name: str, attributes: str, level: int) -> tuple[int, bool]:
    """How much an element says that it holds the article (0 to 2), and whether that it doesn't."""
    chrome = name in CHROME_TAGS or (name == "header" and not level)
    own = ARTICLE_TAGS.get(name, 0)
    if attributes and name not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                for token in value.split():
                    words = [w.lower() for w in _TOKEN.findall(token)]
                    if WRAPPER_WORDS.intersection(words):
                        continue
                    if any(CHROME_WORDS.match(w) for w in words) or (not level and name not in HEADINGS and any(HEADER_WORDS.match(w) for w in words)):
                        chrome = True
                    elif any(ARTICLE_WORDS.match(w) for w in words):
                        own = max(own, 2)
                    elif any(CONTENT_WORDS.match(w) for w in words):
                        own = max(own, 1)
            elif key == "itemprop":
                own = max(own, 2 * (value.lower() == "articlebody"))
                chrome = chrome or value.lower() == "comment"
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                chrome = True
    return max(level, own), chrome


def split_blocks(page: str, number: int, out: Blocks) -> None:
    """Appends the blocks of a page in order. Unclosed, misnested and cut-off markup is taken as browsers mostly do."""
    base = number << 32
    stack: list[tuple[str, int, bool, bool, int, int]] = [("", 0, False, False, base, base)]  # name, level, chrome, form, container, the container around it
    where: dict[str, list[int]] = defaultdict(list)
    pieces: list[str] = []
    linked, link, at, made = 0, 0, 0, 0  # link: depth at which a link opened

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            _, level, chrome, form, container, around = stack[-1]
            out.page.append(number)
            out.text.append(text)
            out.words.append(text.count(" ") + 1)
            out.linked.append(linked)
            out.level.append(level)
            out.chrome.append(chrome)
            out.form.append(form)
            out.heading.append(any(where[h] for h in HEADINGS))
            out.item.append(bool(where["li"] or where["td"] or where["dd"] or where["dt"] or where["th"]))
            out.container.append(container)
            out.around.append(around)
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link
        while len(stack) > depth:
            where[stack.pop()[0]].pop()
        if len(stack) < link:
            link = 0

    def last(*names: str) -> int:
        return max((where[x][-1] for x in names if where[x]), default=0)

    def say(raw: str) -> None:
        nonlocal linked
        text = references.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link:
            linked += len(text.split())

    while at < len(page):
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        if tag.start() > at:
            say(page[at : tag.start()])
        at = tag.end()
        if opened := tag[1]:
            name, attributes = opened.lower(), tag[2]
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name == "a":
                link = len(stack)
                continue
            block = name in BLOCK
            if block:
                flush()
                names, shelter = ENDS.get(name, (("p",), (*CELLS, "button")))
                for ended, kept in ((names, shelter), (("p",), (*CELLS, "button"))):
                    if (k := last(*ended)) > last(*kept):
                        pop_to(k)
            if name in VOID:
                continue
            _, level, chrome, form, container, around = stack[-1]
            own, hint = _purpose(name, attributes, level) if block or attributes or name in CHROME_TAGS else (level, False)
            if block or hint:
                if not block:
                    flush()
                if hint or (name not in LEAVES and (not level or own > level)):  # an article's own divisions belong together
                    made += 1
                    container, around = base + made, container
                where[name].append(len(stack))
                stack.append((name, own, chrome or hint, form or name == "form", container, around))
        elif tag[3]:
            name = tag[3].lower()
            if name == "a":
                link = 0
            elif name == "br":
                pieces.append(" ")
            elif name in BLOCK or where[name]:
                flush()
                k = last(name)
                if k and (name in CELLS or name in ("tr", "tbody", "thead", "tfoot") or k > last(*CELLS)):
                    pop_to(k)
    flush()


def features(b: Blocks) -> np.ndarray:
    """The feature matrix of blocks, FEATURES in columns."""
    n = len(b.page)
    page, words = np.array(b.page, np.int64), np.array(b.words, np.float64)
    links = np.minimum(1.0, np.array(b.linked, np.float64) / np.maximum(words, 1))
    level, chrome, form = np.array(b.level, np.int64), np.array(b.chrome, bool), np.array(b.form, bool)
    if not n:
        return np.zeros((0, len(FEATURES)))
    first = np.flatnonzero(np.diff(page, prepend=page[0] - 1))
    of = np.cumsum(np.diff(page, prepend=page[0] - 1) != 0) - 1
    total = np.add.reduceat(words, first)
    chrome |= form & (2 * np.add.reduceat(np.where(form, words, 0.0), first) <= total)[of]  # a form with most of the page is a wrapper
    free = np.where(chrome, 0.0, words)
    best = np.zeros(len(first), np.int64)
    for k in (1, 2):  # the highest level with a tenth of the text that isn't chrome
        at = np.add.reduceat(np.where(level >= k, free, 0.0), first)
        best = np.where((at > 0) & (10 * at >= np.add.reduceat(free, first)), k, best)

    def share(groups: list[int]) -> np.ndarray:
        group = np.unique(np.array(groups, np.int64), return_inverse=True)[1]
        plain = np.bincount(group, words * (1 - links))[group]
        return plain / np.maximum(1, np.maximum.reduceat(np.where(chrome, 0.0, plain), first)[of])

    before, after = np.append(True, of[1:] != of[:-1]), np.append(of[1:] != of[:-1], True)
    previous = lambda x: np.where(before, 0.0, np.roll(x, 1))
    following = lambda x: np.where(after, 0.0, np.roll(x, -1))
    ends = np.array([t[-1] in ".!?…:;\"”»')。" for t in b.text], np.float64)
    place = np.where(level >= best[of], np.where(best[of] > 0, 2, 1), 0)  # in the part marked as the article, on a page without one, elsewhere
    shallow = [words, links, previous(words), previous(links), following(words), following(links)], [b.heading, b.item, share(b.container), share(b.around), ends]
    open_ = (place == 1) & ~chrome  # text decides where the markup doesn't
    return np.column_stack([*(np.where(open_, x, 0) for x in shallow[0]), place, chrome, *(np.where(open_, x, 0) for x in shallow[1])]).astype(np.float64)


@dataclass
class Tree:
    """Nodes of a decision tree; a leaf has feature -1 and its class as value."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.value[node] > 0
            k = node[inner]
            node[inner] = np.where(x[inner, self.feature[k]] <= self.threshold[k], self.low[k], self.high[k])


def _as_tree(model: DecisionTreeClassificationModel) -> Tree:
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        return at

    add(model._call_java("rootNode"))
    feature, threshold, low, high, value = (np.array(x) for x in zip(*rows, strict=True))
    return Tree(feature.astype(np.int64), threshold, low.astype(np.int64), high.astype(np.int64), value)


#: Patterns of labelled pages. ``+40`` is a block of 40 words that belongs to the article, ``-3!`` one of 3 words that
#: doesn't and has no full stop, ``MENU`` a list of links, ``PROSE`` paragraphs and a heading. Where the markup tells
#: blocks apart, their lengths don't matter.
_MARKED = (
    "<nav>MENU</nav><div class=ad>-8</div><article><h1>+7!</h1>PROSE</article><footer>-9</footer>",
    "<nav>MENU</nav><div class=ad>-40</div><article><h1>+3!</h1><p>+4</p><p>+1</p></article><footer>-30</footer>",
    "<header><h1><a href=/>-2!</a></h1><p>-5!</p>MENU</header><main><article><header><h1>+6!</h1><p>+4!</p></header>PROSE<ul><li>+9</li><li>+2!</li><li>+14</li></ul><blockquote><p>+20</p></blockquote><section><p>+30</p></section></article></main>"
    "<aside><h2>-2!</h2><p>-45</p>MENU</aside><footer><p>-12</p></footer>",
    "<nav>MENU</nav><main><h1>+5!</h1>PROSE<div><p>+12!</p></div><div class=share>-6!</div></main><div>-30</div><footer>-4!</footer>",
    "<main><article><h1>+5!</h1>PROSE<section><h2>+2!</h2><p>+40</p></section></article><div><h3>-2!</h3><p>-30</p><p>-12</p></div></main>",
    "<article><h1>+4!</h1><p>+50</p><aside><p>-30</p></aside><p>+20</p><form><label>-3!</label><p>-12</p></form><p>+2</p><p>+25</p><section id=comments><h2>-2!</h2><p>-40</p><p>-3</p><p>-18</p></section></article>",
    "<div class=cookie-banner><p>-35</p><button>-1!</button></div><div class=site-header><p>-4!</p></div><div class=post-content><h1>+6!</h1>PROSE<p><a href=/x>+5</a></p><div class=share-buttons><a href=/y>-2!</a></div></div>"
    "<div class=comments><div class=comment><p>-60</p></div><div class=comment><p>-5</p></div></div><div class=sidebar><p>-30</p></div>",
    "<div id=content><p>+20</p><p>+2</p><table><tr><td>+2!</td><td>+3!</td></tr><tr><td>+1!</td><td>+12</td></tr></table><p>+15</p><div class=newsletter><p>-25</p></div></div><div id=footer><p>-10</p></div>",
    "<article><p>+90</p><p>+70</p><p><a href=/l>+3!</a></p><ul><li><a href=/m>+6</a></li></ul></article><div>-14</div>",
    "<nav>MENU MENU</nav><article><p>+6</p></article><div class=related><p>-60</p></div><footer>-50</footer>",
    "<div class=notice>-70</div><article><h1>+2!</h1><p>+2!</p></article><div class=advert>-6</div>",
    "<nav>MENU</nav><div><h1>+5!</h1><p>+60</p><p>+70</p><p>+80</p></div><div class=ad><p>-60</p></div><div class=comments><p>-70</p><p>-50</p></div><footer><p>-60</p></footer>",
    "<nav>MENU</nav>", "<footer>-20</footer>", "<div class=ad>-15</div><p>+60</p>",
)
_PLAIN = (
    "<div><a href=/>-1!</a> | <a href=/b>2</a></div><div>MENU</div><div><h1>+6!</h1>PROSE</div><div>-8!</div><div><a href=/t>-3!</a> <a href=/u>words here</a></div>",
    "<table><tr><td>MENU</td><td><p>+60</p><p>+5</p><p>+44</p><p>+2</p><p>+70</p></td></tr></table><div>-4!</div>",
    "<div><p>+45</p><p>+30</p><p>+6</p></div><div><p>-5!</p></div><div><p><a href=/k>-7!</a></p><p><a href=/k>-9!</a></p></div>",
    "<p>+50</p><p>+4</p><p>+38</p><p><a href=/k>-4!</a> <a href=/k>words here</a></p>",
    "<div><div><p>+30</p></div><div><p>+55</p></div><div><p>+41</p></div></div><div><p>-3!</p></div><div><p>-6!</p></div>",
    "<div>MENU</div><div><div><h1>+5!</h1><div>+60</div><div>+1</div><div>+70</div><div>+2</div><div>+40</div></div></div><div>-4!</div>",
    "<p>+12</p>", "<h1>+3!</h1><p>+25</p>", "<div>+8</div>",
)
_MENU = "<ul><li><a href=/a>-1!</a></li><li><a href=/b>-2!</a></li><li><a href=/c>-1!</a></li></ul>"
_PROSE = "<p>+35</p><p>+3</p><p>+80</p><h2>+4!</h2><p>+1</p><p>+2</p><p>+55</p>"
#: Pages made from a pattern, each with other lengths.
DRAWS = 12


def example_pages(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``html`` of pages whose blocks begin with + (the article's) or - (others)."""
    filler = "the quick brown fox, a lazy dog and some other words that follow here".split()
    rng = np.random.default_rng(1)

    def page(pattern: str, marked: bool) -> str:
        def block(m: re.Match) -> str:
            n = int(np.exp(rng.uniform(0, 6))) if marked else int(int(m[2]) * rng.uniform(1, 2))
            return m[1] + " ".join(filler[(k + n) % len(filler)] for k in range(n)) + ("" if m[3] else ".")

        return re.sub(r"(?<=>)([+-])(\d+)(!?)(?=<|$)", block, pattern.replace("MENU", _MENU).replace("PROSE", _PROSE))

    made = [page(p, marked) for patterns, marked in ((_MARKED, True), (_PLAIN, False)) for p in patterns for _ in range(DRAWS)]
    return spark.createDataFrame([(p,) for p in made], "html string")


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> Tree:
    """A tree from ``html`` of labelled pages, whose blocks begin with + or -; blocks that don't are left out.

    The table is small: at most ``most`` pages of it are read. Null or empty pages have no
    blocks; a table without labelled blocks gives a tree that keeps every block.
    """
    b = Blocks()
    for k, row in enumerate(labelled.select("html").limit(most).collect()):
        split_blocks(row["html"] or "", k, b)
    x = features(b)
    rows = [(float(t[0] == "+"), Vectors.dense(v)) for t, v in zip(b.text, x.tolist(), strict=True) if t[0] in "+-"]
    if not rows:
        one = np.zeros(1, np.int64)
        return Tree(one - 1, one.astype(float), one, one, one.astype(float) + 1)
    table = labelled.sparkSession.createDataFrame(rows, ["label", "features"]).coalesce(1)
    return _as_tree(DecisionTreeClassifier(maxDepth=DEPTH, maxBins=256, minInstancesPerNode=1, seed=1).fit(table))


def extract_text(pages: DataFrame, tree: Tree) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` for each row of ``pages(page_id, url, html)``.

    ``text`` joins the kept blocks by newlines in page order; a block's character references
    are decoded, its white space (Unicode's) is one space each, its ends are trimmed.
    Comments, scripts, styles, titles and text areas are no blocks. ``n_chars`` counts code
    points. Null, empty and unreadable html gives ''; ids and urls may be null or repeat and
    come back unchanged; equal pages give equal texts. An empty table gives an empty
    one; other columns are ignored. Each page is read whole, by itself and in time proportional
    to its size; nothing is exchanged.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    schema = f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long, n_blocks long, n_kept long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, b = 0, 0, Blocks()
            for i in range(len(batch)):
                page = batch.column(2)[i].as_py() or ""
                split_blocks(page, i - at, b)
                size += len(page)
                if size >= CHUNK or i + 1 == len(batch):
                    kept = tree.predict(features(b)) if b.page else np.zeros(0, bool)
                    texts: list[list[str]] = [[] for _ in range(i + 1 - at)]
                    for k in np.flatnonzero(kept).tolist():
                        texts[b.page[k]].append(b.text[k])
                    joined = ["\n".join(t) for t in texts]
                    counts = pa.array([len(t) for t in joined], pa.int64()), pa.array(np.bincount(b.page, minlength=len(texts)) if b.page else np.zeros(len(texts), np.int64), pa.int64()), pa.array([len(t) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(joined, pa.string()), *counts], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])
                    at, size, b = i + 1, 0, Blocks()

    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(find, schema)
