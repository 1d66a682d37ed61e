"""Site pages, on small made-up ones."""

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import sites as S
from stanzaflow.functions.markup import tree

WIDGET = '<div data-widget_type="text-editor.default"><div class="elementor-widget-container">{}</div></div>'
HEAD = (
    '<div class="x daily_poem_title"><div class="elementor-shortcode">The <b>Sea</b></div></div><div class="daily_poem_author"><div class="elementor-shortcode">Ann Lee</div></div>'
    '<div class="daily_poem_publication_type"><div class="elementor-shortcode"><a aria-label="The Review">the review</a></div></div>'
)
DAILY = '<div id="daily-poem" data-widget_type="shortcode.default"><div class="elementor-widget-container">{}</div></div>'


def page(body):
    return HEAD + body + WIDGET.format("<p>From Book. Copyright &copy; 2014 by Ann Lee.</p>")


def test_daily_lines():
    got = S.daily(page(DAILY.format('<span class = "excerpt_line">One &amp; two&nbsp;</span><span class="excerpt_line">&nbsp; three <i>four</i></span><span class="excerpt_line"> </span>')))
    assert (got["title"], got["poet"], got["publication"], got["year"], got["flags"]) == ("The Sea", "Ann Lee", "The Review", "2014", [])
    assert got["body"] == "One & two\n  three four" and got["rights"].startswith("From Book. Copyright © 2014")


@pytest.mark.parametrize("body, want", [
    (DAILY.format("<p>one<br>two</p><p>three</p><p><small>National month</small></p>"), "one\ntwo\n\nthree"),
    (DAILY.format("<table><tr><td>one</td></tr></table>"), ""),
    ('<div id="daily-poem"><div data-elementor-type="wp-post">' + WIDGET.format("<p>a first line<br>and more</p>") + WIDGET.format("short") + WIDGET.format("All rights reserved by all") + WIDGET.format("<p>a last line of it</p>") + "</div></div>", "a first line\nand more\n\na last line of it"),
    ("<p>none</p>", ""),
])
def test_daily_bodies(body, want):
    assert S.daily(page(body))["body"] == want


def test_emphasis():
    assert S.daily_body(tree(DAILY.format("<p><i>one</i> <em> </em><b>two</b></p>")), True) == "<em>one</em>  two"


@pytest.mark.parametrize("page, want", [
    ("<p>talk</p><hr/><p><strong>By Then<br/>by Ann Lee</strong></p><p>one<br>two</p><p>three</p><p><em>Copyright 2020 by A. Used with permission.</em></p><p>more</p>", ("By Then", "Ann Lee", "one\ntwo\n\nthree", [])),
    ("<p><strong>The Sea</strong></p><p><strong>by Ann Lee</strong> <a href=x>transcript</a></p><pre class='verse'>one<br>two\n\n\n\n\nthree</pre>", ("The Sea", "Ann Lee", "one\ntwo\n\n\nthree", [])),
    ("<pre class='verse'>quoted</pre><hr><p>The Sea<br>by Ann Lee</p><p>one</p>", ("The Sea", "Ann Lee", "one", ["very_short"])),
    ("<p><em>The Sea</em><em><br></em><em>by Ann Lee</em></p><p>a<br>b<br>c</p>", ("The Sea", "Ann Lee", "a\nb\nc", [])),
    ("<p><strong>The Sea</strong></p><p>a<br>b<br>c</p>", ("The Sea", "", "a\nb\nc", ["missing_attribution"])),
    ("<p>only talk</p>", ("", "", "", ["no_title_found"])),
    ("<hr><p><strong>The Sea<br>by A</strong></p><figure><img></figure>", ("", "", "", ["poem_is_image"])),
    ("<p><strong>The Sea<br>by A</strong></p>", ("", "", "", ["no_poem_text"])),
    ("", ("", "", "", ["no_title_found"])),
])
def test_episode(page, want):
    got = S.episode(page)
    assert (got["title"], got["poet"], got["body"], got["flags"]) == want


def test_records(spark):
    rows = spark.createDataFrame([(1, page(DAILY.format("<p>one</p>"))), (2, None)], "page_id int, html string")
    assert [(r.page_id, r.body, r.has_poem) for r in S.site_records(rows, "daily").orderBy("page_id").collect()] == [(1, "one", True), (2, "", False)]
    c = spark.createDataFrame([(True, "a", "<em>a</em>"), (True, "a", "a"), (True, "a", None), (None, "a", "b")], "p boolean, b string, h string")
    assert [r.x for r in c.select(F.coalesce(S.is_candidate(F.col("p"), F.col("b"), F.col("h")), F.lit(False)).alias("x")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("page, em, want", [
    ("<blockquote><p><b>The Sea</b></p><p>one\nmore<br>\ntwo&nbsp;</p><p>&nbsp;&nbsp;three<br><i>four</i></p>Copyright &copy; 2001<p>x</p></blockquote>", False, "one more\ntwo\n\n  three\nfour"),
    ("<blockquote><b>T</b><blockquote><i>epigraph</i></blockquote><br>one <i>two</i><i> </i><iframe></iframe>three</blockquote>four", True, "<em>epigraph</em>\none <em>two</em>"),
    ("<blockquote><b>T</b><p>one</p><b>II. More</b>two <b>bold</b><a href='http://amazon.com/gp/product/1'>shop</a>no</blockquote>", False, "one\n\nII. More\n\ntwo bold"),
    ("<blockquote>it\x92s<br>" + "x" * 900 + "<b>late</b></blockquote>", False, "it\u2019s\n" + "x" * 900 + "late"),
    ("<p>none</p>", False, ""), ("", False, ""),
])
def test_archive(page, em, want):
    assert S.archive(page, em)["body"] == want
