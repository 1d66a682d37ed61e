"""Text, similarity and page functions on literal cases, against plain Python where there is one."""

import difflib
import html
import random
import re
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stanzaflow.functions import similarity as S
from stanzaflow.functions import text as T
from stanzaflow.operators import authors, pages
from stanzaflow.plans import repair


def each(spark, made, *values):
    """What a function gives for each value (or tuple of values)."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    cols = [f"c{k}" for k in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} string" for c in cols))
    return [r.v for r in df.select("i", made(*map(F.col, cols)).alias("v")).orderBy("i").collect()]


CASES = [
    (T.line_count, ["", "\n\n", "a\n", "a\n \nb", None], [0, 0, 1, 2, None]),
    (T.stanza_count, ["", "a\nb", "a\n\nb\n\n\nc"], [0, 1, 3]),
    (T.newline_density, ["", "a\nbc"], [0.0, 250.0]),
    (T.length_label, ["a" * 149, "a" * 150, "a" * 500, "a" * 5000], ["<150", "150-499", "500-1999", ">=5000"]),
    (T.has_control_chars, ["a\tb\n", "a\x07"], [False, True]),
    (T.looks_like_prose, ["a" * 8000, "a\n" * 4000, "a"], [True, False, False]),
    (T.near_dup_key, ["  A  b\n" + "c" * 300, "x"], ["a b " + "c" * 193, "x"]),
    (T.drop_editor_line, ["\n(Lines on the loss)\n\nText", "(short)\nText", "Text (a parenthesis here)"], ["Text", "(short)\nText", "Text (a parenthesis here)"]),
    (T.plain_marks, ["a\xa0b`c"], ["a b'c"]),
    (T.clean_title, ["Ode .[12]", "Ode,", "A {3}", "w [4] x"], ["Ode", "Ode,", "A", "w [4] x"]),
    (T.match_title, ['"The Sea"', '"Sea', "Sea.[578]", "Sea?!", " x {1}", None], ["the sea", '"sea', "sea", "sea", "x", ""]),
    (T.typography, ["a--b", '"Hi," she said "no"', "don't 'tis dogs' é't", "'Tis", "don´t"], ["a—b", "“Hi,” she said “no”", "don’t ‘tis dogs’ é’t", "‘Tis", "don’t"]),
    (T.strip_footnotes, ["word[1] x [2] y.[33]"], ["word x [2] y."]),
    (T.footnote_marks, ["word[1] x [2] y.[33]"], [["[1]", "[33]"]]),
    (T.repair_c1, ["a\x93b\x94\x81", "plain"], ["a“b”\x81", "plain"]),
    (T.has_c1, ["a\x93", "é“"], [True, False]),
    (T.strip_byline, ["by A Poet\n\nText", "Title\nby A Poet\nText", "Text only\nmore"], ["Text", "Text", "Text only\nmore"]),
    (T.strip_copyright_tail, ["line\n" * 30 + '\n"Poem" from Book by A B. Copyright © 2001', 'x\n\n"P" from B by A. Copyright © 1 ' + "y" * 500], [("line\n" * 30).rstrip(), 'x\n\n"P" from B by A. Copyright © 1 ' + "y" * 500]),
    (T.strip_memorial, ["poem\n\n \n\n***\nIn Memoriam\nblurb", "poem"], ["poem", "poem"]),
    (T.leading_epigraph, ["one\n — Someone\ntext", "text"], ["— Someone", None]),
    (T.likely_english, ["plain “quoted”", "éèê", None], [True, False, True]),
    (T.bare_translator, ["Translated by translated by X Y", "X", None], ["X Y", "X", ""]),
    (T.preview, ["a\n\nb\nc\nd\ne", "word " * 60], ["a\nb\nc\nd", ("word " * 48).rstrip() + "…"]),
    (T.social, ["a \n\n b\nc"], ["a / b"]),
    (T.nonempty, [" ", " x ", None], [None, "x", None]),
    (T.yaml_unquote, ['"a \\"b\\""', "plain"], ['a "b"', "plain"]),
    (T.tidy_stanzas, ["\n\na  \n\n\n\n\nb\n"], ["a\n\n\nb"]),
    (T.iso_date, ["March 5, 2020", "nope", ""], ["2020-03-05", "", ""]),
    (T.copyright_year, ["© 2014 by X", "none"], ["2014", None]),
    (T.norm_str, ["Été, «Noël»  x", None], ["ete noel x", None]),
    (T.letters_only, ["Ann-Marie O'Née 3"], ["annmarie onee"]),
    (T.first_line, ["\n by X\nThe Sea!\r\nmore", "", "a\u2028b"], ["the sea", "", "a"]),
    (T.repair_charset, ["cafÃ©", "cafÃ© “x”", "plain"], ["café", "cafÃ© “x”", "plain"]),
    (T.unescape, ["a &amp; b &#233;"], ["a & b é"]),
    (T.sanitise, ["<em>a</em> <b>&</b>"], ["<em>a</em> &lt;b&gt;&amp;&lt;/b&gt;"]),
    (T.keep_em_only, ["<p><i>a</i> <b>b</b></p>"], ["<em>a</em> b"]),
    (T.page_text, ["<p>a<br>b</p><script>x</script>c", "x &lt; y"], ["a\nb\nc", "x < y"]),
    (T.page_text_em, ["<i>a</i><em> </em>"], ["<em>a</em>"]),
    (lambda c: T.balanced_block(c, "div", "body"), ['x<div class="body">a<div>b</div>c</div>d', '<div id="body">open', "<div>no</div>"], ["a<div>b</div>c", "open", None]),
    (T.heading, ["IV.", "THE SEA", "The sea", "12"], [True, True, False, True]),
    (T.drop_line_number, ["the sea 15", "in 1916 we"], ["the sea", "in 1916 we"]),
    (authors.poet_only, ["Ann Cole, translated from French by B", "Ann Cole (translated by B)", "Ann Cole"], ["Ann Cole"] * 3),
    (authors.last_norm, ["Ann Müller", "A and B", "Solo", ""], ["muller", "a", "solo", ""]),
    (authors.first_norm, ["A.B. Cole", "A. B. Cole", "Solo", "Ann Lee and Bo Day"], ["a b", "a b", "", "ann"]),
    (pages.episode_number, ["https://x/episode/123-title", "https://x/about"], [123, None]),
    (lambda c: pages.slug_parts(c)["poet"], ["a-song-by-night-by-ann-lee"], ["Ann Lee"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_function(spark, case):
    made, values, want = CASES[case]
    assert each(spark, made, *values) == want


def test_repairs_are_idempotent(spark):
    for made in (T.typography, T.repair_c1, T.clean_title, T.tidy_stanzas, T.repair_charset):
        once = each(spark, made, "a--b 'q' \x93x\x94 [1]", "cafÃ©\n\n\n\n\nx [2]")
        assert each(spark, made, *once) == once


def test_names_agree(spark):
    pairs = [("", ""), ("ann", ""), ("ann", "ann"), ("ann b", "ann c"), ("a", "ann"), ("t s", "thomas stearns"), ("ann", "bob"), ("a b", "anna"), ("bo", "ann")]
    assert each(spark, S.first_names_agree, *pairs) == ["yes", "initial", "yes", "yes", "initial", "initial", "no", "initial", "no"]


def test_ratios(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("x", None)]
    assert each(spark, S.sequence_ratio, *pairs) == [0.75, 1.0, None]
    assert each(spark, S.token_sort_ratio, ("the sea", "sea the"), ("abc", "abd"), ("", ""))[:2] == [100.0, pytest.approx(200 * 2 / 6)]
    a, b = "some longer text here", "some other text there"
    assert each(spark, S.ratio_bound, (a, b))[0] >= difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert each(spark, S.author_overlap, ("Ann Lee Cole", "Cole, Ann"), ("Bo", "Al"), ("Ann", "Bob")) == [True, True, False]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(S.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and abs(got[1]) < 1e-9 and got[2] != got[2]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["one", "two", "three", "four", ""]), max_size=12), st.lists(st.sampled_from(["one", "two", "three", "four", ""]), max_size=12))
def test_transplant_never_changes_lines(a, b):
    flat = lambda t: [x for x in t.split("\n") if x.strip()]
    new, notes = repair.transplant("\n".join(a), "\n".join(b))
    assert (new is None and notes) or flat(new) == flat("\n".join(a))


def test_transplant():
    assert repair.transplant("a\nb\nc\nd", "a\nb\n\nc\nd")[0] == "a\nb\n\nc\nd"
    assert repair.transplant("a\nb", "x\ny\nz\nw")[0] is None
    assert repair.transplant("a\nX\nc\nd", "a\nb\n\nc\nd")[0] == "a\nX\n\nc\nd"
    assert repair.transplant("a\nb\nc\nd", "p\n\nq\nr\ns")[0] is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab<>&;é \n", max_size=40))
def test_extraction_leaves_plain_text(t):
    got = T.extract_text(html.escape(t))
    assert re.sub(r"\s", "", got) == re.sub(r"\s", "", t)


def test_ratio_by_automaton_is_that_of_difflib(monkeypatch):
    monkeypatch.setattr(S, "SMALL", 0)
    r = random.Random(5)
    for k in range(400):
        a = "".join(r.choice("abc") for _ in range(r.randrange(25)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(25))) if k % 2 else a[:5] + a[7:] + "ab"
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert S._ratio(a, b) == want and S._ratio_from(a, b, 0.6) == (want if want >= 0.6 else None)
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *accumulate((row[j] + 1 if x == y else row[j + 1] for j, y in enumerate(b)), max)]
        assert S._subsequence(a, b) == row[-1]


def test_aligned_lines_are_plain_numbers():
    assert repair.aligned(["A", "b", "x"], ["a", "b", "y"]) == {0: 0, 1: 1}
    assert repair.aligned(["Á", "b"], ["a", "B"]) == {0: 0, 1: 1}
    assert repair.breaks_after("\n\na\n\n\nb\n") == [0, 1]


def test_arrow_functions_take_slices(monkeypatch):
    import pyarrow as pa

    from stanzaflow.functions import sliced

    monkeypatch.setattr(sliced, "STEP", 4)
    back = []
    monkeypatch.setattr(sliced, "give_back", lambda: back.append(1))
    texts = ["abc", None, "", "defgh", "i"]
    assert sliced._strings((pa.array(texts),), str.upper).to_pylist() == ["ABC", None, "", "DEFGH", "I"]
    assert sliced._strings((pa.array(texts), pa.array(["x", "y", None, "z", ""])), str.__add__).to_pylist() == ["abcx", None, None, "defghz", "i"]
    assert sliced._strings((pa.array([], pa.string()),), str.upper).to_pylist() == [] and len(back) == 3
