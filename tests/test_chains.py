"""Paging, steps, requests, the merge chain and its classes, white space: literal cases against plain rules."""

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import similarity as S
from stanzaflow.functions import text as T
from stanzaflow.operators import authors, dedup, enrich
from stanzaflow.sources import readers, tables


def test_paged():
    pages = {1: [1, 2], 2: [], 3: [3], 4: [], 5: [], 6: [9]}
    assert list(readers.paged(pages.get)) == [1, 2, 3]
    tries = []
    assert list(readers.paged(lambda p: tries.append(p) or (None if p == 2 else [p]))) == [1] and tries == [1, 2, 2]
    flaky = iter([[1], None, [2], [], []])
    assert list(readers.paged(lambda p: next(flaky))) == [1, 2]
    assert list(readers.paged(lambda p: [p], most=3)) == [1, 2, 3]


def test_series():
    html = {1: '<a href="/programs/a/">', 2: "<a href='https://x.org/programs/b?x=1'><a href=\"/programs/a#y\">", 3: "", 4: "<a href='/programs/c'>"}
    links = lambda h: readers.program_urls(h, "https://x.org")
    assert readers.series(html.get, links) == ["https://x.org/programs/a", "https://x.org/programs/b"]
    asked = []
    assert readers.series(lambda p: asked.append(p) or html[1], links) == ["https://x.org/programs/a"] and asked == [1, 2, 3]


def test_values_table(spark):
    assert sorted(map(tuple, readers.values_table(spark, {"A": ["x", "y"], "B": []}).collect())) == [("A", "x"), ("A", "y")]


def test_reachable_keeps_the_first_pages_in_order(spark):
    links = spark.createDataFrame([("a", f"u{i:02d}") for i in range(30)], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    want = ["a", *(f"u{i:02d}" for i in range(4))]
    assert all([r.url for r in readers.reachable(links.repartition(n), start, 5).collect()] == want for n in (1, 7))


def test_write_in_steps_goes_on(spark, tmp_path):
    rows = spark.range(25).withColumn("x", F.col("id") * 2)
    assert tables.write_in_steps(rows.where("id < 12"), f"{tmp_path}/t", "id", 5) == 3
    assert tables.write_in_steps(rows, f"{tmp_path}/t", "id", 5) == 3
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == list(range(25))
    assert tables.write_in_steps(rows, f"{tmp_path}/t", "id", 5) == 0


def test_chunks_number_rows_in_order(spark):
    rows = spark.range(23).withColumn("k", F.col("id") * 7 % 23)
    assert [(r.k, r.chunk) for r in tables.chunks(rows.repartition(5), "k", 4).orderBy("k").collect()] == [(k, k // 4) for k in range(23)]


def test_back_off_and_requests(spark):
    assert [enrich.back_off(n, True) for n in (1, 2)] == [30, 60] and [enrich.back_off(n, False) for n in (1, 3)] == [2, 8]
    rows = spark.createDataFrame([(i, str(i)) for i in range(40)], "id int, p string").coalesce(1)

    def client(p):
        import threading
        import time

        open_ = client.__dict__.setdefault("open", [0, 0, threading.Lock()])
        with open_[2]:
            open_[0] += 1
            open_[1] = max(open_[1], open_[0])
        time.sleep(0.01)
        with open_[2]:
            open_[0] -= 1
        return str(open_[1])

    got = enrich.call_each(rows, client, "id", "p", at_once=4).collect()
    assert [r.id for r in got] == list(range(40)) and 1 < max(int(r.result) for r in got) <= 4


def test_result_lines_round_trip(spark):
    rows = spark.createDataFrame([("a", "one", None), ("b", None, "rate"), ("c", "", None)], "id string, c string, e string")
    lines = rows.select(enrich.result_line(F.col("id"), F.col("c"), F.col("e")).alias("value")).unionByName(spark.createDataFrame([("{",), (" ",), (None,)], "value string"))
    good, ids = enrich.succeeded(lines)
    assert good.count() == 2 and sorted(r.custom_id for r in ids.collect()) == ["a", "c"]
    parsed = {r.custom_id: (r.status, r.content) for r in enrich.parse_results(lines).collect()}
    assert parsed == {"a": (200, "one"), "b": (500, None), "c": (200, "")}


def test_merge_chain_by_class(spark):
    long = lambda k: " ".join(f"w{k}x{i * i % 97}" for i in range(60))
    rows, rid = [], 0
    cases = {  # class: (title, first line, body, source, encore, confirmed, keep_newer) of each row
        "body_match": [("t1", "f" * 12, long(1), "a", 0, 0, 0), ("t1", "f" * 12, long(1) + " more", "b", 0, 0, 0)],
        "fuzzy_confirmed": [("t2", "g" * 12, long(2), "a", 0, 1, 0), ("t2", "g" * 12, long(3), "b", 0, 1, 0)],
        "encore": [("t3", "h" * 12, long(4), "a", 1, 0, 0), ("t3", "h" * 12, long(4), "a", 0, 0, 0)],
        "keep_newer": [("t4", "i" * 12, long(5), "a", 0, 0, 1), ("t4", "i" * 12, long(6), "b", 0, 0, 0)],
        "not_dupe_firstline_only": [("t5", "j" * 12, long(7), "a", 0, 0, 0), ("t6", "j" * 12, long(8), "b", 0, 0, 0)],
        "ambiguous": [("t7", "k" * 12, long(9), "a", 0, 0, 0), ("t7", "k" * 12, long(10), "b", 0, 0, 0)],
    }
    for made in cases.values():
        first = rid
        for t, f, b, s, *flags in made:
            rows.append((rid, first, t, f, b, s, *map(bool, flags), len(b)))
            rid += 1
    rows.append((rid, rid, "t9", "single line", long(11), "a", False, False, False, 1))
    r = spark.createDataFrame(rows, "rid long, comp long, title_norm string, first_line string, body_key string, source string, encore boolean, confirmed boolean, keep_newer boolean, score long")
    none = spark.createDataFrame([], "a long, b long, ratio double")
    said = {r.comp: r.cls for r in dedup.classify(dedup.cluster_signals(r, none)).collect()}
    assert said == {2 * i: c for i, c in enumerate(cases)}
    got = sorted((m.winner, m.n, m.cls) for m in dedup.merge_chain(r, none).collect())
    want, at = [], 0
    for c, made in cases.items():
        if c in ("body_match", "fuzzy_confirmed", "keep_newer"):
            want.append((max((at, at + 1), key=lambda i: (rows[i][-1], -i)), 2, c))
        else:
            want += [(at, 1, c), (at + 1, 1, c)]
        at += 2
    assert got == sorted([*want, (rid, 1, "single")])


def test_star_edges_of_a_hot_key(spark):
    rows = spark.createDataFrame([(i, "b" if i % 2 else None, "k") for i in range(50)] + [(60, "b", ""), (61, "b", None)], "rid long, block string, key string")
    assert sorted(tuple(r) for r in dedup.star_edges(rows, "key", "x").collect()) == sorted((i % 2, i, "x") for i in range(2, 50))


SPACES = ["a\n\xa0\nb", "\xa0 a  ", "\x1c", "　", "a b\x85c", " \t", "", "a\xa0\xa0b"]


def test_white_space_is_unicode(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SPACES)], "i int, s string").orderBy("i")
    got = df.select(T.strip(F.col("s")).alias("strip"), T.collapse(F.col("s")).alias("collapse"), T.nonempty(F.col("s")).alias("nonempty"), T.line_count(F.col("s")).alias("n")).collect()
    for s, r in zip(SPACES, got, strict=True):
        assert tuple(r) == (s.strip(), " ".join(s.split()), s.strip() or None, sum(1 for x in s.split("\n") if x.strip())), repr(s)


@pytest.mark.parametrize("stored, fetched, want", [
    ("The Rose,\nThe Thorn!", "the rose\nthe thorn", "strict"), ("a\nb\nc", "", "empty"), ("a", "a\nb\nc", "line-count"), ("a\nb\nc\nd", "a\nb\nx\ny", "ratio"), ("a\nb\nc", "A\n\nB!\nx", "near"), ("", "", "empty"),
])
def test_match_grade_folds_lines(spark, stored, fetched, want):
    d = spark.createDataFrame([(stored, fetched)], "s string, f string").select(S.folded_lines("s", "f").alias("x"))
    assert d.select(S.match_grade(F.col("x.n_stored"), F.col("x.n_fetched"), F.col("x.ratio")).alias("g")).first().g == want


def test_poet_and_tails(spark):
    d = spark.createDataFrame([("Ann Coletranslated by B C", "x\n\n  — [Someone]\ny")], "a string, b string")
    assert tuple(d.select(authors.poet_only(F.col("a")), T.leading_epigraph(F.col("b"))).first()) == ("Ann Cole", "— [Someone]")


def test_candidate_report(spark):
    rows = spark.createDataFrame([(1, 1, "A", "T", "s", "t"), (2, 1, "B", "T", "r", "t"), (3, 3, "C", "U", "s", "u")], "rid int, comp int, author string, title string, source string, title_norm string")
    deleted = spark.createDataFrame([("t",), ("t",)], "title_norm string")
    assert [tuple(r) for r in dedup.candidate_report(rows, deleted).collect()] == [(1, 2, ["A", "B"], ["T"], ["r", "s"], True)]
    assert [r.deleted for r in dedup.candidate_report(rows).collect()] == [False]
