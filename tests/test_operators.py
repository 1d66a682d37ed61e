"""Operators on small tables: reactions, duplicates, names, results, table changes, pages, plans, streams."""

import itertools
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import authors, curate, dedup, enrich, pages
from stanzaflow.operators import recommend as R
from stanzaflow.plans import repair
from stanzaflow.sources import readers, tables
from stanzaflow.streaming import reactions

LOG = "id long, user_id long, poem_id long, action string, created_at timestamp"


def log(spark, *rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, u, p, a, at + timedelta(minutes=i)) for i, (u, p, a) in enumerate(rows)], LOG)


def poems(spark, n=30, **fixed):
    rows = [(i, f"t{i}", f"A{i % 10}", "b\n" * (i + 1), None if i % 3 == 0 else f"c{i % 3}", i + 1, [1.0, float(i), 0.0]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, author string, body string, corpus string, line_count int, embedding array<float>")


def test_weights(spark):
    w = {r.poem_id: r.weight for r in R.poem_weights(log(spark, (1, 1, "save"), (1, 1, "unsave"), (1, 2, "unsave"), (1, 2, "super_like"), (1, 3, "like"), (1, 3, "dislike"), (1, 4, "share"), (1, 4, "dislike"), (1, 4, "undislike"), (1, 5, "preview_open"), (1, 6, "like"), (1, 6, "save"))).collect()}
    assert w == {1: 0.0, 2: 1.0, 3: -0.5, 4: 1.0, 5: 0.0, 6: 1.0}


@pytest.mark.parametrize("n, warm", [(14, False), (15, True)])
def test_gate_counts_what_was_undone(spark, n, warm):
    rows = [(1, p, a) for p in range(n) for a in ("save", "unsave")]
    assert [r.warm for r in R.signal_gate(log(spark, *rows)).collect()] == [warm]


def test_taste_of_opposites_is_zero_not_missing(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 1.0])], "id long, embedding array<float>")
    w = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "user_id long, poem_id long, weight double")
    got = {r.user_id: r.taste for r in R.taste_vector(w, p).collect()}
    assert got == {1: [0.0, 0.0]}
    near = R.taste_pool(p, [0.0, 0.0]).collect()
    assert [r.id for r in near] == [1, 2, 4] and all(r.dist != r.dist for r in near)


def test_picker_levels(spark):
    p = poems(spark)
    pick = lambda n, recent, pool=p: R.pick_diverse(pool, n, recent, "x").collect()
    name = {r.id: r.author for r in p.collect()}
    full = pick(10, None)
    assert {r.level for r in full} == {0} and len({name[r.id] for r in full}) == 10
    assert {r.level for r in pick(10, ["A1", None])} == {2} and {r.level for r in pick(12, None)} == {3}
    assert pick(0, None) == [] and pick(3, None, p.where("false")) == [] and len(pick(50, None)) == 30
    assert sorted(map(tuple, full)) == sorted(map(tuple, R.pick_diverse(p.repartition(7), 10, None, "x").collect()))


def test_split():
    assert [R.split_counts(n) for n in (1, 2, 5, 15)] == [(0, 1), (1, 1), (2, 3), (7, 8)]


def test_recommend_shows_nothing_seen(spark):
    p, rows = poems(spark), [(1, i, "like") for i in range(16)]
    small = R.Version(pool=6)
    for force in (False, True, None):
        got = R.recommend(p, log(spark, *rows), 1, 6, force_random=force, version=small).collect()
        assert [r.ord for r in got] == list(range(1, len(got) + 1)) and len(got) == 6 and all(r.id >= 16 for r in got)
    assert {r.slice for r in R.recommend(p, log(spark, *rows), 1, 6, version=small).collect()} == {0, 1}
    assert R.recommend(p, log(spark, *rows), 1, 6, short=False, medium=False, long=False).count() == 0
    with pytest.raises(PermissionError):
        R.recommend(p, log(spark, *rows), None)


def test_corpus_filter(spark):
    p = poems(spark, 9)
    n = lambda names: p.where(R.in_corpora(names)).count()
    assert [n(x) for x in (None, [], ["__null__"], ["c1", "__null__"], ["zz"], [None, "c1"])] == [9, 9, 3, 6, 0, 3]


def test_library(spark):
    rows = log(spark, (1, 1, "save"), (1, 2, "save"), (1, 1, "unsave"), (1, 3, "super_like"), (1, 4, "dislike"), (1, 4, "undislike"), (1, 5, "save"), (1, 99, "save"))
    assert [(r.pos, r.poem_id) for r in R.library(rows, poems(spark)).orderBy("pos").collect()] == [(1, 5), (2, 2)]
    assert [r.poem_id for r in R.skipped(rows).collect()] == [4] and R.skipped(rows, True).count() == 0
    assert R.saved_count(rows).first().n_saved == 3
    assert [r.id for r in R.by_ids(poems(spark), [9, 77, 2]).orderBy("ord").collect()] == [9, 2]
    assert R.unskip(rows, 1, 4).count() == 6 and R.migrate_reader(rows, 1, 8).select("user_id").distinct().first()[0] == 8
    assert R.toggle({"disliked": True}, "like") == ({"disliked": False, "liked": True}, ["undislike", "like"])
    assert R.corpus_filter_form(["a", "b"], ["b", "a"]) == [] and R.corpus_filter_form(["b"], ["a", "b"]) == ["b"]


def test_edges_and_components(spark):
    rows = spark.createDataFrame([(1, "x", "t", "a long first line"), (2, "x", "t", ""), (3, "x", "u", "a long first line"), (4, "y", "t", "short"), (5, "y", "v", "short")], "rid long, block string, title_norm string, first_line string")
    e = dedup.exact_edges(rows)
    assert sorted((r.a, r.b, r.kind) for r in e.collect()) == [(1, 2, "title"), (1, 3, "firstline")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.range(60).select(F.col("id").alias("rid"))
    assert {r.rid: r.comp for r in dedup.components(nodes, chain).collect()} == {i: 0 if i <= 40 else i for i in range(60)}


def test_fuzzy_edges_are_all_pairs_above(spark):
    import difflib
    import random

    rng, bodies = random.Random(1), []
    for _ in range(6):
        b = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90, 240)))
        bodies += [b, b[: len(b) - rng.randrange(0, 30)], "".join(c if rng.random() > 0.05 else "z" for c in b)]
    rows = spark.createDataFrame([(i, "x", b, "", "") for i, b in enumerate(bodies)], "rid long, block string, body_key string, title_norm string, first_line string")
    want = {(i, j) for i, j in itertools.combinations(range(len(bodies)), 2) if min(len(bodies[i]), len(bodies[j])) >= 100 and difflib.SequenceMatcher(None, bodies[i], bodies[j], autojunk=False).ratio() >= 0.85}
    assert {(r.a, r.b) for r in dedup.fuzzy_edges(rows).collect()} == want and want


def test_classes(spark):
    cols = "comp int, n_sources int, any_encore boolean, max_ratio double, any_title_first boolean, any_first_only boolean, confirmed boolean, keep_newer boolean"
    rows = [(1, 1, True, 0.99, True, False, False, False), (2, 2, True, 0.95, True, False, False, False), (3, 2, False, 0.5, False, True, False, False), (4, 2, False, 0.5, True, True, False, False), (5, 1, True, 0.0, True, False, True, False), (6, 1, False, 0.6, True, False, False, True)]
    assert [r.cls for r in dedup.classify(spark.createDataFrame(rows, cols)).orderBy("comp").collect()] == ["encore", "body_match", "not_dupe_firstline_only", "ambiguous", "fuzzy_confirmed", "keep_newer"]


def plain_classes(rows):
    """The reference's clusters and classes, pair by pair: (ids, class)."""
    from difflib import SequenceMatcher

    comp, pairs = {r[0]: r[0] for r in rows}, []
    for p, q in itertools.combinations(rows, 2):
        if p[1] != q[1]:
            continue
        x, y = p[5], q[5]
        sigs = ({"t"} if p[3] and p[3] == q[3] else set()) | ({"f"} if p[4] == q[4] and len(p[4]) > 10 else set())
        ratio = SequenceMatcher(None, x, y, autojunk=False).ratio()
        if not sigs and min(len(x), len(y)) >= 100 and ratio >= 0.85:
            sigs = {"b"}
        if sigs:
            pairs.append((p[0], sigs, ratio))
            old, new = comp[q[0]], comp[p[0]]
            comp = {k: new if c == old else c for k, c in comp.items()}
    out = set()
    for c in set(comp.values()):
        ids = sorted(i for i in comp if comp[i] == c)
        mine = [(s, r) for i, s, r in pairs if comp[i] == c]
        if len(ids) > 1:
            first_only, both = any("f" in s and "t" not in s for s, _ in mine), any({"t", "f"} <= s for s, _ in mine)
            out.add((tuple(ids), "body_match" if max(r for _, r in mine) >= 0.9 else "not_dupe_firstline_only" if first_only and not both else "ambiguous"))
    return out


def signal_rows():
    import random

    rng, rows = random.Random(4), []
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    for block in map(str, range(40)):
        body, other = text(200), text(200)
        for i in range(rng.randint(2, 5)):
            b = rng.choice([body, body, other, text(200)])
            cuts = set(rng.sample(range(200), rng.choice([0, 4, 15, 24, 35])))
            b = "".join("#" if j in cuts else c for j, c in enumerate(b))
            rows.append((len(rows), block, rng.choice("xy"), rng.choice(["", "t1", "t2", f"own {i}"]), rng.choice(["short", "a long first line", "another first line", f"first line of {i}"]), b))
    return rows


SIGNALS = "rid long, block string, source string, title_norm string, first_line string, body_key string"


def test_cluster_signals_are_those_of_the_pairs(spark):
    near = "a body of some fifty characters that was typed in"
    rows = [
        (1, "p", "x", "t", "a long first line", near), (2, "p", "y", "u", "a long first line", near.replace("fifty", "forty")),
        (3, "q", "x", "t", "a long first line", "abc" * 9), (4, "q", "x", "t", "a long first line", "xyz" * 9), (5, "q", "x", "u", "a long first line", "klm" * 9),
        (6, "r", "x", "t", "short", "abc" * 9), (7, "r", "x", "t", "short", "xyz" * 9), (8, "r", "x", "t", "short", "xyz" * 9 + "w"),
    ]
    for r, want in ((rows, {((1, 2), "body_match"), ((3, 4, 5), "ambiguous"), ((6, 7, 8), "body_match")}), (signal_rows(), None)):
        d = spark.createDataFrame(r, SIGNALS)
        exact, fuzzy = dedup.exact_edges(d), dedup.fuzzy_edges(d)
        comp = d.join(dedup.components(d.select("rid"), exact.select("a", "b").unionByName(fuzzy.select("a", "b"))), "rid")
        ids = {x.comp: tuple(sorted(x.ids)) for x in comp.groupBy("comp").agg(F.collect_list("rid").alias("ids")).collect()}
        got = {(ids[x.comp], x.cls) for x in dedup.classify(dedup.cluster_signals(comp, fuzzy)).collect()}
        assert got == plain_classes(r) and (want is None or got == want) and len({c for _, c in got}) > 1


def test_merge_takes_the_first_of_the_richest(spark):
    rows = spark.createDataFrame([(1, 1, "s1", "a", 1.0), (1, 2, "s2", "b", 2.0), (1, 3, "s3", "c", 2.0)], "comp int, rid long, source string, title string, score double")
    r = dedup.merge(rows).first()
    assert (r.winner, r.title, r.n, r.provenance) == (2, "b", 3, ["s1", "s2", "s3"])


def test_near_dup_longest(spark):
    base = "x" * 210
    rows = spark.createDataFrame([(1, base), (2, base + "yy"), (3, base + "zz"), (4, "s" * 49), (5, "s" * 49), (6, "p" * 50), (7, "p" * 50)], "rid long, body string")
    assert sorted(r.rid for r in dedup.near_dup_longest(rows).collect()) == [2, 4, 5, 6]


def test_containing(spark):
    probes = spark.createDataFrame([(1, "art two three four fi"), (2, "ab"), (3, "one two nine four five")], "probe_id long, probe string")
    texts = spark.createDataFrame([(1, "start two three four five"), (2, "x ab y"), (3, None)], "text_id long, body string")
    assert sorted(map(tuple, dedup.containing(probes, texts).collect())) == [(1, 1), (2, 2)]


def test_names(spark):
    rows = spark.createDataFrame([("A. Cole", "live"), ("Anna Cole", "x"), ("Anna Cole", "x"), ("Bo Cole", "x"), ("Bo Cole", "y"), ("Anna Cole.", "x"), ("Zed", "x")], "name string, source string")
    t = authors.name_table(rows).withColumn("rid", F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("name")).cast("long"))
    g = authors.group_names(t)
    groups = {frozenset(r.names) for r in g.groupBy("comp").agg(F.collect_set("name").alias("names")).collect()}
    assert groups == {frozenset({"A. Cole", "Anna Cole", "Anna Cole."}), frozenset({"Bo Cole"}), frozenset({"Zed"})}
    assert sorted(r.canonical for r in authors.canonical(g).collect()) == ["A. Cole", "Bo Cole", "Zed"]
    bridge = g.withColumn("comp", F.lit(1))
    s = authors.possible_splits(bridge).first()
    assert {s.name_a, s.name_b} == {"Anna Cole", "Bo Cole"}


def test_fuzzy_flags_find_all_pairs(spark):
    import random

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for x in a:
            cur = [prev[0] + 1]
            for j, y in enumerate(b):
                cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (x != y)))
            prev = cur
        return prev[-1]

    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(70)})
    rows = spark.createDataFrame([(i, n, n, n) for i, n in enumerate(names)], "rid long, name string, last_norm string, full string")
    want = {(i, j) for i, j in itertools.combinations(range(len(names)), 2) if lev(names[i], names[j]) <= 2 and 1 - lev(names[i], names[j]) / max(len(names[i]), len(names[j])) >= 0.5}
    assert {(r.a, r.b) for r in authors.fuzzy_flags(rows, 0.5).collect()} == want


def test_fuzzy_flags_compare_last_names_once(spark):
    rows = spark.createDataFrame([(i, f"{a} {last}", last, a + last) for i, (a, last) in enumerate(itertools.product(["ann", "anna", "bo", "zoe"], ["of", "to", "cole", "coles"]))], "rid long, name string, last_norm string, full string")
    pairs = authors.fuzzy_flags(rows, 0.75)
    got = {(r.a, r.b, r.name_a, r.name_b) for r in pairs.collect()}
    assert (2, 3, "ann cole", "ann coles") in got and (2, 7, "ann cole", "anna coles") in got and all(a < b for a, b, *_ in got)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "levenshtein(full" in plan.lower() and "bit_count" in plan.lower()


def test_first_words(spark):
    texts = ["", "  ", " one", "one\u2003two\n three", "a\x1cb c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.first_words(F.col("t"), 2)).collect()
    assert [r[0] for r in rows] == ["", "", "one", "one two", "a b", None]


def test_results(spark):
    ok = '{"custom_id":"%s","response":{"status_code":%d,"body":{"choices":[{"message":{"content":%s}}]}}}'
    good = '"{\\"mood\\":1,\\"emotional_intensity\\":2,\\"imagery\\":3,\\"accessibility\\":4,\\"formality\\":5,\\"summary\\":\\"s\\"}"'
    lines = [ok % ("a", 200, good), ok % ("a", 500, '"x"'), ok % ("b", 500, '"x"'), ok % ("b", 200, good), "broken", "", ok % ("c", 200, '"{nope"'), ok % ("d", 200, '"{\\"mood\\":1}"'), ok % ("e", 200, good.replace("5", "50"))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n long, value string")
    r = enrich.parse_results(df, order="n")
    err = {x.custom_id: x.e for x in r.select("custom_id", enrich.rubric_error(F.col("status"), F.col("content")).alias("e")).collect()}
    assert err == {"a": "status", "b": None, "c": "parse", "d": "missing", "e": "range"}
    rows = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert [x.content is not None for x in enrich.join_results(rows, r, "id").orderBy("id").collect()] == [False, True, False]
    report = enrich.completeness(rows, results=(r, "custom_id"))
    assert report.first().n_missing == 1
    with pytest.raises(ValueError):
        enrich.require_complete(report)
    v = enrich.verify_results(r, 2).first()
    assert (v.n, v.ok, v.errors) == (5, 4, 1)


def test_calls_retry(spark):
    def client(p):
        if p == "bad":
            raise RuntimeError("no")
        return p.upper()

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, p string")
    assert [tuple(r) for r in enrich.call_each(rows, client, "id", "p", attempts=3).orderBy("id").collect()] == [(1, True, "OK", 1), (2, False, "no", 3)]


def test_table_changes(spark):
    t = spark.createDataFrame([("poem_9999", "a"), ("poem_18426", None), ("x", "b")], "id string, v string")
    assert t.agg(F.max(tables.numeric_suffix(F.col("id")))).first()[0] == 18426
    new = tables.assign_ids(t, spark.createDataFrame([(i,) for i in (5, 3, 9)], "k long"), "k").orderBy("k").collect()
    assert [r.id for r in new] == ["poem_18427", "poem_18428", "poem_18429"]
    b = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("y", "3", 1)], "id string, v string, n int")
    assert sorted((r.id, r.v) for r in tables.upsert(t, b, "id", "n").where("id in ('x', 'y')").collect()) == [("x", "2"), ("y", "3")]
    assert tables.insert_ignore(t, b.drop("n").where("id = 'y'")).count() == 4
    out, n = tables.update_distinct(t, F.lit("a"), "v")
    assert n.first()[0] == 2 and {r.v for r in out.collect()} == {"a"}
    assert {r.v for r in tables.sparse_update(t, spark.createDataFrame([("x", "z")], "id string, v string")).collect()} == {"a", None, "z"}
    left = tables.delete_where(t, F.col("v") == "b", (b, "id"))
    assert left[0].count() == 2 and [r.id for r in left[1].collect()] == ["y"]
    assert {r.v for r in tables.rename(t, "v", {"a": "b"}).collect()} == {"b", None}
    assert tables.markdown_rows(t.where("id = 'x'")).first().line == "| x | b |"


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "t": "x"}, {"id": 2}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "id long, t string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\nbroken{\n{"id": 2}\n')
    assert sorted(r.id for r in readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id long").collect()) == [1, 2]
    (tmp_path / "c.csv").write_text('id,t\n1,"two\nlines ""q"""\n')
    assert readers.csv(spark, str(tmp_path / "c.csv")).first().t == 'two\nlines "q"'
    (tmp_path / "d.yaml").write_text('groups:\n  - canonical: "Ann \\"A\\" Lee"\n    confirmed: true\n    variants:\n      - name: A. Lee\n        count: 2\n      - name: "Ann \\"A\\" Lee"\n  - canonical: B\n    confirmed: false\n    variants:\n      - name: Bee\n')
    sheet = readers.review_sheet(spark, str(tmp_path / "d.yaml"))
    assert sheet.count() == 3 and [tuple(r) for r in readers.variant_map(sheet).collect()] == [("A. Lee", 'Ann "A" Lee')]
    tables.write_json(sheet, str(tmp_path / "out"))
    tables.write_csv(sheet, str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3 and readers.csv(spark, str(tmp_path / "csv")).count() == 3
    page = spark.createDataFrame([('<loc> http://a/1 </loc><loc>http://a/1</loc><a href="/2020/x.shtml"></a><a href="/2021/y.shtml"></a><a href="/2020/x.shtml"></a><a href="/2020/about.shtml">',)], "html string")
    assert [r.url for r in readers.sitemap_urls(page).collect()] == ["http://a/1"]
    assert [r.url for r in readers.archive_links(page, "http://h").orderBy("pos").collect()] == ["http://h/2020/x.shtml", "http://h/2021/y.shtml"]
    snaps = spark.createDataFrame([("http://h/2020/x.shtml", "20200101000000"), ("http://h/2020/x.shtml", "20210101000000"), ("http://h/about.shtml", "2")], "url string, timestamp string")
    assert [tuple(r) for r in readers.latest_snapshots(snaps).collect()] == [("http://h/2020/x.shtml", "20210101000000")]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert [tuple(r) for r in readers.reachable(links, spark.createDataFrame([("a",)], "url string")).collect()] == [("a", 0), ("b", 1), ("c", 2)]
    people = readers.author_rows(("s", spark.createDataFrame([("A  B", True), (" ", True), ("C", False)], "name string, has_poem boolean")))
    assert [tuple(r) for r in people.collect()] == [("A B", "s")]


def test_pages(spark):
    rows = [(1, "u", "<html><head><title>T | Site</title></head><body><article><h1>The <b>Sea</b></h1><p>one<br>two &amp; three</p><p><i>four</i></p></article></body></html>"), (2, "u", '<meta content="Og" property="og:title"><div>no</div>'), (3, "u", "<article><img src=x></article>"), (4, "u", None)]
    got = {r.page_id: r for r in pages.records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].title, got[1].body, got[1].has_text) == ("The Sea", "one\ntwo & three\n\nfour", True)
    assert (got[2].title, got[2].drop_reason, got[3].drop_reason, got[4].has_text) == ("Og", "no block", "image only", False)
    posts = spark.createDataFrame([(7, "s", "<blockquote><h5><strong>T</strong> <em>P</em></h5>a<br>b</blockquote><blockquote>note</blockquote><blockquote><h5><em>P</em><strong>T</strong></h5>c</blockquote>"), (8, "s", "none")], "post_id long, slug string, html string")
    assert [(r.id, r.body) for r in pages.quote_rows(posts).orderBy("id").collect()] == [("7-A", "a\nb"), ("7-B", "c")]
    c = spark.createDataFrame([("<p>From <i>Book</i> published by Good House. Copyright © 2012 by X</p>",)], "h string").select(pages.credits(F.col("h")).alias("c")).first().c
    assert (c.year, c.book, c.journal, c.publisher) == ("2012", "Book", "", "Good House")
    assert pages.is_announcement(F.lit("x"), F.lit("y")) is not None


def test_curation(spark):
    p = poems(spark).withColumn("rid", F.col("id"))
    assert {r.k for r in curate.cap_per_author(p, 2).collect()} == {1, 2}
    listed = spark.createDataFrame([("A1", "t1"), ("A2", "zzz")], "author string, listed string")
    assert [tuple(r) for r in curate.title_matches(p, listed).where("score = 100").collect()] == [(1, 100.0)]
    rows = spark.createDataFrame([("podcast", "by X\n\ncafÃ© x"), ("other", "by X\ntext")], "source string, body string")
    assert [(r.body, r.changes) for r in curate.clean_b(rows).orderBy("source").collect()] == [("by X\ntext", []), ("café x", ["encoding", "byline"])]
    chained = curate.clean_a(spark.createDataFrame([("T [1]", "A", "x`y"), (None, "A", "x"), ("T", "A", "p" * 1200)], "title string, author string, body string")).collect()
    assert [tuple(r) for r in chained] == [("T", "A", "x'y")]


def test_bilingual(spark):
    cols = "group_id string, url string, title string, translator string, body string"
    rows = [("1-A", "u1", "orig", "", "éééé"), ("1-B", "u1", "eng", "Translated by X", "plain"), ("2-A", "u2", "a", "", "x"), ("2-B", "u2", "b", "", "y"), ("3-A", "u3", "en", "", "plain"), ("3-B", "u3", "es", "Translated by Z", "ñéñé"), ("4-A", "u4", "m", "Translated by A", "x"), ("4-B", "u4", "n", "Translated by B", "x")]
    t = spark.createDataFrame(rows, cols)
    d = curate.bilingual_decisions(t)
    assert sorted((r.url, r.drop_all, r.keep_title) for r in d.collect()) == [("u1", False, "eng"), ("u2", True, None), ("u3", False, "en")]
    assert sorted(r.title for r in curate.bilingual_filter(t, d).collect()) == ["en", "eng", "m", "n"]


def test_plans(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nb\n\nc", "strict"), (2, "a\nb\nc", "a\n\nb\nc", "near"), (3, "a", "z", "ratio")], "id long, stored string, fetched string, grade string")
    plan = repair.stanza_plan(rows)
    assert [(r.path, r.new_body, r.skipped) for r in plan.orderBy("id").collect()] == [("overwrite", "a\nb\n\nc", False), ("transplant", "a\n\nb\nc", False), ("none", None, True)]
    p = rows.select("id", F.col("stored").alias("body"), F.lit(9).alias("line_count"))
    assert [(r.body, r.line_count) for r in repair.apply_plan(p, plan).orderBy("id").collect()] == [("a\nb\n\nc", 3), ("a\n\nb\nc", 3), ("a", 9)]
    poems_ = spark.createDataFrame([(1, "A", "x y"), (2, "A", "q"), (3, "A", "q"), (4, "B", "w"), (5, "C", "n")], "id long, author string, body string")
    parsed = spark.createDataFrame([("a", "X  Y", "<p>1"), ("A", "q", "<p>2"), ("B", "w", "<p>3"), ("b", "W", "<p>4"), ("A", "xy", "<p>1")], "author string, body string, html string")
    assert {r.id: (r.html, r.status) for r in repair.backfill(poems_, parsed).collect()} == {1: ("<p>1", "one"), 2: (None, "ambiguous"), 3: (None, "ambiguous"), 4: (None, "conflict"), 5: (None, "none")}
    tries = spark.createDataFrame([(1, 0, "near", 0.9), (1, 1, "strict", 0.95), (1, 2, "strict", 0.99)], "id long, source_ord int, grade string, ratio double")
    assert repair.best_attempt(tries).first().source_ord == 1


def test_stream_state(spark, tmp_path):
    rows = log(spark, (1, 1, "save"), (1, 1, "unsave"), (1, 2, "like"))
    rows.write.parquet(str(tmp_path / "log"))
    q = reactions.start(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), "state_now", str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("state_now").collect())) == sorted(map(tuple, R.reaction_state(rows).collect()))


def test_text_guards(spark):
    df = spark.createDataFrame([("a\x93b", "a“b"), ("a\x93b", "c“b")], "x string, y string")
    assert [r[0] for r in df.select(T.only_c1_changed(F.col("x"), F.col("y"))).collect()] == [True, False]


def test_near_pairs_lose_none_and_settle_most():
    import random

    from stanzaflow.functions import similarity as S

    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(80)]
    a = ["".join(rng.choice(words) for _ in range(rng.randrange(25, 60))) for _ in range(30)]
    b = [x[:k] + "zq" * 5 + x[k + 8 :] for x in a[:10] for k in (20, 60)] + ["".join(rng.choice(words) for _ in range(40)) for _ in range(30)] + ["", a[0]]
    got = set(S.near_pairs(a, b, 0.85))
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if S._ratio(x, y) >= 0.85}
    assert want <= got and len(got) <= len(want) + 10 and len(want) > 15
    assert S._SideBySide(b).subsequences(a[3]).tolist() == [S._subsequence(a[3], y) for y in b]


def test_fuzzy_edges_form_no_row_for_each_pair(spark):
    """Bodies meet inside tiles, not in a join of rows."""
    rows = spark.createDataFrame([(i, "k", "x" * 150 + str(i), f"t{i}", "") for i in range(4)], "rid long, block string, body_key string, title_norm string, first_line string")
    plan = dedup.fuzzy_edges(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "ArrowEvalPython" not in plan


def test_title_matches_form_no_row_for_each_pair(spark, monkeypatch):
    from stanzaflow.functions import similarity as S

    rows = spark.createDataFrame([(i, f"A{i % 2}", ["The Sea at Night", "Night, the sea at", "Other", "", None][i % 5]) for i in range(20)], "rid long, author string, title string")
    listed = spark.createDataFrame([("A0", "the sea at night"), ("A0", "Sea"), ("A1", ""), ("A2", "Other")], "author string, listed string")
    found = curate.title_matches(rows, listed)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = rows.join(listed, "author").select("rid", S.token_sort_ratio(T.match_title(F.col("title")), T.match_title(F.col("listed"))).alias("score"))
    want = {(r.rid, r.score) for r in pairs.groupBy("rid").agg(F.max("score").alias("score")).where("score >= 85").collect()}
    assert {(r.rid, r.score) for r in found.collect()} == want and len(want) > 4
    monkeypatch.setattr(curate, "TITLES", 1)
    assert {(r.rid, r.score) for r in curate.title_matches(rows, listed).collect()} == want


def test_near_pairs_go_by_where_blocks_lie(monkeypatch):
    """Strings whose longest block lies far apart aren't compared character by character."""
    import random

    from stanzaflow.functions import similarity as S

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("aaabbcdefghijk") for _ in range(n))
    line = "kjihgfedcbakjihgfedcba"
    a, b = [line + text(400) for _ in range(12)], [text(400) + line for _ in range(12)]
    monkeypatch.setattr(S._Lanes, "subsequences", lambda *_: pytest.fail("compared"))
    assert list(S.near_pairs(a, b, 0.85)) == []


def test_near_pairs_of_odd_strings_and_of_a_list_with_itself():
    import random

    from stanzaflow.functions import similarity as S

    rng = random.Random(7)
    base = ["".join(chr(rng.randrange(40, 400)) for _ in range(rng.randrange(1, 90))) for _ in range(12)] + ["x" * n for n in (1, 7, 60, 64, 65)] + ["", "\ud83d" * 9, "ab" * 40, "ba" * 40]
    texts = base + [x[1:] + "é" for x in base] + [x + x[:3] for x in base] + base[:3]
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if max(S._ratio(x, y), S._ratio(y, x)) >= 0.85}
    assert want <= set(S.near_pairs(texts, texts, 0.85))
    assert {(i, j) for i, j in want if i < j} <= set(own := list(S.near_pairs(texts, texts, 0.85, True))) and all(i < j for i, j in own)
    assert list(S.near_pairs([], ["a"], 0.85)) == list(S.near_pairs(["a"], [], 0.85)) == []


def test_bodies_of_one_band_meet_once(spark, monkeypatch):
    rng = __import__("random").Random(3)
    bodies = ["".join(rng.choice("abcdefgh") for _ in range(120)) for _ in range(30)]
    bodies += [b[:60] + "z" + b[61:] for b in bodies]
    rows = spark.createDataFrame([(i, "k", b, "", "") for i, b in enumerate(bodies)], "rid long, block string, body_key string, title_norm string, first_line string")
    for tile in (1 << 21, 1000):
        monkeypatch.setattr(dedup, "TILE", tile)
        got = [(r.a, r.b) for r in dedup.fuzzy_edges(rows).collect()]
        assert sorted(got) == [(i, i + 30) for i in range(30)]


def test_longest_blocks_by_pieces_are_those_of_the_automaton(monkeypatch):
    import difflib
    import random

    from stanzaflow.functions import similarity as S

    rng, found = random.Random(9), 0
    for k in range(150):
        letters = "ab" if k % 3 == 0 else "abcdefghij"
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 500)))
        parts = [x[i : i + rng.randrange(1, 90)] for i in range(0, len(x), 40)]
        y = "".join(rng.choice([p, p, p + "z", p[::-1]]) for p in parts) + x[: k % 50]
        x, y = (x * 3, x * 2) if k % 10 == 0 else (x, y)
        got = S._longest(x, y)
        found += got is not None
        assert got in (None, S._Automaton(y).longest(x))
        m = difflib.SequenceMatcher(None, x, y, autojunk=False)
        assert S._matched(x, y) == sum(b.size for b in m.get_matching_blocks())
    assert found > 90
    # near copies are settled without an automaton
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))
    monkeypatch.setattr(S, "_Automaton", lambda *_: pytest.fail("an automaton is made"))
    other = text[:700] + "-" + text[701:1500] + text[1510:2400] + "--" + text[2400:]
    assert S._matched(text, other) == 3000 - 1 - 10
