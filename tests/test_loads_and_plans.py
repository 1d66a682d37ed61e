"""Chains of results, loading, cleaning, selection, lists and repairs against plain Python."""

import html
import json
import random

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import authors, curate, dedup, enrich
from stanzaflow.plans import repair
from stanzaflow.sources import readers, tables


def test_short_probes_by_pieces(spark, monkeypatch):
    rng = random.Random(3)
    words = ["averyverylongword", "anotherlongword", "é-ß-😀-unusual", "shorter", "ab"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, ""]
    probes = [t[k : k + rng.randrange(19, 60)] for t in texts if t for k in rng.sample(range(len(t)), min(3, len(t)))] + ["notthere" * 4, "averyverylongword x"]
    probes = [p for p in probes if len(p) >= 19]
    monkeypatch.setattr(dedup, "SMALL", 0)
    got = dedup.containing(spark.createDataFrame(list(enumerate(probes)), "probe_id long, probe string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, body string")).collect()
    want = [(i, j) for i, p in enumerate(probes) for j, t in enumerate(texts) if t is not None and p in t]
    assert any(len(p.split()) < 5 for p in probes) and sorted(map(tuple, got)) == sorted(want) and want
    with pytest.raises(ValueError, match="fewer than five words and 19"):
        dedup.containing(spark.createDataFrame([(0, "ab")], "probe_id long, probe string"), spark.createDataFrame([(0, "ab")], "text_id long, body string"))


def test_probes_and_spellings(spark):
    lines = ["short", "a plain line of some length", "the longest line of all of them, but it has “quotes”", "  another plain line, the longest of these  ", "a plain line of same lengtH"]
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.probes(F.col("t"))).collect()]
    assert got == [[lines[3].strip(), lines[1], lines[4], lines[2]], None, []]
    line = "it's \"A & B\" — done…"
    (said,) = spark.createDataFrame([(line,)], "t string").select(T.spellings(F.col("t"))).first()
    assert said[0] == line and said[-1] == html.escape(line) and len(set(said)) == len(said)
    assert {line.replace("'", "’"), line.replace("'", "&#39;"), line.replace("&", "&amp;"), line.replace("—", "&#8212;"), line.replace("…", "..."), line.replace('"', "&quot;")} <= set(said)
    assert spark.createDataFrame([("plain",)], "t string").select(T.spellings(F.col("t"))).first()[0] == ["plain"]


def _results(spark):
    good = {"mood": 3, "emotional_intensity": 1, "imagery": 2, "accessibility": 4, "formality": 5, "summary": "said"}
    chat = lambda i, c, status=200: json.dumps({"custom_id": i, "response": {"status_code": status, "body": {"choices": [{"message": {"content": c}}]}}})
    vector = lambda i, v, status=200: json.dumps({"custom_id": i, "response": {"status_code": status, "body": {"data": [{"embedding": v}]}}})
    lacks = json.dumps({k: v for k, v in good.items() if k not in ("mood", "summary")})
    chats = [chat("a", "{", 200), chat("a", json.dumps(good)), chat("b", lacks), chat("c", "x", 500), chat("d", "no json"), chat("e", json.dumps(good | {"mood": 99})), "not a line"]
    vectors = [vector("a", [1.0, 2.0]), vector("b", [1.0]), vector("c", [], 500), vector("e", [3.0, 4.0])]
    lines = lambda x: enrich.parse_results(spark.createDataFrame(list(enumerate(x)), "ord int, value string"), order="ord")
    return lines(chats), lines(vectors)


def test_merged_results(spark):
    rows = spark.createDataFrame([(i, n) for n, i in enumerate("abcdef")], "id string, n int")
    got = {r.id: r for r in enrich.merge_results(rows, *_results(spark), width=2).collect()}
    assert {i: (r.score_error, r.vector_error) for i, r in got.items()} == {"a": (None, None), "b": ("missing", "width"), "c": ("status", "status"), "d": ("parse", "absent"), "e": ("range", None), "f": ("absent", "absent")}
    assert got["a"].rubric.mood == 3 and got["a"].summary == "said" and got["b"].rubric.mood is None and got["b"].summary == "" and got["c"].rubric is got["d"].rubric is got["f"].rubric is None
    assert got["e"].rubric.mood == 99 and got["b"].embedding == [1.0] and got["c"].embedding is got["d"].embedding is None


def test_a_load_is_whole_or_not_at_all(spark):
    rows = spark.createDataFrame([(f"w{i}", i, f"t{i}", "A", "x\n\ny", "  ") for i in range(4)], "id string, i int, title string, author string, body string, corpus string")
    good = F.struct(*[F.lit(k).alias(c) for k, c in enumerate(enrich.SCORES)])
    merged = rows.withColumns({"rubric": good, "summary": F.lit(" "), "embedding": F.array(F.lit(1.0))}).drop("id")
    there = spark.createDataFrame([("poem_0009", "old", 1, "c", 5), ("poem_0012", "old", 1, "c", 5)], "id string, title string, line_count int, corpus string, mood int")
    with pytest.raises(ValueError, match="2 scores are missing, 1 vectors are missing"):
        enrich.load_batch(there, merged.withColumn("rubric", F.when(F.col("i") > 1, F.col("rubric"))).withColumn("embedding", F.when(F.col("i") != 3, F.col("embedding"))), "i")
    first = enrich.load_batch(there, merged, "i")
    assert sorted(map(tuple, first.collect()))[2:] == [(f"poem_{13 + i:04d}", f"t{i}", 2, None, 0) for i in range(4)]
    broken_off = first.where("id not in ('poem_0014', 'poem_0015')")
    assert sorted(map(tuple, enrich.load_batch(broken_off, merged, "i", again=True).collect())) == sorted(map(tuple, first.collect()))
    assert enrich.load_batch(first, merged, "i", again=True).count() == first.count()
    none = there.where("false")
    assert enrich.load_batch(none, merged, "i").agg(F.min("id")).first()[0] == "poem_0001" and enrich.load_batch(there, merged.where("false"), "i").count() == 2


def test_records_of_three_kinds(spark):
    plain = spark.createDataFrame([("1", "T", "A", "x\n \ny"), ("2", "T", "A", None)], "id string, Title string, Author string, text string")
    assert [tuple(r) for r in enrich.table_rows(plain, "plain").orderBy("id").collect()] == [("1", "T", "A", "x\n \ny", 2), ("2", "T", "A", None, 0)]
    rubric = F.struct(*[F.lit(k).alias(c) for k, c in enumerate(enrich.SCORES)])
    sourced = spark.createDataFrame([("1", "T", "A", "x", " VerseDaily ", "  ", " "), ("2", "T", "A", "x", None, " By X", "s")], "id string, title string, author string, poem_text string, primary_source string, translator string, summary string")
    got = enrich.table_rows(sourced.withColumns({"rubric": rubric, "embedding": F.array(F.lit(1.0))}), "sourced", F.lit("2030-01-01").cast("timestamp")).orderBy("id").collect()
    assert [(r.corpus, r.translator, r.summary, r.mood, r.formality, r.enriched_at.year) for r in got] == [("versedaily", "", None, 0, 4, 2030), (None, "By X", "s", 0, 4, 2030)]


def test_first_cleaning_keeps_an_account(spark):
    long, prose = "a line of some length " * 12 + "\nand more", "word " * 300
    rows = [(1, "T [2]", "A", "(Edited by a friend)\n\n" + long), (2, "T", "A", long + " of it"), (3, "T", "A", long.upper()), (4, None, "A", long), (5, "T", " ", long), (6, "T", "A", prose), (7, "T", "A", prose + "x"), (8, "T", "A", "a`b\xa0c"), (9, "T", "A", "short"), (10, "T", "A", "short"), (11, "T", "A", None)]
    got = {r.rid: r for r in curate.clean_first(spark.createDataFrame(rows, "rid long, title string, author string, body string")).collect()}
    assert {i: r.removed for i, r in got.items()} == {1: "duplicate", 2: None, 3: "duplicate", 4: "missing", 5: "missing", 6: "duplicate", 7: "prose", 8: None, 9: None, 10: None, 11: "missing"}
    assert (got[1].title, got[1].body, got[1].changes) == ("T", long, ["editor", "footnote"]) and (got[8].body, got[8].changes) == ("a'b c", ["marks"]) and got[2].changes == [] and got[4].body == long


def test_selection_with_overrides(spark):
    rng = random.Random(1)
    words = ["the", "sea", "of", "night", "song", "winter", "(road)"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    rows = [(i, rng.choice("ABCD"), title(), "x" * rng.randrange(0, 3000), rng.randrange(0, 60)) for i in range(600)]
    listed, instead = [(a, title()) for a in "ABCC" for _ in range(4)], [("A", title()), ("A", "The  Sea!"), ("D", title())]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def score(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        return 200.0 * common(a, b) / (len(a) + len(b))

    key = lambda t: t.strip().rstrip(".,!?;:").strip().lower()
    lists = {}
    for a, t in [x for x in listed if x[0] != "A"] + instead:
        lists.setdefault(a, []).append(key(t))
    lists.pop("B", None)
    want = {}
    for a, titles in lists.items():
        found = []
        for i, author, t, body, n in rows:
            best = max(score(key(t), x) for x in titles)
            if author == a and best >= 85:
                found.append((0 if key(t) in titles else 1, -best, [0, 1, 3, 2, 1][sum(n >= x for x in (5, 10, 36, 46))] * -1, [0, 1, 3, 2][sum(len(body) >= x for x in (150, 400, 2000))] * -1, i))
        want |= {e[-1]: (k + 1, len(found), e[0] == 0, round(-e[1], 6)) for k, e in enumerate(sorted(found)[:3])}
    frame = lambda x: spark.createDataFrame(x, "author string, listed string")
    out = curate.finalise(spark.createDataFrame(rows, "rid long, author string, title string, body string, line_count int"), frame(listed), frame(instead), ("B",), cap=3)
    got = {r.rid: (r.k, r.n_matched, r.exact, round(r.score, 6)) for r in out.collect()}
    assert got == want and len(want) > 5


def test_rolled_up_list_and_its_files(spark, tmp_path):
    rows = [("Zed  Ade", "x"), ("Zed Ade", "x"), ("Zed Ade", "y"), ("Z. Ade", "y"), ("Bo Cy, translated by Q", "x"), (" ", "x"), (None, "y"), ("Al | Ba", "other")]
    variants = spark.createDataFrame([("Z. Ade", "Zed Ade")], "variant string, canonical string")
    out = authors.roll_up(spark.createDataFrame(rows, "name string, source string"), variants, {"y": "Why", "x": "Ex"})
    assert sorted(map(tuple, out.collect())) == [(1, "Zed Ade", 4, 2, 2, "Why (2), Ex (2)"), (2, "Al | Ba", 1, None, None, ""), (3, "Bo Cy", 1, None, 1, "Ex (1)")]
    tables.write_listing(out, "number", str(tmp_path))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.splitlines() == ["| number | name | total | y | x | sources |", "|---|---|---|---|---|---|", "| 1 | Zed Ade | 4 | 2 | 2 | Why (2), Ex (2) |", "| 2 | Al \\| Ba | 1 |  |  |  |", "| 3 | Bo Cy | 1 |  | 1 | Ex (1) |"]
    back = readers.csv(spark, str(tmp_path / "csv"), "number long, name string, total long, y long, x long, sources string")
    assert [r.name for r in back.orderBy("number").collect()] == ["Zed Ade", "Al | Ba", "Bo Cy"]


def test_saved_scopes_by_file(spark, tmp_path):
    kinds = {"p1": "FOUND_WITH_STANZAS", "p2": "FOUND_NEAR_WITH_STANZAS", "p3": "FOUND_NO_STANZAS", "p4": "FOUND_WITH_STANZAS", "p5": "FOUND_WITH_STANZAS", "p6": "FOUND_WITH_STANZAS", "p7": "FOUND_WITH_STANZAS"}
    for name, kind in kinds.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, "category": kind, "fetched_body": None if name == "p6" else "a\n\nb"}, indent=1))
    (tmp_path / "notes.txt").write_text("no json")
    cache = readers.json_by_file(spark, str(tmp_path), "id string, category string, fetched_body string")
    assert sorted(map(tuple, cache.select("file_id", "id").collect())) == [(n, n) for n in kinds]
    two = readers.json_by_file(spark, str(tmp_path), "id string, category string, fetched_body string", ["p2", "p3", "none"])
    assert sorted(r.file_id for r in two.collect()) == ["p2", "p3"]
    (tmp_path / "p1.json").write_bytes(b"\xff{broken")  # not opened
    assert sorted(r.category for r in two.collect()) == ["FOUND_NEAR_WITH_STANZAS", "FOUND_NO_STANZAS"]
    (tmp_path / "p1.json").write_text(json.dumps({"id": "p1", "category": kinds["p1"], "fetched_body": "a\n\nb"}))
    poems = spark.createDataFrame([("p1", "a\nb", None), ("p2", "a\nb", None), ("p3", "a", None), ("p4", "a\n\nb", None), ("p5", "a\nb", "src"), ("p6", "a\nb", None)], "id string, body string, corpus string")
    got = repair.saved_scopes(cache, poems)
    assert {r.id: (r.grade, r.skipped) for r in got.collect()} == {"p1": ("strict", None), "p2": ("near", None), "p4": ("strict", "has stanza breaks"), "p5": ("strict", "corpus src"), "p6": ("strict", "no text")}
    assert {r.id: r.new_body for r in repair.stanza_plan(got.where("skipped is null")).collect()} == {"p1": "a\n\nb", "p2": "a\n\nb"}


def test_scopes_prefer_strict_then_the_best_near(spark):
    tries = [
        (1, 0, 0, "near", 0.9, True), (1, 0, 1, "strict", 0.93, False), (1, 1, 0, "strict", 0.99, True),  # the first strict one
        (2, 0, 0, "near", 0.6, False), (2, 2, 0, "near", 0.9004, True), (2, 1, 0, "near", 0.9001, False),  # the largest near ratio, unrounded
        (3, 0, 0, "ratio", 0.3, False), (3, 1, 0, "line-count", 0.3004, True), (3, 2, 0, "ratio", 0.1, False),  # equal when rounded: the first
        (4, 0, 0, "empty", None, None), (9, 0, 0, "strict", 1.0, True),
    ]
    rows = [(i, s, o, f"s{s}", f"r{s}{o}", 0 if g == "empty" else 5, r, g, b) for i, s, o, g, r, b in tries]
    attempts = spark.createDataFrame(rows, "id long, source_ord int, ord int, source string, ref string, n_fetched int, ratio double, grade string, has_breaks boolean")
    got = {r.id: tuple(r)[1:] for r in repair.scope(spark.range(1, 6), attempts).collect()}
    assert got == {1: ("FOUND_NO_STANZAS", "s0", "r01", ""), 2: ("FOUND_NEAR_WITH_STANZAS", "s2", "r20", ""), 3: ("FOUND_MISMATCH", None, None, "best s0 ratio 0.300 (ratio)"), 4: ("NOT_FOUND", None, None, ""), 5: ("NOT_FOUND", None, None, "")}


def test_reparsed_bodies(spark):
    def body(i, n):
        return [f"line {k} of the text number {i}, it’s — long" for k in range(n)]

    page = lambda stanzas: "<p>" + "</p><p>".join("<br>".join(html.escape(x).replace("—", "&#8212;") for x in s) for s in stanzas) + "</p>"
    a, b, c, d = body(1, 6), body(2, 6), body(3, 6), body(4, 10)
    entries = [(10, page([a[:3], a[3:]])), (11, page([a])), (12, page([[x] for x in b])), (13, "<div>" + c[0].replace("’", "&#8217;").replace("—", "-") + "</div>" + html.escape(c[4])), (14, page([d[:2], d[2:4]])), (15, None)]
    parse = lambda x: F.when(F.contains(x, F.lit("<p>")), F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.replace(x, F.lit("&#8212;"), F.lit("—")), F.lit("<br>"), F.lit("\n")), F.lit("</p>"), F.lit("\n\n")), "<[^>]+>", ""), r"\n+$", ""))
    poems = [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(c)), (4, "\n".join(d)), (5, "none of these lines is on any page"), (6, None), (7, "short"), (8, "\n".join(a))]
    plan = repair.reparse_plan(spark.createDataFrame(poems, "id long, body string"), spark.createDataFrame(entries, "pos long, html string"), parse).collect()
    got = {r.id: (r.pos, r.status, r.flags, r.gained, r.skipped) for r in plan}
    assert got[1] == got[8] == (10, "ok", [], True, False)
    assert got[2] == (12, "flagged", ["too-many-stanzas"], True, True) and got[3] == (13, "unparsed", None, None, True) and got[4] == (14, "flagged", ["line-drift"], True, True)
    assert [got[i] for i in (5, 6, 7)] == [(None, "missed", None, None, True)] * 3
    rows = spark.createDataFrame([(i, t, 0) for i, t in poems], "id long, body string, line_count int")
    made = repair.reparse_plan(rows, spark.createDataFrame(entries, "pos long, html string"), parse)
    new = {r.id: (r.body, r.line_count) for r in repair.apply_plan(rows, made).collect()}
    assert new[1] == ("\n".join(a[:3]) + "\n\n" + "\n".join(a[3:]), 6) and new[2] == ("\n".join(b), 0)


def test_markup_of_several_sources(spark):
    poems = spark.createDataFrame([(1, "A", "x y"), (2, "A", "q"), (3, "B", "w"), (4, "B", "none")], "id long, author string, body string")
    frame = lambda rows: spark.createDataFrame(rows, "author string, body string, html string")
    got = repair.backfill_chain(poems, [frame([("a", "xy", "<1>"), ("a", "XY", "<1>"), ("B", "w", "<3>")]), frame([("A", "X Y", "<1>"), ("b", "w", "<other>"), ("A", "q", "<2>")])])
    assert {r.id: (r.html, r.status, r.n_sources) for r in got.collect()} == {1: ("<1>", "one", 2), 2: ("<2>", "one", 1), 3: (None, "conflict", 2), 4: (None, "none", 0)}


def test_numbers_of_rows_beyond_the_sample(spark):
    n = 40_000
    rows = spark.range(n, numPartitions=8).select("id", F.struct((F.col("id") * 7919 % 10_007).alias("k"), "id").alias("by"), F.lit("x").alias("rest"))
    got = tables.numbered_rows(rows, "by", "place").select("id", "place").collect()
    order = sorted(range(n), key=lambda i: (i * 7919 % 10_007, i))
    assert {r["id"]: r["place"] for r in got} == {i: k + 1 for k, i in enumerate(order)}


def test_backfill_shuffles_no_bodies(spark):
    body = "Ein Vers, der lang ist. " * 50
    poems = spark.createDataFrame([(1, "A", body), (2, "B", None), (3, "A", "x")], "id long, author string, body string")
    source = spark.createDataFrame([(" a", body.upper(), "<p>1"), ("B", None, "<p>2")], "author string, body string, html string")
    out = repair.backfill_chain(poems, [source, source])
    assert sorted(map(tuple, out.select("id", "html", "status", "n_sources").collect())) == [(1, "<p>1", "one", 2), (3, None, "none", 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan and "regexp_replace(lower(body" not in plan.replace("sha2(cast(regexp_replace(lower(body", "")


def test_lines_to_look_poems_up_by_are_picked_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(body):
        calls.add(1)
        return body

    line = "the quiet river number {} carries the evening home"
    poems = spark.createDataFrame([(i, f"{line.format(i)}\nshort") for i in range(40)], "id long, body string")
    entries = spark.createDataFrame([(100 + i, f"<p>so {line.format(i)} again</p>") for i in range(30)], "pos long, html string")
    found = repair.found_entries(poems.select("id", counted("body").alias("body")), entries)
    assert {(r["id"], r["pos"]) for r in found.collect()} == {(i, 100 + i) for i in range(30)}
    assert 40 <= calls.value <= 80
