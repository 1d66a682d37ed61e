"""The corpus pipeline against a plain version of its rules."""

import hashlib
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from test_llm import DOCS, brute_simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        folder = str(tmp_path_factory.mktemp(name) / "x")
        stage(spark, docs, SF).write.parquet(folder)
        out.append((docs, spark.read.parquet(folder)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_language(stages):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages[0])
    assert set(after) == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}


def test_exact(stages):
    before, after = (d.collect() for d in stages[1])
    assert sorted(r.doc_id for r in after) == sorted({r.text: r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}.values())


def test_near(stages):
    before, after = (sorted(d.collect(), key=lambda r: r.doc_id) for d in stages[2])
    fp, comp = [brute_simhash(r.text, P.NEAR_WORDS) for r in before], list(range(len(before)))
    while (new := [min(comp[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= P.NEAR_RADIUS) for i in range(len(fp))]) != comp:
        comp = new
    assert [r.doc_id for r in after] == [before[i].doc_id for i in sorted(set(comp))]


def test_near_finds_planted_copies_and_leaves_clean_documents(spark):
    rng = __import__("random").Random(6)
    words, often = [f"w{k}" for k in range(5000)], [1 / (k + 2.7) for k in range(5000)]  # as often as words of prose
    own = [rng.choices(words, often, k=rng.randrange(80, 500)) for _ in range(150)]
    rows, planted = [(i, " ".join(w)) for i, w in enumerate(own)], 0
    for i, w in enumerate(own[:100]):
        copy = list(w)
        for _ in range(max(1, len(w) // 60)):  # keeps a Jaccard similarity of five-word shingles above 0.8
            copy[rng.randrange(len(copy))] = "edited"
        rows.append((1000 + i, " ".join(copy)))
    kept = {r.doc_id for r in P.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert set(range(150)) <= kept
    assert sum(i not in kept for i in range(1000, 1100)) >= 90


def test_mixed(stages):
    before, after = (d.collect() for d in stages[3])
    words = lambda rows: Counter({s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}})
    had, has = words(before), words(after)
    assert max(Counter(r.doc_id for r in after).values()) <= 2 and all(has[s] <= 2 * had[s] for s in had)
    assert abs(sum(has.values()) - 1.5 * sum(had.values())) < 0.1 * sum(had.values())


def test_tokens(stages):
    before, after = (d.collect() for d in stages[4])
    assert Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in before) == Counter(r.decoded_sha256 for r in after)
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, *"aaaa"), (None, "some words", "en", None, 1, *"aaaa"), (2, "some words", None, "s", 1, *"aaaa"), (2, "some words", None, "s", 1, *"aaaa"), (3, "", "en", "s", 0, *"aaaa")]
    clashing = "_lang _score _said _id _text _source _size _copies _words _copy size kept score copies taken fingerprint component_id keep_id".split()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in clashing if c not in DOCS.split()})
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).count() == 0
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert after.where(" or ".join(f"{c} is distinct from '{c}'" for c in clashing)).count() == 0
    assert [r.doc_id for r in P.exact(spark, docs.where("text <> ''"), SF).collect()] == [2]
    assert P.tokens(spark, docs, SF).count() == 5


def test_rows_of_one_id_are_decided_by_their_text(spark):
    text = lambda i: " ".join(f"w{i}x{j * j % 97}" for j in range(60))
    rows = [(5, text(1)), (5, text(2)), (9, text(1)), (None, text(3)), (None, text(2)), (None, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda stage, d: sorted((r.doc_id or 0, r.text) for r in stage(spark, d, SF).collect())
    assert kept(P.exact, docs) == sorted([(5, text(2)), (9, text(1)), (0, text(3)), (0, text(4))])
    near = [(1, text(1)), (2, text(1)), (2, text(2)), (None, text(2)), (None, text(3)), (None, text(4))]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    assert kept(P.near, docs) == sorted([(1, text(1)), (2, text(2)), (0, text(3)), (0, text(4))])


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0


def test_language_uses_its_prediction(spark, monkeypatch):
    rng = __import__("random").Random(2)
    words = {"xx": ["aba", "abba", "baab"], "yy": ["cdc", "ddc", "ccd"]}
    text = lambda k, n=30: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, text(k), k) for i, k in enumerate(["xx", "yy"] * 40)] + [(100, text("xx"), None), (101, text("yy"), "xx"), (102, "123", "xx"), (103, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    after = {r.doc_id: r.lang for r in P.language(spark, docs, SF).collect()}
    assert after == {**{i: k for i, _, k in rows[:80]}, 100: "xx", 101: "yy"}
    monkeypatch.setattr(P, "LANGUAGES", ["yy"])
    assert {r.doc_id for r in P.language(spark, docs, SF).collect()} == {i for i, k in after.items() if k == "yy"}
    monkeypatch.setattr(P, "LANGUAGES", None)
    monkeypatch.setattr(P, "LEAST_SCORE", 1.1)
    assert P.language(spark, docs, SF).count() == 0


def test_mixed_shares_copies_between_rows_of_one_id(spark):
    rows = [(5, " ".join(f"w{i}" for i in range(k % 17 + 1)) + f" {k}", "s") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    after = P.mixed(spark, docs, SF).collect()
    total, got = (sum(len(r[1].split()) for r in x) for x in (rows, after))
    assert abs(got - 1.5 * total) < 20 and set(Counter(r.text for r in after).values()) == {1, 2}


def test_near_copies_broadcast_nothing_that_grows(spark):
    from stanzaflow.llm.simhash_dedup import simhash_dedup

    docs = spark.createDataFrame([(i, f"one two three four {i // 2}") for i in range(20)], "doc_id long, text string")
    out = simhash_dedup(docs, by_row=True)
    assert out.count() == 20
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 3
