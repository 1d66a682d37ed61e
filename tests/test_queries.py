"""Every query of the library runs; those with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from stanzaflow.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(df):
    c = sorted(df.columns)
    return c, sorted(map(str, map(tuple, df[c].astype(object).where(df[c].notna(), None).values.tolist())))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, duck, name):
    got = queries()[name](spark, sf).toPandas()
    sql = oracle_sql().get(name)
    if sql:
        assert plain(got) == plain(duck.sql(sql).df())


@pytest.mark.parametrize("name", ["dup_components", "reaction_state", "near_dup_keep_longest", "first_seen_duplicates", "assign_ids"])
def test_partitioning_does_not_matter(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = plain(queries()[name](spark, sf).toPandas())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert plain(queries()[name](spark, sf).toPandas()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_without_the_llm_subpackage(spark, monkeypatch):
    import __spark_entry__ as e

    assert set(queries()) <= set(e.queries()) and set(oracle_sql()) <= set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setattr(e, "HAS_LLM", False)
    monkeypatch.setattr(e, "HAS_PIPELINE", False)
    assert set(e.queries()) == set(queries()) and set(e.oracle_sql()) == set(oracle_sql())
    assert e.entry(spark).count() > 0


def test_near_copies_without_a_cheaper_signal_are_one_cluster(spark, tmp_path):
    from difflib import SequenceMatcher

    body = " ".join(f"word{i * i % 89} and so" for i in range(20))
    texts = [f"on a first title of its own\n{body}", f"on some other heading\n{body} more", "on quite another matter, with nothing in common\nshort"]
    spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    flat = ["".join(t.split()) for t in texts]
    assert SequenceMatcher(None, flat[0], flat[1], autojunk=False).ratio() >= 0.9
    rows = lambda name: sorted(tuple(r) for r in queries()[name](spark, str(tmp_path)).collect())
    assert rows("dup_components") == [(0, 0), (1, 1), (2, 2)] and rows("dup_components_fuzzy") == [(0, 0), (1, 0), (2, 2)]
    assert rows("merge_clusters_fuzzy") == [(0, max((0, 1), key=lambda i: len(texts[i])), 2, "s0,s1")] and rows("cluster_classes_ratio") == [(0, 2, "body_match")]


def test_whole_forms_compare_more_than_openings(spark, tmp_path):
    passage = "an opening of over thirty chars, first line\nand then a second line of the passage, which is much longer than the first line of it"
    tail = " ".join(f"word{i * i % 89}" for i in range(40))
    texts = {
        0: ("an opening of over thirty chars; another text " + tail, "src1"), 1: ("x" + passage[1:], "src1"), 2: ("nothing\n" + passage.split("\n")[1] + " " + tail, "src1"),
        3: ("one title of twenty characters and A\nsome", "src7"), 4: ("one title of twenty characters and B\nmore", "src1"), 5: ("One title of twenty characters and a\nother", "src1"),
    }
    spark.createDataFrame([(i, t, s) for i, (t, s) in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda name: sorted(tuple(r) for r in queries()[name](spark, str(tmp_path)).collect())
    assert rows("live_antijoin") == [(0,), (2,), (3,), (4,), (5,)]
    assert rows("deleted_titles") == [(3,), (5,)]
    assert rows("probe_join") == [(7, 1), (7, 2)]


def test_clean_chain_against_plain_python(spark, tmp_path):
    import hashlib

    head, tail, memorial = "by A Poet\n\n", '\n\n"Song" from Book by A Poet. Copyright © 2001', "\n\n \n\n***\nIn Memoriam\nblurb"
    body = "\n".join(f"line {i} of a poem" for i in range(30))
    texts = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in (body, head + body, body + tail, body + memorial, head + body + tail, "caf\u00c3\u00a9 " + body, "caf\u00c3\u00a9\u00a0" + body, "a\u00a0" + body) for s in ("src0", "src1", "src2"))]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def repaired(t):
        try:
            return t.encode("latin1").decode()
        except UnicodeError:  # a lone no-break space
            return t

    def plain(t, s):
        changes = []
        for name, on, new in (
            ("encoding", "Ã©" in t and repaired(t) != t, repaired), ("byline", s == "src1" and t.startswith("by "), lambda x: x.split("\n", 1)[1].strip()),
            ("copyright", s == "src1" and "Copyright" in t, lambda x: x[: x.index('\n\n"Song"')]), ("memorial", s == "src2" and "Memoriam" in t, lambda x: x[: x.index("\n\n \n")]), ("nbsp", "\xa0" in t, lambda x: x.replace("\xa0", " ")),
        ):
            if on:
                t, changes = new(t), [*changes, name]
        return hashlib.sha256(t.encode()).hexdigest(), changes

    got = {r.doc_id: (r.body_sha256, r.changes) for r in queries()["clean_chain"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(t, s) for i, t, s in texts} and {c for _, cs in got.values() for c in cs} == {"encoding", "byline", "copyright", "memorial", "nbsp"}
