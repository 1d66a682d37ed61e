"""Functions callable from SQL, views of a reader, tables in buckets, counted writes."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from stanzaflow import queries as Q
from stanzaflow.operators import recommend as R
from stanzaflow.plans import serving
from stanzaflow.sources import writes


@pytest.fixture(scope="module")
def served(spark, sf):
    own = spark.newSession()
    serving.publish(own, Q.poems(own, sf), Q.interactions(own, sf))
    return own


def test_look_ups(served):
    assert [(r["ord"], r["id"]) for r in served.sql("select ord, id from get_poems_by_ids(array(7, 3, 99999, 7)) order by ord").collect()] == [(0, 7), (1, 3), (3, 7)]
    assert served.sql("select id from get_poem(5)").collect()[0]["id"] == 5
    assert served.sql("select * from get_poem(null)").collect() == served.sql("select * from get_poems_by_ids(null)").collect() == []


@pytest.mark.parametrize("call, named", [
    ("10, 8, recent => array('A01', 'A11', null)", {"limit": 8, "recent": ["A01", "A11", None]}), ("3, 4, corpora => array('src3', '__null__'), seed => 'x'", {"user": 3, "limit": 4, "corpora": ["src3", "__null__"], "seed": "x"}),
    ("987654, 60", {"user": 987654, "limit": 60}), ("10, 1", {"limit": 1}),
])
def test_recommend_poems_is_recommend(spark, served, sf, call, named):
    args = {"user": 10} | named
    got = served.sql(f"select * from recommend_poems({call}) order by ord").collect()
    want = R.recommend(Q.poems(spark, sf), Q.interactions(spark, sf), **args).orderBy("ord").collect()
    assert list(map(tuple, got)) == list(map(tuple, want))


@pytest.mark.parametrize("n, recent", [(0, "array()"), (3, "array('A00', null)"), (60, "array('A01')"), (100_000, "null")])
def test_pick_diverse(spark, served, sf, n, recent):
    pool = Q.poems(spark, sf).where("id % 2 = 0 or id > 150").select("id", "author", "corpus")
    names = {"array()": [], "null": None, "array('A00', null)": ["A00", None], "array('A01')": ["A01"]}[recent]
    Q.poems(served, sf).where("id % 2 = 0 or id > 150").createOrReplaceTempView("pool")
    got = served.sql(f"select * from pick_diverse(table(select id, author, corpus from pool), {n}, {recent}, 'q') order by ord").collect()
    want = R.pick_diverse(pool, n, names, "q").orderBy("ord").collect()
    assert [(r["id"], r["ord"], r["level"]) for r in got] == [(r["id"], r["ord"], r["level"]) for r in want]


def test_pick_diverse_bounds(served):
    for bad in ("table(select id from range(3)), 2, array(), 's'", "table(select id, 'a' author, 'b' corpus from range(3)), -1, array(), 's'", "table(select id, 'a' author, 'b' corpus from range(3)), 1, array(), ''", "table(select id, 'a' author, 'b' corpus from range(1001)), 1, array(), 's'"):
        with pytest.raises(Exception):  # noqa: B017
            served.sql(f"select * from pick_diverse({bad})").collect()
    assert served.sql("select * from pick_diverse(table(select id, 'a' author, 'b' corpus from range(0)), 2, array(), 's')").collect() == []


def test_views_of_a_reader(served):
    serving.as_reader(served, None)
    assert served.sql("select * from my_interactions").collect() == []
    serving.as_reader(served, 10)
    mine = served.sql("select * from my_interactions where poem_id > 4")
    assert {r["user_id"] for r in mine.collect()} == {10}
    assert "EqualTo(user_id,10)" in mine._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def rows_of(spark, path):
    return sorted(map(tuple, writes.read(spark, path).collect()))


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/rows/bucket=*/*.parquet")}


def test_upsert_touches_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    writes.create(spark.range(200).select("id", F.lit("old").alias("v"), F.lit(None).cast("int").alias("k")), path, buckets=16)
    before = files(path)
    batch = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (900, "new", None)], "id long, v string, k int")
    assert writes.upsert_rows(spark, path, batch, order="k") <= 2
    want = sorted([(i, "old", None) for i in range(200) if i != 3] + [(3, "b", 2), (900, "new", None)])
    assert rows_of(spark, path) == want
    assert len(before - files(path)) <= 2 and len(before & files(path)) >= 14
    writes.upsert_rows(spark, path, batch, order="k")
    assert rows_of(spark, path) == want
    assert writes.upsert_rows(spark, path, batch.limit(0)) == 0


def test_sparse_update_and_delete_with_children(spark, tmp_path):
    parent, child = str(tmp_path / "p"), str(tmp_path / "c")
    writes.create(spark.createDataFrame([(i, "x", "y") for i in range(20)], "id long, a string, b string"), parent, buckets=8)
    writes.create(spark.createDataFrame([(100 + i, i % 20) for i in range(60)], "id long, poem long"), child, buckets=8)
    writes.update_rows(spark, parent, spark.createDataFrame([(2, "new", None), (3, None, "z"), (77, "no", "no")], "id long, a string, b string"))
    assert [r for r in rows_of(spark, parent) if r[1:] != ("x", "y")] == [(2, "new", "y"), (3, "x", "z")]
    writes.delete_rows(spark, parent, spark.createDataFrame([(2,), (5,), (500,)], "id long"), (child, "poem"))
    assert {r[0] for r in rows_of(spark, parent)} == set(range(20)) - {2, 5}
    assert {r[1] for r in rows_of(spark, child)} == set(range(20)) - {2, 5}
    writes.delete_rows(spark, parent, spark.range(20))
    assert rows_of(spark, parent) == [] and files(parent) == set()


def test_ingest_goes_on_after_a_bad_batch(spark, tmp_path):
    path, source = str(tmp_path / "t"), tmp_path / "in"
    source.mkdir()
    writes.create(spark.range(10).select("id", F.lit("old").alias("v")), path, buckets=4)

    def put(name, *rows):
        (source / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        os.utime(source / name, (len(list(source.iterdir())),) * 2)

    put("a.json", {"id": 1, "v": "a"}, {"id": 11, "v": "a"})
    put("b.json", {"id": 2, "v": "b"}, {"id": 3, "v": ""})
    put("c.json", {"id": 4, "v": "c"})
    put("d.json", {"id": 5, "v": "d"}, '{"id": 6, "v')
    run = lambda: writes.ingest(spark, str(source), "id long, v string", path, str(tmp_path / "log"), str(tmp_path / "seen"), check=F.length("v") > 0)
    run()
    want = sorted([(i, {1: "a", 4: "c"}.get(i, "old")) for i in range(10)] + [(11, "a")])
    assert rows_of(spark, path) == want
    said = {r["batch"]: r for r in writes.batches(spark, str(tmp_path / "log")).collect()}
    assert [said[k]["error"] is None for k in range(4)] == [True, False, True, False] and "1 rows break" in said[1]["error"]
    before = files(path)
    run()
    assert rows_of(spark, path) == want and files(path) == before
    put("e.json", {"id": 2, "v": "e"})
    run()
    assert (2, "e") in rows_of(spark, path) and writes.batches(spark, str(tmp_path / "log")).count() == 5


def test_update_counted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a´b", None), (2, "c", "´"), (3, None, "x")], "id long, body string, title string")
    fix = lambda c: F.replace(c, F.lit("´"), F.lit("’"))
    out, n = writes.update_counted(rows, {"body": fix(F.col("body")), "title": fix(F.col("title"))}, str(tmp_path / "a"))
    assert sorted(map(tuple, out.collect())) == [(1, "a’b", None), (2, "c", "’"), (3, None, "x")]
    assert n == {"n_rows": 3, "body": 1, "title": 1}
    assert writes.update_counted(out, {"body": fix(F.col("body")), "title": fix(F.col("title"))}, str(tmp_path / "b"))[1] == {"n_rows": 3, "body": 0, "title": 0}
    assert writes.update_counted(rows.limit(0), {"body": fix(F.col("body"))}, str(tmp_path / "c"))[1] == {"n_rows": 0, "body": 0}


def test_split_counted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "t"), (2, " ", "t"), (3, None, ""), (4, "b", None)], "id long, body string, title string")
    reasons = {f"no {c}": F.coalesce(F.trim(c), F.lit("")) == "" for c in ("body", "title")} | {"never": F.lit(None).cast("boolean")}
    kept, removed, n = writes.split_counted(rows, reasons, str(tmp_path / "a"))
    assert [tuple(r) for r in kept.collect()] == [(1, "a", "t")]
    assert sorted((r["id"], r["reasons"]) for r in removed.collect()) == [(2, ["no body"]), (3, ["no body", "no title"]), (4, ["no title"])]
    assert n == {"n_rows": 4, "n_kept": 1, "no body": 2, "no title": 2, "never": 0}


def test_clean_counted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a--b "), (2, "c"), (3, None)], "id long, body string")
    steps = [("dash", F.replace("body", F.lit("--"), F.lit("—"))), ("trim", F.trim("body"))]
    out, log, n = writes.clean_counted(rows, steps, "body", str(tmp_path / "a"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a—b"), (2, "c"), (3, None)]
    assert sorted(map(tuple, log.collect())) == [(1, "dash", 5, 4), (1, "trim", 4, 3)]
    assert n == {"n_rows": 3, "n_changed": 1, "dash": 1, "trim": 1}
