"""The vector sum and the stored index against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaflow import queries as Q
from stanzaflow.operators import recommend as R
from stanzaflow.operators import vectors as V

BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize("rows_in_batch", [10_000, 7])
def test_vector_sum(spark, rows_in_batch):
    rng = np.random.default_rng(1)
    rows = [(int(u) if u else None, None if u == 3 else "ab"[int(u) % 2], None if k % 11 == 0 else [float(x) for x in rng.integers(-5, 6, 4 if k % 7 else 2)], None if k % 13 == 0 else float(k % 5 - 2)) for k, u in enumerate(rng.integers(0, 6, 300))]
    rows += [(9, "z", None, 1.0), (9, "z", [1.0], None), (8, "y", [1.0, None, 2.0], 2.0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
        df = spark.createDataFrame(rows, "user long, kind string, v array<double>, w double").repartition(5)
        got = {(r["user"], r["kind"]): r["total"] for r in V.vector_sum(df, ("user", "kind"), "v", "w").collect()}
        plain = {r["user"]: r["total"] for r in V.vector_sum(df, ("user",), "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, whole = {}, {}
    for u, kind, v, w in rows:
        for out, key, factor in ((want, (u, kind), w), (whole, u, 1.0)):
            if v is not None and factor is not None:
                t = out.setdefault(key, [0.0] * 4)
                for i, x in enumerate(v):
                    t[i] += (x or 0) * factor
    assert {k: v + [0.0] * (4 - len(v)) for k, v in got.items()} == want
    assert {k: v + [0.0] * (4 - len(v)) for k, v in plain.items()} == whole
    assert V.vector_sum(df.limit(0), ("user",), "v", "w").collect() == []


def test_vector_sum_shuffles_one_row_for_each_key_and_partition(spark):
    df = spark.range(0, 20_000, 1, 6).select((F.col("id") % 3).alias("user"), F.array(*[F.lit(1.0)] * 8).alias("v"))
    out = V.vector_sum(df, ("user",), "v")
    assert sorted((r["user"], r["total"][0]) for r in out.collect()) == [(0, 6667.0), (1, 6667.0), (2, 6666.0)]
    plan = out._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 2 and "Generate" not in plan


def exact(x, q, k):
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.round(1 - (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)), 6)
    return np.lexsort((np.arange(len(x)), d))[:k]


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    rows = spark.read.parquet(f"{BIG}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    path = str(tmp_path_factory.mktemp("index"))
    index = V.write_index(rows, path)
    by_id = {r["id"]: r["embedding"] for r in rows.collect()}
    assert sorted(by_id) == list(range(len(by_id)))
    return index, np.array([by_id[i] for i in range(len(by_id))], np.float64)


def test_every_row_is_indexed_once(spark, big):
    index, x = big
    rows = index.rows(spark)
    assert rows.count() == len(x) == rows.select("id").distinct().count()
    cell = {r["id"]: r["cell"] for r in rows.select("id", "cell").collect()}
    assert all(cell[i] == int(np.argmax((x[i] / np.linalg.norm(x[i])) @ index.centroids.T)) for i in range(0, len(x), 50))


def test_recall_of_a_thousand(spark, big):
    index, x = big
    rng = np.random.default_rng(3)
    tastes = [x[rng.choice(len(x), 8)].sum(0) for _ in range(4)] + [x[17]]
    held = [np.isin([r["id"] for r in V.nearest(spark, index, q.tolist(), 1000).select("id").collect()], exact(x, q, 1000)).mean() for q in tastes]
    assert np.mean(held) >= 0.95


def test_small_probes_read_few_folders(spark, big):
    index, x = big
    out = V.nearest(spark, index, x[5].tolist(), 10, probes=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    cells = index.cells(x[5:6], 3)[0].tolist()
    read = index.rows(spark).where(F.col("cell").isin(cells)).select("_metadata.file_path").distinct().collect()
    assert {int(r["file_path"].split("cell=")[1].split("/")[0]) for r in read} == set(cells)
    assert out.first()["id"] in exact(x, x[5], 3)


def test_nearest_all_equals_the_exact_scan_when_all_cells_are_probed(spark, big):
    index, x = big
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 100, 200)] + [(7, [0.0] * x.shape[1]), (8, None)], "query_id long, vector array<double>")
    seen = spark.createDataFrame([(0, 0), (100, 5), (100, 100)], "query_id long, id long")
    got = V.nearest_all(index, asked, 15, seen, probes=len(index.centroids)).collect()
    gone = {0: {0}, 100: {5, 100}, 200: set()}
    for i in (0, 100, 200):
        mine = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == i)
        assert [k for _, k in mine] == [k for k in exact(x, x[i], 20).tolist() if k not in gone[i]][:15]
    assert {r["query_id"] for r in got} == {0, 100, 200}


def test_index_survives_reopening_and_odd_tables(spark, big, tmp_path):
    index, x = big
    again = V.open_index(spark, index.path)
    assert again.probes == index.probes and np.allclose(again.centroids, index.centroids)
    for rows in ([], [(1, None)], [(1, [0.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0])]):
        small = V.write_index(spark.createDataFrame(rows, "id long, embedding array<float>"), str(tmp_path / f"i{len(rows)}"))
        found = [r["id"] for r in V.nearest(spark, small, [1.0, 0.0], 5).collect()] if len(rows) != 1 or rows[0][1] else []
        assert found[:3] == ([1, 2, 2] if len(rows) > 1 else found[:3])
    assert V.nearest(spark, small, [0.0, 0.0], 5).collect() == []


def test_recommend_on_the_index_is_the_exact_one_when_all_cells_are_probed(spark, sf, tmp_path):
    import dataclasses

    p, log = Q.poems(spark, sf), Q.interactions(spark, sf)
    index = R.index_poems(p, str(tmp_path / "poems"))
    whole = dataclasses.replace(index, probes=len(index.centroids))
    assert list(map(tuple, R.recommend(p, log, Q.READER, index=whole).collect())) == list(map(tuple, R.recommend(p, log, Q.READER).collect()))
    want = {(r["user_id"], r["rank"]): r["id"] for r in R.recommend_all(p, log).collect()}
    assert {(r["user_id"], r["rank"]): r["id"] for r in R.recommend_all_indexed(whole, p, log).collect()} == want
    held = [r["id"] in {i for (u, _), i in want.items() if u == r["user_id"]} for r in R.recommend_all_indexed(index, p, log).collect()]
    assert np.mean(held) >= 0.9


def test_blocks_of_queries_and_shards_of_cells_give_the_same_rows(spark, big, monkeypatch):
    index, x = big
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 120)] + [(777, [0.0] * x.shape[1])], "query_id long, vector array<double>")
    seen = spark.createDataFrame([(i, i) for i in range(0, 120)] + [(5, j) for j in range(300)], "query_id long, id long")
    for probes in (1, 7, len(index.centroids)):
        one = set(map(tuple, V.nearest_all(index, asked, 4, seen, probes=probes).collect()))
        monkeypatch.setattr(V, "BLOCK", 25)
        monkeypatch.setattr(V, "SHARD", 30)  # cells are cut as well
        many = V.nearest_all(index, asked, 4, seen, probes=probes)
        assert set(map(tuple, many.collect())) == one
        monkeypatch.undo()


@pytest.mark.parametrize("held", [V.MOST_HELD, 50] if hasattr(V, "MOST_HELD") else [0])
def test_nearest_rows_are_those_of_a_whole_scan(held, monkeypatch):
    import pyarrow as pa

    for name, size in (("MOST_HELD", held), ("QUERIES", 16), ("ROWS", 64)):
        monkeypatch.setattr(V, name, size)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[100:250] = x[3] * rng.choice([1, 2, 3], 150)[:, None]  # a large group at one distance
    x[250:260], x[260, 2] = 0, np.nan
    ids = rng.permutation(400) * 3
    y = np.concatenate([rng.normal(size=(40, 8)), x[[3, 100]], np.zeros((1, 8))])
    gone = [rng.choice(ids, 6).tolist() + [999_999] for _ in y]
    gone[4] = ids[:395].tolist()
    gone[5] = None
    names = np.arange(len(y)) + 1000
    for undefined in (False, True):
        got = V.nearest_rows(pa.chunked_array([names]), pa.array(gone, pa.list_(pa.int64())), 9, y, x, ids, [(0, 70, np.arange(len(y))), (70, 400, None)], undefined=undefined).to_pandas()
        for q in range(len(y)):
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.round(1 - (x @ y[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y[q])), 6)
            open_ = [(np.inf if np.isnan(a) else a, i) for a, i in zip(d.tolist(), ids.tolist()) if i not in (gone[q] or []) and (undefined or not np.isnan(a))]
            mine = got[got["query_id"] == q + 1000]
            assert sorted(zip(mine["dist"].fillna(np.inf).tolist(), mine["id"].tolist())) == sorted(open_)[:9], (q, undefined)


def test_recommend_all_is_the_same_in_small_blocks(spark, sf):
    p, log = Q.poems(spark, sf), Q.interactions(spark, sf)
    whole = set(map(tuple, R.recommend_all(p, log).collect()))
    assert whole and set(map(tuple, R.recommend_all(p, log, block=4, shard=33).collect())) == whole
