"""Periodic runs and hard negatives against brute force, and on odd rows."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stanzaflow.llm import hard_negatives as negatives
from stanzaflow.llm import periodic_runs as runs
from stanzaflow.llm import queries


def brute_runs(words, least=12):
    """Every stretch that no neighbour continues, with its smallest period."""
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                w = words[i : j + q]
                if not any(w[r:] == w[:-r] for r in range(1, q)):
                    found.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda x: (x[0], x[2]))


def brute_collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def odd_words(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(0, 70))]
    if kind == 1:
        u = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        return [rng.choice("abcd") for _ in range(rng.randrange(0, 9))] + u * rng.randrange(1, 9) + [rng.choice("abcd") for _ in range(rng.randrange(0, 9))] + u * rng.randrange(0, 4)
    if kind == 2:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(0, 7)):
            a, b = b, b + a
        return b
    return [str(rng.randrange(6)) for _ in range(rng.randrange(0, 60))] + ["é"] * rng.randrange(0, 40)


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        docs = [odd_words(rng) for _ in range(rng.randrange(1, 6))]
        of, start, length, period, spelt, n_words = runs._chunk([" ".join(w).encode() for w in docs], 12)
        for k, words in enumerate(docs):
            mine = of == k
            want = brute_runs(words)
            assert sorted(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True), key=lambda x: (x[0], x[2])) == want
            assert spelt[k].decode() == brute_collapsed(words, want)
            assert n_words[k] == len(words)


def test_long_runs_in_little_time():
    for words, want in (([7] * 100_000, (0, 100_000, 1)), ([k % 777 for k in range(100_000)], (0, 100_000, 777))):
        of, start, length, period, spelt, _ = runs._chunk([" ".join(map(str, words)).encode()], 12)
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [want]
        assert len(spelt[0].split()) == want[2]


def planted(doc_id, text):
    words = (text or "").split(" ") if (text or "") else []
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_op11_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(0, 150))) for _ in range(300)] + ["", None, "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    planted_runs = 0
    for k, t in enumerate(texts):
        words = planted(k, t)
        want = brute_runs(words)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        r = got[k]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        assert r["collapsed_sha256"] == sha(brute_collapsed(words, want))
        planted_runs += bool(want)
    assert planted_runs > 15


def test_runs_of_odd_rows(spark):
    schema = "doc_id long, text string, runs string, collapsed string, n_words string"
    rows = [(None, "a b " * 9, "x", "x", "x"), (3, None, None, None, None), (3, "", "", "", ""), (3, " \t\n", "", "", ""), (4, "a b " * 6 + "\x0ba b" * 6, "", "", ""), (None, "a b " * 9, "x", "x", "x"), (5, "z" * 3_000_000, "", "", "")]
    got = sorted(runs.periodic_runs(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"][:9]) for r in got] == [
        (None, 18, [(0, 18, 2)], "a b"), (None, 18, [(0, 18, 2)], "a b"), (3, 0, [], ""), (3, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 1)], "a b"), (5, 1, [], "z" * 9),
    ]
    assert runs.periodic_runs(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], schema), least=6)


def brute_negatives(rows, is_anchor, k_pos, k_neg, low, high):
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2]]
    out = []
    for a in (r for r in fine if is_anchor(r)):
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=True))  # noqa: B023, E731
        near = [(-score(r), r[0]) for r in fine if r[0] != a[0] and r[1] == a[1] and len(r[2]) == len(a[2])]
        far = [(-score(r), r[0]) for r in fine if r[1] != a[1] and len(r[2]) == len(a[2])]
        for p, p_id in sorted(near)[:k_pos]:
            inside = sorted((s, i) for s, i in far if low * -p <= 100 * -s <= high * -p)
            out += [(a[0], p_id, rank, i, -p, -s) for rank, (s, i) in enumerate(inside[:k_neg], 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("sizes", [(256, 2048, 32), (3, 7, 2), (1, 1, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(negatives, "ANCHORS", sizes[0])
    monkeypatch.setattr(negatives, "ROWS", sizes[1])
    monkeypatch.setattr(negatives, "CHUNK", sizes[2])
    rng = random.Random(2)
    n = 40 if sizes[1] == 1 else 150
    rows = [(i, rng.choice(["a", "b", "c", None]), [rng.randrange(-3, 9) for _ in range(rng.choice([5, 5, 3]))]) for i in range(n)]
    rows += [(None, "a", [1] * 5), (n, "a", None), (n + 1, "b", []), rows[20], rows[20], rows[31], (33, "a", rows[33][2])]  # nulls, repeats, one id with two labels
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label string, q array<long>, anchor string, slot string")
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, 3, 4)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda r: r[0] % 10 == 0, 3, 4, 30, 90)


def test_negatives_of_empty_tables_and_large_numbers(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, q array<long>")
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    big = 10**8  # sums beyond 2 ** 53, added as whole numbers
    rows = [(0, "a", [big, big + 1]), (1, "a", [big, big]), (2, "b", [big - 1, 0]), (3, "b", [big, 1]), (4, "b", [big // 2, 7])]
    df = spark.createDataFrame(rows, "vec_id long, label string, q array<long>")
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") == 0).collect())) == brute_negatives(rows, lambda r: r[0] == 0, 5, 10, 30, 90)


def test_quantised(spark):
    rows = [([0.5, -0.001, 1.0],), ([float("nan"), 1.0],), ([float("inf")],), ([1.0, None],), (None,), ([],)]
    got = spark.createDataFrame(rows, "e array<float>").select(negatives.quantised(F.col("e")).alias("q")).collect()
    assert [r["q"] for r in got] == [[128, -1, 256], None, None, None, None, None]


def test_ties_by_id(spark):
    rows = [(i, "a" if i < 9 else "b", [2, 0] if i < 9 else [1, 0]) for i in range(30)]
    df = spark.createDataFrame([rows[i] for i in random.Random(1).sample(range(30), 30)], "vec_id long, label string, q array<long>")
    got = negatives.hard_negatives(df, F.col("vec_id") == 4).collect()
    assert sorted((r["positive_id"], r["rank"], r["negative_id"]) for r in got) == sorted((p, k + 1, 9 + k) for p, k in itertools.product([0, 1, 2, 3, 5], range(10)))


def test_files_of_score_tiles_are_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    from stanzaflow.llm import hard_negatives as H

    monkeypatch.setattr(H, "ROWS", 4)
    monkeypatch.setattr(H, "ANCHORS", 2)
    rows = spark.range(400).select("id", F.lit("a").alias("label"), F.array(F.col("id"), F.lit(1).cast("long")).alias("q"))
    tiles = H._score_tiles(H._packed(rows.where("id % 50 = 0"), 8, 2).cache(), H._packed(rows, 400, 4).cache())
    per_file = [r["n"] for r in tiles.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert sum(per_file) >= 400 and max(per_file) <= 8


def test_scores_of_anchors_and_rows_are_neither_shuffled_nor_written(spark, monkeypatch):
    from stanzaflow.llm import hard_negatives as H

    monkeypatch.setattr(H, "_score_tiles", lambda *_: pytest.fail("tiles are written"))
    rows = [(i, "ab"[i % 2], [i % 5, 1 + i % 7]) for i in range(60)]
    got = H.hard_negatives(spark.createDataFrame(rows, "vec_id long, label string, q array<long>"), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda r: r[0] % 10 == 0, 5, 10, 30, 90)
    shuffled = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert shuffled and not any("scores" in x for x in shuffled)


def test_blocks_hold_numbers_as_narrow_as_they_are(spark):
    from stanzaflow.llm import hard_negatives as H

    for most, width in ((127, 1), (128, 2), (32768, 4), (2**31, 8)):
        rows = spark.range(5).select("id", F.lit("a").alias("label"), F.array(-F.col("id"), F.lit(most)).alias("q"))
        assert [len(r["body"]) for r in H._packed(rows, 5, 8).collect()] == [5 * 2 * width]
