"""Taps as rows, many patterns at once, containment by the rarest key: against plain Python."""

import random
import re

import pytest

from stanzaflow.operators import curate, dedup
from stanzaflow.operators import recommend as R


def test_toggle_rows_are_a_fold(spark):
    rng = random.Random(4)
    taps = [(k, rng.randrange(3), rng.randrange(3), rng.choice(["like", "dislike", "save", None, "share"]), rng.randrange(40)) for k in range(400)]
    got = R.toggle_rows(spark.createDataFrame(taps, "id long, user_id long, poem_id long, what string, created_at long")).collect()
    states, want = {}, []
    for k, user, poem, what, at in sorted(taps, key=lambda t: (t[4], t[0])):
        if what in ("like", "dislike", "save"):
            states[user, poem], rows = R.toggle(states.get((user, poem), {}), what)
            want += [(user, poem, at, k, n + (len(rows) == 1), a) for n, a in enumerate(rows)]
    assert sorted((r["user_id"], r["poem_id"], r["created_at"], r["id"], r["n"], r["action"]) for r in got) == sorted(want)
    assert len(want) > 250


def test_pattern_hits(spark):
    texts = [(1, "a.b (x) a.b\nab"), (2, None), (3, "nothing"), (4, "((x) a.b.a.b"), (5, "é" * 30 + "a.b"), (6, "a.b" * 3000)]
    patterns = [("p", "a.b"), ("q", "(x"), ("r", "(x)"), ("s", ""), ("t", "zz"), ("same", "a.b")]
    got = {(r["id"], r["pattern_id"]): (r["n"], r["at"], r["before"]) for r in curate.pattern_hits(spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame(patterns, "pattern_id string, pattern string"), 3).collect()}
    want = {}
    words = "|".join(re.escape(p) for p in sorted({p for _, p in patterns if p}, key=lambda p: (-len(p), p)))
    for i, body in texts:
        for m in re.finditer(words, body or ""):
            for name, p in patterns:
                if p == m[0]:
                    n, at, before = want.get((i, name), (0, m.start() + 1, body[max(0, m.start() - 3) : m.end() + 3]))
                    want[i, name] = n + 1, at, before
    assert got == want and (1, "q") not in got and got[6, "p"][0] == 3000
    assert curate.pattern_hits(spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([], "pattern_id string, pattern string")).collect() == []
    with pytest.raises(ValueError):
        curate.pattern_hits(spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame(patterns, "pattern_id string, pattern string"), most=4)


def test_containing_equals_every_pair(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.6 else f"w{rng.randrange(60)}"
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(120)] + ["", None, "the of\tthe\nof a the of"]
    probes = ["the of", "of a the of the a", "", "w1", "the of\tthe\nof a", None, "not to be found in any of the texts", "the  of the of a"]
    for t in texts[:60]:
        if len(t) > 20:
            k = rng.randrange(len(t) - 10)
            probes.append(t[k : k + rng.randrange(5, 60)])
    got = dedup.containing(spark.createDataFrame(list(enumerate(probes)), "probe_id long, probe string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, body string"))
    rows = list(map(tuple, got.collect()))
    assert sorted(rows) == sorted((i, j) for i, p in enumerate(probes) for j, t in enumerate(texts) if p is not None and t is not None and p in t)
    assert dedup.containing(spark.createDataFrame([], "probe_id long, probe string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, body string")).collect() == []
