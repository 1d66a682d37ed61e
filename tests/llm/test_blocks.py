"""Blocks hold about equal bytes whatever the ids."""

import numpy as np
import pytest
from stanzaflow.llm import blocks as B
from test_llm import frame, prose
import random


@pytest.mark.parametrize("ids", ["plain", "hot", "null", "long together", "two"])
def test_blocks_by_bytes(spark, monkeypatch, ids):
    monkeypatch.setattr(B, "LEAST_BLOCK", 4000)
    monkeypatch.setattr(B, "CELLS", 64)
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(400)]
    known = list(range(400))
    if ids == "hot":
        known = [7 if i % 3 else i for i in known]
    elif ids == "null":
        known = [None if i % 3 else i for i in known]
    elif ids == "long together":
        texts = [prose(rng, 200) if i < 40 else "a" for i in known]
    elif ids == "two":
        known = [-(1 << 62) if i % 2 else 1 << 62 for i in known]
    dealt = B.deal(frame(spark, texts, ids=known))
    rows = dealt.rows.collect()
    size = {}
    for r in rows:
        size.setdefault(r.block, []).append(r)
    import zstandard

    out = lambda r: len(zstandard.ZstdDecompressor().decompress(bytes(r.body), max_output_size=1 << 20))
    total = sum(len(t.encode()) for t in texts)
    assert len(rows) == 400 and dealt.total_bytes == total and max(size) < dealt.count
    assert max(sum(map(out, v)) for v in size.values()) <= 4 * 4000
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.turn))
    assert [r.block for r in order] == sorted(r.block for r in rows)


def test_lay_out():
    r = B.lay_out(np.arange(3), np.array([0, 10, 95, 3, 3]), 30)
    assert r.first.tolist() == [0, 0, 1, 5, 5] and r.parts.tolist() == [1, 1, 4, 1, 1]


def test_empty(spark):
    assert B.deal(frame(spark, [])).rows.count() == 0 and B.deal(frame(spark, [None], ids=[None])).rows.count() == 1
