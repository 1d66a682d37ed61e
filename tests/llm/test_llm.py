"""Each operator against a brute-force version, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from stanzaflow.llm import blocks, byte_bpe, language_id, line_dedup, mixing, queries, simhash_dedup, substring_dedup, suffix_dedup, token_files, vector_dedup
from stanzaflow.llm.exact_dedup import exact_dedup
from stanzaflow.llm.shared import components, spread_hot

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, block string, key string, label string"


def frame(spark, texts, sources=None, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(25)]
    out = [None, "", " ", "\n\n", "a", "a" * 350, "ab" * 200, "word", "x y", None]
    for t in base:
        out += [t, t] if rng.random() < 0.3 else [t]
        if rng.random() < 0.5:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "edited"
            out.append("  ".join(w))
    passage = prose(rng, 60)
    out += [f"{prose(rng, 5)} {passage}\t{prose(rng, 30)}" for _ in range(6)]
    out.append("long " + prose(rng, 30_000, 10**6))
    rng.shuffle(out)
    return out


EMPTY = [[], [None], [""], [None, None, "", ""]]


def brute_bytes(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("texts", [corpus(1), corpus(2), *EMPTY])
def test_suffix_dedup(spark, texts, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20_000)
    got = {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, texts).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)


def test_suffix_dedup_repeated_and_null_ids(spark):
    t = prose(random.Random(5), 80)
    rows = suffix_dedup.suffix_dedup(frame(spark, [t, t, t], ids=[None, 7, 7])).collect()
    assert sorted((r.doc_id or -1, len(r.kept) > 0) for r in rows) == [(-1, True), (7, False), (7, False)]


def test_difference_cover():
    assert len({(a - b) % suffix_dedup.COVER_PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == suffix_dedup.COVER_PERIOD


def brute_words(texts, length=20):
    seen, out = set(), []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                gone[p : p + length] = [True] * length
            seen.add(k)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("texts", [corpus(3), corpus(4), *EMPTY, ["a " * 90, "a b " * 60, "a " * 30]])
def test_substring_dedup(spark, texts, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20_000)
    got = {r.doc_id: (r.n_words, sum(s.stop - s.start for s in r.spans), r.kept) for r in substring_dedup.substring_dedup(frame(spark, texts).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts)


def test_automaton_with_two_characters_a_word(monkeypatch):
    import zstandard

    monkeypatch.setattr(substring_dedup, "CHARS", 8)
    a, b = " ".join(f"u{i}" for i in range(30)), " ".join(f"u{i}" for i in range(4, 34))
    cell = zstandard.ZstdCompressor().compress(f"{a}\n{b}".encode())
    assert np.flatnonzero(substring_dedup._judge([cell], 20)[0]).tolist() == [11 + i for i in range(7)]


def test_cells():
    rng = np.random.default_rng(3)
    for bits in (32, 56):
        for n in (0, 1, 2, 1000):
            v = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
            assert (blocks.unpack_cell(blocks.pack_cell(v, bits)) == v).all()


def test_language_id(spark, sf):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and lang[r.doc_id].lang]
    assert sum(r.lang_pred == lang[r.doc_id].lang for r in held) / len(held) >= 0.95


def test_language_id_odd_rows(spark):
    d = frame(spark, ["the cat and the dog", "le chat et la souris", None, "", "123 !?", "x" * 2_200_000, "the"], langs=["en", "fr", "en", None, "fr", None, None])
    d = d.withColumn("lang_pred", F.lit("old"))
    got = {r.doc_id: r for r in language_id.identify(d, language_id.train(d)).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4)] == ["en", "fr", "und", "und", "und"] and got[2].score == 0.0
    assert got[6].lang_pred == "en" and got[0].key == "x"
    none = language_id.train(d.where("false"))
    assert {r.lang_pred for r in language_id.identify(d, none).collect()} == {"und"}


def test_language_pieces(monkeypatch):
    whole = np.concatenate(list(language_id._buckets("abcdefghij" * 5)))
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert Counter(np.concatenate(list(language_id._buckets("abcdefghij" * 5))).tolist()) == Counter(whole.tolist())


def brute_vectors(rows, cosine=0.93):
    unit = {}
    for k, (_, e, label) in enumerate(rows):
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, np.float64)
            unit[k] = x / np.linalg.norm(x)
    link = {k: {j for j in unit if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine} for k in unit}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((rows[k][0], len(link.get(k, ())), c, rows[k][0] == c))
    return sorted(out)


@pytest.mark.parametrize("tile", [2048, 16])
def test_vector_dedup(spark, tile, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rng, rows = np.random.default_rng(2), []
    for label in (1, 2, None):
        for _ in range(12):
            x = rng.standard_normal(16)
            for _ in range(rng.integers(1, 9)):
                rows.append((len(rows), (x + 0.12 * rng.standard_normal(16) * rng.integers(0, 2)).astype(np.float32).tolist(), label))
    nan, inf = float("nan"), float("inf")
    rows += [(1000 + i, e, 1) for i, e in enumerate([None, [], [0.0] * 16, [nan] * 16, [inf] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0], [1.0] * 16, [5.0] * 16])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1)).withColumn("id", F.lit(1))
    got = sorted(tuple(r) for r in vector_dedup.vector_dedup(d.repartition(3)).collect())
    want = brute_vectors(rows)
    missed = sum(w[1] for w in want) - sum(g[1] for g in got)
    assert 0 <= missed <= 0.02 * sum(w[1] for w in want) and (missed or got == want)
    assert vector_dedup.vector_dedup(d.where("false")).count() == 0


def test_vector_plan_misses_little():
    for n in (10, 10**4, 10**7):
        k, tables = vector_dedup.plan_tables(n, 0.93)
        assert (1 - vector_dedup.collision(0.93) ** k) ** tables <= 0.1


@pytest.mark.parametrize("cosine", [0.5, 0.8, 0.93, 0.99])
def test_vector_plan_keeps_its_miss_at_every_size(cosine):
    for n in (1, 10, 10**5, 2 * 10**6, 10**7, 10**9):
        k, tables = vector_dedup.plan_tables(n, cosine)
        assert k >= 1 and tables <= vector_dedup.MAX_TABLES and (1 - vector_dedup.collision(cosine) ** k) ** tables <= vector_dedup.MISS


@pytest.mark.parametrize("texts", [corpus(6), *EMPTY])
def test_exact_dedup(spark, texts):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, texts)).collect()}
    same = [[j for j, u in enumerate(texts) if (u or "") == (t or "")] for t in texts]
    assert [got[i] for i in range(len(texts))] == [(s[-1], len(s), s[-1] == i, hashlib.sha256((texts[i] or "").encode()).hexdigest()) for i, s in enumerate(same)]


def test_exact_dedup_is_native(spark):
    plan = exact_dedup(frame(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_share_out():
    t = mixing.share_out([100, 100, 100], [5, 2, 1], 450, 2)
    assert t[0] == 200 and abs(sum(t) - 450) < 1e-9 and max(t) <= 200 and abs(t[1] - 500 / 3) < 1e-9
    assert mixing.share_out([], [], 0, 2) == [] and mixing.share_out([0, 0], [1, 1], 0, 2) == [0, 0]


@pytest.mark.parametrize("fan", [7, 2048])
def test_mixing(spark, fan):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(0, 40)) if rng.random() < 0.95 else None for _ in range(600)]
    sources = [rng.choice(["a", "b", "c", "é", None, "a", "a"]) for _ in texts]
    d = frame(spark, texts, sources)
    rows = mixing.mix(d, fan=fan).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(d.repartition(5), fan=fan).collect())) and len(rows) == 600
    for s in set(sources):
        mine = [r for r in rows if r.source == s]
        assert len(mine) == sources.count(s) and {r.source_size for r in mine} == {sum(r.size for r in mine)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 41
    assert all(r.size == len((texts[r.doc_id] or "").split()) and r.taken == r.copies * r.size and r.copies <= 2 for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    assert mixing.mix(d.where("false")).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [None, ""])).collect()] == [0, 0]


def test_pivot_keeps_mass_and_expectation():
    rng, size, p = np.random.default_rng(1), np.array([3.0, 8, 1, 20, 5]), np.array([0.2, 0.5, 0.9, 0.3, 0.6])
    total = np.zeros(5)
    for _ in range(4000):
        q, left = mixing.pivot(size, p, rng)
        assert abs(q @ size - p @ size) < 1e-9 and sum((q > 0) & (q < 1)) <= 1
        total += q
    assert np.abs(total / 4000 - p).max() < 0.04


def odd_texts():
    rng = random.Random(9)
    chars = [chr(c) for c in (*range(0, 0x180), *range(0x2000, 0x2070), 0x180E, 0x3000, 0xFEFF, 0x1F600, 0x0301, 0x0660, 0x00BD, 0x4E2D, 0x0130, 0x03A3, 0x212A)]
    return ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 80))) for _ in range(400)] + ["a" * 5000, "  \n\t x", "don't we'll I'M", "<|endoftext|> <|startoftext|>", "▁ ▁a", "\x1c\x1d\x1e\x1f\x85\xa0"]


def test_byte_bpe_is_the_rank_tokenizer(spark, monkeypatch):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe  # noqa: F401

    ranks = {p: i for i, p in enumerate(byte_bpe.read_ranks(RANKS))}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus(8), *odd_texts(), *[r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]]
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(frame(spark, texts), RANKS, PATTERN), RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == plain.encode_ordinary(t or ""), repr(t)[:200]
        assert bytes(got[i].decoded) == (t or "").encode()
    coder = byte_bpe.ByteBpe(RANKS, PATTERN)
    want = coder.encode("some words here")
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    assert coder.encode("some words here") == want
    assert byte_bpe.encode(frame(spark, []), RANKS, PATTERN).count() == 0
    monkeypatch.setattr(byte_bpe, "STEP", 100)
    both = {r.doc_id: r for r in byte_bpe.encode(frame(spark, texts), RANKS, PATTERN, ids="key", decoded="spans").collect()}
    assert all(both[i].key == got[i].ids and bytes(both[i].spans) == bytes(got[i].decoded) for i in range(len(texts)))


def brute_simhash(t, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [8192, 8])
def test_simhash_dedup(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    rng = random.Random(11)
    texts = corpus(11)
    base = prose(rng, 300)
    for _ in range(60):
        w = base.split(" ")
        w[rng.randrange(300)] = "other"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash_dedup.simhash_dedup(frame(spark, texts).repartition(3)).collect()}
    fp = [brute_simhash(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fp]
    comp = list(range(len(fp)))
    for _ in fp:
        new = [min(comp[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(len(fp))]
        if new == comp:
            break
        comp = new
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert simhash_dedup.simhash_dedup(frame(spark, [])).count() == 0


def test_tiles_miss_no_pair():
    masks = simhash_dedup.tile_masks(2)
    full = (1 << 64) - 1
    assert all(any(not (m & (1 << a | 1 << b)) for m in masks) for a in range(64) for b in range(a, 64)) and all(0 < m <= full for m in masks)


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = [*corpus(12), *odd_texts()]
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    rows = sorted(token_files.token_index(frame(spark, texts), WORDS, sequence=64).collect())
    at = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert tuple(rows[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)[:200]
        at += len(ids)
    assert token_files.token_index(frame(spark, []), WORDS).count() == 0


def test_word_coder_pieces_and_generations(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PIECE", 50)
    monkeypatch.setattr(token_files, "CACHE", 60)
    monkeypatch.setattr(token_files, "YOUNG", 20)
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    texts = [x or "" for x in [*corpus(13)[:40], *odd_texts(), "E\u0301 I\u0307 K\u030a, a, a. 1. \u00e9, ,, .. x., 's, I'S."]]
    got = token_files.WordCoder(WORDS).encode_all([x.encode() for x in texts])
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_file_layout(tmp_path):
    import pyarrow as pa

    ids = [np.arange(5, dtype="<u2"), np.array([], "<u2"), np.arange(9, dtype="<u2")]
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f:
        assert token_files.write_file(f, [3, 4, None], ids, np.dtype("<u2"), 4) == 14
    with pa.memory_map(str(tmp_path / "x.arrow")) as f:
        table = pa.ipc.open_file(f).read_all()
        assert table["tokens"].type.list_size == 4 and sum(map(sum, table["mask"].to_pylist())) == 14
    assert [(d, s, x.tolist()) for d, s, x in token_files.read_file(pa.memory_map(str(tmp_path / "x.arrow")))] == [(3, 0, [0, 1, 2, 3, 4]), (4, 5, []), (None, 5, list(range(9)))]


def test_line_dedup(spark):
    page = "<html><head><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><p>Own {i}<br>x  y</p><!-- <p>no</p> --><script>a<b</script></body></html>"
    rows = [(i, f"http://{'Big' if i < 8 else 'small'}.example/{i}", page.replace("{i}", str(i)), "a") for i in range(10)] + [(10, None, None, "a"), (11, "nowhere", "", "a")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in line_dedup.line_dedup(d).collect()}
    assert (got[0].host, got[0].n_lines, got[0].n_removed, got[0].kept) == ("big.example", 3, 2, "Own 0")
    assert got[9].kept == "Own 9" and got[10].n_lines == 0 and got[11].host == ""
    assert [r.kept for r in line_dedup.line_dedup(d, ratio=0.1, least_copies=1).where("host = 'big.example'").collect()] == [""] * 8
    assert line_dedup.line_dedup(d.where("false")).count() == 0
    assert not re.search("Python|Arrow|Pandas", line_dedup.line_dedup(d)._jdf.queryExecution().toString())


def test_line_dedup_takes_small_hosts(spark, sf):
    rows = [(i, f"http://{h}/{i}", f"<p>Home</p><p>Own {i}</p>") for i, h in enumerate("aaaabbc")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = line_dedup.line_dedup(d).orderBy("page_id").collect()
    assert [r.kept for r in got] == [f"Own {i}" for i in range(6)] + ["Home\nOwn 6"]
    lines, removed = {r.page_id: r for r in line_dedup.line_dedup(spark.read.parquet(f"{sf}/pages.parquet"), least_pages=10**9).collect()}, {}
    for h in {r.host for r in lines.values()}:
        own = [r for r in lines.values() if r.host == h]
        on = Counter(x for r in own for x in set(r.kept.split("\n")) - {""})
        removed |= {r.page_id: sum(on[x] > max(1, 0.3 * len(own)) for x in r.kept.split("\n") if x) for r in own}
    assert {r.page_id: r.n_removed for r in queries.op10_line_dedup(spark, sf).collect()} == removed


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)] + [(2000 + k, 2001 + k) for k in range(60)]
    up = {}
    for a, b in pairs:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(80):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in up.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spread_hot(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(3)], "key long, item long")
    got = spread_hot(rows, "key", "item", 10).collect()
    met = Counter()
    for key in (1, 2):
        for tile in {r.tile for r in got if r.key == key}:
            mine = [r for r in got if r.key == key and r.tile == tile]
            cross = any(r.side for r in mine)
            met.update((key, a.item, b.item) for a in mine for b in mine if a.item != b.item and (a.side < b.side if cross else a.item < b.item))
    pairs = Counter((k, *sorted(p)) for k, *p in met.elements())
    assert len(pairs) == 50 * 49 // 2 + 3 and set(pairs.values()) == {1}
