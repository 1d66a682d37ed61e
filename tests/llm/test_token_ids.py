"""Token files against the library as it stands, and random access without copies."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from stanzaflow.llm import queries, shared, token_files
from test_llm import DOCS, WORDS, corpus, frame, odd_texts
from tokenizers import Tokenizer

AWKWARD = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y", "<|EndOfText|>", "<|endoftext", "İ.", "İ .", "T̈", "ẗ T̈.", "KΣ Σ", "a\xa0b\x85c d", "İ, don't 'S we'LL", "", " ", "̈x", "x ̈"]


def alike_words():
    """Two words that a polynomial hash modulo 2 ** 64 can't tell apart (Thue-Morse over a and b)."""
    bits = [i.bit_count() & 1 for i in range(1024)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


@pytest.mark.parametrize("texts", [AWKWARD, alike_words() + [" ".join(alike_words())], odd_texts(), corpus(14)[:60]])
def test_query_gives_the_ids_of_the_untouched_library(spark, tmp_path, texts):
    plain, at = Tokenizer.from_file(WORDS), 0
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in queries.op9_token_files(spark, str(tmp_path)).collect())
    for i, text in enumerate(texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert rows[i] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)[:200]
        at += len(ids)


@pytest.mark.parametrize("as_text", [True, False])
def test_random_texts(as_text, monkeypatch):
    monkeypatch.setattr(token_files, "YOUNG", 500)
    monkeypatch.setattr(token_files, "PIECE", 40)
    rng, plain = random.Random(5), Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = as_text
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\t", "\n", "\x85", "\xa0", "̈", "̇", "İ", "Σ", "K", "T", "é", "'s", "'LL", "it", ".", ",", "9", "٠", "中", "\U0001f600", "Word", "and"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x300, 0x590), rng.randrange(0x1E00, 0x2100)))) for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    got = token_files.WordCoder(WORDS, as_text).encode_all([t.encode() for t in texts])
    for t, g, e in zip(texts, got, plain.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert g.tolist() == e.ids, repr(t)


def test_words_of_one_name_are_told_apart(monkeypatch):
    """Even if all names were equal."""
    from stanzaflow.llm import words

    plain = Tokenizer.from_file(WORDS)
    texts = ["one two", "one", "two three, one", "", "long" * 9, "x " * 40, "long" * 8 + "lone", *AWKWARD]
    for bits in (0, 1, 3):
        monkeypatch.setattr(token_files, "word_names", lambda body, bits=bits: (lambda x: (x[0] & np.uint64(bits), *x[1:]))(words.word_names(body)))
        coder = token_files.WordCoder(WORDS, False)
        for _ in range(2):
            for t in ([x] for x in texts), [texts]:
                for part in t:
                    got = coder.encode_all([x.encode() for x in part])
                    assert [g.tolist() for g in got] == [plain.encode(x, add_special_tokens=False).ids for x in part]


def test_sequences_are_views_of_the_mapped_file(tmp_path):
    path, ids = str(tmp_path / "x.arrow"), [np.arange(k, dtype="<u2") for k in (5, 0, 3000, 7, 1)]
    with pa.OSFile(path, "wb") as sink:
        total = token_files.write_file(sink, [3, 4, None, 8, 9], ids, np.dtype("<u2"), 8)
    held = pa.memory_map(path)
    whole = held.read_buffer(held.size())
    before = pa.total_allocated_bytes()
    file = token_files.TokenFile(held)
    flat = np.concatenate(ids)
    assert len(file) == -(-total // 8) > token_files.BATCH
    for i in range(len(file)):
        x, m = file.tokens(i), file.mask(i)
        want = flat[8 * i : 8 * i + 8]
        assert x[: len(want)].tolist() == want.tolist() and m.to_pylist() == [k < len(want) for k in range(8)]
        assert whole.address <= x.ctypes.data < whole.address + whole.size and not x.flags.owndata and not x.flags.writeable
        assert whole.address <= m.buffers()[1].address < whole.address + whole.size
    assert pa.total_allocated_bytes() - before < 10_000
    with pytest.raises(IndexError):
        file.tokens(len(file))
    assert [(d, s, x.tolist()) for d, s, x in file.documents()] == [(d, s, x.tolist()) for d, s, x in zip([3, 4, None, 8, 9], [0, 5, 5, 3005, 3012], ids)]


def test_missing_files_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        token_files.read_tokens(spark, f"file://{tmp_path}/nothing")
    empty = token_files.token_index(spark.createDataFrame([], DOCS), WORDS, special_as_text=False)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_odd_rows(spark):
    rows = sorted(token_files.token_index(frame(spark, ["b", None, "a", "a"], ids=[7, None, 7, 7]), WORDS).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 1), (7, 1, 2), (7, 3, 2), (7, 5, 2)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
