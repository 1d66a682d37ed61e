"""Token ids in Arrow files of equal-length sequences, written in document order and read back.

A file holds the documents of one block, a range of doc_ids, as an Arrow IPC file: record
batches of ``tokens`` (fixed-size list of unsigned ids), ``mask`` (fixed-size list of
booleans, false where the last sequence is padded) and ``docs`` (which documents begin in
the sequence, where in the file and with how many ids). Buffers aren't compressed, so a
memory-mapped file gives any sequence without a copy (``TokenFile``).
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from . import blocks as B
from .shared import cut, fresh_dir
from .words import word_names

# a task has one core: more threads only wait for each other
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 256
#: Words whose ids a worker remembers at most, but for the words of one piece, and those that it adds to the old ones at once.
CACHE, YOUNG = 1_500_000, 150_000
#: Bytes of text whose words are looked up at once, and words that the library gets at once.
PIECE, STEP = 4 << 20, 4096
END = 1
#: The tokenizer's own pattern of pre-tokens, and what it comes to on lower-case ASCII without an apostrophe.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


class _Words:
    """Known words in flat arrays, sorted by name: their bytes, their ids, and where both lie."""

    def __init__(self, kind: np.dtype):
        none = np.zeros(0, np.int64)
        self.names, self.at, self.n, self.ids = np.zeros(0, np.uint64), none, none, np.zeros(0, kind)
        self.text_at, self.size, self.text = none, none, np.zeros(8, np.uint8)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each name, and whether it is there."""
        if not len(self.names):
            return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        row = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return row, self.names[row] == names

    def add(self, other: "_Words") -> None:
        both = np.concatenate([self.names, other.names])
        order = np.argsort(both, kind="stable")
        join = lambda a, b, shift: np.concatenate([a, b + shift])[order]
        self.names, self.n, self.size = both[order], join(self.n, other.n, 0), join(self.size, other.size, 0)
        self.at, self.text_at = join(self.at, other.at, len(self.ids)), join(self.text_at, other.text_at, len(self.text) - 8)
        self.ids, self.text = np.concatenate([self.ids, other.ids]), np.concatenate([self.text[:-8], other.text])


def same_bytes(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[x : x + size] and b[y : y + size] are equal, for all x, y and sizes; both arrays have 8 bytes more."""
    out, todo, at = np.ones(len(x), bool), np.arange(len(x)), 0
    wa, wb = (np.ndarray((len(t) - 7,), "<u8", t, strides=(1,)) for t in (a, b))
    while len(todo):
        left = np.minimum(size[todo] - at, 8).astype(np.uint64)
        differ = (wa[x[todo] + at] ^ wb[y[todo] + at]) << ((np.uint64(8) - left) * np.uint64(8))
        out[todo[differ != 0]] = False
        at += 8
        todo = todo[(size[todo] > at) & (differ == 0)]
    return out


class WordCoder:
    """Ids of texts by the library; words between ASCII white space are remembered by their bytes.

    The tokenizers meant here (NFC, lower case, white space dropped) never join across ASCII
    white space and nothing composes with it, so a text's ids are those of its words. Each
    distinct word goes to the library once, whole; where the tokenizer has the pattern
    ``_PATTERN``, ASCII words without an apostrophe go as the pre-tokens that it makes of
    them in lower case, which share more. Words with other characters are never changed. A
    word is found by a 64-bit name and then compared by its bytes; texts in which two words
    share a name go to the library whole, as do those that spell out an added token, unless
    ``special_as_text`` says that such spellings are ordinary text. Two generations of words
    are remembered: the young one, of up to YOUNG words, joins the old one, which starts
    anew when it holds CACHE words.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # no word comes twice
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = [] if special_as_text else [t.content.encode() for t in added]
        if not special_as_text and any(t.normalized for t in added):
            raise ValueError("an added token that is sought in normalised text can't be found word by word")
        vocabulary, said = self.tokenizer.get_vocab(), json.loads(self.tokenizer.to_str())
        self.kind = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        suffix = said["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.parts = json.dumps(said["pre_tokenizer"]).find(json.dumps(_PATTERN)) >= 0 and bool(suffix)
        self.old, self.young = _Words(self.kind), _Words(self.kind)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out, group, size = [], [], 0
        for text in texts:
            if any(m in text for m in self.marks):
                out += self._by_words(group) + [self._whole(text)]
                group, size = [], 0
            elif len(text) > PIECE:
                out += self._by_words(group) + [np.concatenate([x for p in _pieces(text) for x in self._by_words([p])])]
                group, size = [], 0
            else:
                group.append(text)
                size += len(text)
                if size > PIECE:
                    out += self._by_words(group)
                    group, size = [], 0
        return out + self._by_words(group)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.kind)

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        body = b"\n".join(texts)
        names, s, e = word_names(body)
        if not len(names):
            return [np.zeros(0, self.kind)] * len(texts)
        padded = np.frombuffer(body + bytes(8), np.uint8)
        name, first, which = np.unique(names, return_index=True, return_inverse=True)
        size, s1 = e - s, s[first]
        alike = (size == size[first][which]) & same_bytes(padded, s, padded, s1[which], np.minimum(size, size[first][which]))
        n, at, ids = np.zeros(len(name), np.int64), np.zeros(len(name), np.int64), []
        missing, base = np.ones(len(name), bool), 0
        for known in (self.young, self.old):
            row, hit = known.find(name)
            hit &= missing
            row, hits = row[hit], np.flatnonzero(hit)
            fits = known.size[row] == size[first[hits]]
            fits &= same_bytes(known.text, known.text_at[row], padded, s1[hits], np.where(fits, known.size[row], 0))
            alike &= ~np.isin(which, hits[~fits]) if not fits.all() else True
            n[hits], at[hits] = known.n[row], known.at[row] + base
            missing[hits] = False
            ids.append(known.ids)
            base += len(known.ids)
        if missing.any():
            new = np.flatnonzero(missing)
            a, b = s1[new].tolist(), e[first[new]].tolist()
            coded = self._coded([body[x:y] for x, y in zip(a, b)])
            found = _Words(self.kind)
            found.names, found.n, found.size = name[new], np.fromiter(map(len, coded), np.int64, len(coded)) // self.kind.itemsize, size[first[new]]
            found.at, found.text_at = np.cumsum(found.n) - found.n, np.cumsum(found.size) - found.size
            found.ids = np.frombuffer(b"".join(coded), self.kind)
            found.text = np.frombuffer(b"".join([body[x:y] for x, y in zip(a, b)]) + bytes(8), np.uint8)
            n[new], at[new] = found.n, found.at + base
            ids.append(found.ids)
        flat, n, at = np.concatenate(ids), n[which], at[which]
        begins = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(at - begins[:-1], n) + np.arange(begins[-1])]
        if missing.any():
            self.young.add(found)
            if len(self.young.names) > min(YOUNG, CACHE):
                if len(self.old.names) > CACHE:
                    self.old = _Words(self.kind)
                self.old.add(self.young)
                self.young = _Words(self.kind)
        turns = np.searchsorted(s, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        out = [ids[a:b] for a, b in zip(begins[turns[:-1]].tolist(), begins[turns[1:]].tolist())]
        for k in np.unique(np.searchsorted(turns, np.flatnonzero(~alike), side="right") - 1).tolist():
            out[k] = self._whole(texts[k])
        return out

    def _coded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes."""
        known: dict[bytes, bytes] = {}
        parted = [None] * len(words)
        if self.parts:
            words = [w.lower() if w.isalpha() else w for w in words]
            for i, w in enumerate(words):
                if not w.isalpha() and w.isascii() and b"'" not in w:
                    parted[i] = (w[:-1].lower(), w[-1:]) if w[:-1].isalpha() and not w[-1:].isdigit() else _PARTS.findall(w.lower())
        new = dict.fromkeys(x for w, p in zip(words, parted, strict=True) for x in (p or (w,)))
        letters = [w for w in new if w.isalpha()]  # of bytes: ASCII letters only
        alone = [w for w in new if not w.isalpha()]
        for at in range(0, len(letters), STEP):
            alone += self._letters(letters[at : at + STEP], known)
        for at in range(0, len(alone), STEP):
            step = alone[at : at + STEP]
            for w, x in zip(step, self.tokenizer.encode_batch_fast([w.decode() for w in step], add_special_tokens=False), strict=True):
                known[w] = np.array(x.ids, self.kind).tobytes()
        return [known[w] if p is None else b"".join([known[x] for x in p]) for w, p in zip(words, parted, strict=True)]

    def _letters(self, words: list[bytes], known: dict[bytes, bytes]) -> list[bytes]:
        """Encodes words of ASCII letters, each one pre-token, as one text parted at the ends of words; returns them if that isn't so."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return words
        flat, at = ids.tobytes(), 0
        for w, end in zip(words, (ends * self.kind.itemsize).tolist(), strict=True):
            known[w] = flat[at:end]
            at = end
        return []


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at spaces or line ends."""
    at = 0
    while at < len(text):
        ends = [x for x in (text.find(b" ", at + PIECE), text.find(b"\n", at + PIECE)) if x >= 0]
        end = min(ends, default=len(text))
        yield text[at:end]
        at = end


@functools.lru_cache(maxsize=2)
def _coder(path: str, special_as_text: bool) -> WordCoder:
    return WordCoder(path, special_as_text)


DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))


def write_file(sink, doc_ids: list[int | None], ids: list[np.ndarray], kind: np.dtype, sequence: int = SEQUENCE) -> int:
    """Writes one file of the documents' ids and returns how many ids it holds."""
    n = np.array([len(x) for x in ids], np.int64)
    start = np.cumsum(n) - n
    total = int(n.sum())
    rows = -(-total // sequence)
    flat = np.zeros(rows * sequence, kind)
    if ids:
        flat[:total] = np.concatenate(ids)
    item = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    schema = pa.schema([("tokens", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence)), ("docs", DOCS)])
    first = np.searchsorted(start, np.arange(rows + 1, dtype=np.int64) * sequence)
    first[-1:] = len(ids)
    with pa.ipc.new_file(sink, schema) as out:
        for at in range(0, rows, BATCH):
            upto = min(rows, at + BATCH)
            tokens = pa.FixedSizeListArray.from_arrays(pa.array(flat[at * sequence : upto * sequence], item), sequence)
            mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(at * sequence, upto * sequence) < total), sequence)
            docs = [[{"doc_id": doc_ids[k], "start": int(start[k]), "n": int(n[k])} for k in range(first[i], first[i + 1])] for i in range(at, upto)]
            out.write_batch(pa.record_batch([tokens, mask, pa.array(docs, DOCS)], schema=schema))
    return total


class TokenFile:
    """Random access to the sequences of one file; what it returns are views of the file's bytes.

    ``source`` is a path, which is mapped into memory, or an Arrow buffer or file. Batches
    are found by the footer, so sequence ``i`` costs one look-up and no copy.
    """

    def __init__(self, source):
        self.reader = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else source)
        self.sequence_length = self.reader.schema.field("tokens").type.list_size
        batches = self.reader.num_record_batches
        self.full = self.reader.get_batch(0).num_rows if batches else 1
        self.rows = (batches - 1) * self.full + self.reader.get_batch(batches - 1).num_rows if batches else 0

    def __len__(self) -> int:
        return self.rows

    def _part(self, i: int, column: str) -> pa.Array:
        if not 0 <= i < self.rows:
            raise IndexError(i)
        return self.reader.get_batch(i // self.full).column(column).slice(i % self.full, 1).flatten()

    def tokens(self, i: int) -> np.ndarray:
        """The ids of sequence ``i``, padding included, as a read-only view."""
        return self._part(i, "tokens").to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.Array:
        """Which of them count, as a view of the file's bits."""
        return self._part(i, "mask")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document; only one that crosses batches is joined by a copy."""
        if not self.rows:
            return
        batches = [self.reader.get_batch(k) for k in range(self.reader.num_record_batches)]
        flat = [b.column("tokens").flatten().to_numpy(zero_copy_only=True) for b in batches]
        step = self.full * self.sequence_length
        for b in batches:
            docs = b.column("docs").flatten()
            start, n = docs.field(1).to_numpy(), docs.field(2).to_numpy()
            for doc_id, s, k in zip(docs.field(0).to_pylist(), start.tolist(), n.tolist(), strict=True):
                first, last = s // step, max(s, s + k - 1) // step
                parts = [flat[j][max(0, s - j * step) : s + k - j * step] for j in range(first, last + 1) if j < len(flat)]
                yield doc_id, s, parts[0] if len(parts) == 1 else np.concatenate(parts or [flat[0][:0]])


def read_file(content) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document of a file."""
    return TokenFile(content).documents()


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, sequence: int = SEQUENCE, special_as_text: bool = True) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` and writes ``folder/block-NNNNNNNN.arrow``; returns ``block, n_tokens`` of each file.

    Files follow each other in ascending doc_id (null ids first, repeated ids ordered by
    a hash of the text). Every document ends with id 1; a null text is empty and has that id alone. The
    folder is a URI that every executor reaches. A file is written under another name and
    renamed, so a repeated task replaces it by the same bytes.
    """
    base = B.deal(docs)

    def write(key: tuple, table: pa.Table) -> pa.Table:
        coder, rows = _coder(tokenizer, special_as_text), B.unpack(table)
        end = np.array([END], coder.kind)
        ids = [np.concatenate([x, end]) for x in coder.encode_all([body for _, body in rows])]
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"block-{key[0].as_py():08d}.arrow"
        draft = f"{path}/_{uuid.uuid4().hex}-{name}"
        with fs.open_output_stream(draft) as sink:
            n = write_file(sink, [i for i, _ in rows], ids, coder.kind, sequence)
        fs.move(draft, f"{path}/{name}")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n_tokens": pa.array([n], pa.int64())})

    return cut(base.rows.groupBy("block").applyInArrow(write, "block int, n_tokens long"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``block, doc_id, local_start, n_tokens, ids_crc32`` of each document of a folder's files.

    A folder without files is an error: what was written isn't where this session looks.
    """
    kind = "block int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(f"{folder}/block-*.arrow")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in read_file(pa.BufferReader(content.as_buffer()))]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], ["block", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    return files.select(F.regexp_extract("path", r"block-(\d+)\.arrow$", 1).cast("int").alias("block"), "content").mapInArrow(read, kind)


def token_index(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, special_as_text: bool = True) -> DataFrame:
    """Writes token files to the shared folder and returns ``doc_id, start, n_tokens, ids_crc32`` read back from them.

    ``start`` counts the ids of all documents before. ``special_as_text``: spellings of
    special tokens in a text are ordinary text, so that a text can't forge a mark; if
    false, they become the tokens' ids, as the library does unless told otherwise. A null
    text is empty; very long texts are encoded in pieces cut at white space. An empty table
    gives an empty result; files that were written but aren't found are an error.
    """
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    files = write_tokens(docs, tokenizer, folder, sequence, special_as_text)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    starts = files.select("block", before.alias("before"))
    if files.isEmpty():
        return starts.select(F.lit(0).cast("long").alias("doc_id"), F.col("before").alias("start"), F.col("before").alias("n_tokens"), F.col("before").alias("ids_crc32"))
    return read_tokens(spark, folder).join(starts, "block").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
