"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Strings of ``length`` bytes (100) are compared. Documents are cut into *pieces* that
overlap by ``length - 1`` bytes, pieces lie in blocks of a few MB.

1. Settle. Of every ``COVER_PERIOD`` (57) places of a piece, the 8 whose remainder is in a
   perfect difference set are cover samples. For any two places there is one shift below
   57 that takes both to samples, so two equal strings of 100 bytes hold two samples whose
   next 100 - 57 + 1 = 44 bytes are equal. Blocks and buckets exchange 64-bit names of
   those 44 bytes; a suffix none of whose samples has a name that occurs again can't agree
   with another for 100 bytes. The others are named by their 100 bytes and exchanged the
   same way, so that few but those that recur are left. Names only settle, they remove
   nothing.
2. Sort. What is left goes, as runs of text, to the bucket of its least 8-byte string by
   hash (equal suffixes have the same one), equal runs of a block once. A bucket sorts its
   suffixes by their bytes, one bucket at a time: by the first 8 bytes, then, since for
   any two places one shift below ``SORT_PERIOD`` (7) takes both to samples of a second
   cover, by the ranks of those samples, which prefix doubling computed before. So a long
   tie costs one look-up, and ranks are held for 3 of 7 places only.
3. Neighbours in suffix order that agree in 100 bytes, compared byte by byte, are equal
   strings; each but the first is marked, and every byte that a marked string covers is
   removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .words import Sums

COVER_PERIOD = 57
#: A perfect difference set: each remainder but 0 is one difference of two members.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: The cover of the sort in a bucket, a perfect difference set too.
SORT_PERIOD, SORT_COVER = 7, (0, 1, 3)
#: Keys in a bucket of names, about, and bits of a name inside its bucket.
BUCKET_KEYS, NAME_BITS = 4 << 20, 32
#: Text bytes of the corpus for one bucket of suffixes.
SORT_BYTES = 4 << 20
#: Suffixes of a piece of a document.
PIECE = 57 << 15

_COVERED = np.zeros(COVER_PERIOD, bool)
_COVERED[list(COVER)] = True
SPANS = "array<struct<start:long,stop:long>>"
OUT = f"doc_id long, n_bytes long, spans {SPANS}, kept binary"
RUNS = "bucket int, block int, body binary"


def _samples(n: int) -> np.ndarray:
    return np.flatnonzero(np.resize(_COVERED, n))


def words8(body: bytes) -> np.ndarray:
    """The 8 bytes at each place as a number that sorts like them; the body needs 7 bytes behind the last place."""
    return np.ndarray((max(0, len(body) - 7),), ">u8", body, strides=(1,))


def least_places(body: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes the place of its least 8-byte string by hash, the first of equals, and its hash."""
    word = words8(body).astype(np.uint64)
    h = B.mix(word, word)
    m, have, reach = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), 1, length - 7
    while have * 2 <= reach:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    if reach > have:
        m = np.minimum(m[: have - reach], m[reach - have :])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64), m >> np.uint64(32)


class SortCover:
    """Ranks of the cover samples of a text by their next ``depth`` bytes at least; equal strings have equal ranks."""

    def __init__(self, word: np.ndarray, depth: int):
        slots = -(-len(word) // SORT_PERIOD)
        place = (np.arange(slots)[:, None] * SORT_PERIOD + np.array(SORT_COVER)).ravel()
        inside = place < len(word)
        first = np.zeros(len(place), np.uint64)
        first[inside] = word[place[inside]]
        rank = np.unique(first, return_inverse=True)[1]
        step, have = len(SORT_COVER), SORT_PERIOD
        while have < depth + SORT_PERIOD and len(rank) and rank.max() + 1 < len(rank):
            behind = np.zeros(len(rank), np.int64)
            behind[: max(0, len(rank) - step)] = rank[step:] + 1
            rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1]
            step, have = step * 2, have * 2
        self.rank = rank
        self.slot = np.full(SORT_PERIOD, -1)
        self.slot[list(SORT_COVER)] = np.arange(len(SORT_COVER))
        r = np.arange(SORT_PERIOD)
        both = (self.slot[(r[:, None, None] + r) % SORT_PERIOD] >= 0) & (self.slot[(r[None, :, None] + r) % SORT_PERIOD] >= 0)
        self.shift = both.argmax(2)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the order of the suffixes at ``a`` and ``b``, whose first SORT_PERIOD bytes are equal."""
        shift = self.shift[a % SORT_PERIOD, b % SORT_PERIOD]
        x, y = a + shift, b + shift
        at = lambda p: self.rank[p // SORT_PERIOD * len(SORT_COVER) + self.slot[p % SORT_PERIOD]]
        return np.sign(at(x) - at(y))


def suffix_order(body: bytes, place: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the suffixes at ``place`` in the order of their first ``length`` bytes (ties in any order)."""
    word = words8(body + bytes(length + 16)).astype(np.uint64)
    cover = SortCover(word, length)
    order = np.argsort(word[place], kind="stable")
    head = word[place[order]]
    group = np.cumsum(np.concatenate([[False], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
    todo, rng = np.arange(len(order)), np.random.default_rng(0)
    while True:
        # groups whose order is open: more than one suffix, not yet found equal
        n = np.bincount(group[todo]) if len(todo) else np.zeros(1, int)
        todo = todo[n[group[todo]] > 1]
        if not len(todo):
            return order
        g = group[todo]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(start, append=len(g))
        pivot = place[order[todo[start + (rng.random(len(start)) * size).astype(np.int64)]]]
        said = cover.compare(place[order[todo]], np.repeat(pivot, size))
        # todo lies in ascending slots of the order, so a stable sort by group keeps groups in their slots
        key = np.repeat(np.arange(len(start)), size) * 3 + said + 1
        turn = np.argsort(key, kind="stable")
        order[todo], key = order[todo[turn]], key[turn]
        new = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        group = group.copy()
        group[todo] = new
        todo = todo[key % 3 != 1]


def repeats(body: bytes, place: np.ndarray, length: int) -> np.ndarray:
    """For each of the ascending places: whether its ``length`` bytes also stand at an earlier one of them."""
    out = np.zeros(len(place), bool)
    if len(place) < 2:
        return out
    order = suffix_order(body, place, length)
    p, word = place[order], words8(body + bytes(8))
    same = np.arange(len(p) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[word[p[same] + at] == word[p[same + 1] + at]]
    joined = np.zeros(len(p), bool)
    joined[same + 1] = True
    start = np.flatnonzero(~joined)
    first = np.minimum.reduceat(order, start)
    out[order] = order != np.repeat(first, np.diff(start, append=len(p)))
    return out


def judge(cells: list[bytes], length: int) -> list[np.ndarray]:
    """For each cell of a bucket, in block order: a bool of each suffix of its runs, True if its bytes came before."""
    kept: dict[bytes, int] = {}
    held: list[list[tuple[int, bool]]] = []
    for x in cells:
        held.append([])
        for run in unpack_runs(x):
            new = run not in kept
            held[-1].append((kept.setdefault(run, len(kept)), new))
    runs = list(kept)
    n = np.array([len(r) - length + 1 for r in runs], np.int64)
    begin = np.cumsum([len(r) for r in runs]) - [len(r) for r in runs]
    ends = np.cumsum(n)
    place = np.repeat(begin - (ends - n), n) + np.arange(int(n.sum()))
    said = repeats(b"".join(runs), place, length)
    return [np.concatenate([said[ends[k] - n[k] : ends[k]] if new else np.ones(n[k], bool) for k, new in cell] or [np.zeros(0, bool)]) for cell in held]


def pack_runs(runs: list[bytes]) -> bytes:
    sizes = np.array([len(r) for r in runs], "<u4")
    return len(runs).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(runs))


def unpack_runs(x: bytes) -> Iterator[bytes]:
    n = int.from_bytes(x[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(x[4:], max_output_size=1 << 31)
    ends = np.cumsum(np.frombuffer(body, "<u4", n), dtype=np.int64) + 4 * n
    for a, b in zip(np.concatenate([[4 * n], ends[:-1]]).tolist(), ends.tolist()):
        yield body[a:b]


class _Batch:
    """Pieces of a block that lie behind each other in one text, so that small documents are handled together."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int):
        self.length, self.tie = length, length - COVER_PERIOD + 1
        self.doc, self.at = np.array([k for k, _, _ in pieces]), np.array([at for _, at, _ in pieces])
        self.body = b"".join([x for _, _, x in pieces])
        self.size = np.array([len(x) for _, _, x in pieces])
        self.start = np.cumsum(self.size) - self.size

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the cover samples whose strings lie in one piece, and their pieces."""
        s = _samples(len(self.body) - self.tie + 1)
        owner = np.searchsorted(self.start, s, side="right") - 1
        inside = s + self.tie <= (self.start + self.size)[owner]
        return s[inside], owner[inside]

    def names(self, places: np.ndarray, length: int) -> np.ndarray:
        return Sums(self.body).names(places, length)


class _Block:
    """One block's documents, cut into pieces, with the names that it exchanges."""

    def __init__(self, table: pa.Table, length: int, buckets: int, piece: int):
        self.docs, self.length, self.buckets, self.batches = B.unpack(table), length, buckets, []
        pieces, size = [], 0
        for k, (_, body) in enumerate(self.docs):
            for at in range(0, len(body) - length + 1, piece):
                pieces.append((k, at, body[at : at + piece + length - 1]))
                size += len(pieces[-1][2])
                if size >= piece:
                    self.batches.append(_Batch(pieces, length))
                    pieces, size = [], 0
        if pieces:
            self.batches.append(_Batch(pieces, length))

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sorted names of the samples, the name number of each sample, and how often each name occurs here."""
        found = [np.zeros(0, np.uint64), *(B.split_buckets(b.names(b.samples()[0], b.tie), self.buckets, NAME_BITS) for b in self.batches)]
        return np.unique(np.concatenate(found), return_inverse=True, return_counts=True)

    def open_places(self, tied: np.ndarray) -> list[np.ndarray]:
        """The places of each batch's unsettled suffixes: those that a tied sample follows within the period."""
        used, out = 0, []
        for b in self.batches:
            s, owner = b.samples()
            used += len(s)
            on = tied[used - len(s) : used]
            s, first = s[on], b.start[owner[on]]
            last = first + b.size[owner[on]] - self.length + 1  # behind the last suffix of the piece
            edge = np.zeros(len(b.body) + 1, np.int32)
            np.add.at(edge, np.minimum(np.maximum(s - COVER_PERIOD + 1, first), last), 1)
            np.add.at(edge, np.minimum(s + 1, last), -1)
            out.append(np.flatnonzero(np.cumsum(edge[:-1]) > 0))
        return out

    def suffixes(self, places: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as samples() for the unsettled suffixes, named by all their bytes."""
        found = [np.zeros(0, np.uint64), *(B.split_buckets(b.names(p, self.length), buckets, NAME_BITS) for b, p in zip(self.batches, places, strict=True) if len(p))]
        return np.unique(np.concatenate(found), return_inverse=True, return_counts=True)

    def runs(self, places: list[np.ndarray], again: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(document, first place, suffixes, bucket, text) of each run of recurring suffixes with one least string."""
        used, doc, first, last, texts = 0, [], [], [], []
        for batch, p in zip(self.batches, places, strict=True):
            used += len(p)
            p = p[again[used - len(p) : used]]
            if len(p):
                piece = np.searchsorted(batch.start, p, side="right") - 1
                turn = np.flatnonzero(np.concatenate([[True], (p[1:] > p[:-1] + 1) | (piece[1:] != piece[:-1])]))
                a, b = p[turn], p[np.append(turn[1:], len(p)) - 1]
                texts += [batch.body[x : y + self.length] for x, y in zip(a.tolist(), b.tolist())]
                shift = (batch.at - batch.start)[piece[turn]]
                doc.append(batch.doc[piece[turn]])
                first.append(a + shift)
                last.append(b + shift)
        if not texts:
            return
        # neighbouring suffixes are hashed together; strings that cross from one text into the next are left out
        body = b"".join(texts)
        doc, first, n = np.concatenate(doc), np.concatenate(first), np.concatenate(last) - np.concatenate(first) + 1
        least, h = least_places(body, self.length)
        begin = np.cumsum(n + self.length - 1) - (n + self.length - 1)
        inside = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        owner, least = np.repeat(np.arange(len(n)), n), least[inside]
        start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
        size, at, owner = np.diff(start, append=len(least)), inside[start], owner[start]
        h = h[at].astype(np.uint64)
        bucket = ((B.mix(h, h) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        place = first[owner] + at - begin[owner]
        for k, x, m, c, y in zip(doc[owner].tolist(), place.tolist(), size.tolist(), bucket.tolist(), at.tolist()):
            yield k, x, m, c, body[y : y + m + self.length - 1]


def suffix_dedup(docs: DataFrame, length: int = 100, piece: int = PIECE) -> DataFrame:
    """Cut from every document the bytes of ``length``-byte strings that also start earlier.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id``,
    ``n_bytes``, ``spans`` (maximal removed runs as byte offsets) and ``kept`` (remaining
    bytes, which may cut a character). Earlier means a smaller doc_id, or the same document
    and an earlier start. A null text is empty; texts under ``length`` bytes lose nothing;
    very long texts are handled in pieces of ``piece`` bytes. Rows that repeat a doc_id are separate documents,
    ordered by a hash of their text; null ids come first. An empty table gives an empty
    result.
    """
    if length < COVER_PERIOD + 7:
        raise ValueError(f"length must be at least {COVER_PERIOD + 7}")
    base = B.deal(docs)
    # bucket counts are only tuning; about a fifth of all suffixes is unsettled in texts with many copies
    n_ranks = max(12, min(1 << 16, base.total_bytes * len(COVER) // COVER_PERIOD // BUCKET_KEYS))
    n_suffix = max(12, min(1 << 16, base.total_bytes // 5 // BUCKET_KEYS))
    n_sort = max(8, base.total_bytes // SORT_BYTES)

    def replies(table: pa.Table, about: int) -> pa.Table:
        return table.filter(pa.array(table["about"].to_numpy() == about))

    def send_samples(key: tuple, table: pa.Table) -> pa.Table:
        keys, _, n = _Block(table, length, n_ranks, piece).samples()
        return B.cells(key[0].as_py(), keys, n > 1, n_ranks, NAME_BITS)

    def open_places(block: _Block, table: pa.Table) -> list[np.ndarray]:
        keys, which, _ = block.samples()
        return block.open_places(B.heard(table, keys, n_ranks, NAME_BITS)[which])

    def send_suffixes(key: tuple, table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.cells(0, np.zeros(0, np.uint64), np.zeros(0, bool), n_suffix, NAME_BITS)
        block = _Block(table, length, n_ranks, piece)
        keys, _, n = block.suffixes(open_places(block, heard), n_suffix)
        return B.cells(key[0].as_py(), keys, n > 1, n_suffix, NAME_BITS)

    def runs(table: pa.Table, heard: pa.Table) -> tuple[_Block, Iterator[tuple[int, int, int, int, bytes]]]:
        block = _Block(table, length, n_ranks, piece)
        places = open_places(block, replies(heard, 0))
        keys, which, _ = block.suffixes(places, n_suffix)
        return block, block.runs(places, B.heard(replies(heard, 1), keys, n_suffix, NAME_BITS)[which], n_sort)

    def send_runs(key: tuple, table: pa.Table, heard: pa.Table) -> pa.Table:
        mine: dict[int, dict[bytes, None]] = {}
        if table.num_rows:
            for _, _, _, bucket, text in runs(table, heard)[1]:
                mine.setdefault(bucket, {})[text] = None
        bodies = [pack_runs(list(x)) for x in mine.values()]
        return pa.table({"bucket": pa.array(list(mine), pa.int32()), "block": pa.array([key[0].as_py()] * len(mine), pa.int32()), "body": pa.array(bodies, pa.binary())})

    def sort_bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bits = [np.packbits(x).tobytes() for x in judge([x.as_py() for x in table["body"]], length)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    def remove(key: tuple, table: pa.Table, heard: pa.Table) -> pa.Table:
        block, found = runs(table, heard)
        said = replies(heard, 2)
        bits = {k: np.unpackbits(np.frombuffer(x.as_py(), np.uint8)).astype(bool) for k, x in zip(said["bucket"].to_pylist(), said["bits"], strict=True)}
        used, met = dict.fromkeys(bits, 0), set()
        gone: list[list[np.ndarray]] = [[] for _ in block.docs]
        for k, at, n, bucket, text in found:
            if (bucket, text) in met:
                gone[k].append(np.arange(at, at + n))
            else:
                met.add((bucket, text))
                gone[k].append(at + np.flatnonzero(bits[bucket][used[bucket] : used[bucket] + n]))
                used[bucket] += n
        rows = []
        for (doc_id, body), marked in zip(block.docs, gone, strict=True):
            s = np.concatenate([np.zeros(0, np.int64), *marked])
            new = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + length]))[: len(s)]
            spans = list(zip(s[new].tolist(), (s[np.append(new[1:], len(s)) - 1] + length).tolist())) if len(s) else []
            edges = [0, *(x for span in spans for x in span), len(body)]
            kept = b"".join([body[a:b] for a, b in zip(edges[::2], edges[1::2])])
            rows.append((doc_id, len(body), [{"start": a, "stop": b} for a, b in spans], kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "spans": pa.array(cols[2], kind), "kept": pa.array(cols[3], pa.binary())})

    by_block = base.rows.groupBy("block")
    answers = B.answer(by_block.applyInArrow(send_samples, B.CELL), B.recurring).withColumn("about", F.lit(0))
    named = by_block.cogroup(answers.groupBy("block")).applyInArrow(send_suffixes, B.CELL)
    answers = answers.unionAll(B.answer(named, B.recurring).withColumn("about", F.lit(1)))
    sent = by_block.cogroup(answers.groupBy("block")).applyInArrow(send_runs, RUNS)
    answers = answers.unionAll(sent.groupBy("bucket").applyInArrow(sort_bucket, B.REPLY).withColumn("about", F.lit(2)))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(remove, OUT)
