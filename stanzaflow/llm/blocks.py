"""Documents in blocks of adjacent ids, and cells of sorted keys between blocks and buckets.

Two operators look for strings that occur again anywhere in a corpus. Both deal the
documents into *blocks* (ranges of doc_id, a few MB of text each, compressed) once and
exchange only sorted keys between blocks and *buckets* of the key space. A *cell* is what
one block sends to one bucket; the bucket answers with one bit for each key of the cell.
Since blocks are ranges of doc_id, "starts earlier" between blocks is a comparison of
block numbers, so no positions travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes in a block: the corpus over AIM_BLOCKS, within these bounds.
LEAST_BLOCK, MOST_BLOCK, AIM_BLOCKS = 2 << 20, 32 << 20, 512
#: Ranges of doc_id whose text bytes are counted before they are joined or cut into blocks.
CELLS = 2048


@dataclass
class Blocks:
    rows: DataFrame  # block int, doc_id long, turn long, body binary (zstd)
    count: int
    total_bytes: int


@dataclass
class Ranges:
    """Cells of doc_id (number 0: null ids; number k: up to ``upto[k - 1]``; last: above) and the blocks they belong to."""

    upto: np.ndarray
    first: np.ndarray  # block of a cell, or the first of its blocks
    parts: np.ndarray  # how many blocks a large cell is cut into

    def cell(self, ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        return np.where(null, 0, np.searchsorted(self.upto, ids, side="left") + 1)

    def block(self, ids: np.ndarray, null: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Blocks in the order of (doc_id, turn): a large cell is cut evenly by id, or by turn if it has one id only."""
        cell = self.cell(ids, null)
        ends = np.concatenate([[0.0], self.upto.astype(np.float64), [2.0**63]])
        low, high = np.concatenate([[0.0], [-(2.0**63)], ends[1:-1]])[cell], ends[cell]
        one = null | (high - low <= 1)
        share = np.where(one, (turn.astype(np.float64) + 2.0**63) / 2.0**64, (ids.astype(np.float64) - low - 1) / np.maximum(1.0, high - low))
        return self.first[cell] + np.clip((share * self.parts[cell]).astype(np.int64), 0, self.parts[cell] - 1)


def plan_ranges(quantiles: list[int], least: int, most: int) -> np.ndarray:
    """Upper bounds of the cells. An id that fills several quantiles gets a cell of its own."""
    q = np.array(quantiles, np.int64)
    values, n = np.unique(q, return_counts=True)
    own = values[n > 1]
    return np.unique(np.concatenate([values, own[own > np.iinfo(np.int64).min] - 1, np.array([least - 1, most], np.int64)]))


def lay_out(upto: np.ndarray, held: np.ndarray, size: int) -> Ranges:
    """Blocks of about ``size`` bytes from the bytes of each cell: small neighbours are joined, large cells cut."""
    first, parts, at, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, size
    fresh = True
    for k, n in enumerate(held.tolist()):
        if not fresh and n > room:
            at, room, fresh = at + 1, size, True
        first[k] = at
        if n > size:
            parts[k] = -(-n // size)
            at, room, fresh = at + int(parts[k]), size, True
        else:
            room, fresh = room - n, False
    return Ranges(upto, first, parts)


def deal(docs: DataFrame) -> Blocks:
    """Blocks of ``docs(doc_id, text)`` by text bytes; null texts count as empty, null ids come first.

    Rows that repeat a doc_id follow each other by ``turn``, a hash of the text, so an id
    with very many rows is cut into blocks too; one text is never cut. What travels to the
    driver and in closures is a few numbers for each of about CELLS ranges.
    """
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("turn"), text.alias("text"))
    narrow = d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    cuts = [k / CELLS for k in range(1, CELLS)]
    total, least, most, found = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", cuts, 10 * CELLS)).first()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, total // AIM_BLOCKS))
    upto = plan_ranges(found or [], least or 0, most or 0)
    blank = Ranges(upto, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(upto) + 2, np.int64)
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            np.add.at(held, blank.cell(b.column(0).fill_null(0).to_numpy(), null), b.column(1).to_numpy())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["cell", "n"])

    held = np.zeros(len(upto) + 2, np.int64)
    if total > size:
        for r in narrow.mapInArrow(weigh, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            held[r["cell"]] = r["n"]
    ranges = lay_out(upto, held, size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, turn = b.column(0), b.column(1).to_numpy()
            at = ranges.block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), turn)
            bodies = [press.compress(x.as_buffer()) if x.is_valid else press.compress(b"") for x in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), ids, b.column(1), pa.array(bodies, pa.binary())], ["block", "doc_id", "turn", "body"])

    return Blocks(d.mapInArrow(pack, "block int, doc_id long, turn long, body binary"), int((ranges.first + ranges.parts).max()), int(total))


def unpack(table: pa.Table) -> list[tuple[int | None, bytes]]:
    """The documents of a block in order: by id, then by turn and text; null ids first."""
    press = zstandard.ZstdDecompressor()
    docs = [(i, t, press.decompress(x.as_buffer(), max_output_size=1 << 31)) for i, t, x in zip(table["doc_id"].to_pylist(), table["turn"].to_pylist(), table["body"], strict=True)]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1:]))
    return [(i, body) for i, _, body in docs]


_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    h = b * _P2
    h ^= h >> _S29
    h += a
    h *= _P1
    h ^= h >> _S32
    h *= _P3
    h ^= h >> _S29
    return h


def chain(h: np.ndarray, shift: int) -> np.ndarray:
    """From names of the strings at each place to names of those joined with their right neighbours ``shift`` on."""
    return mix(h[: max(0, len(h) - shift)], h[shift:])


def split_buckets(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Keys as bucket << bits | low bits of the hash, as uint64 (buckets <= 2 ** (64 - bits))."""
    at = ((h >> _S32) * np.uint64(buckets)) >> _S32
    return (at << np.uint64(bits)) | (mix(h, h) & np.uint64((1 << bits) - 1))


def pack_cell(v: np.ndarray, bits: int) -> bytes:
    """Sorted distinct keys below 2 ** bits: low bytes as they are, gaps of the rest squeezed."""
    low = max(1, (bits - max(0, len(v).bit_length() - 1)) // 8)
    high = np.diff(v >> np.uint64(8 * low), prepend=np.uint64(0))
    top = int(high.max(initial=0))
    wide = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    gaps = zstandard.ZstdCompressor(level=1).compress(high.astype(f"<u{wide}").tobytes())
    lows = np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()
    return b"".join((bytes((low, wide)), len(v).to_bytes(4, "little"), lows, gaps))


def unpack_cell(x: bytes) -> np.ndarray:
    low, wide, n = x[0], x[1], int.from_bytes(x[2:6], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(x, np.uint8, n * low, 6).reshape(n, low)
    gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[6 + n * low :], max_output_size=max(1, n * wide)), f"<u{wide}")
    return out.view("<u8")[:, 0] | (np.cumsum(gaps.astype(np.uint64)) << np.uint64(8 * low))


CELL = "bucket int, block int, keys binary, marks binary"
REPLY = "block int, bucket int, bits binary"


def cells(block: int, keys: np.ndarray, marks: np.ndarray, buckets: int, bits: int) -> pa.Table:
    """Cells of a block's sorted distinct ``keys`` (see split_buckets); ``marks``: a bit of each."""
    ends = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(bits)) if buckets < 1 << (64 - bits) else np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << np.uint64(bits)), len(keys))
    full = np.flatnonzero(np.diff(ends))
    low = keys & np.uint64((1 << bits) - 1)
    return pa.table({
        "bucket": pa.array(full.astype(np.int32)),
        "block": pa.array(np.full(len(full), block, np.int32)),
        "keys": pa.array([pack_cell(low[ends[k] : ends[k + 1]], bits) for k in full], pa.binary()),
        "marks": pa.array([np.packbits(marks[ends[k] : ends[k + 1]]).tobytes() for k in full], pa.binary()),
    })


def answer(cells: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Replies of all buckets. ``judge(keys, blocks, marks)`` gets one bucket's keys, sorted by key and block, and returns a bool of each."""

    def one(table: pa.Table) -> pa.Table:
        blocks, got = table["block"].to_numpy(), [unpack_cell(x.as_py()) for x in table["keys"]]
        n = [len(x) for x in got]
        keys, owner = np.concatenate(got), np.repeat(blocks, n)
        marks = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k) for x, k in zip(table["marks"], n, strict=True)]).astype(bool)
        order = np.lexsort((owner, keys))
        said = np.zeros(len(keys), bool)
        said[order] = judge(keys[order], owner[order], marks[order])
        ends = np.cumsum([0, *n])
        return pa.table({
            "block": pa.array(blocks, pa.int32()), "bucket": table["bucket"],
            "bits": pa.array([np.packbits(said[a:b]).tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
        })

    return cells.groupBy("bucket").applyInArrow(one, REPLY)


def recurring(keys: np.ndarray, blocks: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """True for keys of two blocks or more, or marked as repeated inside one."""
    same = keys[1:] == keys[:-1]
    out = marks.copy()
    out[1:] |= same
    out[:-1] |= same
    return out


def later(keys: np.ndarray, blocks: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """True for keys that an earlier block has too."""
    out = np.zeros(len(keys), bool)
    out[1:] = keys[1:] == keys[:-1]
    return out


def heard(replies: pa.Table, keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The replies to a block's sorted distinct keys, one bool of each."""
    at = keys >> np.uint64(bits)
    ends = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
    out = np.zeros(len(keys), bool)
    for bucket, bits_ in zip(replies["bucket"].to_pylist(), replies["bits"], strict=True):
        a, b = ends[bucket], ends[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits_.as_py(), np.uint8), count=b - a)
    return out
