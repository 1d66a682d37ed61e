"""SimHash near-duplicates: exact comparison of fingerprints in tiles by population count.

A tile holds fingerprints of one population count. Two tiles are compared, all pairs by
exclusive-or and bit counts, only if their population counts differ by the radius at most;
other pairs of tiles can't hold a link and are skipped. To keep the number of tile pairs
in proportion to the corpus, tiles are laid inside *strips*: fingerprints within ``radius``
bits of each other agree in one of ``radius + 1`` bands, and in the rest again in one of as
many sub-bands, and a strip holds those that share a band and a sub-band. So every pair
within the radius meets in a strip, and nothing is missed; links come from the tiles alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, components, cut, give_back, partitions, return_memory, spread_hot

return_memory()

#: Fingerprints of one strip that one task lays into tiles; pairs of fingerprints that are compared at once.
TILE, PAIRS = 8192, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose hashes are counted at once.
PIECE = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: words between ASCII white space, A-Z lower-cased, shingles with repeats."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        h = np.array([digest(b" ".join(w), seed)], np.uint64)
    else:
        joined = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), PIECE):
        bits = np.unpackbits(h[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > len(h)).tolist())


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, digest: bool = False) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; with ``digest`` also ``text_sha256``, null texts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])
            give_back()

    text = F.col("text").cast("string")
    more = [F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256")] if digest else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *more).mapInArrow(run, "doc_id long, fp long" + ", text_sha256 string" * digest)


def _bands(bits: int, parts: int) -> list[int]:
    """Masks that cut the set bits of ``bits`` into near-equal runs."""
    at = [i for i in range(64) if bits >> i & 1]
    return [sum(1 << i for i in at[k * len(at) // parts : (k + 1) * len(at) // parts]) for k in range(parts)]


def tile_masks(radius: int) -> list[int]:
    full = (1 << 64) - 1
    return [band | sub for band in _bands(full, radius + 1) for sub in _bands(full ^ band, radius + 1)]


def tile_pairs(strip: np.ndarray, ones: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of rows sorted by ``strip`` and population count, and the pairs of tiles to compare.

    Returns where each tile starts (and the end of the last), and the two tiles of each
    pair: of one strip, with population counts at most ``radius`` apart.
    """
    name = strip.astype(np.int64) * 128 + ones
    bounds = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]])) if len(name) else np.zeros(1, np.int64)
    held = name[bounds[:-1]]
    first, second = [], []
    for apart in range(radius + 1):
        at = np.searchsorted(held, held + apart)
        at[at == len(held)] = 0
        met = np.flatnonzero(held[at] == held + apart) if len(held) else at
        first.append(met)
        second.append(at[met])
    return bounds, np.concatenate(first), np.concatenate(second)


def compare(strip: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius, from tiles that may hold any. Rows are sorted by strip and population count.

    A strip with rows of both sides pairs those of one side with those of the other only.
    """
    bounds, a, b = tile_pairs(strip, np.bitwise_count(fp), radius)
    size = np.diff(bounds)
    crossed = np.zeros(int(strip.max(initial=0)) + 1, bool)
    crossed[strip[side == 1]] = True
    # rows of a tile against another tile, many at once as far as PAIRS allows
    rows = np.repeat(bounds[a], size[a]) + np.arange(size[a].sum()) - np.repeat(np.cumsum(size[a]) - size[a], size[a])
    start, width = np.repeat(bounds[b], size[a]), np.repeat(size[b], size[a])
    own = np.repeat(a == b, size[a])
    width = np.where(own, start + width - rows - 1, width)
    start = np.where(own, rows + 1, start)
    ends = np.cumsum(width)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = width[at:upto]
        p = np.repeat(rows[at:upto], n)
        q = np.repeat(start[at:upto], n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        close = np.bitwise_count(fp[p] ^ fp[q]) <= radius
        p, q = p[close], q[close]
        fit = ~crossed[strip[p]] | (side[p] != side[q])
        yield p[fit], q[fit]
        at = upto


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``prints(fp)`` that connect just those within the radius.

    Of the links in one task only those that join two trees are returned.
    """
    spark, masks = prints.sparkSession, tile_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    strips = spread_hot(rows.join(shared.hint("merge"), "key"), "key", "fp", TILE).withColumn("part", F.pmod(F.xxhash64("key", "tile"), F.lit(4 * partitions(spark))).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        key, tile, side = (table[c].to_numpy() for c in ("key", "tile", "side"))
        fp = table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, np.bitwise_count(fp), tile, key))
        key, tile, side, fp = key[order], tile[order], side[order], fp[order]
        strip = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]))
        names, which = np.unique(fp, return_inverse=True)
        forest, edges = Forest(len(names)), []
        for p, q in compare(strip, side, fp, radius):
            edges += forest.connect(which[p], which[q])
        a, b = (np.array(x, np.int64) for x in (zip(*edges, strict=True) if edges else ([], [])))
        give_back()
        return pa.table({"a": pa.array(names[a].view(np.int64)), "b": pa.array(names[b].view(np.int64))})

    return strips.select("part", "key", "tile", "side", "fp").groupBy("part").applyInArrow(run, "a long, b long")


def simhash_dedup(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, by_row: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, fingerprint, component_id, kept``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest doc_id reachable by
    links of ``radius`` bits or fewer; ``kept`` says that the row is its component's own.
    Texts without words have fingerprint zero and are linked like any other; a text of
    fewer words than a shingle is one shingle. Rows that repeat a doc_id are separate rows
    with one id. A null doc_id keeps its row; a component of null ids alone has a null id.
    A very long text is hashed in pieces; an empty table gives an empty result; other columns
    are ignored. Tables that grow with the corpus are joined by sorting, so none comes to the
    driver as a broadcast. ``by_row`` adds ``text_sha256`` and ``root``, which tell rows of one doc_id and
    components of one id apart.
    """
    prints = cut(fingerprints(docs, words, seed, by_row))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(least.select("fp"), radius))
    each = least.join(comp.hint("merge"), least.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = each.groupBy("root").agg(F.min("least").alias("component_id"))
    more = ["text_sha256", "root"] if by_row else []
    each = each.join(named.hint("merge"), "root").select("fp", "component_id", *more[1:])
    return prints.join(each.hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *more
    )
