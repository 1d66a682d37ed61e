"""Periodic runs: passages of a document that repeat with a fixed period of words.

The method is that of Stoye and Gusfield (2002). Two suffixes i and j = i + D that part at a
node of depth D of the suffix tree begin a *branching* tandem repeat: D words twice, after
which the period breaks. Each is found from the node's smaller half: every leaf there is
looked up, D further or D back, in the other half, so that a leaf is touched once for each
doubling of its subtree. A branching repeat ends a run of period D; rotating it to the left
as long as the word before agrees with the word one period on gives the run's start.

A node of the tree is an interval of the suffix array, its depth the least common prefix
inside it; a node with many children counts as a chain of nodes with two, which leaves the
halves smaller and the repeats the same. Only stretches in which groups of GRAM words recur
enter the tree: a run of 12 words or more consists of such groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import mix
from .shared import return_memory
from .words import word_names

return_memory()

#: A run has this many words at least, and twice its period.
LEAST_WORDS = 12
#: Words of a group. A run of LEAST_WORDS or more repeats each of its groups, but for those across the seam of a run of exactly two periods.
GRAM = LEAST_WORDS // 2
#: Text bytes that are worked on together; a longer text is worked on alone.
CHUNK = 2 << 20
#: Pairs of a leaf and a node that are looked up at once.
PAIRS = 1 << 21

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_array(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``names`` in order and the rank of each, by prefix doubling; only suffixes that aren't told apart yet are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank, step = np.empty(n, np.int64), 1
    new = np.diff(names[order], prepend=names[order[0]] - 1) != 0 if n else np.zeros(0, bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    order = order[~alone]
    while len(order):
        later = order + step
        second = np.where(later < n, rank[np.minimum(later, n - 1)], -1)
        first = rank[order]
        turn = np.lexsort((second, first))
        order, first, second = order[turn], first[turn], second[turn]
        group = np.append(True, first[1:] != first[:-1])
        new = group | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(order))
        rank[order] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        order, step = order[~(new & np.append(new[1:], True))], 2 * step
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


def common_prefixes(names: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order (Kasai et al., 2001); 0 for the first."""
    n = len(names)
    out = np.zeros(n, np.int64)
    s, sa, place, lcp = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (names, suffixes, rank, out))
    h = 0
    for i in range(n):
        r = place[i]
        if r == 0:
            h = 0
            continue
        j = sa[r - 1]
        end = n - max(i, j)
        while h < end and s[i + h] == s[j + h]:
            h += 1
        lcp[r] = h
        if h:
            h -= 1
    return out


def nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes below the root, with two children each: the interval [low, high) of a node, cut at ``at``; their depth is ``lcp[at]``."""
    n = len(lcp)
    low, high = np.zeros(n, np.int64), np.full(n, n, np.int64)
    lows, highs, depth = memoryview(low), memoryview(high), memoryview(np.ascontiguousarray(lcp, np.int64))
    open_ = [0]
    for k in range(1, n):
        d = depth[k]
        while open_ and depth[open_[-1]] >= d:
            highs[open_.pop()] = k
        lows[k] = open_[-1] if open_ else k
        open_.append(k)
    at = np.flatnonzero(lcp > 0)
    return low[at], at, high[at]


def branching_repeats(suffixes: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all branching tandem repeats, from the leaf lists of smaller halves."""
    low, at, high = nodes(lcp)
    n = len(suffixes)
    left = at - low <= high - at
    first = np.where(left, low, at)
    size = np.where(left, at - low, high - at)
    other_low, other_high = np.where(left, at, low), np.where(left, high, at)
    starts, halves = [], []
    ends = np.cumsum(size)
    k = 0
    while k < len(at):
        upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, side="right")))
        node = np.repeat(np.arange(k, upto), size[k:upto])
        leaf = suffixes[np.arange(len(node)) - np.repeat(np.cumsum(size[k:upto]) - size[k:upto], size[k:upto]) + first[node]]
        depth = lcp[at[node]]
        for sign in (1, -1):
            to = leaf + sign * depth
            inside = (to >= 0) & (to < n)
            r = rank[np.where(inside, to, 0)]
            found = inside & (r >= other_low[node]) & (r < other_high[node])
            starts.append(np.minimum(leaf, to)[found])
            halves.append(depth[found])
        k = upto
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(starts or empty), np.concatenate(halves or empty)


def rotations(names: np.ndarray, starts: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How many words each repeat can be rotated to the left: words before ``starts`` that agree with the word one period on."""
    out, live, width = np.zeros(len(starts), np.int64), np.arange(len(starts)), 16
    while len(live):
        stays = []
        for part in np.array_split(live, max(1, -(-len(live) * width // PAIRS))):
            i = (starts[part] - out[part])[:, None] - 1 - np.arange(width)
            same = (i >= 0) & (names[np.maximum(i, 0)] == names[np.maximum(i, 0) + period[part][:, None]])
            whole = same.all(1)
            out[part] += np.where(whole, width, same.argmin(1))
            stays.append(part[whole])
        live, width = np.concatenate(stays), min(2 * width, PAIRS)
    return out


def maximal_runs(names: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all maximal runs of ``names`` with at least ``least`` words and two periods.

    Repeats that end at one place are merged: the shortest period there is primitive, and
    multiples of it inside its run are the same run. Few primitive ones share an end, so
    few rounds are needed.
    """
    suffixes, rank = suffix_array(names)
    start, half = branching_repeats(suffixes, rank, common_prefixes(names, suffixes, rank))
    found: list[tuple[np.ndarray, ...]] = []
    order = np.lexsort((half, start + 2 * half))
    start, half = start[order], half[order]
    while len(start):
        end = start + 2 * half
        group = np.append(True, end[1:] != end[:-1])
        lead = np.flatnonzero(group)
        begin = start[lead] - rotations(names, start[lead], half[lead])
        found.append((begin, end[lead] - begin, half[lead]))
        mine = np.cumsum(group) - 1
        rest = ~(group | ((half % half[lead][mine] == 0) & (start >= begin[mine])))
        start, half = start[rest], half[rest]
    s, n, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    long = n >= least
    order = np.lexsort((q[long], s[long]))
    return s[long][order], n[long][order], q[long][order]


def recurring(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places whose next GRAM words occur again in the same document, by 64-bit names (equal words have equal names)."""
    n = len(names) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h ^ names[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = mix(h, doc[:n].astype(np.uint64))
    whole = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    order = whole[np.argsort(h[whole])]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    return np.sort(order[again])


def _chunk(bodies: list[bytes], least: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[bytes], list[int]]:
    """Of each document: its runs, the words that go (or None) and its words; all documents at once."""
    sizes = np.array([len(b) + 1 for b in bodies])
    body = b"\n".join(bodies)
    names, s, e = word_names(body)
    doc = np.searchsorted(np.cumsum(sizes), s, side="right")
    at = recurring(names, doc)
    n_words = np.bincount(doc, minlength=len(bodies))
    base = np.cumsum(n_words) - n_words
    runs = [np.zeros(0, np.int64)] * 4
    if len(at):
        fresh = np.append(True, (np.diff(at) > GRAM) | (np.diff(doc[at]) > 0))
        opens = np.flatnonzero(fresh)
        first, last = at[opens], at[np.append(opens[1:], len(at)) - 1] + GRAM
        stretch = last - first
        keep = stretch >= least
        first, stretch = first[keep], stretch[keep]
        where = np.arange(stretch.sum()) - np.repeat(np.cumsum(stretch) - stretch, stretch) + np.repeat(first, stretch)
        known: dict[bytes, int] = {}
        word = np.array([known.setdefault(body[a:z], len(known)) for a, z in zip(s[where].tolist(), e[where].tolist(), strict=True)], np.int64)
        apart = np.repeat(np.arange(len(first)), stretch) * (len(known) + 1) + word  # no stretch shares a word with another
        begin, length, period = maximal_runs(np.unique(apart, return_inverse=True)[1].astype(np.int64), least) if len(apart) else runs[:3]
        begin = where[begin] if len(begin) else begin
        runs = [doc[begin], begin - base[doc[begin]], length, period]
    of, start, length, period = runs
    spelt = [b" ".join(b.split()) for b in bodies]
    for k in np.unique(of).tolist():
        mine = of == k
        edge = np.zeros(n_words[k] + 1, np.int64)
        np.add.at(edge, start[mine] + period[mine], 1)
        np.add.at(edge, start[mine] + length[mine], -1)
        words = spelt[k].split(b" ")
        spelt[k] = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])
    return of, start, length, period, spelt, n_words


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Maximal runs of the words of each row of ``docs(doc_id, text)``: ``doc_id, n_words, runs, collapsed``.

    Words are what stands between ASCII white space. A run is a stretch of words with
    smallest period q (words q apart are equal), at least ``least`` (12 or more) and 2 q
    long, which no neighbouring word continues; ``runs`` has start, length and period of all,
    by start and period, numbers in words from 0. ``collapsed`` is the text without the words
    that any run holds after its first q words, the others joined by one space.

    Null and empty texts have no words, no runs and ''. Each row is looked at alone: ids may
    be null or repeat, and come back unchanged; equal rows give equal results; an empty table
    gives an empty one; other columns are ignored. Documents aren't exchanged. Short texts
    are worked on together up to CHUNK bytes; a longer one takes about 100 bytes of memory for
    each word, and some 200 for each word in a stretch that recurs.
    """
    if least < 2 * GRAM:
        raise ValueError(f"least must be {2 * GRAM} or more")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def batch(ids: pa.Array, bodies: list[bytes]) -> pa.RecordBatch:
        of, start, length, period, spelt, n_words = _chunk(bodies, least)
        order = np.lexsort((period, start, of))
        flat = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start, length, period)], ["start", "length", "period"])
        ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(bodies)))).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat).cast(kind), pa.array(spelt, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, held, size = b.column(1), 0, [], 0
            for i in range(len(texts)):
                held.append((texts[i].as_py() or ""))
                held[-1] = held[-1].encode()
                size += len(held[-1])
                if size >= CHUNK or i + 1 == len(texts):
                    yield batch(b.column(0).slice(at, i + 1 - at), held)
                    at, held, size = i + 1, [], 0

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(find, schema)


def words_of(text: Column) -> Column:
    """The words of a text between ASCII white space; none if it is null."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))


def plant_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where every tenth document by the crc32 of its id repeats itself from a word on.

    With h the crc32 of the id, g = floor(h / 10) and n words: if h % 10 = 0 and n > 0, each
    word i >= a becomes the word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    A null id has no crc32; its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    n = F.size("_words").cast("long")
    a = g % n
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("long")
    repeated = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("_words"))
    placed = chosen.withColumns({"_a": F.when(n > 0, a), "_p": F.when(n > 0, p)})
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
