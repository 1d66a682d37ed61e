"""Removal of repeated passages of words by sharded Aho-Corasick automata.

1. Nominate. Windows of ``length`` words (20) are named by a hash; names that occur twice
   anywhere are nominated, by an exchange of sorted 32-bit keys between blocks of
   documents and buckets of names.
2. Confirm. A document's nominated windows are cut into passages of windows that share an
   anchor (the least hash of four words inside the window, so equal windows have equal
   anchors) and passages go to the shard of their anchor, equal ones of a block once. A
   shard numbers its windows word by word (by prefix doubling on the words' own numbers,
   without hashes) and confirms the phrases that recur; it tells each block which of the
   phrases it sent are confirmed, and in which block a phrase stands first. It tells no
   places.
3. Locate. A block compiles its passages with confirmed phrases into Aho-Corasick automata,
   words as a few characters each, one for every ``CHUNK`` words of text or so, and streams
   its documents whole through them; a document without a confirmed phrase among those that it
   nominated has none at all and is left out. Every phrase in an occurrence that an automaton finds
   is marked, but for the first one in the block where the phrase stands first.
4. Words that a marked occurrence covers are removed.

Names only nominate; what is removed was compared word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import blocks as B
from .blocks import mix
from .words import word_names

#: Words of the string whose hash anchors a window.
ANCHOR = 4
#: Text bytes of the corpus for one shard and one bucket of names.
SHARD_BYTES, BUCKET_KEYS = 4 << 20, 2 << 20
NAME_BITS = 32
#: Words of documents whose phrases share an automaton, about.
CHUNK = 300_000
#: The first character that stands for a part of a word, and how many characters each part has at most: an automaton
#: looks through the letters behind a node one by one, so a node mustn't have one for each word.
FIRST_CHAR, CHARS = 0x100, 64

SPANS = "array<struct<start:long,stop:long>>"
OUT = f"doc_id long, n_words long, spans {SPANS}, kept string"
CELL = "shard int, block int, body binary"


def window_names(names: np.ndarray, length: int) -> np.ndarray:
    h, have = names, 1
    while have * 2 <= length:
        h, have = B.chain(h, have), have * 2
    return B.chain(h, length - have) if length > have else h


def _anchors(names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor, and the anchors' names by place."""
    g = window_names(names, min(ANCHOR, length))
    reach = length - min(ANCHOR, length) + 1
    m, have = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64), 1
    while have * 2 <= reach:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    if reach > have:
        m = np.minimum(m[: have - reach], m[reach - have :])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64), g


class _Block:
    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.docs, self.length, self.buckets = B.unpack(table), length, buckets
        self.names = [word_names(body)[0] for _, body in self.docs]

    def windows(self) -> np.ndarray:
        """The names of all windows, in order."""
        found = [np.zeros(0, np.uint64)]
        for names in self.names:
            if len(names) >= self.length:
                found.append(B.split_buckets(window_names(names, self.length), self.buckets, NAME_BITS))
        return np.concatenate(found)

    def passages(self, replies: pa.Table, shards: int) -> np.ndarray:
        """Document, first word, number of words and shard of each nominated passage, in order."""
        keys, which = np.unique(self.windows(), return_inverse=True)
        named = B.heard(replies, keys, self.buckets, NAME_BITS)[which]
        at, out = 0, [np.zeros((4, 0), np.int64)]
        for doc, names in enumerate(self.names):
            n = len(names) - self.length + 1
            if n <= 0:
                continue
            on = named[at : at + n]
            at += n
            if not on.any():
                continue
            place, g = _anchors(names, self.length)
            turn = np.flatnonzero(np.r_[on[0], on[1:] & (~on[:-1] | (place[1:] != place[:-1]))])
            stop = np.flatnonzero(np.r_[on[:-1] & (~on[1:] | (place[1:] != place[:-1])), on[-1]]) + 1
            anchor = g[place[turn]]  # least of its neighbours, so hashed once more
            shard = ((mix(anchor, anchor) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            out.append(np.stack([np.full(len(turn), doc), turn, stop - turn + self.length - 1, shard.astype(np.int64)]))
        return np.concatenate(out, axis=1)


def _texts(docs: list[tuple[int | None, bytes]], found: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(document, shard, passage) of what ``passages`` found."""
    last, words = -1, []
    for doc, start, n, shard in zip(*found.tolist(), strict=True):
        if doc != last:
            last, words = doc, docs[doc][1].split()
        yield doc, shard, b" ".join(words[start : start + n])


def _notes(sizes: np.ndarray, found: np.ndarray) -> bytes:
    """Words of each document of a block and its passages, as the block sends them to itself."""
    flat = np.concatenate([[len(sizes)], sizes, np.diff(found, axis=1, prepend=0).ravel()])
    return zstandard.ZstdCompressor(level=3).compress(flat.astype("<i8").tobytes())


def _noted(notes: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(notes, max_output_size=1 << 31), "<i8").astype(np.int64)
    n = int(flat[0]) + 1
    return flat[1:n], np.cumsum(flat[n:].reshape(4, -1), axis=1)


def window_numbers(words: np.ndarray, length: int) -> np.ndarray:
    """A number for each string of ``length`` of the numbers ``words``, equal for equal strings only."""
    number, have, parts = words, 1, {}
    while True:
        parts[have] = number
        if have * 2 > length:
            break
        number = _paired(number[:-have], number[have:])
        have *= 2
    at, out = have, number
    while at < length:
        step = max(k for k in parts if k <= length - at)
        n = len(words) - at - step + 1
        out = _paired(out[:n], parts[step][at : at + n])
        at += step
    return out


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def confirm(cells: list[list[tuple[bytes, bool]]], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which windows of each cell's passages are phrases that recur, and which stand in this cell first.

    ``cells`` are those of one shard in block order; a passage comes with whether its block
    has it more than once.
    """
    number: dict[bytes, int] = {}
    times: list[int] = []
    first: list[int] = []
    held: list[list[int]] = []
    for k, cell in enumerate(cells):
        held.append([])
        for p, repeated in cell:
            i = number.setdefault(p, len(number))
            if i == len(times):
                times.append(0)
                first.append(k)
            times[i] += 1 + repeated
            held[-1].append(i)
    code: dict[bytes, int] = {}
    split = [p.split(b" ") for p in number]
    size = np.array([len(p) for p in split], np.int64)
    words = np.array([code.setdefault(w, len(code)) for p in split for w in p], np.int64)
    n = size - length + 1
    begin = np.cumsum(n) - n
    place = np.repeat(np.cumsum(size) - size - begin, n) + np.arange(int(n.sum()))
    phrase = window_numbers(words, length)[place]
    owner = np.repeat(np.arange(len(size)), n)
    recurs = np.bincount(phrase, np.array(times, float)[owner]) > 1
    stands = np.full(len(recurs), len(cells))
    np.minimum.at(stands, phrase, np.array(first)[owner])
    confirmed, stands = recurs[phrase], stands[phrase]
    out = []
    for k, mine in enumerate(held):
        at = np.concatenate([np.arange(begin[i], begin[i] + n[i]) for i in mine])
        out.append((confirmed[at], stands[at] == k))
    return out


class Phrases:
    """Automata of phrases over whole documents; a word is a few characters, each from an alphabet of its own place."""

    def __init__(self, length: int, words: Iterable[bytes]):
        known = dict.fromkeys(words)
        self.wide = 1
        while CHARS**self.wide <= len(known):
            self.wide += 1
        self.base = math.ceil((len(known) + 1) ** (1 / self.wide))
        self.span, self.other, self.met, self.turn = length * self.wide, self._letters(0), {}, 0
        self.letters = {w: self._letters(i + 1) for i, w in enumerate(known)}

    def _letters(self, i: int) -> str:
        out = ""
        for place in range(self.wide):
            i, digit = divmod(i, self.base + 1)
            out += chr(FIRST_CHAR + place * (self.base + 1) + digit)
        return out

    def spell(self, passage: bytes) -> str:
        return "".join([self.letters[w] for w in passage.split(b" ")])

    def locate(self, passages: dict[str, tuple[np.ndarray, np.ndarray]], documents: list[list[bytes]]) -> list[np.ndarray]:
        """Where phrases to remove start in each document.

        A passage comes with its windows whose phrase goes wherever the passage is met, and
        those whose phrase stands in this block first: such a phrase stays at the first
        place where it is met. Call it with a block's documents in order: what was met
        before is remembered.
        """
        base = np.cumsum([0, *map(len, documents)])
        marks = np.zeros(base[-1] + 1, bool)
        texts, known = list(passages), list(passages.values())
        automaton = ahocorasick.Automaton()
        for k, text in enumerate(texts):
            automaton.add_word(text, k)
        found = []
        if len(automaton):
            automaton.make_automaton()
            letter, other = self.letters.get, self.other
            for at, words in zip(base.tolist(), documents):
                hits = np.array(list(automaton.iter("".join([letter(w, other) for w in words]))), np.int64).reshape(-1, 2)
                hits[:, 0] += at * self.wide + 1
                found.append(hits)
        if found:
            end, k = np.concatenate(found).T
            start = (end - np.array([len(t) for t in texts])[k]) // self.wide
            n = np.array([len(gone) for gone, _ in known])
            flat, upto = np.concatenate([gone for gone, _ in known]), np.cumsum(n)
            times, ends = n[k], np.cumsum(n[k])
            marks[np.repeat(start, times) + flat[np.repeat((upto - n)[k] - ends + times, times) + np.arange(int(times.sum()))]] = True
            for j in np.flatnonzero(np.array([len(fresh) for _, fresh in known])[k]).tolist():
                text, fresh, here = texts[k[j]], known[k[j]][1], int(start[j])
                if self.met.setdefault(text, self.turn + here) != self.turn + here:  # the passage was met before, and so all its phrases
                    marks[here + fresh] = True
                    continue
                for i in fresh.tolist():
                    if self.met.setdefault(text[i * self.wide : i * self.wide + self.span], self.turn + here + i) != self.turn + here + i:
                        marks[here + i] = True
        self.turn += int(base[-1])
        return [np.flatnonzero(marks[x:y]) for x, y in zip(base, base[1:])]


def _judge(cells: list[bytes], length: int) -> list[np.ndarray]:
    """All steps on the cells of one shard as if they were one block: a bool of each window, True if its words came before."""
    press = zstandard.ZstdDecompressor()
    held = [press.decompress(x, max_output_size=1 << 31).split(b"\n") for x in cells]
    automata = Phrases(length, (w for cell in held for p in cell for w in p.split(b" ")))
    said, out = confirm([[(p, False) for p in cell] for cell in held], length), []
    for cell, (confirmed, _) in zip(held, said, strict=True):
        n = np.cumsum([0, *(p.count(b" ") + 2 - length for p in cell)])
        passages = {automata.spell(p): (np.zeros(0, np.int64), np.flatnonzero(confirmed[a:b])) for p, a, b in zip(cell, n, n[1:])}
        marks = np.zeros(n[-1], bool)
        for at, places in zip(n, automata.locate(passages, [p.split(b" ") for p in cell])):
            marks[at + places] = True
        out.append(marks)
    return out


def _pack(passages: dict[bytes, bool]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join([(b"+" if again else b"-") + p for p, again in passages.items()]))


def _unpack(cell: bytes) -> list[tuple[bytes, bool]]:
    return [(x[1:], x[:1] == b"+") for x in zstandard.ZstdDecompressor().decompress(cell, max_output_size=1 << 31).split(b"\n")]


def substring_dedup(docs: DataFrame, length: int = 20, chunk: int = CHUNK) -> DataFrame:
    """Cut from every document the words of ``length``-word windows that also start earlier.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are what ASCII
    white space separates, unchanged. Returns ``doc_id``, ``n_words``, ``spans`` (maximal
    removed runs of words) and ``kept`` (remaining words joined by one space). Earlier means
    a smaller doc_id, or the same document and an earlier start. A null text has no words;
    documents under ``length`` words lose nothing; very long texts are named in pieces and
    lie in one block. Rows that repeat a doc_id are separate documents, ordered by a hash of
    their text; null ids come first. An empty table gives an empty result.
    """
    base = B.deal(docs)
    buckets = max(4, min(1 << 16, base.total_bytes // 6 // BUCKET_KEYS))
    shards = max(8, base.total_bytes // SHARD_BYTES)

    def name(key: tuple, table: pa.Table) -> pa.Table:
        keys, n = np.unique(_Block(table, length, buckets).windows(), return_counts=True)
        return B.cells(key[0].as_py(), keys, n > 1, buckets, NAME_BITS)

    def send(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        mine: dict[int, dict[bytes, bool]] = {}
        number, notes = key[0].as_py(), []
        if table.num_rows:
            block = _Block(table, length, buckets)
            found = block.passages(replies, shards)
            for _, shard, p in _texts(block.docs, found):
                cell = mine.setdefault(shard, {})
                cell[p] = p in cell
            notes = [_notes(np.array([len(x) for x in block.names], np.int64), found)]
        # what the block found goes to itself past the shards, in a group of its own
        return pa.table({
            "shard": pa.array([*mine, *[-1 - number for _ in notes]], pa.int32()), "block": pa.array([number] * (len(mine) + len(notes)), pa.int32()),
            "body": pa.array([*(_pack(x) for x in mine.values()), *notes], pa.binary()),
        })

    def check(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            return pa.table({"block": table["block"], "bucket": table["shard"], "bits": table["body"]})
        table = table.sort_by("block")
        bits = [np.packbits(np.concatenate(x)).tobytes() for x in confirm([_unpack(x.as_py()) for x in table["body"]], length)]
        return pa.table({"block": table["block"], "bucket": table["shard"], "bits": pa.array(bits, pa.binary())})

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        docs = B.unpack(table)
        own = replies["bucket"].to_numpy() < 0
        sizes, found = np.zeros(0, np.int64), []
        for x in replies.filter(pa.array(own))["bits"]:  # one at most
            sizes, found = _noted(x.as_py())
            found = list(_texts(docs, found))
        sent: dict[int, dict[bytes, int]] = {}
        for _, shard, p in found:
            sent.setdefault(shard, {}).setdefault(p, p.count(b" ") + 2 - length)
        automata = Phrases(length, (w for cell in sent.values() for p in cell for w in p.split(b" ")))
        said: dict[bytes, tuple[str, np.ndarray, np.ndarray]] = {}  # equal passages are of one shard
        answers = replies.filter(pa.array(~own))
        for shard, x in zip(answers["bucket"].to_pylist(), answers["bits"], strict=True):
            total = sum(sent[shard].values())
            bits, at = np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=2 * total).astype(bool), 0
            for p, n in sent[shard].items():
                confirmed, fresh = bits[at : at + n], bits[total + at : total + at + n]
                if confirmed.any():
                    said[p] = automata.spell(p), np.flatnonzero(confirmed & ~fresh), np.flatnonzero(confirmed & fresh)
                at += n
        busy = {doc for doc, _, p in found if p in said}
        rows, turn = [], 0
        for part in _chunks(sizes.tolist(), chunk):
            passages: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            while turn < len(found) and found[turn][0] < part.stop:
                if found[turn][2] in said:
                    text, gone, fresh = said[found[turn][2]]
                    passages[text] = gone, fresh
                turn += 1
            documents = [docs[k][1].split() for k in part]
            for k, words, s in zip(part, documents, automata.locate(passages, [w if k in busy else [] for k, w in zip(part, documents)]), strict=True):
                edge = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + length])) if len(s) else s
                spans = list(zip(s[edge].tolist(), (s[np.append(edge[1:], len(s)) - 1] + length).tolist())) if len(s) else []
                ends = [0, *(x for span in spans for x in span), len(words)]
                kept = b" ".join([w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]).decode()
                rows.append((docs[k][0], len(words), [{"start": a, "stop": b} for a, b in spans], kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()), "spans": pa.array(cols[2], kind), "kept": pa.array(cols[3], pa.string())})

    by_block = base.rows.groupBy("block")
    named = B.answer(by_block.applyInArrow(name, B.CELL), B.recurring)
    passages = by_block.cogroup(named.groupBy("block")).applyInArrow(send, CELL)
    replies = passages.groupBy("shard").applyInArrow(check, B.REPLY)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(remove, OUT)


def _chunks(sizes: list[int], chunk: int) -> Iterator[range]:
    """Numbers of neighbouring documents of about ``chunk`` words together."""
    at = total = 0
    for k, size in enumerate(sizes):
        total += size
        if total >= chunk or k + 1 == len(sizes):
            yield range(at, k + 1)
            at, total = k + 1, 0
