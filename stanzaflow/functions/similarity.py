"""Similarity of texts, names and vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stanzaflow.functions.text import _fold


#: Cells (length times length) up to which difflib finds matches; beyond them an automaton does, in linear time.
SMALL = 1 << 14


class _Automaton:
    """The suffix automaton of a string: for any other string the longest common block, earliest in it and then in this one."""

    def __init__(self, s: str) -> None:
        self.step, self.link, self.size, self.first = [{}], [-1], [0], [-1]
        last = 0
        for i, c in enumerate(s):
            last = self._extend(last, i, c)

    def _state(self, size: int, first: int, step: dict, link: int) -> int:
        self.size.append(size), self.first.append(first), self.step.append(step), self.link.append(link)
        return len(self.size) - 1

    def _extend(self, last: int, i: int, c: str) -> int:
        step, link = self.step, self.link
        new, p = self._state(i + 1, i, {}, 0), last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            return new
        q = step[p][c]
        if self.size[q] == self.size[p] + 1:
            link[new] = q
            return new
        twin = self._state(self.size[p] + 1, self.first[q], dict(step[q]), link[q])
        link[q] = link[new] = twin
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        return new

    def longest(self, s: str) -> tuple[int, int, int]:
        """Where the block starts in ``s`` and in the automaton's string, and its length."""
        step, link, size = self.step, self.link, self.size
        at = n = best = 0
        found = 0, 0, 0
        for i, c in enumerate(s):
            while at and c not in step[at]:
                at = link[at]
                n = size[at]
            if c in step[at]:
                at, n = step[at][c], n + 1
            if n > best:
                best, found = n, (i + 1 - n, self.first[at] + 1 - n, n)
        return found


#: Lengths of the pieces of one string that are looked for in the other, the longest first.
PIECES = (64, 16)


def _common(x: str, i: int, y: str, j: int) -> int:
    """How many characters agree from these places on."""
    n, k, most = 0, 16, min(len(x) - i, len(y) - j)
    while n < most and k:
        k = min(k, most - n)
        if x[i + n : i + n + k] == y[j + n : j + n + k]:
            n, k = n + k, 2 * k
        else:
            k //= 2
    return n


def _longest(x: str, y: str) -> tuple[int, int, int] | None:
    """What ``_Automaton(y).longest(x)`` gives, or None where it isn't found by pieces.

    Every block of 2 * w - 1 characters or more holds a piece of ``x`` that begins at a multiple
    of w, so if one of that length is found, all that are as long or longer are.
    """
    back = x[::-1], y[::-1]
    for w in PIECES:
        best, ends, seen = (0, 0, 0), {}, 0
        for p in range(0, len(x) - w + 1, w):
            q = y.find(x[p : p + w])
            while q >= 0:
                seen += 1
                if ends.get(p - q, 0) < p + w:  # not in a block that is known
                    left = _common(back[0], len(x) - p, back[1], len(y) - q)
                    n = left + w + _common(x, p + w, y, q + w)
                    ends[p - q] = p - left + n
                    best = min(best, (-n, p - left, q - left))
                q = y.find(x[p : p + w], q + 1)
            if seen > len(x):  # one piece over and over
                return None
        if -best[0] >= 2 * w - 1:
            return best[1], best[2], -best[0]
    return None


def _matched(a: str, b: str) -> int:
    """Characters in the blocks that Ratcliff and Obershelp's method matches."""
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        found = _longest(x, y)
        if found is None and len(x) * len(y) <= SMALL:
            total += sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            continue
        i, j, n = found or _Automaton(y).longest(x)
        if n:
            total += n
            todo += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


def _ratio(a: str, b: str) -> float:
    return 2.0 * _matched(a, b) / (len(a) + len(b)) if a or b else 1.0


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit of one integer for each character of ``b``."""
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for c in a:
        hit = free & at.get(c, 0)
        free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


def _may_reach(a: str, b: str, least: float) -> bool:
    """Do two bounds, counts of characters and the common subsequence, leave a ratio of ``least`` or more, in either order?"""
    need = least * (len(a) + len(b)) / 2 - 1e-6
    return (Counter(a) & Counter(b)).total() >= need and _subsequence(a, b) >= need


def _ratio_from(a: str, b: str, least: float) -> float | None:
    """The ratio if it is ``least`` or more; bounds settle most pairs."""
    if not _may_reach(a, b, least):
        return None
    r = _ratio(a, b)
    return r if r >= least else None


#: Characters of texts that are held side by side.
TOGETHER = 1 << 17


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class _SideBySide:
    """Strings one after the other in a whole number, a bit for each character and a free one between: another string meets all at once."""

    def __init__(self, strings: list[str]) -> None:
        self.size = np.array([len(s) for s in strings])
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.total = int(self.size.sum()) + len(strings)
        places: dict[str, list[int]] = {}
        for k, s in zip(self.start.tolist(), strings):
            for j, c in enumerate(s, k):
                places.setdefault(c, []).append(j)
        self.at = {}
        for c, j in places.items():
            bits = np.zeros(self.total, np.uint8)
            bits[j] = 1
            self.at[c] = _number(bits)
        bits = np.ones(self.total, np.uint8)
        bits[self.start + self.size] = 0
        self.full = _number(bits)

    def subsequences(self, a: str) -> np.ndarray:
        """Length of the longest common subsequence of ``a`` with each string, as ``_subsequence`` finds it."""
        full, at = self.full, self.at
        free = full
        for c in a:
            if c in at:
                hit = free & at[c]
                free = (free + hit | free - hit) & full
        bits = np.unpackbits(np.frombuffer((full ^ free).to_bytes((self.total + 7) // 8, "little"), np.uint8), bitorder="little")
        return np.add.reduceat(bits[: self.total], self.start, dtype=np.int64)


#: Characters told apart (all rarer ones count as one), and the share of the text that a class of them has at least.
SYMBOLS, SHARE = 64, 0.1
#: Pairs whose bounds are held at once, places of blocks that are, and characters of the strings in one number, about.
PAIRS, PLACES, LANES = 1 << 22, 1 << 20, 1 << 20
#: Lengths of the blocks that are looked for, the longest first, and blocks of a pair on average beyond which shorter ones aren't.
BLOCKS, MANY = (12, 9, 8, 7), 12


class _Lanes:
    """Strings of like length, of each class of characters a number of equal lanes, of which any choice meets another string at once."""

    def __init__(self, strings: list[np.ndarray], classes: list[list[int]]) -> None:
        text = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
        codes = np.concatenate(strings)
        self.classes = []
        for letters in classes:
            mine = np.isin(codes, letters)
            t, c = text[mine], codes[mine]
            size = np.bincount(t, minlength=len(strings))
            place = np.arange(len(t)) - (np.cumsum(size) - size)[t]
            width = 8 * (int(size.max(initial=0)) // 8 + 1)  # one bit at least stays free, where carries end
            at = {}
            for x in letters:
                bits = np.zeros((len(strings), width), np.uint8)
                bits[t[c == x], place[c == x]] = 1
                at[x] = np.packbits(bits, axis=1, bitorder="little")
            self.classes.append((size, at, np.packbits(np.arange(width) < size[:, None], axis=1, bitorder="little")))

    def subsequences(self, k: int, which: np.ndarray, a: list[int]) -> np.ndarray:
        """Length of the longest common subsequence of ``a``, characters of class ``k``, with those of the chosen strings."""
        size, at, full = self.classes[k]
        at = {x: int.from_bytes(bits[which].tobytes(), "little") for x, bits in at.items()}
        free = full = int.from_bytes(full[which].tobytes(), "little")
        for c in a:
            hit = free & at[c]
            free = (free + hit | free ^ hit) & full
        width = self.classes[k][2].shape[1]
        left = np.frombuffer(free.to_bytes(len(which) * width, "little"), np.uint8).reshape(len(which), width)
        return size[which] - np.bitwise_count(left).sum(1, dtype=np.int64)


class _Grams:
    """The places of strings, with the hash of what follows and the character before: both in one key, the hash in its upper bits."""

    def __init__(self, strings: list[np.ndarray], none: int) -> None:
        self.size = np.array([len(s) for s in strings])
        self.codes = np.concatenate(strings)
        self.text = np.repeat(np.arange(len(strings)), self.size)
        self.place = np.arange(len(self.codes)) - (np.cumsum(self.size) - self.size)[self.text]
        self.before = np.where(self.place > 0, np.roll(self.codes, 1), none).astype(np.uint64)

    def keys(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of strings of ``q`` characters in order, and which places they are of."""
        at = np.flatnonzero(self.place + q <= self.size[self.text])
        h = np.zeros(len(at), np.uint64)
        for k in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.codes[at + k] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9) & ~np.uint64(255) | self.before[at]
        order = np.argsort(h)
        return h[order], at[order]


def _by_blocks(a: _Grams, b: _Grams, most: np.ndarray) -> None:
    """Lowers ``most``, for each pair what its strings match at most, by where their longest common blocks lie.

    Ratcliff and Obershelp's method begins with a longest block; what lies before it in one
    string and behind it in the other can't match, so the pair matches no more than the
    shorter rest along the block's diagonal. Pairs are settled by the longest blocks that are
    found: all that begin a block of q characters or more, so the longest is among them.
    """
    open_ = np.ones(most.size, bool)
    for q in BLOCKS:
        (x, ax), (y, by) = a.keys(q), b.keys(q)
        hash_ = x & ~np.uint64(255)
        # of the places in b with this hash those with the same character before are left out: the block begins earlier
        ends = [np.searchsorted(y, k, side) for k, side in ((hash_, "left"), (x, "left"), (x, "right"), (hash_ | np.uint64(255), "right"))]
        first, number = np.concatenate([ends[0], ends[2]]), np.concatenate([ends[1] - ends[0], ends[3] - ends[2]])
        ax = np.concatenate([ax, ax])
        some = number > 0
        first, number, ax = first[some], number[some], ax[some]
        upto = np.cumsum(number)
        if len(upto) and upto[-1] > MANY * most.size:
            return
        found = np.full(most.size, -1, np.int32)
        step = 0
        while step < len(upto):
            begin = upto[step] - number[step]
            stop = max(step + 1, int(np.searchsorted(upto, begin + PLACES, "right")))
            n = number[step:stop]
            i, j = np.repeat(ax[step:stop], n), by[np.repeat(first[step:stop] - (upto[step:stop] - n - begin), n) + np.arange(n.sum())]
            pair = a.text[i] * len(b.size) + b.text[j]
            d = a.place[i] - b.place[j]
            bound = np.minimum(a.size[a.text[i]] - np.maximum(d, 0), b.size[b.text[j]] + np.minimum(d, 0))
            np.maximum.at(found, pair, bound.astype(np.int32))
            step = stop
        new = open_ & (found >= 0)
        flat = most.reshape(-1)
        flat[new] = np.minimum(flat[new], found[new])
        open_ &= ~new
        if not open_.any():
            return


def near_pairs(a: list[str], b: list[str], least: float, own: bool = False) -> Iterator[tuple[int, int]]:
    """Places in ``a`` and ``b`` of all pairs whose ratio may be ``least`` or more; few others are among them.

    Pairs are held against bounds of what two strings match, the cheapest first: their lengths,
    the counts of each character, where their longest common blocks lie (``_by_blocks``), and the
    sum of the longest common subsequences of their characters of each class, which takes a
    fraction of the work of one over all characters. Those of rarer characters come first; a
    string meets many at once, and only those that are left. With ``own`` both lists are the
    same and only pairs of a string with a later one are looked for.
    """
    if not a or not b:
        return
    count = sum((Counter(s) for s in (*a, *b)), Counter())
    code = {ord(c): min(k, SYMBOLS - 1) for k, (c, _) in enumerate(count.most_common())}
    coded = lambda s: np.frombuffer(s.translate(code).encode("latin-1"), np.uint8)
    share = np.zeros(SYMBOLS)
    for c, n in count.items():
        share[code[ord(c)]] += n / max(1, count.total())
    classes: list[list[int]] = [[]]
    for k in reversed(range(min(SYMBOLS, len(count)))):
        if share[classes[-1]].sum() >= SHARE and len(classes[-1]) > 2:
            classes.append([])
        classes[-1].append(k)
    order = sorted(range(len(b)), key=lambda j: len(b[j]))
    ys = [coded(b[j]) for j in order]
    counts = lambda strings: np.array([np.bincount(s, minlength=SYMBOLS) for s in strings], np.int32)
    of_b, size_b = counts(ys), np.array([len(y) for y in ys])
    lanes, begin = [], 0
    for j in range(1, len(ys) + 1):
        if j == len(ys) or size_b[begin : j + 1].sum() > LANES or size_b[j] > 1.25 * size_b[begin] + 8:
            lanes.append((begin, j, _Lanes(ys[begin:j], classes)))
            begin = j
    grams = _Grams(ys, 255)
    step = max(1, PAIRS // len(b))
    for start in range(0, len(a), step):
        xs = [coded(x) for x in a[start : start + step]]
        of_a, size_a = counts(xs), np.array([len(x) for x in xs])
        need = least * (size_a[:, None] + size_b) / 2 - 1e-6
        most = np.array([np.minimum(of_b, c).sum(1, dtype=np.int32) for c in of_a])
        most = np.minimum(most, np.minimum(size_a[:, None], size_b))
        bag = most.copy()
        if own:
            most[np.array(order) <= np.arange(start, start + len(xs))[:, None]] = -1
        if (most >= need).any():
            _by_blocks(_Grams(xs, 254), grams, most)
        for i, x in enumerate(xs):
            alive = most[i] >= need[i]
            if not alive.any():
                continue
            parts = [x[np.isin(x, letters)].tolist() for letters in classes]
            for begin, end, side in lanes:
                which = np.flatnonzero(alive[begin:end])
                upto = bag[i, begin:end].astype(np.int64)
                for k, (letters, part) in enumerate(zip(classes, parts)):
                    if not len(which):
                        break
                    upto[which] += side.subsequences(k, which, part) - np.minimum(of_b[begin + which][:, letters], of_a[i, letters]).sum(1)
                    which = which[upto[which] >= need[i, begin + which]]
                for j in which.tolist():
                    yield start + i, order[begin + j]


def best_token_sort(a: list[str], b: list[str]) -> list[float]:
    """For each string of ``a`` the largest ``token_sort_ratio`` with one of ``b``, which isn't empty; it meets many at once."""
    x, y = ([" ".join(sorted(s.split())) for s in side] for side in (a, b))
    chunks, held, size = [], [], 0
    for n, s in enumerate(y):
        held.append(s)
        size += len(s)
        if size > TOGETHER or n + 1 == len(y):
            chunks.append(_SideBySide(held))
            held, size = [], 0
    out = []
    for s in x:
        best = 0.0
        for c in chunks:
            total = c.size + len(s)
            best = max(best, float(np.where(total == 0, 100.0, 200.0 * c.subsequences(s) / np.maximum(total, 1)).max()))
        out.append(best)
    return out


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; the order of the arguments can matter."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def sequence_ratio_from(a: Column | str, b: Column | str, least: float) -> Column:
    """The same ratio where it is ``least`` or more, else null; most pairs below are settled by bounds."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _ratio_from(x, y, least) for x, y in zip(a, b)], dtype="float64")

    return ratio(a, b)


@F.pandas_udf(DoubleType())
def lines_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same ratio over lists of lines."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio of strings of these lengths can't exceed."""
    return F.coalesce(F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)), F.lit(1.0))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the strings' words are sorted, then 200 * LCS / total length."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
        return 100.0 if not x and not y else 200.0 * _subsequence(x, y) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def first_names_agree(a: Column, b: Column) -> Column:
    """'yes', 'initial' or 'no' for two normalised first names (words of letters)."""
    x, y = F.split(a, " "), F.split(b, " ")

    def initials_of(short: Column, long: Column) -> Column:
        pairs = F.zip_with(short, F.slice(long, F.lit(1), F.size(short)), lambda p, q: p == F.substring(q, 1, 1))
        return (F.size(short) <= F.size(long)) & F.forall(short, lambda p: F.length(p) == 1) & F.forall(pairs, lambda t: t)

    def is_initial(p: Column, q: Column) -> Column:
        return (F.length(p[0]) == 1) & (p[0] == F.substring(q[0], 1, 1))

    return (
        F.when(a == b, "yes").when((a == "") | (b == ""), "initial").when(x[0] == y[0], "yes")
        .when(is_initial(x, y) | is_initial(y, x) | initials_of(x, y) | initials_of(y, x), "initial").otherwise("no")
    )


def author_overlap(query: Column, found: Column) -> Column:
    """Do the names share two words of over two letters, or all that the query has?"""
    q, f = (F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) > 2)) for c in (query, found))
    return F.size(F.array_intersect(q, f)) >= F.least(F.lit(2), F.size(q))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; NaN (sorts last) if a vector is zero."""
    return F.coalesce(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(float("nan")))


@F.pandas_udf(StructType([StructField("n_stored", IntegerType()), StructField("n_fetched", IntegerType()), StructField("ratio", DoubleType())]))
def folded_lines(stored: pd.Series, fetched: pd.Series) -> pd.DataFrame:
    """Of two texts: the non-blank lines of each and the ratio of their lists of folded lines (no accents, marks or case)."""

    def one(x, y):
        if x is None or y is None:
            return None, None, None
        x, y = ([_fold(t, "NFKD") for t in z.split("\n") if t.strip()] for z in (x, y))
        return len(x), len(y), SequenceMatcher(None, x, y).ratio()

    return pd.DataFrame([one(x, y) for x, y in zip(stored, fetched)], columns=["n_stored", "n_fetched", "ratio"])


def match_grade(stored_lines: Column, fetched_lines: Column, ratio: Column) -> Column:
    """'strict' (lines differ by one at most, ratio .92), 'near' (.55), else why not."""
    delta = F.abs(stored_lines - fetched_lines)
    return F.when(fetched_lines == 0, "empty").when((delta <= 1) & (ratio >= 0.92), "strict").when((delta <= 1) & (ratio >= 0.55), "near").when(delta > 1, "line-count").otherwise("ratio")
