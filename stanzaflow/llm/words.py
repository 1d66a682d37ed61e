"""Names of words: hashes computed for a whole text at once."""

from __future__ import annotations

import re

import numpy as np

from .blocks import mix

#: Bytes of a long text that are named at once, but for a longer word.
PIECE = 2 << 20
_GAP = re.compile(rb"[\t-\r ]")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """The first n powers of the base (1) or of its inverse (-1) modulo 2 ** 64."""
    if len(_powers[sign]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        steps = np.full(size, _BASE if sign > 0 else _INVERSE, np.uint64)
        steps[0] = 1
        made = np.multiply.accumulate(steps)
        if size > 1 << 22:
            return made[:n]
        _powers[sign] = made
    return _powers[sign][:n]


def word_names(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit name of each word between ASCII white space, and where each starts and ends; long texts in pieces."""
    if len(body) <= 2 * PIECE:
        return _piece_names(body)
    found, at = [], 0
    while at < len(body):
        gap = _GAP.search(body, at + PIECE)
        end = gap.start() if gap else len(body)
        name, s, e = _piece_names(body[at:end])
        found.append((name, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _piece_names(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(body, np.uint8)
    word = ~_SPACE[a]
    turns = np.flatnonzero(np.diff(word, prepend=False, append=False))
    s, e = turns[::2], turns[1::2]
    if not len(s):
        return np.zeros(0, np.uint64), s, e
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _power(1, len(a)), out=sums[1:])
    return mix((sums[e] - sums[s]) * _power(-1, len(a))[s], (e - s).astype(np.uint64)), s, e


class Sums:
    """64-bit names of strings at any places of a text, from running sums over it."""

    def __init__(self, body: bytes):
        a = np.frombuffer(body, np.uint8)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _power(1, len(a)), out=self.sums[1:])

    def names(self, places: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[places + length] - self.sums[places]) * _power(-1, len(self.sums))[places]
        return mix(h, h >> np.uint64(31))
