"""Arrow functions over strings that hold a few MB at once, whatever the size of a batch, and give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of strings, about, that are Python objects at once.
STEP = 4 << 20


def give_back() -> None:
    """Returns freed memory to the system (as far as Arrow's pool and glibc can), since a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _strings(columns: tuple[pa.Array, ...], one: Callable[..., str | None]) -> pa.Array:
    """``one`` of the strings of each row, null where any of them is, slice by slice."""
    n = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    turns = np.flatnonzero(np.diff(np.cumsum(n) // STEP, prepend=0)).tolist()
    made = []
    for a, b in zip([0, *turns], [*turns, len(n)], strict=True):
        parts = [c.slice(a, b - a).to_pylist() for c in columns]
        made.append(pa.array([None if None in row else one(*row) for row in zip(*parts, strict=True)], pa.string()))
    out = pa.concat_arrays(made)
    del made
    give_back()
    return out


def of_one(one: Callable[[str], str | None]):
    """A column function of one string column; null stays null."""

    @F.arrow_udf(StringType())
    def run(c: pa.Array) -> pa.Array:
        return _strings((c,), one)

    return run


def of_two(one: Callable[[str, str], str | None]):
    """The same of two string columns."""

    @F.arrow_udf(StringType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _strings((a, b), one)

    return run
