"""Byte-level BPE with sentencepiece: a model serialised from a rank vocabulary.

Every byte stands for one printable character, so a rank file's byte strings become
sentencepiece pieces. A piece's score is its negative rank: sentencepiece merges the pair
of best score first, which is the pair of lowest rank. The normaliser is the identity and
adds or removes no space. Texts are cut by the pattern first and each pre-token is encoded
alone. A pre-token that is itself a piece is that piece, as in rank-file tokenizers.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .shared import give_back, return_memory

return_memory()

#: Pre-tokens whose ids a worker remembers.
CACHE = 200_000
#: Texts longer than this are matched piece by piece instead of in one list.
LONG = 1 << 22


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = (b for b in range(256) if b not in plain)
    at = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [at[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64 and rank in a line) by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for piece, rank in pairs:
        out[int(rank)] = base64.b64decode(piece)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """A protobuf field: varint, 32-bit float or bytes, by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model of which piece ``i`` has id ``i`` and the unknown piece the id after the last."""
    # fixed values of the format: ModelProto pieces=1, trainer=2, normalizer=3; SentencePiece piece=1, score=2,
    # type=3 (2: unknown); TrainerSpec model_type=3 (2: BPE), vocab_size=4, unk=40, bos=41, eos=42, pad=43;
    # NormalizerSpec name=1, add_dummy_prefix=3, remove_extra_whitespaces=4, escape_whitespaces=5
    chars = byte_characters()
    out = [_field(1, _field(1, "".join(chars[b] for b in p)) + _field(2, float(-rank))) for rank, p in enumerate(pieces)]
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1
    out.append(_field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    def __init__(self, ranks: str, pattern: str):
        self.pieces = read_ranks(ranks)
        self.rank = {p: i for i, p in enumerate(self.pieces)}
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(self.pieces))
        self.pattern = regex.compile(pattern)
        self.chars = byte_characters()
        self.known: dict[str, bytes] = {}
        self.table = np.array(self.pieces, object)

    def _pre_token(self, token: str) -> bytes:
        raw = token.encode()
        rank = self.rank.get(raw)
        ids = [rank] if rank is not None else self.model.EncodeAsIds("".join([self.chars[b] for b in raw]))
        out = np.array(ids, "<i4").tobytes()
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(raw) <= 64:
            self.known[token] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        known, new = self.known, self._pre_token
        if len(text) > LONG:
            return b"".join(known.get(m[0]) or new(m[0]) for m in self.pattern.finditer(text))
        return b"".join([known.get(t) or new(t) for t in self.pattern.findall(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())


@functools.lru_cache(maxsize=2)
def _coder(ranks: str, pattern: str) -> ByteBpe:
    """One for each worker and vocabulary."""
    return ByteBpe(ranks, pattern)


def _arrays(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


#: Bytes of text or ids in one output batch.
STEP = 2 << 20


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP bytes, so that neither side holds all results of a large batch."""
    turns = np.flatnonzero(np.diff(np.cumsum(sizes) // STEP, prepend=0)).tolist()
    for a, b in zip([0, *turns], [*turns, batch.num_rows]):
        if a < b:
            yield batch.slice(a, b - a)


def _encode_slice(coder: ByteBpe, part: pa.RecordBatch, text: str) -> pa.ListArray:
    return _arrays([coder.encode(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()])


def _decode_column(coder: ByteBpe, ids: pa.ListArray) -> pa.Array:
    return pa.array([coder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values) else b"" for x in ids], pa.binary())


def _put(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    at = part.schema.get_field_index(name)
    return part.append_column(name, column) if at < 0 else part.set_column(at, name, column)


def _schema(rows: DataFrame, **new: str) -> StructType:
    """The rows' schema with the new columns in the place of old ones of that name, or at the end."""
    kinds = {k: StructField(k, _parse_datatype_string(v)) for k, v in new.items()}
    return StructType([kinds.pop(f.name, f) for f in rows.schema.fields] + [kinds[k] for k in new if k in kinds])


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>) of each whole text; null text counts as empty, [].

    No string of the text is a special token. With ``decoded``, a column of that name gets
    the bytes that the ids stand for, decoded from them in the same pass. Columns that have
    these names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for b in batches:
            for part in _slices(b, pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)):
                made = _encode_slice(coder, part, text)
                part = _put(part, ids, made)
                yield _put(part, decoded, _decode_column(coder, made)) if decoded else part
            give_back()

    docs = docs.withColumn(text, F.col(text).cast("string"))
    return docs.mapInArrow(run, _schema(docs, **{ids: "array<int>"}, **({decoded: "binary"} if decoded else {})))


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for; null or empty ids give empty bytes. A column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for b in batches:
            for part in _slices(b, 4 * pc.fill_null(pc.list_value_length(b.column(b.schema.get_field_index(ids))), 0).to_numpy(zero_copy_only=False)):
                yield _put(part, out, _decode_column(coder, part.column(part.schema.get_field_index(ids))))

    return rows.mapInArrow(run, _schema(rows, **{out: "binary"}))
