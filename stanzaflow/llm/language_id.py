"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import free_names, give_back, return_memory

return_memory()

#: Buckets of the hashed 1-, 2- and 3-grams.
FEATURES = 1 << 16
#: Most training rows of each language, about: rows whose hashed id and text are below a threshold.
TRAIN_ROWS = 5_000
#: Characters handled at once, so that a very long text needs little memory.
PIECE = 1 << 20
#: Added to every count.
SMOOTHING = 0.5
#: Bounds the model, FEATURES x languages 4-byte numbers, to 128 MB.
MOST_LANGUAGES = 512
#: Entries of the sparse count matrix that are multiplied at once.
ENTRIES = 1 << 18
UNKNOWN = "und"

_ODD = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]
_SHIFT = np.uint32(16)


@dataclass
class LanguageModel:
    """``logp[bucket, language]`` and the log priors; its size is FEATURES x languages."""

    languages: list[str]
    logp: np.ndarray
    prior: np.ndarray


def _buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of a text, piece by piece; pieces overlap by two characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(c), PIECE):
        p = c[max(0, at - 2) : at + PIECE]
        new = len(p) - min(at, 2)
        h = p
        for n in range(3):
            if n:
                h = h[:-1] * _ODD[1] + p[n:]
            if len(h):
                m = (h + np.uint32(n)) * _ODD[0]
                m = (m ^ (m >> np.uint32(15))) * _ODD[2]
                yield (m >> _SHIFT).astype(np.uint16)[-new:]


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's row of the sparse count matrix: its buckets in order, and how often each occurs."""
    buckets, counts, held, size = [], [], [], 0
    for h in [*_buckets(text), None]:
        if h is not None:
            held.append(h)
            size += len(h)
        if held and (h is None or size > PIECE):
            run = np.sort(np.concatenate(held), kind="stable")  # of 16 bits: by radix
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            buckets.append(run[first])
            counts.append(np.diff(first, append=len(run)))
            held, size = [], 0
    if len(buckets) == 1:
        return buckets[0], counts[0]
    total = np.zeros(FEATURES, np.int64)
    for b, n in zip(buckets, counts, strict=True):
        total[b] += n
    b = np.flatnonzero(total)
    return b.astype(np.uint16), total[b]


def scores(rows: list[tuple[np.ndarray, np.ndarray]], logp: np.ndarray) -> np.ndarray:
    """The product of a sparse count matrix, given by rows, with ``logp``: log likelihoods, a row for each text."""
    out = np.zeros((len(rows), logp.shape[1]))
    full = [i for i, (b, _) in enumerate(rows) if len(b)]
    if full:
        n = [len(rows[i][0]) for i in full]
        cells = logp[np.concatenate([rows[i][0] for i in full])] * np.concatenate([rows[i][1] for i in full])[:, None]
        out[full] = np.add.reduceat(cells, np.cumsum(n) - n, axis=0)
    return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fits the model on ``doc_id, text, lang``.

    Rows without text or lang don't count. At most about ``train_rows`` rows of each
    language are read, chosen by a hash of doc_id and text, so that what reaches the driver
    (counts of FEATURES x languages) doesn't grow with the corpus. The priors are the shares
    of all labelled rows. More than ``MOST_LANGUAGES`` languages are an error. Null or
    repeated ids are rows like any other (rows equal in id and text are read together or not at all); an empty table gives a model without languages.
    """
    rows = labelled.where("lang is not null and text is not null")
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(held) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would outgrow a broadcast")
    languages = sorted(held)
    if not languages:
        return LanguageModel([], np.zeros((FEATURES, 0), np.float32), np.zeros(0))
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, train_rows / held[k]) * (1 << 30)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) < limit[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = seen.setdefault(lang, np.zeros(FEATURES, np.int64))
                for h in _buckets(text):
                    n += np.bincount(h, minlength=FEATURES)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    found = chosen.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    counts = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((FEATURES, len(languages)), SMOOTHING)
    lang = counts["lang"].combine_chunks().dictionary_encode()
    col = np.array([languages.index(x) for x in lang.dictionary.to_pylist()], np.int64)
    if len(lang):
        np.add.at(table, (counts["bucket"].to_numpy(), col[lang.indices.to_numpy()]), counts["n"].to_numpy())
    total = np.array([held[k] for k in languages], float)
    return LanguageModel(languages, np.log(table / table.sum(0)).astype(np.float32), np.log(total / total.sum()))


def identify(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``lang`` and ``score`` (posterior probability, 0 to 1).

    Only ``text`` is read, all of it. A null text, or one without a letter, gets ``und``
    and 0; so does any text if the model knows no language. Columns that already have
    these names are replaced. Of equal posteriors the first language by name wins. Texts of a
    batch form a sparse matrix of counts, which is multiplied with the log probabilities; a
    very long text is counted in pieces.
    """
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            out, rows, at, size = [(UNKNOWN, 0.0)] * len(texts), [], [], 0
            for i, text in enumerate([*texts, None]):
                if text is not None and m.languages and _has_letter(text):
                    rows.append(_row(text))
                    at.append(i)
                    size += len(rows[-1][0])
                if rows and (i == len(texts) or size > ENTRIES):
                    p = scores(rows, m.logp) + m.prior
                    p -= p.max(1, keepdims=True)
                    for k, best, top in zip(at, p.argmax(1).tolist(), (1 / np.exp(p).sum(1)).tolist(), strict=True):
                        out[k] = (m.languages[best], top)
                    rows, at, size = [], [], 0
            del texts, text
            give_back()
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    said = F.pandas_udf(predict, kind)
    (both,) = free_names(docs, "_said")
    return docs.withColumn(both, said(F.col("text").cast("string"))).withColumns({lang: F.col(f"{both}.lang_pred"), score: F.col(f"{both}.score")}).drop(both)


def held_out() -> Column:
    """True for the fold that training leaves out: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
