"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s wants r = t / s copies of each of its documents. Every
document gets floor(r) copies; the fraction p = r - floor(r) is rounded so that the words
of the source stay at the target: two fractional documents a and b exchange words (the
mass p * size of both together doesn't change) until one of them is 0 or 1, with odds that
keep each document's expectation. One fractional document is left of a group; the
residuals of up to ``FAN`` groups form a group of the next level, and so on until each
source has one, which is rounded at random. A source so misses its target by less than
one document. Random numbers come from hashes of the ids, so reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .shared import cut

#: Documents in a group of the reduction tree, about.
FAN = 2048
#: Most sources: their sizes go to the driver and their targets into a broadcast.
MOST_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def share_out(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """``total`` shared by weight, each share at most ``most`` times its size, the excess reshared until none is above."""
    open_, out, left = list(range(len(sizes))), [0.0] * len(sizes), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def pivot(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds all of ``p`` but at most one to 0 or 1, keeping sum(p * sizes). Returns p and the place left, or -1."""
    p, draws, a = p.copy(), rng.random(len(p)), -1
    for b in range(len(p)):
        if not 0.0 < p[b] < 1.0:
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - p[a]) * sizes[a], p[b] * sizes[b])  # a gains, b gives
        down = min(p[a] * sizes[a], (1 - p[b]) * sizes[b])
        gain = up if draws[b] * (up + down) < down else -down
        a_full = (1 - p[a]) * sizes[a] <= gain if gain > 0 else p[a] * sizes[a] <= -gain
        b_full = p[b] * sizes[b] <= gain if gain > 0 else (1 - p[b]) * sizes[b] <= -gain
        pa_, pb_ = p[a] + gain / sizes[a], p[b] - gain / sizes[b]
        p[a] = (1.0 if gain > 0 else 0.0) if a_full else pa_
        p[b] = (0.0 if gain > 0 else 1.0) if b_full else pb_
        if a_full:
            a = -1 if b_full else b
    return p, a


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11, fan: int = FAN, by_row: bool = False) -> DataFrame:
    """For each row of ``docs(doc_id, text, source)``: ``doc_id, source, size, source_size, target, copies, taken``.

    Size is the number of words (null text: 0). Sources, by code point and null last, weigh
    ``weights`` in turn, share ``share`` times all words and get at most ``most`` times
    their own, the excess reshared. ``taken`` is ``copies * size``; copies is at most
    ceil(most). Documents without words get no copies. Repeated or null doc_ids are rows like
    any other: groups are dealt by a hash of id and text. A very long text is only counted.
    An empty table gives an empty result; other columns are ignored. More than MOST_SOURCES
    sources are an error. ``by_row`` adds ``text_hash``, which tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")))
    held = [(r["source"], r["n"], r["words"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()]
    if len(held) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    held.sort(key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    targets = share_out([w for _, _, w in held], [weights[i % len(weights)] for i in range(len(held))], share * sum(w for _, _, w in held), most)
    plan = [(s, n, w, t, max(1, math.ceil(n / fan))) for (s, n, w), t in zip(held, targets, strict=True)]
    table = F.broadcast(spark.createDataFrame(plan, "source string, n long, source_size long, target double, groups long").withColumnRenamed("source", "_s"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.join(table, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "n")
        .withColumn("ratio", F.least(ratio, F.lit(float(most))))
        .withColumn("base", F.floor("ratio")).withColumn("p", F.col("ratio") - F.floor("ratio"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
        .withColumn("grp", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("groups")))
        .drop("ratio", "groups")
    )
    schema = StructType([*rows.schema.fields, StructField("open", BooleanType())])

    def level(number: int, last: bool):
        def round_group(key: tuple, g: pa.Table) -> pa.Table:
            g = g.take(pc.sort_indices(g, sort_keys=[("doc_id", "ascending"), ("size", "ascending"), ("text_hash", "ascending")]))
            size, p = g["size"].to_numpy().astype(float), g["p"].to_numpy()
            rng = np.random.default_rng([seed, number, key[1].as_py(), *(key[0].as_py() or "\0").encode()])
            # the last group ends with its smallest documents, so that the residual is small
            order = np.argsort(-size, kind="stable") if last else rng.permutation(len(size))
            q, left = pivot(size[order], p[order], rng)
            if last and left >= 0:
                q[left] = float(rng.random() < q[left])
            p = np.empty(len(q))
            p[order] = q
            return g.set_column(g.schema.get_field_index("p"), "p", pa.array(p)).append_column("open", pa.array((p > 0) & (p < 1)))

        return round_group

    groups, number, done, todo = max([g for *_, g in plan] or [1]), 0, None, rows
    while True:
        last = groups == 1
        out = cut(todo.groupBy("source", "grp").applyInArrow(level(number, last), schema))
        settled = out.where("not open").drop("open")
        done = settled if done is None else done.unionAll(settled)
        if last:
            break
        todo = out.where("open").drop("open").withColumn("grp", F.floor(F.col("grp") / fan))
        groups, number = math.ceil(groups / fan), number + 1
    copies = (F.col("base") + F.col("p").cast("long")).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("long")
    more = ["text_hash"] if by_row else []
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *more).withColumn("taken", F.col("copies") * F.col("size"))
