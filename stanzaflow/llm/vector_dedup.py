"""Near-duplicate vectors: Euclidean p-stable hashing and exact cosine checks.

A table's key is the quantised values of K random projections of the unit vector,
``floor((a . x + b) / w)``. Equal vectors form one class first and are hashed once. K
grows with the logarithm of the largest label's classes so that chance buckets stay small,
and the number of tables follows from K so that a pair at the threshold is missed with
probability ``MISS`` at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, components, cut, partitions, spread_hot

WIDTH = 2.0
MISS = 0.002
MAX_TABLES = 48
#: Vectors of one key that one task compares with each other.
TILE = 2048
#: Rows of a tile that are multiplied at once.
ROWS = 128


def collision(cosine: float, width: float = WIDTH) -> float:
    """The chance that one projection puts two unit vectors of this cosine into one cell (Datar et al., 2004)."""
    c = math.sqrt(max(1e-12, 2 - 2 * cosine))
    r = width / c
    return 1 - 2 * 0.5 * math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(classes: int, cosine: float) -> tuple[int, int]:
    """Projections in a table and tables. A projection of width 2 tells about 1.3 bits of unrelated vectors.

    Where MISS would need more than MAX_TABLES tables, fewer projections are taken: buckets get larger, the miss doesn't.
    """
    k = min(14, max(6, math.ceil(math.log2(max(2, classes) / 16) / 1.3)))
    while (tables := math.ceil(math.log(MISS) / math.log(1 - collision(cosine) ** k))) > MAX_TABLES:
        k -= 1
    return k, tables


def vector_dedup(vectors: DataFrame, cosine: float = 0.93, seed: int = 7) -> DataFrame:
    """Links between rows of ``vec_id, embedding, label`` whose cosine is at least ``cosine``.

    Only rows with equal, non-null labels are compared, in double precision. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing; so do
    vectors of different lengths with each other. Returns ``vec_id, n_links, component_id,
    kept`` for each row (repeated rows of one vec_id count as separate vectors; a null
    vec_id keeps its row and can't be a component's id).
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"), "label")
    fine = F.expr("label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(e, x -> x <> 0)")
    v = v.withColumn("cls", F.when(fine, F.xxhash64("label", "e"))).withColumn("cls2", F.when(fine, F.xxhash64("e", "label", F.lit("2"))))
    classes = cut(v.where("cls is not null").groupBy("cls", "cls2", "label").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("e").alias("e")).select(F.xxhash64("cls", "cls2").alias("id"), "*"))
    most = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("e")).alias("dim")).agg(F.max("n"), F.max("dim")).first()
    n_most, dim = (most[0] or 0), (most[1] or 1)
    k, tables = plan_tables(n_most, cosine)
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k)

    def unit(flat: pa.ListArray) -> np.ndarray:
        n = np.diff(flat.offsets.to_numpy())
        x = np.zeros((len(n), dim))
        x[np.arange(dim) < n[:, None]] = flat.flatten().to_numpy()
        x /= np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def keys(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
        q = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k).astype(np.uint64)
        h = salt[:, None] + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # tables far apart, so that keys of two don't meet
        for i in range(k):
            h = (h ^ q[:, :, i]) * np.uint64(0x9E3779B185EBCA87)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)

    def hashed(batches):
        for t in batches:
            x = unit(t.column(1).cast(pa.list_(pa.float64())))
            h = keys(x, t.column(2).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([t.column(0), pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), tables).cast(pa.list_(pa.int64()))], ["id", "keys"])

    salted = classes.select("id", "e", F.xxhash64("label", F.size("e")).alias("salt"))
    sigs = salted.mapInArrow(hashed, "id long, keys array<long>")
    places = sigs.select("id", F.posexplode("keys").alias("tab", "key"))
    shared = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = spread_hot(places.join(shared, "key"), "key", "id", TILE)
    body = classes.select("id", "size", "e").join(sigs, "id")
    tiles = met.join(body, "id").withColumn("part", F.pmod(F.xxhash64("key", "tile"), F.lit(8 * partitions(spark))).cast("int")).select("part", "key", "tile", "side", "tab", "id", "size", "e", "keys")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, tile, side, tab, ids = (table[c].to_numpy() for c in ("key", "tile", "side", "tab", "id"))
        size = table["size"].to_numpy()
        x = unit(table["e"].combine_chunks().cast(pa.list_(pa.float64())))
        sig = table["keys"].combine_chunks().flatten().to_numpy().reshape(-1, tables)
        order = np.lexsort((ids, side, tile, key))
        key_, tile_ = key[order], tile[order]
        ends = np.flatnonzero(np.r_[True, (key_[1:] != key_[:-1]) | (tile_[1:] != tile_[:-1]), True])
        names, which = np.unique(ids, return_inverse=True)
        size_of = np.zeros(len(names), np.int64)
        size_of[which] = size
        links, forest, edges = np.zeros(len(names), np.int64), Forest(len(names)), []
        for s, t in zip(ends[:-1], ends[1:]):
            rows = order[s:t]
            cross = bool((side[rows] == 1).any())
            left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if cross else (rows, rows)
            if len(left) == 0 or len(right) == 0 or (not cross and len(rows) < 2):
                continue
            before = int(tab[rows[0]])  # rows of one key are of one table
            for i in range(0, len(left), ROWS):
                l = left[i : i + ROWS]
                close = x[l] @ x[right].T >= cosine
                if not cross:
                    close &= np.arange(len(right)) > np.arange(i, i + len(l))[:, None]
                p, q = np.nonzero(close)
                p, q = l[p], right[q]
                for t_ in range(before):  # a pair counts in the first table in which it meets
                    new = sig[p, t_] != sig[q, t_]
                    p, q = p[new], q[new]
                p, q = which[p], which[q]
                links += np.bincount(p, size_of[q], len(names)).astype(np.int64) + np.bincount(q, size_of[p], len(names)).astype(np.int64)
                edges += [(names[f], names[g]) for f, g in forest.connect(p, q)]
        at = np.flatnonzero(links)
        src, dst = (np.array(z, np.int64) for z in (zip(*edges, strict=True) if edges else ([], [])))
        return pa.table({
            "id": pa.array(np.concatenate([names[at], src]).astype(np.int64)),
            "other": pa.array([None] * len(at) + dst.tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[at], np.zeros(len(src), np.int64)])),
        })

    found = cut(tiles.groupBy("part").applyInArrow(compare, "id long, other long, links long"))
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    each = classes.select("id", "cls", "cls2", "size", "least").join(degree, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = each.groupBy("root").agg(F.min("least").alias("component"))
    each = each.join(named, "root").select("cls", "cls2", "component", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return (
        v.select("vec_id", "cls", "cls2").join(each, ["cls", "cls2"], "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
