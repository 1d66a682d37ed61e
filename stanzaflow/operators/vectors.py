"""Vectors at scale: weighted sums with partial sums on the map side, and a stored inverted-file index.

The index deals vectors into cells around centroids and writes one folder for each cell, so a
search reads the cells nearest to its vector alone and ranks what they hold exactly. How many
cells that takes is measured when the index is written: sample vectors are looked up by a whole
scan, and as many cells are taken as hold ``RECALL`` of what was found.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from stanzaflow.functions.similarity import dot

#: Vectors, about, that centroids are fitted on, and cells at most.
SAMPLE, MOST_CELLS = 65_536, 2_048
#: Sample vectors that are looked up by a whole scan, neighbours of each, and the share of those that probed cells hold on average.
MEASURED, NEIGHBOURS, RECALL = 48, 1_000, 0.97
#: Vectors in a file of a cell, about; a larger cell has several.
FILE = 65_536
#: Rows and queries that a task holds, about; a query with what it has seen is the larger.
SHARD, BLOCK = 65_536, 16_384
#: Queries and rows of one matrix product, and candidates held before their distances are taken.
QUERIES, ROWS, MOST_HELD = 1_024, 4_096, 1 << 20


# ---- sums ----


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones are filled with zeros, null components count as 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(n.max(initial=0))
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _runs(batch: pa.RecordBatch, by: int) -> np.ndarray:
    """Where the first ``by`` columns change."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for c in batch.columns[:by]:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def vector_sum(rows: DataFrame, by: tuple[str, ...], vector: str, weight: str | None = None, name: str = "total") -> DataFrame:
    """``by, name``: the sum of ``weight * vector`` over the rows of each key, as doubles.

    Every partition adds up its own rows first, so what is shuffled is one vector for each
    key and partition, and a key with very many rows is no hot one. Null vectors and weights
    count as nothing (a key with no others has no row), null components as 0; vectors of
    different lengths are filled with zeros.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{name}` array<double>"])
    factor = F.col(weight).cast("double") if weight else F.lit(1.0)

    def add(batches: Iterator[pa.RecordBatch], weighted: bool) -> Iterator[pa.RecordBatch]:
        """One row for each run of equal keys; a run that goes on in the next batch is carried over."""
        carried: pa.RecordBatch | None = None
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(len(by)))
            if weighted:
                x = x * b.column(len(by) + 1).to_numpy()[:, None]
            at = _runs(b, len(by))
            sums = np.add.reduceat(x, at, axis=0)
            made = pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[: len(by)]), _lists(sums)], [*by, name])
            if carried is not None:
                joined = pa.Table.from_batches([carried, made]).combine_chunks().to_batches()[0]
                if len(_runs(joined.slice(0, 2), len(by))) == 1:
                    both = _matrix(joined.column(len(by)).slice(0, 2)).sum(0)
                    first = pa.RecordBatch.from_arrays([*(c.slice(0, 1) for c in joined.columns[: len(by)]), _lists(both[None])], [*by, name])
                    joined = pa.Table.from_batches([first, *([joined.slice(2)] if len(joined) > 2 else [])]).combine_chunks().to_batches()[0]
                made = joined
            if len(made) > 1:
                yield made.slice(0, len(made) - 1)
            carried = made.slice(len(made) - 1)
        if carried is not None:
            yield carried

    held = rows.select(*by, F.col(vector).alias("_vector"), factor.alias("_weight")).where("_vector is not null and _weight is not null")
    partial = held.sortWithinPartitions(*by).mapInArrow(lambda b: add(b, True), schema)
    return partial.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: add(b, False), schema)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) if x.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))


# ---- index ----


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: ``path/cells`` holds the rows by cell, ``path/centroids`` the cells' centroids and ``path/plan`` how many cells a search reads."""

    path: str
    centroids: np.ndarray
    probes: int
    schema: StructType

    def cells(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The cells nearest to each vector, a row for each."""
        return _near(self.centroids, vectors, probes or self.probes)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/cells")


def _near(centroids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    if centroids.shape[1] != vectors.shape[1]:  # an index without vectors
        return np.zeros((len(vectors), 1), np.int64)
    return np.argsort(-_unit(vectors) @ centroids.T, axis=1, kind="stable")[:, :n]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x, dtype=np.float64), where=norm > 0)


def _assigned(vectors: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """The rows with ``cell``, their nearest centroid (0 for a zero vector), and ``norm``."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    at = vectors.columns.index(vector)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), "norm double, cell int"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 4096):
                part = b.slice(k, 4096)
                x = _matrix(part.column(at))
                cell = np.argmax(_unit(x) @ shared.value.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.linalg.norm(x, axis=1)), pa.array(cell)], [*part.schema.names, "norm", "cell"])

    return vectors.mapInArrow(find, schema)


def write_index(vectors: DataFrame, path: str, id: str = "id", vector: str = "embedding", cells: int | None = None, recall: float = RECALL, neighbours: int = NEIGHBOURS, seed: int = 7) -> VectorIndex:
    """Writes the index of all rows with a vector, other columns with them, and returns it.

    Centroids (by default the root of the number of rows, at most ``MOST_CELLS``) come from
    k-means by cosine over about ``SAMPLE`` rows; every row is then dealt to its cell. What
    the driver holds is bounded: the centroids, ``MEASURED`` sample vectors and their
    neighbours' cells. Vectors have one length and no null components; null vectors aren't indexed.
    A cell with many rows is cut into files by a hash of the id.
    """
    spark = vectors.sparkSession
    known = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).drop("cell", "norm")
    n = known.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = known.where(F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(id, F.col(vector).cast("array<double>").alias("v"))
    sample = sample.where(F.exists("v", lambda x: x != 0))
    k = max(1, min(MOST_CELLS, cells or round(n**0.5)))
    if sample.limit(2).count() < 2 or k < 2:
        first = known.select(F.col(vector).cast("array<double>").alias("v")).first()
        centroids = np.array([first["v"] if first else []], np.float64)
    else:
        model = KMeans(k=k, maxIter=8, seed=seed, distanceMeasure="cosine", initMode="random", featuresCol="features").fit(sample.select(array_to_vector("v").alias("features")))
        centroids = _unit(np.array(model.clusterCenters(), np.float64))
    dealt = _assigned(known, vector, centroids)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("_n"))
    files = F.greatest(F.lit(1), F.ceil(F.col("_n") / FILE)).cast("int")
    cut = dealt.join(F.broadcast(sizes), "cell").withColumn("_file", F.pmod(F.xxhash64(id), files))  # sizes has a row for each cell, MOST_CELLS at most
    schema = StructType([*known.schema.fields, StructField("norm", DoubleType()), StructField("cell", IntegerType())])
    cut.repartition("cell", "_file").select(*schema.names).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    probes = _measured(spark, path, sample, id, vector, centroids, min(neighbours, n), recall, seed) if len(centroids) > 1 else 1
    spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(json.dumps({"probes": probes, "rows": n, "schema": schema.json()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
    return VectorIndex(path, centroids, probes, schema)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    plan = json.loads(spark.read.text(f"{path}/plan").first()[0])
    return VectorIndex(path, np.array([r["centroid"] for r in rows], np.float64), plan["probes"], StructType.fromJson(json.loads(plan["schema"])))


def _measured(spark: SparkSession, path: str, sample: DataFrame, id: str, vector: str, centroids: np.ndarray, k: int, recall: float, seed: int) -> int:
    """Cells that a search must read for the recall wanted: half of the vectors looked up are rows, half sums of eight rows, as tastes are."""
    drawn = sample.orderBy(F.xxhash64(id, F.lit(seed + 1)), id).limit(5 * MEASURED).select("v").collect()
    x = np.array([r["v"] for r in drawn], np.float64)
    half = MEASURED // 2
    sums = [x[half + 8 * i : half + 8 * i + 8].sum(0) for i in range(half) if half + 8 * i < len(x)]
    q = _unit(np.concatenate([x[:half], np.array(sums).reshape(-1, x.shape[1])]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int32))] * len(q)
        for b in batches:
            scores, cell = q @ _unit(_matrix(b.column(0))).T, b.column(1).to_numpy()
            for i, s in enumerate(scores):
                s, c = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], cell])
                top = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                best[i] = s[top], c[top]
        for i, (s, c) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(s), pa.array(c.astype(np.int32))], ["q", "score", "cell"])

    found = spark.read.parquet(f"{path}/cells").select(vector, "cell").mapInArrow(nearest, "q int, score double, cell int")
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("place") <= k)
    held = top.groupBy("q", "cell").agg(F.count("*").alias("n")).collect()
    order = np.argsort(np.argsort(-q @ centroids.T, axis=1, kind="stable"), axis=1)
    at = np.zeros(len(centroids))
    for r in held:
        at[order[r["q"], r["cell"]]] += r["n"]
    return int(np.searchsorted(np.cumsum(at) / max(1, at.sum()), recall) + 1)


def nearest(spark: SparkSession, index: VectorIndex, vector: list[float], k: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, probes: int | None = None, column: str = "embedding") -> DataFrame:
    """The ``k`` indexed rows nearest to one vector, with ``dist`` (cosine, 6 digits): reads the folders of the probed cells alone.

    ``keep`` filters the rows before they are ranked. A zero vector has no nearest rows; rows with one come last.
    """
    norm = float(np.linalg.norm(vector))
    cells = index.cells(np.array([vector], np.float64), probes)[0].tolist() if norm else []
    rows = keep(index.rows(spark).where(F.col("cell").isin(cells)))
    inner = dot(F.col(column), F.array(*[F.lit(float(x)) for x in vector]))
    return rows.withColumn("dist", F.round(1 - F.try_divide(inner, F.col("norm") * norm), 6)).orderBy(F.asc_nulls_last("dist"), "id").limit(k).drop("norm", "cell")


def nearest_all(index: VectorIndex, queries: DataFrame, k: int, seen: DataFrame | None = None, probes: int | None = None, column: str = "embedding") -> DataFrame:
    """``query_id, id, dist, rank``: the ``k`` indexed rows nearest to each row of ``queries(query_id, vector)``, without its rows of ``seen(query_id, id)``.

    Cells lie in shards of about SHARD rows (a cell with more is dealt to several), queries in
    blocks of about BLOCK; a query goes once to each shard with cells that it probes. A task
    holds one block and one shard however many queries and rows there are, and takes a cell's
    queries as matrix products; it keeps ``k`` rows of a query, so scores are never rows. Zero
    vectors find nothing. Both ids are longs, ``query_id`` is unique.
    """
    spark = queries.sparkSession
    n_probes = probes or index.probes
    rows = index.rows(spark).select(F.col("id").cast("long").alias("id"), F.col(column).alias("v"), "cell")
    # a row for each cell, MOST_CELLS at most; of a cell dealt to several shards each has an even part
    places, at = {}, 0
    for r in rows.groupBy("cell").count().orderBy("cell").collect():
        parts = -(-r["count"] // SHARD)
        places[r["cell"]] = [(at + i * r["count"] // parts) // SHARD for i in range(parts)]
        at += r["count"]
    shared = spark.sparkContext.broadcast((index.centroids, places))
    dealt = spark.createDataFrame(list(places.items()), "cell int, shards array<int>")
    rows = rows.join(F.broadcast(dealt), "cell").withColumn("shard", F.get("shards", F.pmod(F.xxhash64("id"), F.size("shards")).cast("int")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, places = shared.value
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
                x = _matrix(b.column(1))
                cells = _near(centroids, x, n_probes)
                of, shards, lists = [], [], []
                for i, (probed, norm) in enumerate(zip(cells.tolist(), np.linalg.norm(x, axis=1).tolist(), strict=True)):
                    wanted: dict[int, list[int]] = {}
                    for c in probed if norm else []:
                        for shard in set(places.get(c, [])):
                            wanted.setdefault(shard, []).append(c)
                    of += [i] * len(wanted)
                    shards += wanted.keys()
                    lists += wanted.values()
                kept = b.take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shards, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "vector", "seen", "block", "shard", "cells"])

    q = queries.where("vector is not null").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    q = q.checkpoint() if spark.sparkContext.getCheckpointDir() else q.persist()
    blocks = max(1, -(-q.count() // BLOCK))
    if seen is not None:
        q = q.join(seen.groupBy("query_id").agg(F.collect_set(F.col("id").cast("long")).alias("seen")), "query_id", "left")
    else:
        q = q.withColumn("seen", F.lit(None).cast("array<long>"))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = q.select("query_id", "vector", "seen", "block").mapInArrow(ask, "query_id long, vector array<double>, seen array<long>, block int, shard int, cells array<int>")
    # a shard meets every block
    rows = rows.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v", "cell")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return nearest_rows([], [], k, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0, np.int64), [])
        b = b.sort_by("cell")
        cell = b["cell"].to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        lists = a["cells"].combine_chunks()
        who, probed = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
        order = np.argsort(probed, kind="stable")
        who, probed = who[order], probed[order]
        sections = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            i, j = np.searchsorted(probed, [cell[lo], cell[lo] + 1])
            sections.append((lo, hi, np.sort(who[i:j])))
        return nearest_rows(a["query_id"], a["seen"], k, _matrix(a["vector"]), _matrix(b["v"]), b["id"].to_numpy(), sections)

    found = asked.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard")).applyInArrow(score, "query_id long, id long, dist double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))).where(F.col("rank") <= k)


def nearest_rows(query_ids: pa.ChunkedArray, seen: pa.ChunkedArray, k: int, y: np.ndarray, x: np.ndarray, ids: np.ndarray, sections: list[tuple[int, int, np.ndarray | None]], undefined: bool = False) -> pa.Table:
    """``query_id, id, dist``: for each row of ``y`` the ``k`` rows of ``x`` nearest by cosine (6 digits, ties by id), without the ids in its list of ``seen``.

    ``sections`` are stretches ``lo, hi`` of ``x`` with the sorted places of the queries that ask
    them, None for all. Products in single precision tell which rows may be among the ``k``;
    their distances are then taken in double precision, so the result is that of a whole scan.
    Distances that are undefined are left out, or come last as NaN where ``undefined`` is set.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(y) and len(x):
        y_norm, x_norm = np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)
        some_y, some_x = (np.isfinite(n) & (n > 0) for n in (y_norm, x_norm))
        u, v = (np.where(some[:, None], z, 0) / np.where(some, n, 1)[:, None] for z, n, some in ((y, y_norm, some_y), (x, x_norm, some_x)))
        u, v = u.astype(np.float32), v.astype(np.float32)
        slack = 1.1e-6 + 2 * (x.shape[1] + 4) * 6e-8  # a step of the rounding and what single precision may be off
        lists = seen.combine_chunks() if isinstance(seen, pa.ChunkedArray) else seen
        gone_q, gone_id = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        by_id = np.argsort(ids, kind="stable")
        first, end = (np.searchsorted(ids, gone_id, side, sorter=by_id) for side in ("left", "right"))
        times = end - first
        gone_q, gone_at = np.repeat(gone_q, times), by_id[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]

        def exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = np.empty(len(q))
            for i in range(0, len(q), 1 << 15):
                a, b = q[i : i + (1 << 15)], c[i : i + (1 << 15)]
                d[i : i + (1 << 15)] = np.round(1 - np.einsum("ij,ij->i", y[a], x[b]) / (y_norm[a] * x_norm[b]), 6)
            order = np.lexsort((ids[c], d, q))
            q, c, d = q[order], c[order], d[order]
            best = _places(q) < k
            return q[best], c[best], d[best]

        for lo_q in range(0, len(y), QUERIES):
            n = min(QUERIES, len(y) - lo_q)
            least = np.where(some_y[lo_q : lo_q + n], np.float32(-2), np.float32(np.inf))
            mine = slice(*np.searchsorted(gone_q, [lo_q, lo_q + n]))
            order = np.argsort(gone_at[mine], kind="stable")
            g_q, g_at = gone_q[mine][order] - lo_q, gone_at[mine][order]
            q, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
            for lo, hi, who in sections:
                asked = np.arange(n) if who is None else who[slice(*np.searchsorted(who, [lo_q, lo_q + n]))] - lo_q
                if not len(asked):
                    continue
                row = np.full(n, -1)
                row[asked] = np.arange(len(asked))
                for at in range(lo, hi, ROWS):
                    end = min(at + ROWS, hi)
                    scores = u[lo_q + asked] @ v[at:end].T
                    scores[:, ~some_x[at:end]] = -np.inf
                    i, j = np.searchsorted(g_at, [at, end])
                    r = row[g_q[i:j]]
                    scores[r[r >= 0], g_at[i:j][r >= 0] - at] = -np.inf
                    new = np.flatnonzero(least[asked] == -2)
                    if len(new) and end - at > k:
                        least[asked[new]] = np.maximum(np.partition(scores[new], -k, axis=1)[:, -k] - np.float32(slack), np.float32(-2))
                    r, col = np.nonzero(scores >= least[asked][:, None])
                    if not len(r):
                        continue
                    q, c, s = np.r_[q, asked[r]], np.r_[c, col + at], np.r_[s, scores[r, col]]
                    if len(q) > MOST_HELD:  # very many at one distance
                        q, c, d = exact(q + lo_q, c)
                        q, s = q - lo_q, (1 - d).astype(np.float32)
                    order = np.lexsort((-s, q))
                    q, c, s = q[order], c[order], s[order]
                    last = np.flatnonzero(_places(q) == k - 1)
                    least[q[last]] = np.maximum(least[q[last]], s[last] - np.float32(slack))
                    kept = s >= least[q]
                    q, c, s = q[kept], c[kept], s[kept]
            out.append(exact(q + lo_q, c))
        if undefined:
            had = np.bincount(np.concatenate([q for q, _, _ in out]), minlength=len(y))
            rest = by_id[~some_x[by_id]]
            for i in np.flatnonzero(had < k).tolist():
                more = rest if some_y[i] else by_id
                more = more[~np.isin(more, gone_at[slice(*np.searchsorted(gone_q, [i, i + 1]))])][: k - had[i]]
                out.append((np.full(len(more), i), more, np.full(len(more), np.nan)))
    q, c, d = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    names = query_ids.to_numpy() if len(query_ids) else np.zeros(0, np.int64)
    return pa.table({"query_id": pa.array(names[q].astype(np.int64)), "id": pa.array(ids[c].astype(np.int64)), "dist": pa.array(d.astype(np.float64))})


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each of the sorted keys among its equals, from 0."""
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    starts = np.flatnonzero(new)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
