"""Hard negatives: anchors against all rows by a two-dimensional block product (SUMMA).

Rows and anchors are dealt into blocks and every block into chunks of dimensions. The
chunks of both sides meet in the cells of the grid of (anchor block, row block); a cell's
task adds up the products of its chunks and reduces the tile of int64 scores at once, so
scores never leave it. The grid is gone through twice: for the best rows of the anchor's
own label, and, when the positives are known, for the best rows in each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fresh_dir, return_memory

return_memory()

#: Anchors and rows of a block; a tile of scores has the product of both, 16 MB. All rows are copied for each block of anchors.
ANCHORS, ROWS = 1024, 2048
#: Tiles of a file, where the scores themselves are kept: writer and reader of Parquet hold up to all rows of one at once (pages are cut after 100 rows, batches after 4,096).
TILES = 8
#: Dimensions of a chunk at least, and chunks of a vector at most.
CHUNK, CHUNKS = 32, 8
#: Sums below this are exact in double precision.
EXACT = 2.0**53

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90

#: Packed blocks, and tiles of scores.
_PACKED = "size int, block long, ids array<long>, labels array<string>, chunk int, body binary"
_TILES = "a_block long, r_block long, a_ids array<long>, a_labels array<string>, ids array<long>, labels array<string>, scores binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component x, taken as double; null if the vector is null, empty or holds a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _narrowest(x: np.ndarray) -> np.dtype:
    """The smallest kind of whole numbers that holds all of x."""
    return np.result_type(np.int8, *[np.min_scalar_type(int(k)) if k < 0 else np.min_scalar_type(-int(k) - 1) for k in (x.min(initial=0), x.max(initial=0))])


def _packed(rows: DataFrame, count: int, most: int) -> DataFrame:
    """``rows(id, label, q)`` in blocks of up to ``most`` rows of one size, a row for each chunk of dimensions; dealt in turn, so no key decides where a row goes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def block(size: int) -> pa.RecordBatch:
            nonlocal made
            ids, labels, vectors = zip(*held.pop(size), strict=True)
            x = np.concatenate(vectors)
            made += 1
            chunk = max(CHUNK, -(-size // CHUNKS))
            x = x.astype(_narrowest(x))
            bodies = [np.ascontiguousarray(x[:, k : k + chunk]).tobytes() for k in range(0, size, chunk)]
            n = len(bodies)
            ids_, labels_ = pa.array([np.concatenate(ids)] * n, pa.list_(pa.int64())), pa.array([[y for part in labels for y in part]] * n, pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([size] * n, pa.int32()), pa.array([base + made] * n), ids_, labels_, pa.array(range(n), pa.int32()), pa.array(bodies, pa.binary())], ["size", "block", "ids", "labels", "chunk", "body"])

        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                mine = b.filter(pa.array(sizes == size))
                ids, labels = mine.column(0).to_numpy(zero_copy_only=False), mine.column(1).to_pylist()
                x = mine.column(2).flatten().to_numpy().reshape(-1, size)
                at = 0
                while at < len(x):
                    have = sum(len(p[0]) for p in held.get(size, []))
                    upto = min(len(x), at + most - have)
                    held.setdefault(size, []).append((ids[at:upto], labels[at:upto], x[at:upto]))
                    if have + upto - at == most:
                        yield block(size)
                    at = upto
        for size in list(held):
            yield block(size)

    return rows.repartition(max(1, -(-count // most))).mapInArrow(pack, _PACKED)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 product of a and the transpose of b; in double precision where that is exact."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _cells(anchors: DataFrame, rows: DataFrame, reduce: Callable[[pa.RecordBatch], list[pa.RecordBatch]], schema: str, wanted: DataFrame | None = None) -> DataFrame:
    """What ``reduce`` makes of the tile of scores of each cell of the grid of anchor blocks and row blocks.

    A tile is a row of ``_TILES``, with ``wanted(a_block, wanted)`` also that; anchor blocks without ``wanted`` have no cells.
    Only blocks travel: numbers as narrow as they are, a copy for each block of the other side.
    """
    if wanted is not None:
        anchors = anchors.join(wanted.withColumnRenamed("a_block", "block"), "block")
    # a row for each block, so small that every task may have them; a join by size would gather all bodies in one task
    a_blocks = F.broadcast(anchors.where("chunk = 0").select("size", F.col("block").alias("a_block")))
    r_blocks = F.broadcast(rows.where("chunk = 0").select("size", F.col("block").alias("r_block")))
    once = lambda c: F.when(F.col("chunk") == 0, F.col(c)).alias(c)  # noqa: E731  one chunk names the rows
    side = lambda df, block: df.select("size", "chunk", F.col("block").alias(block), once("ids"), once("labels"), F.size("ids").alias("n"), "body", *[once(c) for c in ("wanted",) if c in df.columns])
    down, across = side(anchors, "a_block").join(r_blocks, "size"), side(rows, "r_block").join(a_blocks, "size")

    def side_of(table: pa.Table) -> tuple[dict[int, np.ndarray], int]:
        """Each chunk as a matrix, and the place of the one that names the rows."""
        chunks, named = {}, 0
        for i, (k, size, n, body) in enumerate(zip(table["chunk"].to_pylist(), table["size"].to_pylist(), table["n"].to_pylist(), table["body"], strict=True)):
            chunk = max(CHUNK, -(-size // CHUNKS))
            width = min(chunk, size - k * chunk)
            buffer = body.as_buffer()
            chunks[k] = np.frombuffer(buffer, np.dtype(f"i{buffer.size // (n * width)}")).reshape(n, width)
            named = i if k == 0 else named
        return chunks, named

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        (a, i), (b, j) = side_of(left), side_of(right)
        total = None
        for k in sorted(a):
            part = _product(a[k], b[k])
            total = part if total is None else np.add(total, part, out=total)
        named = {"a_block": left["a_block"].slice(i, 1), "r_block": right["r_block"].slice(j, 1), "a_ids": left["ids"].slice(i, 1), "a_labels": left["labels"].slice(i, 1), "ids": right["ids"].slice(j, 1), "labels": right["labels"].slice(j, 1)}
        tile = pa.table(named | {"scores": pa.array([total.tobytes()], pa.binary())} | {c: left[c].slice(i, 1) for c in ("wanted",) if c in left.column_names})
        return pa.Table.from_batches(reduce(tile.combine_chunks().to_batches()[0]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return down.groupBy("a_block", "r_block").cogroup(across.groupBy("a_block", "r_block")).applyInArrow(meet, schema)


def _score_tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """``a_block, r_block, a_ids, a_labels, ids, labels, scores``: the tiles themselves, written and read again; 8 bytes for each anchor and row, so ``hard_negatives`` doesn't keep them."""
    out = fresh_dir(anchors.sparkSession, "score-tiles")
    _cells(anchors, rows, lambda tile: [tile], _TILES).write.option("maxRecordsPerFile", TILES).parquet(out)
    return anchors.sparkSession.read.parquet(out)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k places of the highest scores, ties by smaller id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _tile(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of anchors, ids of rows, scores, and whether both have one label."""
    a_ids, ids = (b[c][i].values.to_numpy() for c in ("a_ids", "ids"))
    code = np.unique(np.array(b["a_labels"][i].as_py() + b["labels"][i].as_py(), dtype=str), return_inverse=True)[1]
    scores = np.frombuffer(b["scores"][i].as_buffer(), np.int64).reshape(len(a_ids), len(ids))
    return a_ids, ids, scores, code[: len(a_ids), None] == code[None, len(a_ids) :]


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            a_ids, ids, scores, same = _tile(b, i)
            slot, found = [], []
            for r, a in enumerate(a_ids.tolist()):
                at = np.flatnonzero(same[r] & (ids != a))
                best = at[_best(scores[r, at], ids[at], k)]
                slot += [r] * len(best)
                found.append(best)
            at, slots = np.concatenate(found), np.array(slot, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([b["a_block"][i].as_py()] * len(at), pa.int64()), pa.array(slots), pa.array(a_ids[slots]), pa.array(ids[at]), pa.array(scores[slots, at])], ["a_block", "slot", "anchor_id", "positive_id", "positive_score"])


def _negatives(batches: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            _, ids, scores, same = _tile(b, i)
            pairs, found = [], []
            for w in b["wanted"][i].as_py():
                r, p = w["slot"], w["positive_score"]
                # rational bounds as whole numbers: ceil(low * p / 100) to floor(high * p / 100)
                at = np.flatnonzero(~same[r] & (scores[r] >= -(-low * p // 100)) & (scores[r] <= high * p // 100))
                best = at[_best(scores[r, at], ids[at], k)]
                pairs += [(w["pair"], s) for s in scores[r, best].tolist()]
                found.append(ids[best])
            pair, score = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])), pa.array(score, pa.int64())], ["pair", "negative_id", "negative_score"])


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among ``rows(vec_id, label, q)``.

    ``q`` are whole-number vectors, ``anchor`` says which rows are anchors. A row's score is
    its inner product with the anchor; higher come first, ties by smaller vec_id. The first
    ``positives`` other rows of the anchor's label are its positives; for each, the first
    ``negatives`` rows of another label are returned whose score lies between ``low`` and
    ``high`` percent of the positive's, ranked from 1.

    Rows whose vec_id, label or vector is null take no part, nor do empty vectors; vectors of
    different sizes don't meet. Rows that repeat a vec_id are rows of their own (as anchors
    too: the results then repeat), but none is another row to an anchor with its id. A
    positive with no row in its window, and an anchor without positives, give nothing; so
    does an empty table. Scores are int64. Other columns are ignored; ``anchor`` may use them.

    Every anchor meets every row, block by block: scores grow with anchors times rows, but
    are made and reduced in the task of a cell (16 MB at every size). What is shuffled are
    the blocks, for each block of the other side, and the best rows of each cell; blocks are
    filled in turn, so no label or id is hot.
    """
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & (F.size("q") > 0)
    kept = cut(rows.where(fine).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("q").cast("array<long>").alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor")))
    n, n_anchors = kept.agg(F.count("*"), F.coalesce(F.count_if("anchor"), F.lit(0))).first()
    a = cut(_packed(kept.where("anchor").select("id", "label", "q"), n_anchors, ANCHORS))
    b = cut(_packed(kept.select("id", "label", "q"), n, ROWS))
    near = _cells(a, b, lambda x: list(_positives([x], positives)), "a_block long, slot long, anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("a_block", "slot").orderBy(F.desc("positive_score"), "positive_id")
    chosen = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    pairs = cut(chosen.withColumn("pair", F.monotonically_increasing_id()))
    wanted = pairs.groupBy("a_block").agg(F.collect_list(F.struct("pair", "slot", "positive_score")).alias("wanted"))  # at most ANCHORS * positives of a block
    far = _cells(a, b, lambda x: list(_negatives([x], negatives, low, high)), "pair long, negative_id long, negative_score long", wanted)
    first = Window.partitionBy("pair").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= negatives)
    return ranked.join(pairs, "pair").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
