"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def return_memory() -> None:
    """Lets this process give large freed arrays back to the system at once (glibc only), since a worker outlives its stage."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Returns what is freed but held by Arrow's pool and glibc: a worker stays, idle, beside the stages after its own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder
    is made and set; a cluster without a shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="shared_")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as ``df`` has such columns (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from reliable storage, with the lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = shared_dir(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the least node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), written as
    aggregate and join so that a node with very many neighbours is never gathered in
    one task. Nodes without an edge don't appear. Loops and repeated edges are allowed.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _digest(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = cut(small.where("a <> b").distinct())
        now = _digest(e)
        if now == state:
            break
        state = now
    rooted = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionAll(rooted.select(F.col("root").alias("node"), "root").distinct())


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.expr("sum(cast(b as decimal(38,0)))").alias("s")).first()
    return row["n"], row["x"], row["s"]


def spread_hot(rows: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """Adds ``tile`` and ``side`` so that a task gets at most about ``2 * limit`` rows of a key.

    Rows of a key with up to ``limit`` rows have tile 0 and side 0: compare each with each.
    A larger key is cut into ``t`` parts by the hash of ``item``. A row goes to one tile
    for each part: its own part's tile (side 0 only) and the tiles shared with another
    part, where rows of side 0 meet those of side 1. Every pair meets in exactly one tile.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    parts = F.when(F.col("_n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("_n") / limit)).cast("long")
    own = F.pmod(F.xxhash64(F.col(item), F.lit("part")), F.col("_t"))
    return (
        rows.join(hot, key, "left").withColumn("_t", parts).withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1)))
        .withColumn("tile", F.least("_own", "_other") * F.col("_t") + F.greatest("_own", "_other"))
        .withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
        .drop("_n", "_t", "_own", "_other")
    )


class Forest:
    """Union-find over small integers; ``join`` tells whether two sets became one."""

    def labels(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while True:
            top = up[up]
            if (top == up).all():
                self.up = up.tolist()
                return up
            up = top

    def connect(self, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
        """Joins all pairs (p[i], q[i]) and returns those that joined two sets; at most a pair for each member is looked at singly in a round."""
        out = []
        while len(p):
            label = self.labels()
            open_ = label[p] != label[q]
            p, q = p[open_], q[open_]
            for side in (p, q):
                first = np.unique(side, return_index=True)[1]
                out += [(x, y) for x, y in zip(p[first].tolist(), q[first].tolist()) if self.join(x, y)]
        return out

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True
