"""Tables in buckets that are changed in place, and writes that count what they change.

A table is a folder of Parquet files, one folder for each bucket of the key's hash. A change
reads and replaces only the buckets that hold its keys: the new rows are written beside the
table first and then moved in by an overwrite of those partitions alone, so that a job that is
lost in between is simply run again. Other buckets keep their files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stanzaflow.sources.tables import fresh_folder, upsert

#: Buckets of a new table.
BUCKETS = 64


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def create(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Writes ``rows`` as a table in buckets of ``key``; column ``bucket`` is the table's own."""
    spark = rows.sparkSession
    plan = {"key": key, "buckets": buckets, "schema": rows.schema.json()}
    rows.withColumn("bucket", _bucket(key, buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(plan),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")


def _plan(spark: SparkSession, path: str) -> tuple[str, int, StructType]:
    plan = json.loads(spark.read.text(f"{path}/plan").first()[0])
    return plan["key"], plan["buckets"], StructType.fromJson(json.loads(plan["schema"]))


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("bucket", IntegerType())])


def read(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows; of some buckets alone if given."""
    _, _, schema = _plan(spark, path)
    rows = spark.read.schema(_with_bucket(schema)).parquet(f"{path}/rows")
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).select(*schema.names)


def rewrite(spark: SparkSession, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replaces the buckets of ``keys`` by what ``change`` makes of their rows; returns how many that are.

    The driver holds the numbers of the buckets, ``BUCKETS`` at most, never keys or rows.
    """
    key, n, schema = _plan(spark, path)
    touched = [r["bucket"] for r in keys.select(_bucket(key, n).alias("bucket")).distinct().collect()]
    if not touched:
        return 0
    staged = fresh_folder(spark, "staged")
    new = change(read(spark, path, touched)).select(*schema.names).withColumn("bucket", _bucket(key, n))
    new.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(staged)
    rows = spark.read.schema(_with_bucket(schema)).parquet(staged)
    rows.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    filled = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    for b in set(touched) - filled:  # a bucket that lost its last row has no partition to overwrite
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(f"{path}/rows")
    return len(touched)


def upsert_rows(spark: SparkSession, path: str, batch: DataFrame, order: str | None = None) -> int:
    """Rows of the batch replace rows with their key or are added; of equal keys in the batch the last by ``order`` counts."""
    key, _, _ = _plan(spark, path)
    return rewrite(spark, path, batch.select(key), lambda rows: upsert(rows, batch, key, order))


def update_rows(spark: SparkSession, path: str, patch: DataFrame) -> int:
    """Non-null values of the patch replace those of the table, by key; keys that the table doesn't have are left out."""
    from stanzaflow.sources.tables import sparse_update

    key, _, _ = _plan(spark, path)
    return rewrite(spark, path, patch.select(key), lambda rows: sparse_update(rows, patch, key))


def delete_rows(spark: SparkSession, path: str, gone: DataFrame, *children: tuple[str, str]) -> int:
    """Removes the rows with the keys ``gone(key)``, first those of ``children`` (path of a table, its column that names the key)."""
    key, _, _ = _plan(spark, path)
    for child, column in children:
        own, _, _ = _plan(spark, child)
        keys = read(spark, child).join(gone.select(F.col(key).alias(column)), column, "left_semi").select(own)
        rewrite(spark, child, keys, lambda rows, column=column: rows.join(gone.select(F.col(key).alias(column)), column, "left_anti"))
    return rewrite(spark, path, gone.select(key), lambda rows: rows.join(gone.select(key), key, "left_anti"))


def ingest(spark: SparkSession, source: str, schema: str, path: str, log: str, checkpoint: str, check: Column | None = None, files: int = 1, order: str | None = None) -> None:
    """Upserts the files that ``source`` (a folder of JSON lines) has gained, batch by batch; a batch that fails is noted and the others go on.

    A batch is ``files`` files. It fails as a whole, as a database's would: if a row breaks
    ``check`` or can't be read. ``log`` gets one row for each batch, ``batch, n_rows, error``
    (null: applied). The checkpoint knows which files were seen, so running this again takes
    up new files only; a batch that was under way when its job was lost is done again with
    the same number and the same result.
    """

    def apply(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        error = None
        try:
            n = batch.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(check, F.lit(False)) if check is not None else F.lit(False)).alias("bad")).first()
            if n["bad"]:
                raise ValueError(f"{n['bad']} rows break the check")
            upsert_rows(own, path, batch, order)
        except Exception as e:  # whatever is wrong with a batch, the next ones go on
            error = str(e).splitlines()[0][:500]
        rows = n["n"] if error is None or "n" in locals() else None
        said = own.createDataFrame([(number, rows, error)], "batch long, n_rows long, error string")
        said.coalesce(1).write.mode("overwrite").parquet(f"{log}/number={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("mode", "FAILFAST").json(source)
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batches(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema("batch long, n_rows long, error string").parquet(f"{log}/number=*")


# ---- counted in the pass that writes ----


def update_counted(rows: DataFrame, changes: dict[str, Column], path: str) -> tuple[DataFrame, dict[str, int]]:
    """Writes ``rows`` with ``changes`` applied to ``path``; returns what was written and how many values of each column changed.

    One scan: the counts are observed while the rows are written.
    """
    seen = Observation()
    new = rows.withColumns({f"_new_{c}": e for c, e in changes.items()})
    counted = new.observe(seen, F.count("*").alias("n_rows"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_new_{c}"))).alias(c) for c in changes])
    counted.select(*[F.col(f"_new_{c}").alias(c) if c in changes else F.col(c) for c in rows.columns]).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), dict(seen.get)


def split_counted(rows: DataFrame, reasons: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Writes ``rows`` to ``path``, kept and removed ones in folders of their own; returns both and the counts.

    ``reasons`` name the conditions under which a row goes (null: it stays); removed rows
    have the ``reasons`` that hold. One scan writes both and counts rows, kept rows and each reason.
    """
    seen = Observation()
    held = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items()]), lambda x: x.isNotNull())
    marked = rows.withColumn("reasons", held).withColumn("removed", F.size("reasons") > 0)
    counts = [F.count_if(F.array_contains("reasons", name)).alias(name) for name in reasons]
    marked.observe(seen, F.count("*").alias("n_rows"), F.count_if(~F.col("removed")).alias("n_kept"), *counts).write.mode("overwrite").partitionBy("removed").parquet(path)
    back = rows.sparkSession.read.schema(StructType([*marked.schema.fields])).parquet(path)
    return back.where("not removed").select(*rows.columns), back.where("removed").drop("removed"), dict(seen.get)


def clean_counted(rows: DataFrame, steps: list[tuple[str, Column]], column: str, path: str, key: str = "id") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Applies named steps to ``column`` one after another and writes the rows; returns them, the change log ``key, step, before, after``, and the counts.

    A step is an expression on ``column``. The log has a row for each step that changed a
    value, with the value's length before and after; it is written with the rows and read from there.
    """
    seen = Observation()
    out = rows.withColumn("_log", F.array().cast("array<struct<step: string, before: int, after: int>>"))
    for name, new in steps:
        out = out.withColumn("_new", new)
        entry = F.struct(F.lit(name).alias("step"), F.length(column).alias("before"), F.length("_new").alias("after"))
        out = out.withColumn("_log", F.when(F.col(column).eqNullSafe(F.col("_new")), F.col("_log")).otherwise(F.array_append("_log", entry))).withColumn(column, F.col("_new")).drop("_new")
    said = F.transform("_log", lambda e: e["step"])
    counts = [F.count_if(F.array_contains(said, name)).alias(name) for name, _ in steps]
    out.observe(seen, F.count("*").alias("n_rows"), F.count_if(F.size("_log") > 0).alias("n_changed"), *counts).write.mode("overwrite").parquet(path)
    back = rows.sparkSession.read.schema(out.schema).parquet(path)
    return back.select(*rows.columns), back.select(key, F.inline("_log")), dict(seen.get)
