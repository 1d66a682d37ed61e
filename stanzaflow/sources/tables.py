"""Sinks and table changes as pure functions from tables to tables.

Spark tables are rewritten as a whole: every change returns the new table, and a count of
what changed comes from ``changed``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="stanzaflow_")
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _markdown(df: DataFrame) -> Column:
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table."""
    return df.select(_markdown(df).alias("line"))


def write_listing(rows: DataFrame, order: str, folder: str) -> None:
    """The rows in order as CSV with a header (``folder/csv``) and as one Markdown table (``folder/md``), in files whose names are in order."""
    sorted_ = rows.orderBy(order)
    write_csv(sorted_, f"{folder}/csv")
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "part int, line string")
    lines = rows.select(F.lit(2).alias("part"), F.col(order).alias("at"), _markdown(rows).alias("line"))
    head.select("part", F.lit(None).cast(rows.schema[order].dataType).alias("at"), "line").unionByName(lines).orderBy("part", "at").select("line").write.mode("overwrite").text(f"{folder}/md")


def upsert(table: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of the batch replace rows with their key; of equal keys in the batch the last by ``order`` counts."""
    if order:
        batch = batch.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
    new = batch.select(*table.columns)
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new)


def insert_ignore(table: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    return table.unionByName(batch.join(table.select(key), key, "left_anti").select(*table.columns))


def update_distinct(table: DataFrame, new: Column, column: str) -> tuple[DataFrame, DataFrame]:
    """The table with ``column`` set to ``new``, and one row with how many rows that changes."""
    out = table.withColumn("_new", new)
    n = out.agg(F.count_if(~F.col(column).eqNullSafe(F.col("_new"))).alias("n_changed"))
    return out.withColumn(column, F.col("_new")).drop("_new"), n


def sparse_update(table: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Non-null values of the patch replace those of the table, by key; the patch has a row for each key at most."""
    names = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in names])
    return table.join(p, key, "left").select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, gone: Column, *children: tuple[DataFrame, str], key: str = "id") -> list[DataFrame]:
    """The table without the rows where ``gone`` is true, and each child table without their rows."""
    gone = F.coalesce(gone, F.lit(False))
    ids = table.where(gone).select(F.col(key).alias("_gone")).distinct()
    return [table.where(~gone), *(c.join(ids, F.col(k) == F.col("_gone"), "left_anti") for c, k in children)]


def rename(table: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Values of a column renamed by a fixed map, many to one."""
    if not names:
        return table
    m = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return table.withColumn(column, F.coalesce(F.try_element_at(m, F.col(column)), F.col(column)))


def missing_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles with one added for each user without any."""
    new = users.join(profiles.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("display_name"), F.lit(True).alias("is_anonymous"))
    return profiles.select("id", "display_name", "is_anonymous").unionByName(new)


def numeric_suffix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("long")


def numbered_rows(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The rows with their number from 1 on in the given order, from counts of range partitions: never in one task.

    The partitions are dealt once and kept (in the checkpoint folder if there is one): their bounds come
    from a sample, and one drawn for the counts and another for the rows would differ on larger tables.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = (lambda d: d.checkpoint()) if rows.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d.persist())
    dealt = keep(rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()))
    local = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    before = local.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def assign_ids(table: DataFrame, batch: DataFrame, order: str, prefix: str = "poem", width: int = 4) -> DataFrame:
    """The batch with ids that go on from the largest number in use, in the given order.

    Numbers come from counts of range partitions, so the batch is never in one task.
    """
    base = table.agg(F.coalesce(F.max(numeric_suffix(F.col("id"))), F.lit(0)).alias("base"))
    numbered = numbered_rows(batch, order, "_i").join(F.broadcast(base), F.lit(True))
    return numbered.withColumn("id", F.format_string(f"{prefix}_%0{width}d", F.col("base") + F.col("_i"))).drop("_i", "base")


def chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    """The rows with the number of their chunk of ``size`` rows in the given order."""
    return numbered_rows(df, order, "_row").withColumn("chunk", F.floor((F.col("_row") - 1) / size)).drop("_row")


def insert_missing(table: DataFrame, batch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with the batch's rows of new ids, and one row ``n_batch, n_present, base``: base is the largest number less the batch's size."""
    new = batch.join(table.select(key), key, "left_anti").select(*table.columns)
    n = batch.agg(F.count("*").alias("n_batch")).join(batch.join(table.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_present")), F.lit(True))
    top = table.agg(F.coalesce(F.max(numeric_suffix(F.col(key).cast("string"))), F.lit(0)).alias("top"))
    return table.unionByName(new), n.join(top, F.lit(True)).select("n_batch", "n_present", (F.col("top") - F.col("n_batch")).alias("base"))


def append_events(log: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The log with rows ``user_id, poem_id, action`` appended: ids go on from the largest, all at the time ``now``."""
    base = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base"))
    rows = numbered_rows(new.withColumn("_order", F.struct("user_id", "poem_id", "action")), "_order", "_i").join(F.broadcast(base), F.lit(True))
    return log.unionByName(rows.select((F.col("_base") + F.col("_i")).cast("long").alias("id"), "user_id", "poem_id", "action", now.alias("created_at")).select(*log.columns))


def own_rows(table: DataFrame, reader: int | str, column: str = "user_id") -> DataFrame:
    """What a reader may see of a table: the rows that are theirs; none without a reader."""
    return table.where(F.col(column) == F.lit(reader)) if reader is not None else table.where(F.lit(False))


def write_in_steps(rows: DataFrame, path: str, order: str, size: int = 100) -> int:
    """Appends the rows that ``path`` doesn't hold yet, ``size`` at a time in order; a broken run goes on where it stopped. Returns the steps."""
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(order), order, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # a write to the path makes Spark read it again, so each step takes its range of rows that are still missing
    steps = chunks(rows, order, size).groupBy("chunk").agg(F.min(order).alias("least"), F.max(order).alias("most")).orderBy("chunk").collect()
    for step in steps:
        rows.where(F.col(order).between(step["least"], step["most"])).write.mode("append").parquet(path)
    return len(steps)
