"""Exact duplicates by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Characters that the second step hashes.
PREFIX = 256
#: Keys of a step that are sent to every task at most, about 24 MB.
MOST_KEYS = 1 << 20


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, most_keys: int = MOST_KEYS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    1. Rows are counted by the length of the text in bytes; only rows whose length recurs go on.
    2. A hash of the first ``prefix`` characters is made for those and counted with the length; only rows whose pair recurs go on.
    3. Those are hashed in full (SHA-256) and grouped by length, prefix and digest.

    The digest of every text is part of the result, so it is made once more for output, in
    the pass that looks the groups up. Texts aren't normalised; null counts as empty; a very
    long text is only hashed, never shuffled. Of equal texts the row with the largest doc_id
    stays (of repeated rows with that doc_id too, one is counted as kept by its id, so all
    of them read ``kept``); null doc_ids are smaller than all others. An empty table gives
    an empty result; other columns are ignored.

    The recurring lengths and pairs are counted with map-side combining and written; up to
    ``most_keys`` of them are sent to all tasks, so that rows that drop out are dropped where
    they are read. Beyond that, rows meet the keys in a shuffled join, for which the hash of
    the step is made first, so that no text travels. Rows look their group up in a join whose
    large partitions Spark can split, so a group that holds a third of all rows is never
    gathered in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("len"))
    # never null, and said to be so: else the join on it filters by a digest of every text, below the steps that drop rows
    head, digest = F.xxhash64(F.substring("text", 1, prefix)), F.coalesce(F.sha2("text", 256), F.lit(""))

    def recurring(found: DataFrame, *by: str) -> tuple[DataFrame, bool]:
        again = cut(found.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        return again, again.limit(most_keys + 1).count() <= most_keys

    def surviving(found: DataFrame, keys: DataFrame, few: bool, name: str, made: F.Column) -> DataFrame:
        """Rows with a recurring key, and the hash of the next step: made after the keys are asked if they fit into every task."""
        if few:
            return found.join(F.broadcast(keys), keys.columns, "left_semi").withColumn(name, made)
        return found.withColumn(name, made).drop("text").join(keys, keys.columns, "left_semi")

    lengths, few_lengths = recurring(rows.select("len"), "len")
    by_length = lambda of: surviving(of, lengths, few_lengths, "head", head)
    heads, few_heads = recurring(by_length(rows.select("text", "len")).select("len", "head"), "len", "head")
    if few_lengths and few_heads:
        by_head = surviving(by_length(rows), heads, True, "text_sha256", digest)
    else:
        by_head = rows.select("doc_id", "len", head.alias("head"), digest.alias("text_sha256")).join(lengths, "len", "left_semi").join(heads, ["len", "head"], "left_semi")
    groups = by_head.groupBy("len", "head", "text_sha256").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where("n > 1").select("text_sha256", "n", "keep")
    return rows.select("doc_id", digest.alias("text_sha256")).join(groups, "text_sha256", "left").select(
        "doc_id",
        F.coalesce("keep", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep", "doc_id")).alias("kept"),
        "text_sha256",
    )
