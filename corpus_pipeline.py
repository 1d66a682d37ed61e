"""A training corpus from ``documents``: each stage is one operator of stanzaflow.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.llm import byte_bpe, language_id
from stanzaflow.llm.exact_dedup import exact_dedup
from stanzaflow.llm.mixing import mix
from stanzaflow.llm.shared import free_names, fresh_dir
from stanzaflow.llm.simhash_dedup import simhash_dedup


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id, null included, and text are among ``rows(doc_id, text_sha256)``."""
    wanted, digest, own = free_names(docs, "_id", "_digest", "_text")
    same = F.col("doc_id").eqNullSafe(F.col(wanted)) & (F.col(own) == F.col(digest))
    return docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256)).join(rows.select("doc_id", "text_sha256").toDF(wanted, digest), same, "left_semi")


#: A document stays if its language is among LANGUAGES (None: any that the model knows) with at least this posterior
#: probability: below one half, another language is likelier than not.
LANGUAGES, LEAST_SCORE = None, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model holds to be in a language wanted; ``lang`` is what it says.

    Those without text or letters go, those in other languages, and those of which it isn't
    sure. The model learns from the labelled documents of the stage's own input, but for
    the held-out fold.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    said, score = free_names(docs, "_lang", "_score")
    stays = (F.col(said) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    if LANGUAGES is not None:
        stays &= F.col(said).isin(list(LANGUAGES))
    return language_id.identify(docs, model, said, score).where(stays).withColumn("lang", F.col(said)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id; rows that repeat both count once."""
    (digest,) = free_names(docs, "_text")
    return _only(docs, exact_dedup(docs).where("kept")).dropDuplicates(["doc_id", digest]).select(*docs.columns)


#: Near copies are texts whose fingerprints over pairs of words differ in this many bits at most. Of 48 pairs of texts in
#: the 0.1 tables whose five-word shingles have a Jaccard similarity of 0.8 or more it links 43; of all pairs that it
#: links, none has less than 0.2 and 16 of 475 less than 0.5.
NEAR_WORDS, NEAR_RADIUS = 2, 8


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest doc_id and of its texts that with the least SHA-256."""
    rows = simhash_dedup(docs, words=NEAR_WORDS, radius=NEAR_RADIUS, by_row=True).where("kept")
    chosen = rows.groupBy("root").agg(F.min(F.struct("text_sha256", "doc_id")).alias("row")).select("row.*")
    return _only(docs, chosen).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that agree in doc_id, source and text share what theirs take."""
    doc_id, source, text, own, taken, rows, copy = free_names(docs, "_id", "_source", "_hash", "_own", "_taken", "_rows", "_copy")
    mixed = mix(docs, by_row=True).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0").toDF(doc_id, source, text, taken, rows)
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(text))
    more = F.pmod(F.xxhash64(*docs.columns), F.col(rows)) < F.col(taken) % F.col(rows)
    copies = F.floor(F.col(taken) / F.col(rows)) + more.cast("long")
    return hashed.join(mixed, same).withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, and the digest of what they decode to."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(docs.select("doc_id", "source", "text"), *vocabulary, decoded="decoded")
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixed), ("byte_bpe", tokens)]

#: Not SQL: training, fingerprints and random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
