"""The domain's tables (poems, interactions, ...) derived from the test tables.

Each view exists twice: as a DataFrame and as the SQL of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.functions import text as T

#: Event type and parity of event_id to action.
ACTIONS = {
    "click": ("like", "unlike"),
    "purchase": ("save", "unsave"),
    "error": ("dislike", "undislike"),
    "signup": ("share", "super_like"),
    "view": ("preview_skip", "preview_open"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def author_of(doc_id: Column) -> Column:
    return F.concat(F.lit("A"), F.lpad((doc_id * 7 % 60).cast("string"), 2, "0"))


def poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, author, body, corpus, line_count, embedding."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    body = F.coalesce("text", F.lit(""))
    return d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring(F.split(body, "\n")[0], 1, 40).alias("title"),
        author_of(F.col("doc_id")).alias("author"),
        body.alias("body"),
        F.when(F.col("source") != "src0", F.col("source")).alias("corpus"),
        T.line_count(body).alias("line_count"),
        "embedding",
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, poem_id, action, created_at: the append-only log."""
    n = table(spark, sf_dir, "documents").count()
    action = F.coalesce(*[F.when(F.col("event_type") == k, F.when(F.col("event_id") % 2 == 0, a).otherwise(b)) for k, (a, b) in ACTIONS.items()])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", ((F.col("event_id") * 31 + F.col("user_id")) % 50 * (n // 50)).alias("poem_id"), action.alias("action"), F.col("ts").alias("created_at")
    )


NONBLANK = r"regexp_matches(x, '[^ \t\n\r\f]')"
POEMS = rf"""poems as (
  select d.doc_id as id, substr(string_split(coalesce(d.text, ''), chr(10))[1], 1, 40) as title,
    'A' || lpad(cast(d.doc_id * 7 % 60 as varchar), 2, '0') as author, coalesce(d.text, '') as body,
    case when d.source <> 'src0' then d.source end as corpus,
    len(list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda x: {NONBLANK}))::int as line_count,
    e.embedding
  from documents d left join embeddings e on e.vec_id = d.doc_id
)"""
INTERACTIONS = f"""interactions as (
  select event_id as id, user_id, ((event_id * 31 + user_id) % 50) * (select count(*) // 50 from documents) as poem_id,
    case event_type {" ".join(f"when '{k}' then case when event_id % 2 = 0 then '{a}' else '{b}' end" for k, (a, b) in ACTIONS.items())} end as action,
    ts as created_at
  from events
)"""
