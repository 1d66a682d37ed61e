"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, language_id, line_dedup, main_text, token_files
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives, quantised
from .mixing import mix
from .periodic_runs import periodic_runs, plant_periods
from .simhash_dedup import simhash_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .vector_dedup import vector_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _removed(spans: str = "spans") -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), *vocabulary, decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", _removed().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), special_as_text=False)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "host", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(plant_periods(_documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = main_text.train(main_text.example_pages(spark))
    return main_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), tree).select("page_id", "url", "text", "n_chars")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("q")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_suffix_dedup, op2_language_id, op3_vector_dedup, op4_exact_dedup, op5_mixing, op6_byte_bpe, op7_simhash_dedup, op8_substring_dedup, op9_token_files, op10_line_dedup, op11_periodic_runs, op12_main_text, op13_hard_negatives]
    return {f.__name__: f for f in made}


def _lines_sql() -> str:
    text = "coalesce(html, '')"
    for pattern, to in line_dedup.MARKUP:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')" if to != "\n" else f"regexp_replace({text}, '{pattern}', chr(10), 'g')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_vector_dedup": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), fine as (
  select * from v where label is not null and e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from fine a join fine b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select vec_id as a, vec_id as b from v
  union
  select r.a, l.b from reach r join links l on l.a = r.b
)
select v.vec_id, (select count(*) from links l where l.a = v.vec_id)::bigint as n_links,
  r.component_id, v.vec_id = r.component_id as kept
from v join (select a, min(b) as component_id from reach group by a) r on r.a = v.vec_id""",
        "op4_exact_dedup": """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size,
  doc_id = max(doc_id) over t as kept, sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))""",
        "op8_substring_dedup": r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), win as (
  select doc_id, p, array_to_string(words[p:p + 19], ' ') as phrase
  from (select doc_id, words, unnest(range(1, len(words) - 18)) as p from w)
), again as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by phrase order by doc_id, p) as k from win) where k > 1
), gone as (
  select distinct doc_id, q from (select doc_id, unnest(range(p, p + 20)) as q from again)
), marks as (
  select doc_id, list(q) as gone from gone group by doc_id
), each as (
  select w.doc_id, w.words, g.gone, list_filter(list_transform(range(1, len(w.words) + 1), lambda i: case when g.gone is null or not list_contains(g.gone, i) then w.words[i] end), lambda x: x is not null) as kept
  from w left join marks g using (doc_id)
)
select doc_id, len(words)::bigint as n_words, (len(words) - len(kept))::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256
from each""",
        "op10_line_dedup": f"""
with p as (
  select page_id, lower(coalesce(regexp_extract(url, '{line_dedup.HOST}', 1), '')) as host, {_lines_sql()} as lines from pages
), totals as (
  select host, count(*) as n_pages from p group by host
), gone as (
  select host, line from (select host, unnest(list_distinct(lines)) as line from p) join totals using (host)
  group by host, line, n_pages having count(*) > 1 and count(*) > {line_dedup.RATIO} * n_pages
), lists as (
  select host, list(line) as gone from gone group by host
), each as (
  select page_id, p.host, lines, list_filter(lines, lambda x: gone is null or not list_contains(gone, x)) as stays
  from p left join lists using (host)
)
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(stays))::bigint as n_removed,
  sha256(array_to_string(stays, chr(10))) as kept_sha256
from each""",
        "op13_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10""",
    }
