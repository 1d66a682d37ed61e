"""Queries of whole chains over the test tables: results and loading, cleaning, selection, lists, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.functions import similarity as S
from stanzaflow.functions import text as T
from stanzaflow.operators import authors, curate, dedup, enrich
from stanzaflow.plans import repair
from stanzaflow.plans.views import NONBLANK, poems, table
from stanzaflow.queries import _KEY, BASE, NAMES, query
from stanzaflow.sources import tables

# ---- prompts, probes ----


@query(f"{BASE} select id, 'TITLE: ' || title || chr(10) || 'AUTHOR: ' || author || chr(10) || chr(10) || body as prompt, 'TITLE: ' || title || chr(10) || 'AUTHOR: ' || author || chr(10) || chr(10) || body || chr(10) || chr(10) || 'SUMMARY: ' || coalesce(corpus, '') as embedded from poems")
def prompts(spark, d):
    given = [F.col(c) for c in ("title", "author", "body")]
    return poems(spark, d).select("id", T.prompt_text(*given).alias("prompt"), T.prompt_text(*given, F.col("corpus")).alias("embedded"))


@query(f"""{BASE}, l as (select id, unnest(string_split(body, chr(10))) as x, generate_subscripts(string_split(body, chr(10)), 1) as i from poems),
p as (select id, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as line from l where {NONBLANK}),
q as (select *, row_number() over (partition by id order by regexp_matches(line, '[''"’“”—–…&<>]'), -length(line), i) as k from p where length(line) >= 20)
select id, array_to_string(list(line order by k), '|') as probes from q where k <= 5 group by id""")
def probe_lines(spark, d):
    return poems(spark, d).select("id", T.probes(F.col("body")).alias("p")).where(F.size("p") > 0).select("id", F.array_join("p", "|").alias("probes"))


# ---- results, loading ----


def _score_lines(spark: SparkSession, d: str) -> DataFrame:
    """Result lines made of the labels: every eleventh failed, every thirteenth is broken, every fifth was asked for again."""
    l = table(spark, d, "labels").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t"), F.explode(F.expr("if(doc_id % 5 = 0, array(1, 2), array(1))")).alias("ord"))
    mood = (F.col("q") + F.col("ord") - 1).cast("int").alias("mood")
    scores = F.struct(mood, F.col("t").cast("int").alias("emotional_intensity"), *[F.lit(5).alias(c) for c in enrich.SCORES[2:]], F.concat(F.lit("s"), "doc_id").alias("summary"))
    content = F.when((F.col("doc_id") % 13 == 0) & (F.col("ord") == 1), "{broken").otherwise(F.to_json(scores))
    error = F.when((F.col("doc_id") % 11 == 0) & (F.col("ord") == 1), "limit")
    return l.select(enrich.result_line(F.col("doc_id").cast("string"), content, error).alias("value"), "ord")


def _vector_lines(spark: SparkSession, d: str) -> DataFrame:
    body = F.struct(F.array(F.struct("embedding")).alias("data"))
    line = F.struct(F.col("vec_id").cast("string").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response"))
    return table(spark, d, "embeddings").where("vec_id % 7 <> 0").select(F.to_json(line).alias("value"), F.lit(1).alias("ord"))


@query("""with l as (select doc_id, quality + (doc_id % 5 = 0)::int as mood, case when doc_id % 5 = 0 then null when doc_id % 11 = 0 then 'status' when doc_id % 13 = 0 then 'parse' end as bad from labels),
r as (select d.doc_id, l.mood, case when l.doc_id is null then 'absent' else l.bad end as score_error,
    case when e.vec_id is null then 'absent' when e.embedding is null then 'status' when len(e.embedding) <> 64 then 'width' end as vector_error, len(e.embedding) as n
  from documents d left join l on l.doc_id = d.doc_id left join embeddings e on e.vec_id = d.doc_id and e.vec_id % 7 <> 0)
select doc_id, case when score_error is null then mood else -1 end::int as mood, case when score_error is null then 's' || doc_id end as summary, coalesce(n, 0)::int as n_dims, score_error, vector_error from r""")
def merged_results(spark, d):
    """Documents with their scores and vectors from result lines, the last line of each counting, and why one is lacking."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    scores, vectors = (enrich.parse_results(x, order="ord") for x in (_score_lines(spark, d), _vector_lines(spark, d)))
    merged = enrich.merge_results(docs, scores, vectors, width=64)
    n = F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(0)
    return merged.select("doc_id", F.coalesce("rubric.mood", F.lit(-1)).alias("mood"), "summary", n.alias("n_dims"), "score_error", "vector_error")


@query(f"""{BASE}, has as (select id from poems where id not in (select doc_id from labels)), batch as (select p.*, l.quality from poems p join labels l on l.doc_id = p.id where p.embedding is not null)
select printf('poem_%04d', id) as id, title, line_count, corpus, -1 as mood, null::varchar as summary from poems where id in (select id from has) union all
select printf('poem_%04d', coalesce((select max(id) from has), 0) + row_number() over (order by id)), title, line_count, corpus, quality::int, 'of ' || id from batch""")
def wave_load(spark, d):
    """A scored batch, the documents with a label and a vector, is loaded behind those without a label."""
    p, labels = poems(spark, d), table(spark, d, "labels")
    there = p.join(labels, F.col("id") == F.col("doc_id"), "left_anti").select(T.padded_id(F.col("id")).alias("id"), "title", "line_count", "corpus", F.lit(-1).alias("mood"), F.lit(None).cast("string").alias("summary"))
    rubric = F.struct(F.col("quality").cast("int").alias("mood"), *[F.lit(5).alias(c) for c in enrich.SCORES[1:]])
    merged = p.join(labels, F.col("id") == F.col("doc_id")).where("embedding is not null").select(
        F.col("id").alias("place"), "title", "author", "body", "corpus", rubric.alias("rubric"), F.concat(F.lit("of "), F.col("id").cast("string")).alias("summary"), "embedding"
    )
    return enrich.load_batch(there, merged, "place")


@query("""select l.doc_id as id, substr(string_split(coalesce(d.text, ''), chr(10))[1], 1, 40) as title, lower(d.source) as corpus, case when l.doc_id % 2 = 0 then 'X' || d.lang else '' end as translator,
  case when l.doc_id % 3 > 0 then 's' || l.doc_id end as summary, l.quality::int as mood, -1 as formality from labels l join documents d using (doc_id)""")
def sourced_rows(spark, d):
    """Rows of the poems table from records with a source, blank fields as null."""
    l = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rubric = F.struct(*[(F.col("quality") if c == "mood" else F.lit(None)).cast("int").alias(c) for c in enrich.SCORES])
    records = l.select(
        F.col("doc_id").alias("id"), F.substring(F.split(F.coalesce("text", F.lit("")), "\n")[0], 1, 40).alias("title"), F.lit("A").alias("author"), F.col("text").alias("poem_text"),
        F.concat(F.lit(" "), F.upper("source"), F.lit(" ")).alias("primary_source"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("X"), "lang", F.lit(" "))).otherwise("  ").alias("translator"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), "doc_id")).otherwise(" ").alias("summary"), rubric.alias("rubric"), F.lit(None).cast("array<float>").alias("embedding"),
    )
    return enrich.table_rows(records, "sourced").select("id", "title", "corpus", "translator", "summary", "mood", F.coalesce("formality", F.lit(-1)).alias("formality"))


# ---- cleaning, selection, lists ----


@query(rf"""{BASE}, made as (select id, case when id % 4 = 0 then title || ' [3]' else title end as t0, case when id % 17 = 0 then ' ' else author end as author,
    case id % 3 when 0 then '(Edited by another hand)' || chr(10) || chr(10) || body when 1 then body || '`x' else body end as b0 from poems),
m as (select *, not regexp_matches(t0, '\S') or not regexp_matches(author, '\S') or not regexp_matches(b0, '\S') as miss,
    regexp_replace(b0, '^(?:[^\S\n]*\n)*[^\S\n]*\([^\)\n]{{8,200}}\)[^\S\n]*(?:\n\s*|$)', '') as b1 from made),
c as (select *, case when miss then b0 else translate(b1, chr(160) || '`', ' ''') end as body, case when miss or id % 4 > 0 then t0 else rtrim(t0[:-4], ' ,.' || chr(9) || chr(10)) end as title from m),
k as (select *, {_KEY} as k from c),
r as (select *, case when miss then 'missing' when length(k) >= 50 and row_number() over (partition by miss, k order by length(body) desc, id) > 1 then 'duplicate'
    when length(body) > 1000 and (length(body) - length(replace(body, chr(10), ''))) * 1000.0 / length(body) < 5 and len(list_filter(string_split(body, chr(10)), lambda x: {NONBLANK})) < 6 then 'prose' end as removed from k)
select id, title, sha256(body) as body_sha256, array_to_string(list_filter([case when not miss and b1 <> b0 then 'editor' end, case when not miss and body <> b1 then 'marks' end, case when title <> t0 then 'footnote' end], lambda x: x is not null), ',') as changes, removed from r""")
def clean_first(spark, d):
    """Poems with editors' lines, marks, footnotes and blank authors put in: all rows, cleaned, and why some go."""
    i, body = F.col("id"), F.col("body")
    made = poems(spark, d).select(
        i.alias("rid"), F.when(i % 4 == 0, F.concat("title", F.lit(" [3]"))).otherwise(F.col("title")).alias("title"), F.when(i % 17 == 0, " ").otherwise(F.col("author")).alias("author"),
        F.when(i % 3 == 0, F.concat(F.lit("(Edited by another hand)\n\n"), body)).when(i % 3 == 1, F.concat(body, F.lit("`x"))).otherwise(body).alias("body"),
    )
    out = curate.clean_first(made)
    return out.select(F.col("rid").alias("id"), "title", F.sha2("body", 256).alias("body_sha256"), F.array_join("changes", ",").alias("changes"), "removed")


@query()
def finalised(spark, d):
    """At most five poems of an author among those with a title like a listed one; one author's list is replaced, one is dropped."""
    p = poems(spark, d).withColumn("rid", F.col("id"))
    listed = p.where("id % 10 = 0").select("author", F.col("title").alias("listed"))
    instead = p.where("id % 10 = 1 and author = 'A01'").select("author", F.col("title").alias("listed"))
    return curate.finalise(p, listed, instead, ("A07",), cap=5).select("rid", "author", F.round("score", 6).alias("score"), "exact", "k", "n_matched")


_CANON = "case when name in (select p_name from part where p_partkey % 50 = 0) then 'Collected Names' else name end"


@query(f"""with {NAMES}, src as (select name, case p_brand when 'Brand#1' then 'one' when 'Brand#2' then 'two' else 'rest' end as source from names join part on p_partkey = rid),
t as (select {_CANON} as name, count(*) as total, nullif(count(*) filter (source = 'one'), 0) as one, nullif(count(*) filter (source = 'two'), 0) as two from src group by 1),
k as (select *, regexp_replace(lower(string_split(name, ' ')[-1]), '[^a-z]', '', 'g') || ' ' || regexp_replace(lower(array_to_string(string_split(name, ' ')[1:-2], ' ')), '[^a-z ]', '', 'g') as key from t)
select row_number() over (order by key, name) as number, name, total, coalesce(one, 0) as one, coalesce(two, 0) as two, concat_ws(', ', 'First (' || one || ')', 'Second (' || two || ')') as sources from k""")
def author_roll_up(spark, d):
    p = table(spark, d, "part")
    source = F.when(F.col("p_brand") == "Brand#1", "one").when(F.col("p_brand") == "Brand#2", "two").otherwise("rest")
    variants = p.where("p_partkey % 50 = 0").select(F.col("p_name").alias("variant"), F.lit("Collected Names").alias("canonical")).distinct()
    return authors.roll_up(p.select(F.col("p_name").alias("name"), source.alias("source")), variants, {"one": "First", "two": "Second"}).fillna(0, ["one", "two"])


# ---- repairs ----


@query("""with a as (select l_orderkey as id, l_linenumber % 3 as source_ord, (l_partkey * 1000 + l_suppkey) * 10 + l_linenumber as ord, (l_quantity % 4)::int as n, round(l_discount * 10, 2) as ratio, l_linestatus = 'O' as breaks from lineitem),
g as (select *, case when n = 0 then 'empty' when abs(2 - n) <= 1 and ratio >= 0.92 then 'strict' when abs(2 - n) <= 1 and ratio >= 0.55 then 'near' when abs(2 - n) > 1 then 'line-count' else 'ratio' end as grade from a),
best as (select *, row_number() over (partition by id order by case grade when 'strict' then 0 when 'near' then 1 else 2 end, case when grade = 'strict' then 0 else -ratio end, source_ord, ord) as k, max(n) over (partition by id) > 0 as found from g)
select o_orderkey as id, case when grade in ('strict', 'near') then case grade when 'strict' then 'FOUND' else 'FOUND_NEAR' end || case when breaks then '_WITH_STANZAS' else '_NO_STANZAS' end when found then 'FOUND_MISMATCH' else 'NOT_FOUND' end as category,
  case when grade in ('strict', 'near') then 's' || source_ord end as source, case when grade in ('strict', 'near') then ord::varchar end as ref,
  case when grade not in ('strict', 'near') and found then printf('best s%d ratio %.3f (%s)', source_ord, ratio, grade) else '' end as note
from orders left join best on id = o_orderkey and k = 1""")
def scope_categories(spark, d):
    """What texts found for a poem are good for, on attempts whose lines and ratios are those of order lines."""
    a = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("source_ord"), ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("s"), F.col("l_linenumber") % 3).alias("source"),
        ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).cast("string").alias("ref"), (F.col("l_quantity") % 4).cast("int").alias("n_fetched"), F.round(F.col("l_discount") * 10, 2).alias("ratio"), (F.col("l_linestatus") == "O").alias("has_breaks"),
    )
    graded = a.withColumn("grade", S.match_grade(F.lit(2), F.col("n_fetched"), F.col("ratio")))
    return repair.scope(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), graded)


_LINES = lambda c: f"len(list_filter(string_split({c}, chr(10)), lambda x: {NONBLANK}))"
_STANZAS = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\n\\n+'), lambda x: {NONBLANK}))"


@query(f"""with b as (select doc_id, coalesce(text, '') as o, case doc_id % 4 when 0 then replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) when 1 then array_to_string(string_split(coalesce(text, ''), chr(10))[1:2], chr(10)) when 2 then '' else coalesce(text, '') end as n from documents),
s as (select doc_id, {_LINES("o")} as ol, {_LINES("n")} as nl, {_STANZAS("o")} as os, {_STANZAS("n")} as ns from b)
select doc_id, ol::int as old_lines, nl::int as new_lines, os::int as old_stanzas, ns::int as new_stanzas, os <= 1 and ns > 1 as gained,
  array_to_string(list_filter([case when nl = 0 then 'empty-body' end, case when nl > 3 and ns / nl > 0.7 and os / greatest(ol, 1) < 0.5 then 'too-many-stanzas' end, case when nl > 0 and ol >= 3 and abs(nl - ol) / ol > 0.4 then 'line-drift' end], lambda x: x is not null), ',') as flags from s""")
def plan_flags(spark, d):
    """Texts with their breaks doubled, cut to two lines, emptied or as they were: which changes are implausible."""
    t, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    new = F.when(i % 4 == 0, F.replace(t, F.lit("\n"), F.lit("\n\n"))).when(i % 4 == 1, T.first_lines(t, 2)).when(i % 4 == 2, "").otherwise(t)
    out = repair.compared(table(spark, d, "documents").select("doc_id", t.alias("old_body"), new.alias("new_body")))
    return out.select("doc_id", "old_lines", "new_lines", "old_stanzas", "new_stanzas", "gained", F.array_join("flags", ",").alias("flags"))


@query()
def reparse_pages(spark, d):
    """The texts of pages without their stanza breaks get them back from the page that holds their lines."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("pos"), "html")
    read = lambda c: T.page_text(T.balanced_block(c, "article"))
    flat = pages.select(F.col("pos").alias("id"), F.regexp_replace(F.coalesce(read(F.col("html")), F.lit("")), r"\n\s*\n", "\n").alias("body"))
    folder = tables.fresh_folder(spark, "stored")
    flat.write.parquet(f"{folder}/poems")  # they stand for a stored table
    plan = repair.reparse_plan(spark.read.parquet(f"{folder}/poems"), pages, read)
    return plan.select(F.col("id").alias("page_id"), "pos", "status", "old_lines", "new_lines", "old_stanzas", "new_stanzas", F.array_join("flags", ",").alias("flags"), "gained", F.sha2("new_body", 256).alias("body_sha256"))


@query(r"""with p as (select doc_id as id, 'A' || lpad(cast(doc_id * 7 % 60 as varchar), 2, '0') as author, coalesce(text, '') as body from documents), key as (select id, lower(author) as ak, regexp_replace(lower(body), '\s+', '', 'g') as bk from p),
said as (select ak, bk, '<p>' || id as html, 0 as src from key where id % 2 = 0 union all select ak, bk, case when id % 4 = 0 then '<q>' else '<p>' end || id, 1 from key where id % 3 = 0),
g as (select ak, bk, count(distinct html) as nh, min(html) as html, count(distinct src) as ns from said group by all), many as (select ak, bk, count(*) as np from key group by all)
select id, case when nh = 1 and np = 1 then html end as html, case when nh is null then 'none' when np > 1 then 'ambiguous' when nh > 1 then 'conflict' else 'one' end as status, coalesce(ns, 0) as n_sources
from key join many using (ak, bk) left join g using (ak, bk)""")
def backfill_sources(spark, d):
    p = poems(spark, d).select("id", "author", "body")
    marked = lambda mark: p.select("author", "body", F.concat(mark, "id").alias("html"), "id")
    first, second = marked(F.lit("<p>")).where("id % 2 = 0"), marked(F.when(F.col("id") % 4 == 0, "<q>").otherwise("<p>")).where("id % 3 = 0")
    return repair.backfill_chain(p, [first, second])


@query("""with c as (select l_orderkey as comp, count(distinct l_returnflag) as ns, bool_or(l_discount = 0) as enc, max(l_discount * 10) as r, bool_or(l_quantity > 45) as tf, bool_or(l_linenumber > 2) as fo, bool_or(l_partkey % 37 = 0) as conf, bool_or(l_partkey % 11 = 0) as newer from lineitem group by all)
select comp, case when conf then 'fuzzy_confirmed' when ns = 1 and enc then 'encore' when r >= 0.9 then 'body_match' when newer then 'keep_newer' when fo and not tf then 'not_dupe_firstline_only' else 'ambiguous' end as cls from c""")
def cascade_classes(spark, d):
    """The six classes of clusters, on signals that are those of the lines of an order."""
    any_ = lambda rule, name: F.expr(f"bool_or({rule})").alias(name)
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("comp")).agg(
        F.count_distinct("l_returnflag").alias("n_sources"), any_("l_discount = 0", "any_encore"), F.max(F.col("l_discount") * 10).alias("max_ratio"), any_("l_quantity > 45", "any_title_first"),
        any_("l_linenumber > 2", "any_first_only"), any_("l_partkey % 37 = 0", "confirmed"), any_("l_partkey % 11 = 0", "keep_newer"),
    )
    return dedup.classify(g).select("comp", "cls")
