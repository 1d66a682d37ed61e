"""The library's own queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.functions import markup, sites
from stanzaflow.functions import similarity as S
from stanzaflow.functions import text as T
from stanzaflow.operators import authors, curate, dedup, enrich, pages, vectors
from stanzaflow.operators import recommend as R
from stanzaflow.plans import repair, serving, views
from stanzaflow.plans.views import INTERACTIONS, POEMS, interactions, poems, table
from stanzaflow.sources import readers, tables, writes

READER = 10
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from stanzaflow import chain_queries  # noqa: F401  puts its own in

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from stanzaflow import chain_queries  # noqa: F401

    return dict(_SQL)


# ---- SQL shared by several queries ----

STATE = """
saves as (select user_id, poem_id, arg_max(action, (created_at, id)) as a from interactions where action in ('save', 'unsave', 'super_like') group by all),
likes as (select user_id, poem_id, arg_max(action, (created_at, id)) as a from interactions where action in ('like', 'unlike') group by all),
dislikes as (select user_id, poem_id, arg_max(action, (created_at, id)) as a from interactions where action in ('dislike', 'undislike') group by all),
shares as (select distinct user_id, poem_id from interactions where action = 'share'),
state as (
  select p.user_id, p.poem_id, coalesce(s.a in ('save', 'super_like'), false) as saved, coalesce(l.a = 'like', false) as liked,
    coalesce(d.a = 'dislike', false) as disliked, h.poem_id is not null as shared
  from (select distinct user_id, poem_id from interactions) p
  left join saves s using (user_id, poem_id) left join likes l using (user_id, poem_id)
  left join dislikes d using (user_id, poem_id) left join shares h using (user_id, poem_id)
)"""
WEIGHTS = """
weights as (
  select user_id, poem_id, case when disliked then -0.5 else greatest(case when saved then 1.0 else 0.0 end, case when shared then 1.0 else 0.0 end, case when liked then 0.5 else 0.0 end) end::double as weight
  from state
)"""
TASTE = f"""
parts as (
  select user_id, pos, sum(x * weight) as x from (
    select w.user_id, w.weight, unnest(p.embedding)::double as x, unnest(range(len(p.embedding))) as pos
    from weights w join poems p on p.id = w.poem_id where w.weight <> 0 and p.embedding is not null and w.user_id = {READER}
  ) group by all
),
taste as (select list(x order by pos) as v from parts)"""
UNSEEN = f"unseen as (select * from poems where id not in (select poem_id from interactions where user_id = {READER}))"
NEAR = """near as (
  select id, author, corpus, round(1 - list_cosine_similarity(list_transform(embedding, lambda x: x::double), v), 6) as dist
  from unseen, taste where embedding is not null order by dist, id limit 1000
)"""
BASE = f"with {POEMS}, {INTERACTIONS}"
SPLIT = r"string_split(body, chr(10))"
FULL = f"list_filter({SPLIT}, lambda x: {views.NONBLANK})"


def key_sql(seed: str) -> str:
    return f"md5(id::varchar || ':{seed}')"


def level0_sql(pool: str, n: int, seed: str, where: str = "true") -> str:
    k = key_sql(seed)
    return f"""(select id, row_number() over (order by turn, {k}, id)::int as ord from (
    select id, row_number() over (partition by coalesce(corpus, '__none__') order by {k}, id) as turn from (
      select *, row_number() over (partition by author order by {k}, id) as k from {pool}
    ) where k = 1 and {where}
  ) order by ord limit {n})"""


# ---- recommender ----


@query(f"{BASE}, {STATE} select * from state")
def reaction_state(spark, d):
    return R.reaction_state(interactions(spark, d))


@query(f"{BASE}, {STATE}, {WEIGHTS} select * from weights")
def poem_weights(spark, d):
    return R.poem_weights(interactions(spark, d))


@query(f"""{BASE}, {STATE}, {WEIGHTS}, parts as (
  select user_id, pos, sum(x * weight) as x from (
    select w.user_id, w.weight, unnest(p.embedding)::double as x, unnest(range(len(p.embedding))) as pos
    from weights w join poems p on p.id = w.poem_id where w.weight <> 0 and p.embedding is not null
  ) group by all) select user_id, pos::int as pos, round(x, 5) + 0.0 as x from parts""")
def taste_vector(spark, d):
    t = R.taste_vector(R.poem_weights(interactions(spark, d)), poems(spark, d))
    return t.select("user_id", F.posexplode("taste").alias("pos", "x")).select("user_id", "pos", (F.round("x", 5) + 0.0).alias("x"))


@query(f"""{BASE} select user_id, count(distinct case when action in ('save', 'super_like', 'like', 'share') then poem_id end) as n_positive,
  count(distinct case when action in ('save', 'super_like', 'like', 'share') then poem_id end) >= 15 as warm from interactions group by user_id""")
def signal_gate(spark, d):
    return R.signal_gate(interactions(spark, d))


@query(f"{BASE}, {STATE}, {WEIGHTS}, {TASTE}, {UNSEEN}, {NEAR} select id, dist from near order by dist, id limit 20")
def taste_topk(spark, d):
    return R.taste_topk(poems(spark, d), interactions(spark, d), READER)


@query(f"{BASE}, {UNSEEN} select id from unseen where line_count <= 40 order by {key_sql('s:random')}, id limit 1000")
def random_pool(spark, d):
    p = R.unseen(poems(spark, d), interactions(spark, d), READER).where(R.in_buckets(True, True, False))
    return R.random_pool(p, "s:random").select("id")


@query(f"{BASE}, {STATE}, {WEIGHTS}, {TASTE}, {UNSEEN}, {NEAR} select id from unseen where id not in (select id from near) order by {key_sql('s:explore')}, id limit 1000")
def explore_pool(spark, d):
    p, log = poems(spark, d), interactions(spark, d)
    fresh = R.unseen(p, log, READER)
    row = R.taste_vector(R.poem_weights(log.where(F.col("user_id") == READER)), p).first()
    near = R.taste_pool(fresh, row["taste"]) if row else fresh.limit(0)
    return R.random_pool(fresh.join(near.select("id"), "id", "left_anti"), "s:explore").select("id")


_POOL = f"{BASE}, pool as (select * from poems)"


@query(f"{_POOL} select * from {level0_sql('pool', 9, 'p', where=chr(10).join(['author not in (', chr(39) + 'A00' + chr(39) + ')']))}")
def pick_level0(spark, d):
    return R.pick_levels(poems(spark, d), 9, ["A00", None], "p")[0]


@query(f"{_POOL} select id, row_number() over (order by author)::int as ord from (select *, row_number() over (partition by author order by {key_sql('p')}, id) as k from pool) where k = 1 order by author limit 9")
def pick_level2(spark, d):
    return R.pick_levels(poems(spark, d), 9, ["A00"], "p")[1]


@query(f"{_POOL} select id, row_number() over (order by {key_sql('p')}, id)::int as ord from pool order by ord limit 40")
def pick_level3(spark, d):
    return R.pick_levels(poems(spark, d), 40, None, "p")[2]


_FIRST, _SECOND = level0_sql("near", 2, "s:taste"), level0_sql("rest", 3, "s:explore", "author not in (select author from poems join first using (id))")


@query(f"""{BASE}, {STATE}, {WEIGHTS}, {TASTE}, {UNSEEN}, {NEAR}, first as {_FIRST},
rest as (select * from unseen where id not in (select id from near) order by {key_sql('s:explore')}, id limit 1000),
second as {_SECOND}, mixed as (select 0 as slice, * from first union all select 1 as slice, * from second)
select row_number() over (order by slice, b.ord)::int as ord, id, title, author, body, line_count, slice::int as slice from mixed b join poems using (id)""")
def recommend_full(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER)


@query(f"""{BASE}, {UNSEEN}, pool as (select * from unseen where line_count <= 40 order by {key_sql('s:random')}, id limit 1000)
select ord, id, title, author, body, line_count, 0 as slice from {level0_sql('pool', 5, 's:random')} join poems using (id)""")
def recommend_random(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER, long=False, force_random=True)


@query(f"""{BASE}, last as (select user_id, poem_id, arg_max(action, (created_at, id)) as a from interactions where action in ('save', 'super_like', 'dislike', 'unsave') group by all),
weights as (select user_id, poem_id, case a when 'super_like' then 3.0 when 'save' then 1.0 when 'dislike' then -0.5 else 0.0 end::double as weight from last),
{TASTE}, {UNSEEN}, {NEAR} select row_number() over (order by dist, near.id)::int as ord, near.id, title, poems.author, body, line_count, 0 as slice from near join poems using (id) order by dist, near.id limit 5""")
def recommend_v12(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER, version=R.VERSIONS["v12"])


@query(f"""{BASE}, {STATE}, {WEIGHTS}, {TASTE}, unseen as (select * from poems where line_count <= 10 and id not in (select poem_id from interactions where user_id = {READER})), {NEAR}
select row_number() over (order by dist, near.id)::int as ord, near.id, title, poems.author, body, line_count, 0 as slice from near join poems using (id) order by dist, near.id limit 5""")
def recommend_linemax(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER, line_max=10, version=R.VERSIONS["v16"])


@query(f"""{BASE}, {STATE}, {WEIGHTS}, parts as (
  select user_id, pos, sum(x * weight) as x from (
    select w.user_id, w.weight, unnest(p.embedding)::double as x, unnest(range(len(p.embedding))) as pos
    from weights w join poems p on p.id = w.poem_id where w.weight <> 0 and p.embedding is not null
  ) group by all), taste as (select user_id, list(x order by pos) as v from parts group by user_id),
scored as (select t.user_id, p.id, round(1 - list_cosine_similarity(list_transform(p.embedding, lambda x: x::double), v), 6) as dist from taste t, poems p
  where p.embedding is not null and (t.user_id, p.id) not in (select (user_id, poem_id) from interactions))
select user_id, id, dist, (row_number() over (partition by user_id order by dist, id))::int as rank from scored qualify rank <= 5""")
def recommend_all(spark, d):
    return R.recommend_all(poems(spark, d), interactions(spark, d))


def _index(spark: SparkSession, d: str):
    return R.index_poems(poems(spark, d), tables.fresh_folder(spark, "poem-index"))


@query()
def recommend_indexed(spark, d):
    """``recommend_full`` over a stored index: the nearest poems come from the cells nearest to the taste."""
    return R.recommend(poems(spark, d), interactions(spark, d), READER, index=_index(spark, d))


@query()
def recommend_all_indexed(spark, d):
    """``recommend_all`` over a stored index."""
    return R.recommend_all_indexed(_index(spark, d), poems(spark, d), interactions(spark, d))


@query()
def nearest_indexed(spark, d):
    """The ten poems nearest to every hundredth one, itself left out."""
    p = poems(spark, d)
    own = p.where("id % 100 = 0")
    return vectors.nearest_all(_index(spark, d), own.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 10, own.select(F.col("id").alias("query_id"), "id"))


# ---- library ----

_SAVED = "newest as (select user_id, poem_id, arg_max(action, (created_at, id)) as action, max(created_at) as created_at, arg_max(id, (created_at, id)) as iid from interactions where action in ('save', 'unsave') group by all)"


@query(f"{BASE}, {_SAVED} select user_id, row_number() over (partition by user_id order by created_at desc, iid desc)::int as pos, poem_id, title, author, created_at from newest join poems on poems.id = poem_id where action = 'save'")
def library_saved(spark, d):
    return R.library(interactions(spark, d), poems(spark, d))


@query(f"{BASE}, {_SAVED} select user_id, count(*) filter (action = 'save') as n_saved from newest group by user_id")
def library_saved_count(spark, d):
    return R.saved_count(interactions(spark, d))


@query(f"{BASE} select user_id, poem_id, max(created_at) as skipped_at from interactions where action = 'dislike' group by all")
def skipped_list(spark, d):
    return R.skipped(interactions(spark, d))


@query(f"{BASE} select o.ord::int as ord, id, title, author from poems join (values (0, 7), (1, 3), (2, 999999999), (3, 120)) o(ord, x) on o.x = id")
def lookup_by_ids(spark, d):
    return R.by_ids(poems(spark, d), [7, 3, 999999999, 120])


def _published(spark: SparkSession, d: str) -> SparkSession:
    """A session of its own, so that views, functions and the reader of one query are no other's."""
    own = spark.newSession()
    serving.publish(own, poems(own, d), interactions(own, d))
    return own


@query(_SQL["lookup_by_ids"])
def sql_lookup_by_ids(spark, d):
    return _published(spark, d).sql("select ord, id, title, author from get_poems_by_ids(array(7, 3, 999999999, 120))")


@query(_SQL["recommend_full"])
def sql_recommend(spark, d):
    """``recommend_full`` as a SQL table function: one plan, no driver steps."""
    return _published(spark, d).sql(f"select * from recommend_poems({READER}, 5)")


@query(_SQL["recommend_random"])
def sql_recommend_random(spark, d):
    return _published(spark, d).sql(f"select * from recommend_poems({READER}, long => false, force_random => true)")


@query(f"{BASE}, {UNSEEN}, pool as (select * from unseen order by {key_sql('s:random')}, id limit 1000) select id, ord, 0 as level from {level0_sql('pool', 9, 'p', where=chr(10).join(['author not in (', chr(39) + 'A00' + chr(39) + ')']))}")
def sql_pick_diverse(spark, d):
    """The picker as a table function in Python over a pool."""
    own = _published(spark, d)
    R.random_pool(R.unseen(poems(own, d), interactions(own, d), READER), "s:random").createOrReplaceTempView("pool")
    return own.sql("select * from pick_diverse(table(select id, author, corpus from pool), 9, array('A00', null), 'p')")


@query(f"{BASE} select id, user_id, poem_id, action from interactions where user_id = {READER}")
def sql_own_rows(spark, d):
    """A view on the session's reader: who asks can't leave the reader out."""
    own = _published(spark, d)
    serving.as_reader(own, READER)
    return own.sql("select id, user_id, poem_id, action from my_interactions")


@query(f"{BASE}, names as (select distinct coalesce(corpus, '__null__') as c, corpus is null as last from poems) select array_to_string(list(c order by last, c), ',') as corpora from names")
def list_corpora(spark, d):
    return R.corpora(poems(spark, d)).select(F.array_join("corpora", ",").alias("corpora"))


@query(f"{BASE} select id, case when user_id = 3 then {READER} else user_id end as user_id, poem_id, action, created_at from interactions")
def migrate_anon(spark, d):
    return R.migrate_reader(interactions(spark, d), 3, READER)


@query(f"{BASE} select count(*) as n from interactions where not (user_id = {READER} and poem_id = 0 and action not in ('save', 'super_like', 'like', 'share'))")
def unskip_delete(spark, d):
    return R.unskip(interactions(spark, d), READER, 0).agg(F.count("*").alias("n"))


@query(f"""{BASE}, shown as (select user_id, author, row_number() over (partition by user_id order by created_at desc, i.id desc) as k from interactions i join poems p on p.id = poem_id)
select user_id, array_to_string(list(author order by k), ',') as authors from shown where k <= 10 group by user_id""")
def last_authors(spark, d):
    return R.recent_authors(interactions(spark, d), poems(spark, d)).select("user_id", F.array_join("authors", ",").alias("authors"))


@query(f"{BASE}, {_SAVED}, n as (select user_id, count(*) filter (action = 'save') as n from newest group by user_id) select user_id, case when n >= 10 then 3 when n >= 5 then 2 when n >= 1 then 1 else 0 end::int as level from n")
def signup_nudge(spark, d):
    return R.saved_count(interactions(spark, d)).select("user_id", R.nudge(F.col("n_saved")).alias("level"))


@query(f"{BASE} select id from poems where line_count <= 14 or line_count >= 41")
def length_buckets(spark, d):
    return poems(spark, d).where(R.in_buckets(True, False, True)).select("id")


@query(f"{BASE} select id from poems where corpus in ('src3') or corpus is null")
def corpus_filter(spark, d):
    return poems(spark, d).where(R.in_corpora(["src3", "__null__"])).select("id")


@query(f"{BASE} select distinct user_id as id, null::varchar as display_name, true as is_anonymous from interactions")
def missing_profiles(spark, d):
    log = interactions(spark, d)
    none = spark.createDataFrame([], "id long, display_name string, is_anonymous boolean")
    return tables.missing_profiles(log.select(F.col("user_id").alias("id")).distinct(), none)


# ---- text ----


def _texts(name: str, sql: str, made: Callable[[Column], Column]):
    """A query ``id, value`` of a text function over all poems."""

    def run(spark, d):
        return poems(spark, d).select("id", made(F.col("body")).alias("value"))

    run.__name__ = name
    query(f"{BASE} select id, {sql} as value from poems")(run)


_texts("line_count", "line_count", T.line_count)
_texts("stanza_count", f"len(list_filter(regexp_split_to_array(body, '\\n\\n+'), lambda x: {views.NONBLANK}))::int", T.stanza_count)
_texts("newline_density", "round(case when body = '' then 0 else (length(body) - length(replace(body, chr(10), ''))) * 1000.0::double / length(body) end, 6)", lambda c: F.round(T.newline_density(c), 6))
_texts("footnote_strip", r"regexp_replace(body || ' end[3] [4] x[15]', '(\S)(\[\d+\])+', '\1', 'g')", lambda c: T.strip_footnotes(F.concat(c, F.lit(" end[3] [4] x[15]"))))
_texts("c1_remap", "replace(replace(replace(body || chr(133), chr(133), '…'), chr(146), '’'), chr(151), '—')", lambda c: T.repair_c1(F.concat(c, F.lit("\x85"))))
_texts("near_dup_key", r"regexp_replace(lower(regexp_replace(substr(body, 1, 200), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')", T.near_dup_key)
_texts("preview_text", f"(select case when length(t) > 240 then regexp_replace(substr(t, 1, 240), '\\s+\\S*$', '') || '…' else t end from (select array_to_string(({FULL})[1:4], chr(10)) as t))", T.preview)
_texts("social_description", f"substr(array_to_string(list_transform(({FULL})[1:2], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' / '), 1, 160)", T.social)
_texts("head_lines", f"array_to_string(({SPLIT})[1:3], chr(10))", lambda c: T.first_lines(c, 3))
_texts("body_key", r"regexp_replace(lower(body), '\s+', '', 'g')", T.body_key)
_texts("prose_filter", "(length(body) >= 8000 and (length(body) - length(replace(body, chr(10), ''))) * 1000.0 / length(body) < 10)", T.looks_like_prose)
_texts("english_filter", r"length(regexp_replace(body, '[\x00-\x7f‘’“”–—… ]', '', 'g')) <= 2", T.likely_english)
_texts("stanza_breaks", "contains(body, chr(10) || chr(10))", T.has_stanza_breaks)
_texts("title_preprocess", r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(string_split(body, chr(10))[1], 1, 40), '^\s+|\s+$', '', 'g'), '[.\s]*[\[\{]\d+[\]\}][^\p{L}\p{N}_]*$', ''), '[.,!?;:]+$', ''), '^\s+|\s+$', '', 'g'))", lambda c: T.match_title(F.substring(F.split(c, "\n")[0], 1, 40)))
_texts("typography_chain", r"""replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(body || ' ''t -- don''t "q"', '´', '’'), '--', '—'), '(\s)"', '\1“', 'g'), '^"', '“'), '"', '”'), '([\p{L}\p{N}])''', '\1’', 'g'), '(\s)''([\p{L}])', '\1‘\2', 'g'), '^''([\p{L}])', '‘\1'), '''', '’')""", lambda c: T.typography(F.concat(c, F.lit(" 't -- don't \"q\""))))
_texts("accent_snippet", r"case when contains(body, 'é') then regexp_extract(body, '(?s).{0,40}(?:é).{0,40}', 0) end", lambda c: T.snippet(c, "é"))


@query(f"{BASE} select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(l)), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9_]', ' ', 'g'), '\\s+', ' ', 'g')) as value from (select id, coalesce(list_filter(string_split(body, chr(10)), lambda x: {views.NONBLANK} and not regexp_matches(x, '(?i)^\\s*by\\s+\\S'))[1], '') as l from poems)")
def first_line_key(spark, d):
    return poems(spark, d).select("id", T.first_line(F.col("body")).alias("value"))


@query(f"""{BASE} select case when length(body) < 150 then '<150' when length(body) < 500 then '150-499' when length(body) < 2000 then '500-1999' when length(body) < 5000 then '2000-4999' else '>=5000' end as label, count(*) as n from poems group by all""")
def length_distribution(spark, d):
    return curate.length_profile(poems(spark, d))


@query(f"{BASE} select count(*) as n, round(avg(length(body)), 6) as mean, round(median(length(body)), 6) as median, round(stddev_samp(length(body)), 4) as stdev, min(length(body))::int as least, max(length(body))::int as most from poems")
def length_stats(spark, d):
    return curate.length_stats(poems(spark, d))


@query(rf"""{BASE} select issue, n from (select
  count(*) filter (not regexp_matches(body, '\S')) as empty_text, count(*) filter (not regexp_matches(title, '\S')) as missing_title, count(*) filter (not regexp_matches(author, '\S')) as missing_author,
  count(*) filter (regexp_matches(replace(replace(replace(body, chr(10), ''), chr(13), ''), chr(9), ''), '\p{{C}}')) as control_chars,
  count(*) filter (length(body) >= 8000 and (length(body) - length(replace(body, chr(10), ''))) * 1000.0 / length(body) < 10) as possible_prose from poems) unpivot (n for issue in (empty_text, missing_title, missing_author, control_chars, possible_prose))""")
def quality_issues(spark, d):
    return curate.quality_issues(poems(spark, d))


@query(f"{BASE} select id as rid, f as first_rid from (select id, min(id) over (partition by body) as f from poems) where id <> f")
def first_seen_duplicates(spark, d):
    return curate.first_seen(poems(spark, d), "body", rid="id")


@query(f"{BASE}, g as (select author, count(*) as n, min(id) as f from poems group by author) select (row_number() over (order by n desc, f))::int as rank, author, n from g order by n desc, f limit 20")
def author_counts(spark, d):
    return curate.top_values(poems(spark, d), "author", 20, "id")


@query("select lang, count(*) as total, count(*) filter (source = 'src0') as src0, count(*) filter (source = 'src1') as src1, count(*) filter (source = 'src2') as src2 from documents group by lang")
def author_source_pivot(spark, d):
    return curate.source_pivot(table(spark, d, "documents"), "lang", "source", ["src0", "src1", "src2"])


_LS = "case when line_count < 5 then 0 when line_count < 10 then 1 when line_count <= 35 then 3 when line_count <= 45 then 2 else 1 end"
_CS = "case when length(body) < 150 then 0 when length(body) < 400 then 1 when length(body) < 2000 then 3 when length(body) < 5000 then 2 else 1 end"


@query(f"{BASE} select id, author, k from (select id, author, (row_number() over (partition by author order by -({_LS}), -({_CS}), id))::int as k from poems where author <> 'A07') where k <= 5")
def cap_per_author(spark, d):
    return curate.cap_per_author(poems(spark, d).withColumn("rid", F.col("id")), 5, dropped=("A07",)).select("id", "author", "k")


_KEY = r"regexp_replace(lower(regexp_replace(substr(body, 1, 200), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


@query(f"{BASE}, k as (select id, length(body) as n, {_KEY} as k from poems) select id from k qualify length(k) < 50 or row_number() over (partition by k order by n desc, id) = 1")
def near_dup_keep_longest(spark, d):
    return dedup.near_dup_longest(poems(spark, d).withColumn("rid", F.col("id"))).select("id")


# ---- duplicates ----

DEDUP = r"""docs as (
  select doc_id as rid, text as body, source, lang || substr(text, 1, 2) as block,
    regexp_replace(lower(substr(text, 1, 40)), '\s+', ' ', 'g') as title_norm, regexp_replace(lower(string_split(text, chr(10))[1]), '\s+', ' ', 'g') as first_line
  from documents
),
edges as (
  select min(rid) over (partition by block, title_norm) as a, rid as b, 'title' as kind from docs where title_norm <> '' union all
  select min(rid) over (partition by block, first_line) as a, rid as b, 'firstline' as kind from docs where length(first_line) > 10
),
star as (select a, b, kind from edges where a < b)"""
COMP = """comp as (
  select rid, min(c) as comp from (
    with recursive reach(rid, c) as (
      select rid, rid from docs union select e.y, r.c from reach r join (select a as x, b as y from star union select b, a from star) e on e.x = r.rid
    ) select rid, c from reach
  ) group by rid
)"""


def _dedup_rows(spark: SparkSession, d: str) -> DataFrame:
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("rid"), F.col("text").alias("body"), "source", F.concat("lang", F.substring("text", 1, 2)).alias("block"),
        squeeze(F.substring("text", 1, 40)).alias("title_norm"), squeeze(F.split("text", "\n")[0]).alias("first_line"),
    )


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    rows = _dedup_rows(spark, d)
    return rows.join(dedup.components(rows.select("rid"), dedup.exact_edges(rows)), "rid")


def _clustered_whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the components of all three signals, titles, first lines and body ratios, and the fuzzy edges."""
    rows = _dedup_rows(spark, d).withColumn("body_key", T.body_key(F.col("body")))
    keep = (lambda x: x.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda x: x.persist())
    fuzzy = keep(dedup.fuzzy_edges(rows))
    edges = dedup.exact_edges(rows).select("a", "b").unionByName(fuzzy.select("a", "b"))
    return rows.join(dedup.components(rows.select("rid"), edges), "rid"), fuzzy


@query(f"with {DEDUP} select * from star")
def exact_edges(spark, d):
    return dedup.exact_edges(_dedup_rows(spark, d))


@query(f"with {DEDUP}, {COMP} select * from comp")
def dup_components(spark, d):
    return _clustered(spark, d).select("rid", "comp")


@query()
def dup_components_fuzzy(spark, d):
    """The components of exact and fuzzy edges; ``dup_components`` is the form on exact edges alone that SQL can express."""
    return _clustered_whole(spark, d)[0].select("rid", "comp")


def _signals(rows: DataFrame) -> DataFrame:
    """Cluster signals; bodies agree when their SHA-256 occurs twice in a cluster (ratio 1), else the ratio counts as 0."""
    by = rows.groupBy("comp", F.sha2("body", 256).alias("h")).agg(F.count("*").alias("same"), F.collect_set("source").alias("sources"), F.max("title_norm").alias("t"), F.max("first_line").alias("f"))
    g = by.groupBy("comp").agg(
        F.sum("same").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("n_sources"), F.when(F.max("same") > 1, 1.0).otherwise(0.0).alias("max_ratio"),
        (F.count_distinct("t") == 1).alias("any_title_first"), (F.count_distinct("t") > 1).alias("any_first_only"),
    ).where("n > 1")
    none = {c: F.lit(False) for c in ("any_encore", "confirmed", "keep_newer")}
    return dedup.classify(g.withColumns(none))


@query(f"""with {DEDUP}, {COMP}, j as (select * from docs join comp using (rid)),
g as (select comp, count(*) as n, count(*) - count(distinct body) > 0 as same, count(distinct t) as nt from (select *, max(title_norm) over (partition by comp, body) as t from j) group by comp having count(*) > 1)
select comp, n, case when same then 'body_match' when nt > 1 then 'not_dupe_firstline_only' else 'ambiguous' end as cls from g""")
def cluster_classes(spark, d):
    return _signals(_clustered(spark, d)).select("comp", F.col("n").cast("long").alias("n"), "cls")


@query()
def cluster_classes_ratio(spark, d):
    """The classes by the signals and body ratios of pairs; ``cluster_classes`` is the form on exact edges and equal bodies that SQL can express."""
    return dedup.classify(dedup.cluster_signals(*_clustered_whole(spark, d))).select("comp", "n", "cls")


def _merged(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("score", F.length("body"))
    return dedup.merge(rows, fields=()).where("n > 1").join(rows.select(F.col("rid").alias("winner"), "comp"), "winner").select("comp", "winner", "n", F.array_join("provenance", ",").alias("provenance"))


@query(f"""with {DEDUP}, {COMP}, j as (select * from docs join comp using (rid))
select comp, arg_max(rid, (length(body), -rid)) as winner, count(*) as n, array_to_string(list(source order by rid), ',') as provenance from j group by comp having count(*) > 1""")
def merge_clusters(spark, d):
    return _merged(_clustered(spark, d))


@query()
def merge_clusters_fuzzy(spark, d):
    """The merged records of ``dup_components_fuzzy``."""
    return _merged(_clustered_whole(spark, d)[0])


@query()
def body_fuzzy_edges(spark, d):
    r = _dedup_rows(spark, d).withColumn("body_key", T.body_key(F.col("body")))
    return dedup.fuzzy_edges(r)


@query()
def live_dupes(spark, d):
    r = table(spark, d, "documents").select(
        F.col("doc_id").alias("rid"), F.lower(F.substring("text", 1, 2)).alias("author_norm"), F.lower(F.substring("text", 1, 40)).alias("title_norm"),
        F.lower(F.split("text", "\n")[0]).alias("first_line"), T.body_key(F.col("text")).alias("body_key"), (F.col("source") == "src0").eqNullSafe(True).alias("live"),
    )
    return dedup.live_dupes(r.where("live"), r.where("not live"))


@query()
def live_antijoin(spark, d):
    """Documents that agree with no benchmark text by title, first line or body ratio."""
    def rows(name, rid):
        body = F.coalesce("text", F.lit(""))
        return table(spark, d, name).select(
            F.col(rid).alias("rid"), F.lit("").alias("author_norm"), F.lower(F.substring(F.split(body, "\n")[0], 1, 40)).alias("title_norm"),
            T.first_line(body).alias("first_line"), T.body_key(body).alias("body_key"),
        )

    docs = rows("documents", "doc_id")
    found = dedup.live_dupes(rows("benchmark", "item_id"), docs)
    return docs.join(found.select("rid"), "rid", "left_anti").select(F.col("rid").alias("doc_id"))


_TITLES = "titles as (select doc_id, source, lower(substr(string_split(text, chr(10))[1], 1, 40)) as t from documents)"


@query(f"with {_TITLES} select doc_id from titles where t <> '' and t in (select t from titles where source = 'src7')")
def deleted_titles(spark, d):
    """By the title of the poems view, the first line up to 40 characters."""
    t = table(spark, d, "documents").select("doc_id", "source", F.lower(F.substring(F.split("text", "\n")[0], 1, 40)).alias("k")).where("k <> ''")
    return t.join(t.where("source = 'src7'").select("k"), "k", "left_semi").select("doc_id")


@query("""with lines as (select item_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) as p from benchmark)
select distinct item_id as probe_id, doc_id as text_id from lines join documents d on length(p) >= 20 and contains(d.text, p)""")
def probe_join(spark, d):
    """Which documents hold any line of 20 characters or more of which benchmark text."""
    lines = table(spark, d, "benchmark").select(F.col("item_id").alias("i"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("probe", F.trim("line"))
    probes = lines.where(F.length("probe") >= 20).select(F.struct("i", "pos").alias("probe_id"), "probe")
    found = dedup.containing(probes, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("body")))
    return found.select(F.col("probe_id.i").alias("probe_id"), "text_id").distinct()


# ---- names ----

NAMES = """names as (select p_partkey as rid, p_name as name, lower(string_split(p_name, ' ')[-1]) as last_norm, lower(array_to_string(string_split(p_name, ' ')[1:-2], ' ')) as first_norm from part)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("name"))
    return p.withColumn("last_norm", authors.last_norm(F.col("name"))).withColumn("first_norm", authors.first_norm(F.col("name")))


@query(f"with {NAMES} select rid, regexp_replace(last_norm, '[^a-z]', '', 'g') as last_norm, regexp_replace(first_norm, '[^a-z ]', '', 'g') as first_norm from names")
def name_parts(spark, d):
    return _names(spark, d).select("rid", "last_norm", "first_norm")


_DISTINCT = f"with {NAMES}, t as (select name, count(*) as count, min(rid) as rid, any_value(last_norm) as last_norm, any_value(first_norm) as first_norm from names group by name)"


def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).groupBy("name", "last_norm", "first_norm").agg(F.count("*").alias("count"), F.min("rid").alias("rid")).withColumn("sources", F.array(F.lit("part")))


@query(f"{_DISTINCT} select rid, min(rid) over (partition by last_norm, first_norm) as comp from t")
def name_groups(spark, d):
    return authors.group_names(_distinct(spark, d)).select("rid", "comp")


@query(f"{_DISTINCT} select last_norm as grp, arg_max(name, (count, -rid)) as canonical, count(*) as n_variants, sum(count)::bigint as count from t group by last_norm")
def canonical_variant(spark, d):
    named = _distinct(spark, d).withColumn("comp", F.col("last_norm"))
    return authors.canonical(named).select(F.col("comp").alias("grp"), "canonical", "n_variants", "count")


@query("""with w as (select doc_id, trim(array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:2], ' ')) as name from documents where text is not null),
p as (select name, min(doc_id) as rid, string_split(rtrim(regexp_replace(name, '[’‘]', chr(39), 'g'), ' ,;('), ' ') as parts from w where name <> '' group by name),
u as (select name, rid, regexp_replace(lower(strip_accents(parts[-1])), '[^a-z]', '', 'g') as last_norm,
  trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(array_to_string(parts[1:-2], ' '), '([a-zA-Z])\\.', '\\1 ', 'g'))), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) as first_norm from p),
f as (select *, first_norm || last_norm as full from u where last_norm <> '')
select a.rid as a, b.rid as b, a.name as name_a, b.name as name_b from f a join f b on a.rid < b.rid and a.last_norm <> b.last_norm and abs(length(a.last_norm) - length(b.last_norm)) <= 2 and levenshtein(a.last_norm, b.last_norm) <= 2
  and 1 - levenshtein(a.full, b.full) / greatest(length(a.full), length(b.full), 1) >= 0.6""")
def name_fuzzy_flags(spark, d):
    """Doubtful pairs of the first two words of every text, folded."""
    t = table(spark, d, "documents").select("doc_id", T.first_words(F.col("text"), 2).alias("name")).where("name <> ''")
    one = t.groupBy(F.col("name").alias("_name")).agg(F.min("doc_id").alias("rid"), F.min("name").alias("name"))  # what follows is for a name, not for a text
    u = one.withColumn("last_norm", authors.last_norm(F.col("name"))).withColumn("full", F.concat(authors.first_norm(F.col("name")), F.col("last_norm")))
    return authors.fuzzy_flags(u.where("last_norm <> ''"), 0.6)


@query("select p_partkey, case p_brand when 'Brand#1' then 'Brand#2' else p_brand end as author from part")
def variant_apply(spark, d):
    v = spark.createDataFrame([("Brand#1", "Brand#2")], "variant string, canonical string")
    return authors.apply_variants(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("author")), v)


@query("select p_name as name, count(*) as count, array_to_string(list(distinct p_brand order by p_brand), ',') as sources from part group by p_name")
def name_table(spark, d):
    return authors.name_table(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("source"))).select("name", "count", F.array_join("sources", ",").alias("sources"))


# ---- results, ids, table changes ----


@query("select event_id, (props::json->>'k')::int as k from events where props is not null")
def json_results(spark, d):
    return table(spark, d, "events").where("props is not null").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic from documents d left join labels l using (doc_id)")
def score_join(spark, d):
    scored = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return scored.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("""select 'labels' as part, count(*) as n_missing from documents where doc_id not in (select doc_id from labels) union all
select 'embeddings', count(*) from documents where doc_id not in (select vec_id from embeddings)""")
def completeness_gate(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return enrich.completeness(docs, labels=(table(spark, d, "labels"), "doc_id"), embeddings=(table(spark, d, "embeddings"), "vec_id"))


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 50 as chunk from documents")
def chunks(spark, d):
    return tables.chunks(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("select max(regexp_extract(c_name, '(\\d+)$', 1)::bigint) as n from customer")
def max_numeric_id(spark, d):
    return table(spark, d, "customer").agg(F.max(tables.numeric_suffix(F.col("c_name"))).alias("n"))


@query("""select doc_id, printf('poem_%04d', (select max(regexp_extract(c_name, '(\\d+)$', 1)::bigint) from customer) + row_number() over (order by doc_id)) as id from documents""")
def assign_ids(spark, d):
    return tables.assign_ids(table(spark, d, "customer").select(F.col("c_name").alias("id")), table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "id")


@query("select doc_id as id, 'old' as v from labels union all select doc_id, 'new' from documents where doc_id not in (select doc_id from labels)")
def insert_ignore(spark, d):
    old = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("old").alias("v"))
    return tables.insert_ignore(old, table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("new").alias("v")))


@query("select user_id as id, arg_max(event_type, event_id) as v from events group by user_id union all select c_custkey, 'old' from customer where c_custkey not in (select user_id from events)")
def upsert_latest(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("v"))
    return tables.upsert(old, table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("v"), "event_id"), "id", "event_id")


@query("select count(*) filter (replace(text, '.', '!') is distinct from text) as n_changed from documents")
def update_distinct(spark, d):
    return tables.update_distinct(table(spark, d, "documents"), F.replace("text", F.lit("."), F.lit("!")), "text")[1]


@query("select d.doc_id, coalesce(case when l.quality = 1 then 'good' end, d.source) as source from documents d left join labels l using (doc_id)")
def sparse_update(spark, d):
    patch = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"))
    return tables.sparse_update(table(spark, d, "documents").select("doc_id", "source"), patch, "doc_id")


@query("""select 'orders' as t, count(*) as n from orders where o_orderpriority <> '1-URGENT' union all
select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')""")
def prune_rename(spark, d):
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    kept = tables.delete_where(o, F.col("o_orderpriority") == "1-URGENT", (table(spark, d, "lineitem"), "l_orderkey"))
    return kept[0].agg(F.lit("orders").alias("t"), F.count("*").alias("n")).unionByName(kept[1].agg(F.lit("lineitem").alias("t"), F.count("*").alias("n")))


@query("select lang, case when source in ('src1', 'src2') then 'src0' else source end as source, count(*) as n from documents group by all")
def rename_map(spark, d):
    return tables.rename(table(spark, d, "documents"), "source", {"src1": "src0", "src2": "src0"}).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_remaining(spark, d):
    return readers.remaining(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("select distinct source from documents where source in (select source from documents where lang = 'fr')")
def source_intersection(spark, d):
    t = table(spark, d, "documents")
    return t.select("source").intersect(t.where("lang = 'fr'").select("source"))


@query("select 'http://x/' || (2000 + user_id % 20) || '/p' || user_id || '.shtml' as url, max(strftime(ts, '%Y%m%d%H%M%S')) as timestamp from events group by user_id")
def latest_snapshot(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("http://x/"), 2000 + F.col("user_id") % 20, F.lit("/p"), "user_id", F.lit(".shtml")).alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"))
    return readers.latest_snapshots(e)


@query("select doc_id, quality, toxic from labels where (quality is null or quality between 0 and 10) and (toxic is null or toxic between 0 and 10)")
def rubric_range_check(spark, d):
    return table(spark, d, "labels").where(enrich.in_range("quality", "toxic")).select("doc_id", "quality", "toxic")


@query("select sum(length(text))::bigint as tokens_in, count(*) as tokens_out, round(sum(length(text)) * 1.0::double / 1e6 + count(*) * 4.0::double / 1e6, 6) as price from documents")
def cost_model(spark, d):
    t = table(spark, d, "documents").select(F.length("text").cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    return enrich.cost(t, "a", "b")


# ---- pages ----


_SHOWN = lambda c: rf"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '{c}', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query(f"""select page_id, coalesce({_SHOWN("(?is)<h1[^>]*>(.*?)</h1>")}, {_SHOWN("(?is)<meta[^>]*property=.og:title.[^>]*content=.([^>]*?).[ /]*>")}, {_SHOWN("(?is)<title[^>]*>(.*?)</title>")}) as title from pages""")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query("""select page_id, (unnest(range(len(hs))))::int as pos, unnest(hs) as href from (select page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) as hs from pages)""")
def page_links(spark, d):
    return pages.links(table(spark, d, "pages"))


@query(r"select page_id, len(regexp_extract_all(html, '(?i)<p(?:\s[^>]*)?>'))::int as n from pages")
def page_paragraphs(spark, d):
    return table(spark, d, "pages").select("page_id", pages.paragraphs(F.col("html")).alias("n"))


@query("select page_id, html not like '%<article%' as dropped from pages")
def page_records(spark, d):
    return pages.records(table(spark, d, "pages")).select("page_id", (F.col("drop_reason") == "no block").eqNullSafe(True).alias("dropped"))


@query()
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_text("html").alias("text"))


@query()
def page_poems(spark, d):
    return table(spark, d, "pages").select("page_id", markup.page_poem("html", pages.title(F.col("html"))).alias("body"))


@query()
def card_poems(spark, d):
    return table(spark, d, "pages").select("page_id", markup.card_poem("html").alias("body"))


@query()
def book_poems(spark, d):
    return table(spark, d, "documents").select("doc_id", markup.book_poem("text", F.split("text", "\n")[0]).alias("body"))


# ---- bilingual, back-fill, repairs ----

_TURNS = "turns as (select conv_id::varchar || '-' || chr((65 + turn)::int) as group_id, 'u' || conv_id as url, role as title, case when role = 'user' then 'Translated by X' else '' end as translator, text as body, conv_id, turn from conversations)"


@query(rf"""with {_TURNS}, t as (select *, length(regexp_replace(body, '[\x00-\x7f‘’“”–—… ]', '', 'g')) <= 2 as eng from turns),
g as (select conv_id, any_value(url) as url, count(*) filter (translator <> '') as n, arg_min(eng, turn) filter (translator <> '') as eng, arg_min(title, turn) filter (translator <> '') as ct, arg_min(title, turn) filter (translator = '') as ut, count(*) filter (translator = '') as nu from t group by conv_id)
select url, not (n = 1 and (eng or nu > 0)) as drop_all, case when n = 1 and eng then ct when n = 1 and nu > 0 then ut end as keep_title from g where n < 2""")
def bilingual_decisions(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.char(65 + F.col("turn"))).alias("group_id"), F.concat(F.lit("u"), "conv_id").alias("url"), F.col("role").alias("title"), F.when(F.col("role") == "user", "Translated by X").otherwise("").alias("translator"), F.col("text").alias("body"))
    return curate.bilingual_decisions(rows).select("url", "drop_all", "keep_title")


@query(f"""{BASE}, k as (select id, lower(author) as ak, regexp_replace(lower(body), '\\s+', '', 'g') as bk, corpus from poems),
m as (select ak, bk, count(*) as n from k group by all), h as (select ak, bk, count(distinct '<p>' || id) as nh from k where corpus is not null group by all)
select id, case when nh is null then 'none' when n > 1 then 'ambiguous' when nh > 1 then 'conflict' else 'one' end as status from k join m using (ak, bk) left join h using (ak, bk)""")
def backfill_match(spark, d):
    p = poems(spark, d)
    parsed = p.where("corpus is not null").select("author", "body", F.concat(F.lit("<p>"), "id").alias("html"))
    return repair.backfill(p, parsed).select("id", "status")


@query()
def charset_repair(spark, d):
    return poems(spark, d).select("id", T.repair_charset("body").alias("value"))


@query()
def title_fuzzy_match(spark, d):
    p = poems(spark, d).withColumn("rid", F.col("id"))
    listed = p.where("corpus is null").select("author", F.col("title").alias("listed"))
    return curate.title_matches(p, listed)


def _stanzas(spark: SparkSession, d: str) -> DataFrame:
    return poems(spark, d).select("id", F.col("body").alias("stored"), F.replace("body", F.lit(".\n"), F.lit(".\n\n")).alias("fetched"))


@query()
def match_grade(spark, d):
    r = _stanzas(spark, d).select("id", S.folded_lines("stored", "fetched").alias("x"))
    return r.select("id", S.match_grade(F.col("x.n_stored"), F.col("x.n_fetched"), F.col("x.ratio")).alias("grade"))


@query()
def stanza_transplant(spark, d):
    return repair.stanza_plan(_stanzas(spark, d).withColumn("grade", F.lit("near")))


@query()
def clean_chain(spark, d):
    """The cleaned bodies and change logs themselves, two sources standing for those with rules of their own."""
    source = F.when(F.col("source") == "src1", "podcast").when(F.col("source") == "src2", "daily").otherwise(F.col("source")).alias("source")
    rows = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", source, F.col("text").alias("body"))
    return curate.clean_b(rows).select("doc_id", F.sha2("body", 256).alias("body_sha256"), "changes")


# ---- site pages, made from documents and read back ----


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


LINES_BACK = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(replace(x, chr(160), ' '), '\\s+$', ''))"


@query(f"select doc_id, regexp_replace(array_to_string({LINES_BACK}, chr(10)), '\\n+$', '') as body, 'Title ' || doc_id as title, '2014' as year from documents")
def daily_pages(spark, d):
    """Documents as daily pages, a marked line each, and the poems that the parser finds."""
    line = lambda x: F.concat(F.lit('<span class = "excerpt_line">'), _escaped(x), F.lit("</span>"))
    spans = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    html = F.concat(
        F.lit('<div class="daily_poem_title"><div class="elementor-shortcode">Title '), F.col("doc_id"), F.lit('</div></div><div id="daily-poem"><div class="elementor-widget-container">'), spans,
        F.lit('</div></div><div data-widget_type="text-editor.default"><div class="elementor-widget-container">Copyright &copy; 2014 by A</div></div>'),
    )
    made = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return sites.site_records(made, "daily").select(F.col("page_id").alias("doc_id"), "body", "title", "year")


@query(f"""with l as (select doc_id, list_filter({LINES_BACK}, lambda x: trim(x) <> '') as ls from documents)
select doc_id, case when len(ls) > 0 then array_to_string(ls, chr(10)) else '' end as body, case when len(ls) > 0 then 'The Title' else '' end as title, case when len(ls) > 0 then 'A' || doc_id else '' end as poet,
  case when len(ls) = 0 then 'no_poem_text' when len(ls) < 3 then 'very_short' else '' end as flags from l""")
def episode_pages(spark, d):
    """Documents as episodes in verse, and the poems that the parser finds."""
    ls = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.replace(x, F.lit("\xa0"), F.lit(" "))) != "")
    html = F.concat(F.lit("<p>talk</p><hr/><p><strong>The Title<br/>by A"), F.col("doc_id"), F.lit('</strong></p><pre class="verse">'), _escaped(F.array_join(ls, "\n")), F.lit("</pre>"))
    made = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return sites.site_records(made, "episode").select(F.col("page_id").alias("doc_id"), "body", F.when(F.col("body") != "", F.col("title")).otherwise("").alias("title"), "poet", F.array_join("flags", ",").alias("flags"))


# ---- results, batches, tables ----


def _result_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    error = F.when(F.col("event_type") == "error", F.lit("rate"))
    line = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(enrich.result_line(F.col("user_id").cast("string"), F.col("props"), error))
    return e.select("event_id", line.alias("value"))


@query("select user_id::varchar as custom_id, count(*) as n_lines from events where event_id % 7 <> 0 and event_type <> 'error' group by all")
def result_resume_set(spark, d):
    """Result lines written and read again: the ids that need no second request, and their lines."""
    good, ids = enrich.succeeded(_result_lines(spark, d))
    lines = good.select(F.get_json_object("value", "$.custom_id").alias("custom_id"))
    return lines.join(ids, "custom_id", "left_semi").groupBy("custom_id").agg(F.count("*").alias("n_lines"))


@query("""select user_id::varchar as custom_id, arg_max(case when event_type = 'error' then 500 else 200 end, event_id)::int as status,
  nullif(arg_max(case when event_type = 'error' then '' else props end, event_id), '') as content from events where event_id % 7 <> 0 group by all""")
def result_lines_parsed(spark, d):
    return enrich.parse_results(_result_lines(spark, d), order="event_id").select("custom_id", "status", "content")


@query("""with last as (select user_id as chunk, arg_max(case event_type when 'click' then 'submitted' when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'downloaded' end, event_id) as state from events group by all),
s as (select c_custkey as chunk, coalesce(state, 'pending') as state from customer left join last on last.chunk = c_custkey),
f as (select max((state in ('submitted', 'running'))::int) as busy, min(case when state in ('pending', 'failed') then chunk end) as first from s)
select chunk::bigint as chunk, state, case when state in ('submitted', 'running') then 'poll' when state = 'completed' then 'download' when state = 'downloaded' then 'done' when busy = 0 and chunk = first then 'submit' else 'wait' end as next from s, f""")
def chunk_states(spark, d):
    named = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "submitted", "view", "running", "purchase", "completed", "error", "failed", "signup", "downloaded")]), F.col("event_type"))
    events = table(spark, d, "events").select(F.col("user_id").alias("chunk"), F.col("event_id").alias("seq"), named.alias("state"))
    return enrich.chunk_states(table(spark, d, "customer").select(F.col("c_custkey").alias("chunk")), events)


@query("""select p_partkey as id, (ord - 1)::int as ord, guess from (select p_partkey, unnest(gs) as guess, generate_subscripts(gs, 1) as ord
  from (select p_partkey, list_filter([p_name, p_name || ' (' || p_type || ')', case when p_brand <> 'Brand#1' then p_brand end], lambda x: x is not null) as gs from part))""")
def lookup_guesses(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    brand = F.when(F.col("p_brand") != "Brand#1", F.col("p_brand"))
    return enrich.lookups(p, F.col("p_name"), F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")")), F.col("p_name"), brand)


@query(f"with {INTERACTIONS}, new as (select distinct user_id, poem_id from interactions where action = 'like') select (select max(id) from interactions) + row_number() over (order by user_id, poem_id) as id, user_id, poem_id, 'share' as action from new")
def append_events(spark, d):
    """What an append of a share for each liked poem adds to the log."""
    log = interactions(spark, d)
    new = log.where("action = 'like'").select("user_id", "poem_id").distinct().withColumn("action", F.lit("share"))
    return tables.append_events(log, new, F.lit("2030-01-01").cast("timestamp_ntz")).where("year(created_at) = 2030").select("id", "user_id", "poem_id", "action")


@query(f"with {INTERACTIONS} select id, poem_id, action from interactions where user_id = {READER}")
def own_rows(spark, d):
    return tables.own_rows(interactions(spark, d), READER).select("id", "poem_id", "action")


@query("""with have as (select o_orderkey as id from orders where o_orderkey % 3 <> 0) select (select count(*) from orders) as n_batch, (select count(*) from have) as n_present,
  (select max(id) from have) - (select count(*) from orders) as base, (select count(*) from orders) as n_after""")
def insert_missing(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    after, n = tables.insert_missing(o.where("id % 3 <> 0"), o)
    return n.join(after.agg(F.count("*").alias("n_after")), F.lit(True))


@query("select l_orderkey, array_to_string(list(distinct l_shipdate::date::varchar order by l_shipdate::date::varchar), ',') as days from lineitem group by all")
def distinct_days(spark, d):
    days = F.array_sort(F.array_distinct(F.collect_list(F.col("l_shipdate").cast("date").cast("string"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(days, ",").alias("days"))


@query(f"{BASE} select id, row_number() over (order by contains(body, chr(10) || chr(10)) desc, line_count desc, id) as place from poems")
def preview_order(spark, d):
    """Poems with stanza breaks first, then the longest: the order of a review list, as numbers of range partitions."""
    p = poems(spark, d).select("id", F.struct((~T.has_stanza_breaks(F.col("body"))).alias("plain"), (-F.col("line_count")).alias("short"), "id").alias("by"))
    return tables.numbered_rows(p, "by", "place").select("id", "place")


@query(f"""with {DEDUP}, {COMP}, j as (select * from docs join comp using (rid)) select comp, count(*) as n, array_to_string(list_sort(list_distinct(list(source))), ',') as sources, bool_or(title_norm in (select title_norm from docs where source = 'src7')) as deleted
from j group by comp having count(*) > 1""")
def candidate_report(spark, d):
    rows = _clustered(spark, d).withColumns({"author": F.col("block"), "title": F.col("title_norm")})
    return dedup.candidate_report(rows, rows.where("source = 'src7'")).select("comp", "n", F.array_join("sources", ",").alias("sources"), "deleted")


@query()
def merge_chain(spark, d):
    """The merged corpus by class: clusters of one text become one record, all other rows stay."""
    rows, fuzzy = _clustered_whole(spark, d)
    merged = dedup.merge_chain(rows.withColumn("score", F.length("body")), fuzzy)
    return merged.select("winner", "n", "cls", F.array_join("provenance", ",").alias("provenance"))


# ---- earlier forms of the recommender ----

_LAST = "last as (select user_id, poem_id, arg_max(action, (created_at, id)) as a from interactions where action in ('save', 'super_like', 'dislike', 'unsave') group by all)"
_NEAREST = "select row_number() over (order by dist, near.id)::int as ord, near.id, title, poems.author, body, line_count, 0 as slice from near join poems using (id) order by dist, near.id limit 5"


def _last_weights(super_like: float, dislike: float) -> str:
    return f"weights as (select user_id, poem_id, case a when 'super_like' then {super_like} when 'save' then 1.0 when 'dislike' then {dislike} else 0.0 end::double as weight from last)"


def _unseen(where: str) -> str:
    return f"unseen as (select * from poems where {where} and id not in (select poem_id from interactions where user_id = {READER}))"


@query(f"{BASE}, {_LAST}, {_last_weights(2.0, -2.0)}, {TASTE}, {UNSEEN}, {NEAR} {_NEAREST}")
def recommend_v10(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER, version=R.VERSIONS["v10"])


@query(f"{BASE}, {_LAST}, {_last_weights(3.0, -2.0)}, {TASTE}, {UNSEEN}, {NEAR} {_NEAREST}")
def recommend_v11(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER, version=R.VERSIONS["v11"])


@query(f"{BASE}, {_LAST}, {_last_weights(3.0, -0.5)}, {TASTE}, {_unseen('line_count <= 10')}, {NEAR} {_NEAREST}")
def recommend_v14(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER, line_max=10, version=R.VERSIONS["v14"])


@query(f"{BASE}, {STATE}, {WEIGHTS}, {TASTE}, {_unseen('line_count <= 40')}, {NEAR} {_NEAREST}")
def recommend_v19(spark, d):
    return R.recommend(poems(spark, d), interactions(spark, d), READER, long=False, version=R.VERSIONS["v19"])


ESCAPED_BACK = "list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(replace(x, chr(9), ' '), '^ +', ''), '[ \u00a0]+$', ''))"


@query(f"select doc_id, regexp_replace(regexp_replace(array_to_string({ESCAPED_BACK}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as body from documents")
def archive_pages(spark, d):
    """Documents as archive pages, a quotation with line ends, and the poems that the parser finds."""
    html = F.concat(F.lit("<blockquote><p><b>The Title</b></p>"), F.replace(_escaped(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("<br>\n")), F.lit("<iframe></iframe>more</blockquote>"))
    made = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return sites.site_records(made, "archive").select(F.col("page_id").alias("doc_id"), "body")


# ---- tables in buckets, counted writes ----


@query("select doc_id as id, case when doc_id % 4 = 2 then source else 'new' end as source from documents")
def ingest_batches(spark, d):
    """Four batches of files are upserted; the one with a row that breaks the check is left out, the others go on."""
    folder = tables.fresh_folder(spark, "ingest")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    writes.create(rows, f"{folder}/table")
    for k in range(4):
        rows.where(F.col("id") % 4 == k).withColumn("source", F.when(F.col("id") == 2, "broken").otherwise("new")).coalesce(1).write.mode("append").json(f"{folder}/in")
    writes.ingest(spark, f"{folder}/in", "id long, source string", f"{folder}/table", f"{folder}/log", f"{folder}/seen", check=F.col("source") != "broken")
    return writes.read(spark, f"{folder}/table")


@query("""select 'orders' as t, o_orderkey as a, 0 as b from orders where o_orderpriority <> '1-URGENT' union all
select 'lineitem', l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')""")
def bucket_delete(spark, d):
    """Orders and, before them, their lines go by a predicate; what is left in both tables."""
    folder = tables.fresh_folder(spark, "delete")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    lines = table(spark, d, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("line"), "l_orderkey", "l_linenumber")
    writes.create(o, f"{folder}/orders")
    writes.create(lines, f"{folder}/lineitem", "line")
    writes.delete_rows(spark, f"{folder}/orders", o.where("o_orderpriority = '1-URGENT'").select("id"), (f"{folder}/lineitem", "l_orderkey"))
    left = writes.read(spark, f"{folder}/orders").select(F.lit("orders").alias("t"), F.col("id").alias("a"), F.lit(0).alias("b"))
    return left.unionByName(writes.read(spark, f"{folder}/lineitem").select(F.lit("lineitem").alias("t"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("int").alias("b")))


def _fixed_marks(spark: SparkSession, d: str):
    changes = {"body": F.replace("body", F.lit(","), F.lit(";")), "title": F.replace("title", F.lit("."), F.lit("!"))}
    return writes.update_counted(poems(spark, d).select("id", "title", "body"), changes, tables.fresh_folder(spark, "update"))


@query(f"{BASE} select id, replace(title, '.', '!') as title, replace(body, ',', ';') as body from poems")
def counted_update(spark, d):
    return _fixed_marks(spark, d)[0]


@query(f"{BASE} select count(*) as n_rows, count(*) filter (contains(body, ',')) as body, count(*) filter (contains(title, '.')) as title from poems")
def counted_update_counts(spark, d):
    """The counts observed in the pass that wrote ``counted_update``'s rows."""
    n = _fixed_marks(spark, d)[1]
    return spark.createDataFrame([tuple(n.values())], ", ".join(f"{c} long" for c in n))


@query(f"""{BASE}, r as (select id, list_filter([case when corpus is null then 'no corpus' end, case when embedding is null then 'no embedding' end, case when line_count > 5 then 'long' end], lambda x: x is not null) as reasons from poems)
select id, len(reasons) > 0 as removed, array_to_string(reasons, ',') as reasons from r""")
def split_required(spark, d):
    """Kept and removed rows, written in one pass, with the reasons."""
    reasons = {"no corpus": F.col("corpus").isNull(), "no embedding": F.col("embedding").isNull(), "long": F.col("line_count") > 5}
    kept, removed, _ = writes.split_counted(poems(spark, d), reasons, tables.fresh_folder(spark, "split"))
    return kept.select("id", F.lit(False).alias("removed"), F.lit("").alias("reasons")).unionByName(removed.select("id", F.lit(True).alias("removed"), F.array_join("reasons", ",").alias("reasons")))


@query(f"""{BASE}, s as (select id, body as b0, replace(body, '***', '*') as b1, replace(replace(body, '***', '*'), ', ', ',') as b2, trim(replace(replace(body, '***', '*'), ', ', ','), ' ') as b3 from poems)
select id, step, before, after from (select id, 'mark' as step, length(b0)::int as before, length(b1)::int as after, b0 <> b1 as c from s union all
  select id, 'comma', length(b1)::int, length(b2)::int, b1 <> b2 from s union all select id, 'trim', length(b2)::int, length(b3)::int, b2 <> b3 from s) where c""")
def change_log(spark, d):
    """Which step of a cleaning chain changed which row, from the pass that cleaned them."""
    steps = [("mark", F.replace("body", F.lit("***"), F.lit("*"))), ("comma", F.replace("body", F.lit(", "), F.lit(","))), ("trim", F.trim("body"))]
    return writes.clean_counted(poems(spark, d).select("id", "body"), steps, "body", tables.fresh_folder(spark, "clean"))[1]


# ---- taps, many patterns ----

_TAPS = """taps as (select event_id as id, user_id, event_id % 5 as poem_id, case event_type when 'click' then 'like' when 'error' then 'dislike' when 'purchase' then 'save' end as what, ts as created_at
  from events where event_type in ('click', 'error', 'purchase'))"""


@query(f"""with recursive {_TAPS}, numbered as (select *, row_number() over (partition by user_id, poem_id, what = 'save' order by created_at, id) as k from taps),
fold as (
  select id, user_id, poem_id, what, created_at, k, what as state, ''::varchar as old from numbered where k = 1 union all
  select n.id, n.user_id, n.poem_id, n.what, n.created_at, n.k, case when f.state = n.what then '' else n.what end, f.state
  from fold f join numbered n on n.user_id = f.user_id and n.poem_id = f.poem_id and (n.what = 'save') = (f.what = 'save') and n.k = f.k + 1
)
select user_id, poem_id, created_at, id, 0 as n, 'un' || old as action from fold where old <> '' and old <> what union all
select user_id, poem_id, created_at, id, 1, case when state = '' then 'un' || what else what end from fold""")
def toggle_log(spark, d):
    what = F.when(F.col("event_type") == "click", "like").when(F.col("event_type") == "error", "dislike").when(F.col("event_type") == "purchase", "save")
    e = table(spark, d, "events")
    return R.toggle_rows(e.select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 5).alias("poem_id"), what.alias("what"), F.col("ts").alias("created_at")))


_PATTERNS = [(1, "***"), (2, "$$$"), (3, "(c)"), (4, "\n\n"), (5, "that")]


@query(f"""{BASE}, p(pattern_id, pattern) as (values {", ".join(f"({k}, '{x}')" if chr(10) not in x else f"({k}, chr(10) || chr(10))" for k, x in _PATTERNS)})
select id, pattern_id, ((length(body) - length(replace(body, pattern, ''))) // length(pattern))::bigint as n, instr(body, pattern)::int as at,
  substr(body, greatest(1, instr(body, pattern) - 20), instr(body, pattern) - greatest(1, instr(body, pattern) - 20) + length(pattern) + 20) as before
from poems, p where contains(body, pattern)""")
def pattern_hits(spark, d):
    patterns = spark.createDataFrame(_PATTERNS, "pattern_id int, pattern string")
    return curate.pattern_hits(poems(spark, d).select("id", "body"), patterns)
