"""What a client may call from SQL: look-ups, the recommender, the picker, and a reader's own rows.

``publish`` puts the tables behind temporary views and registers the functions; the views on
a reader's rows take the reader from a session variable, so no query can leave it out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from stanzaflow.operators.recommend import CURRENT, NO_CORPUS, NULL_CORPUS, POSITIVE

#: Tables with a reader's rows, and the column that names the reader.
OWNED = {"interactions": "user_id"}
#: The session variable that says who reads.
READER = "reader"


class PickDiverse:
    """``pick_diverse(TABLE(pool), n, recent, seed)``: the picker over a pool of ``id, author, corpus``, as ``id, ord, level``.

    A pool has at most the recommender's pool size of rows; a larger one is an error, so
    that one task never gathers more.
    """

    MOST = CURRENT.pool

    @staticmethod
    def analyze(pool: AnalyzeArgument, n: AnalyzeArgument, recent: AnalyzeArgument, seed: AnalyzeArgument) -> AnalyzeResult:
        if not pool.isTable or not {"id", "author", "corpus"} <= {f.name for f in pool.dataType.fields}:
            raise ValueError("the first argument is a table with id, author and corpus")
        if n.value is None or n.value < 0 or not seed.value:
            raise ValueError("n is a number from 0 on and seed a text, both constant")
        return AnalyzeResult(StructType([StructField("id", LongType()), StructField("ord", IntegerType()), StructField("level", IntegerType())]), withSinglePartition=True)

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.asked: tuple = (0, [])

    def eval(self, pool: Row, n: int, recent: list[str | None] | None, seed: str) -> None:
        if len(self.rows) == self.MOST:
            raise ValueError(f"the pool has more than {self.MOST} rows")
        self.rows.append((hashlib.md5(f"{pool['id']}:{seed}".encode()).hexdigest(), pool["id"], pool["author"], pool["corpus"]))
        self.asked = (n, recent or [])

    def terminate(self):
        n, recent = self.asked
        rows = sorted(self.rows)
        one: dict = {}
        for r in rows:
            one.setdefault(r[2], r)
        turns: dict = {}
        dealt = []
        for r in one.values():
            if r[2] is None or r[2] not in recent:
                corpus = NO_CORPUS if r[3] is None else r[3]
                turns[corpus] = turns.get(corpus, 0) + 1
                dealt.append((turns[corpus], r))
        levels = [(0, [r for _, r in sorted(dealt)]), (2, sorted(one.values(), key=lambda r: (r[2] is not None, r[2] or ""))), (3, rows)]
        level, chosen = next(((k, c) for k, c in levels if len(c) >= n), levels[-1])
        for i, r in enumerate(chosen[:n]):
            yield r[1], i + 1, level


def _pick(name: str, pool: str) -> str:
    """Common table expressions for the picker over ``pool(id, author, corpus, key, m, barred)``, m poems wanted and some authors barred: ``name`` has ``id, author, ord``.

    The places of a row in all levels are windows over the one pool, which has at most the recommender's pool size of rows.
    """
    return f"""
{name}_one as (select *, row_number() over (partition by author order by key, id) = 1 as one from {pool}),
{name}_free as (select *, one and not coalesce(array_contains(barred, author), false) as free from {name}_one),
{name}_turn as (select *, row_number() over (partition by free, coalesce(corpus, '{NO_CORPUS}') order by key, id) as turn from {name}_free),
{name}_places as (
  select id, author, m, one, free, row_number() over (order by free desc, turn, key, id) as ord0, row_number() over (order by one desc, author) as ord2, row_number() over (order by key, id) as ord3,
    case when count_if(free) over () >= m then 0 when count_if(one) over () >= m then 2 else 3 end as level from {name}_turn
),
{name} as (select id, author, case level when 0 then ord0 when 2 then ord2 else ord3 end as ord from {name}_places where case level when 0 then free and ord0 <= m when 2 then one and ord2 <= m else ord3 <= m end)"""


def _recommend_sql() -> str:
    v = CURRENT
    some = ", ".join(f"'{a}'" for a in POSITIVE)
    newest = lambda *a: "max_by(case when action in ({0}) then action end, case when action in ({0}) then struct(created_at, id) end)".format(", ".join(f"'{x}'" for x in a))
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
    n_explore = f"greatest(1, cast(floor(n * {v.explore} + 0.5) as int))"
    return f"""
create or replace temporary function recommend_poems(
  reader bigint, n int default 5, corpora array<string> default array(), short boolean default true, medium boolean default true, long boolean default true,
  recent array<string> default array(), force_random boolean default false, seed string default 's'
) returns table (ord int, id bigint, title string, author string, body string, line_count int, slice int) return
with mine as (select poem_id, action, created_at, id from all_interactions where user_id = recommend_poems.reader),
state as (
  select poem_id, {newest("save", "unsave", "super_like")} as s, {newest("like", "unlike")} as l, {newest("dislike", "undislike")} as d, bool_or(action = 'share') as h from mine group by poem_id
),
weights as (
  select poem_id, case when d = 'dislike' then {v.dislike}D else greatest(
    case when s in ('save', 'super_like') then {v.save}D else 0D end, case when h then {v.share}D else 0D end, case when l = 'like' then {v.like}D else 0D end) end as weight from state
),
parts as (
  select pos, sum(cast(x as double) * weight) as x
  from weights join all_poems p on p.id = poem_id lateral view posexplode(p.embedding) e as pos, x where weight <> 0 and p.embedding is not null group by pos
),
taste as (select transform(array_sort(collect_list(struct(pos, x))), p -> p.x) as v from parts having count(*) > 0),
gate as (select count(distinct case when action in ({some}) then poem_id end) >= {v.min_signals} as enough from mine),
mode as (
  select warm, v, n - {n_explore} as n_taste, case when warm then {n_explore} else n end as n_explore, coalesce(recommend_poems.recent, array()) as recent
  from (select enough and v is not null and not coalesce(recommend_poems.force_random, false) as warm, v from gate left join taste on true)
),
fresh as (
  select p.id, p.author, p.corpus, p.embedding from all_poems p
  where (short and line_count <= 14 or medium and line_count between 15 and 40 or long and line_count >= 41)
    and (coalesce(size(corpora), 0) <= 0 or coalesce(array_contains(corpora, p.corpus), false) or p.corpus is null and array_contains(corpora, '{NULL_CORPUS}'))
    and not exists (select 1 from mine m where m.poem_id = p.id)
),
near as (
  select id, author, corpus, md5(concat(cast(id as string), ':', recommend_poems.seed, ':taste')) as key, m, barred from (
    select *, row_number() over (order by dist, id) as k from (
      select id, author, corpus, n_taste as m, mode.recent as barred, round(coalesce(1 - try_divide({dot("embedding", "v")}, sqrt({dot("embedding", "embedding")}) * sqrt({dot("v", "v")})), double('nan')), 6) as dist
      from fresh cross join mode where warm and embedding is not null)
  ) where k <= {v.pool}
),
rest as (
  select id, author, corpus, key from (
    select id, author, corpus, key, row_number() over (order by key, id) as k from (
      select f.id, f.author, f.corpus, md5(concat(cast(f.id as string), ':', recommend_poems.seed, case when warm then ':explore' else ':random' end)) as key
      from fresh f left anti join near on near.id = f.id cross join mode)
  ) where k <= {v.pool}
),{_pick("first", "near")},
shown as (select coalesce(collect_set(author), array()) as authors from first),
open as (select rest.*, n_explore as m, array_union(mode.recent, authors) as barred from rest cross join mode cross join shown),{_pick("second", "open")},
chosen as (select 0 as slice, id, ord from first union all select case when warm then 1 else 0 end as slice, id, ord from second cross join mode)
select cast(row_number() over (order by c.slice, c.ord) as int), p.id, p.title, p.author, p.body, p.line_count, c.slice from chosen c join all_poems p on p.id = c.id"""


def publish(spark: SparkSession, poems: DataFrame, interactions: DataFrame) -> None:
    """Makes ``get_poem``, ``get_poems_by_ids``, ``recommend_poems`` and ``pick_diverse`` callable from SQL, and ``my_<table>`` a view of the session's reader.

    ``poems(id, title, author, body, corpus, line_count, embedding)``. ``recommend_poems``
    is ``recommend`` as one plan without driver steps: for a null reader it has no rows of
    his, so it explores. A view ``my_<table>`` is empty until ``as_reader`` says who reads;
    its predicate is pushed to the scan.
    """
    poems.createOrReplaceTempView("all_poems")
    interactions.createOrReplaceTempView("all_interactions")
    spark.sql("create or replace temporary function get_poem(poem_id bigint) returns table (id bigint, title string, author string, body string) return select p.id, p.title, p.author, p.body from all_poems p where p.id = poem_id")
    spark.sql("""create or replace temporary function get_poems_by_ids(poem_ids array<bigint>) returns table (ord int, id bigint, title string, author string, body string, line_count int) return
      select o.ord, p.id, p.title, p.author, p.body, p.line_count from posexplode(poem_ids) o(ord, wanted) join all_poems p on p.id = o.wanted""")
    spark.sql(_recommend_sql())
    from pyspark.sql.functions import udtf

    spark.udtf.register("pick_diverse", udtf(PickDiverse))
    spark.sql(f"declare or replace variable {READER} bigint default null")
    for table, column in OWNED.items():
        spark.sql(f"create or replace temporary view my_{table} as select * from all_{table} where {column} = session.{READER}")


def as_reader(spark: SparkSession, reader: int | None) -> None:
    """Says who reads in this session; None: nobody, and the views are empty."""
    spark.sql(f"set variable {READER} = {'null' if reader is None else int(reader)}")
