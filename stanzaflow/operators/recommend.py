"""Reactions, the recommender, and the library of a reader."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stanzaflow.functions.similarity import cosine_distance
from stanzaflow.operators.vectors import BLOCK, SHARD, VectorIndex, _matrix, nearest, nearest_all, nearest_rows, vector_sum, write_index

POSITIVE = ("save", "super_like", "like", "share")
NULL_CORPUS, NO_CORPUS = "__null__", "__none__"


def random_key(column: str, seed: str) -> Column:
    """A reproducible stand-in for random(): the hash of an id and a seed."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}")))


def _latest(*actions: str) -> Column:
    """The newest of these actions in a group; ties go to the larger id."""
    hit = F.col("action").isin(*actions)
    return F.max_by(F.when(hit, F.col("action")), F.when(hit, F.struct("created_at", "id")))


def reaction_state(log: DataFrame, by: tuple[str, ...] = ("user_id", "poem_id")) -> DataFrame:
    """Current state of each reader and poem in one aggregate: saved, liked, disliked (latest wins), shared (sticky)."""
    g = log.groupBy(*by).agg(_latest("save", "unsave", "super_like").alias("s"), _latest("like", "unlike").alias("l"), _latest("dislike", "undislike").alias("d"), F.bool_or(F.col("action") == "share").alias("shared"))
    yes = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    return g.select(*by, yes("s", "save", "super_like").alias("saved"), yes("l", "like").alias("liked"), yes("d", "dislike").alias("disliked"), F.coalesce("shared", F.lit(False)).alias("shared"))


@dataclass(frozen=True)
class Version:
    """Weights and rules of one form of the recommender."""

    like: float = 0.5
    share: float = 1.0
    save: float = 1.0
    super_like: float = 1.0
    dislike: float = -0.5
    latest_action_only: bool = False
    min_signals: int = 15
    pool: int = 1000
    explore: float = 0.5
    exclude_seen_when_cold: bool = True


CURRENT = Version()
VERSIONS = {
    "v10": Version(like=0, share=0, super_like=2.0, dislike=-2.0, latest_action_only=True, min_signals=1, explore=0, exclude_seen_when_cold=False),
    "v11": Version(like=0, share=0, super_like=3.0, dislike=-2.0, latest_action_only=True, min_signals=1, explore=0, exclude_seen_when_cold=False),
    "v12": Version(like=0, share=0, super_like=3.0, dislike=-0.5, latest_action_only=True, min_signals=1, explore=0, exclude_seen_when_cold=False),
    "v14": Version(like=0, share=0, super_like=3.0, dislike=-0.5, latest_action_only=True, min_signals=1, explore=0, exclude_seen_when_cold=False),  # with line_max
    "v16": Version(min_signals=1, explore=0, exclude_seen_when_cold=False),
    "v19": Version(min_signals=1, explore=0, exclude_seen_when_cold=False),  # with length buckets
    "v21": Version(min_signals=5, pool=300, explore=0.28),
    "v30": CURRENT,
}


def poem_weights(log: DataFrame, version: Version = CURRENT, by: tuple[str, ...] = ("user_id", "poem_id")) -> DataFrame:
    """Weight of each reader and poem: a dislike overrides, else the strongest signal counts; signals don't add up."""
    if version.latest_action_only:
        last = log.where(F.col("action").isin("save", "super_like", "dislike", "unsave")).groupBy(*by).agg(F.max_by("action", F.struct("created_at", "id")).alias("a"))
        w = F.when(F.col("a") == "super_like", version.super_like).when(F.col("a") == "save", version.save).when(F.col("a") == "dislike", version.dislike).otherwise(0.0)
        return last.select(*by, w.alias("weight"))
    part = lambda c, w: F.when(F.col(c), F.lit(w)).otherwise(0.0)
    w = F.when(F.col("disliked"), F.lit(version.dislike)).otherwise(F.greatest(part("saved", version.save), part("shared", version.share), part("liked", version.like)))
    return reaction_state(log, by).select(*by, w.alias("weight"))


def taste_vector(weights: DataFrame, poems: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Weighted sum of the embeddings for each reader; no row for a reader without a weighted, embedded poem."""
    w = weights.where("weight <> 0").join(poems.where("embedding is not null").select(F.col("id").alias("poem_id"), "embedding"), "poem_id")
    return vector_sum(w, by, "embedding", "weight", "taste")


def signal_gate(log: DataFrame, min_signals: int = 15) -> DataFrame:
    """Distinct positively marked poems of each reader (undoing doesn't count) and whether the taste is used."""
    n = F.count_distinct(F.when(F.col("action").isin(*POSITIVE), F.col("poem_id")))
    return log.groupBy("user_id").agg(n.alias("n_positive")).withColumn("warm", F.col("n_positive") >= min_signals)


def in_buckets(short: bool = True, medium: bool = True, long: bool = True) -> Column:
    """Length buckets up to 14, 15 to 40, and 41 lines or more; all off matches nothing."""
    n = F.col("line_count")
    return (F.lit(short) & (n <= 14)) | (F.lit(medium) & n.between(15, 40)) | (F.lit(long) & (n >= 41))


def in_corpora(names: list[str | None] | None) -> Column:
    """An empty or missing list takes all; ``__null__`` stands for poems without a corpus."""
    if not names:
        return F.lit(True)
    named = F.coalesce(F.col("corpus").isin([x for x in names if x is not None]), F.lit(False))
    return named | (F.col("corpus").isNull() & F.lit(NULL_CORPUS in names))


def under_cap(line_max: int | None) -> Column:
    return F.lit(True) if line_max is None else F.col("line_count") <= line_max


def unseen(poems: DataFrame, log: DataFrame, user: int) -> DataFrame:
    """Poems that a reader never touched, previews included."""
    return poems.join(log.where(F.col("user_id") == user).select(F.col("poem_id").alias("id")).distinct(), "id", "left_anti")


def random_pool(candidates: DataFrame, seed: str, n: int = 1000) -> DataFrame:
    return candidates.orderBy(random_key("id", seed), "id").limit(n)


def taste_pool(candidates: DataFrame, taste: list[float], n: int = 1000) -> DataFrame:
    """The nearest poems by cosine, with ``dist`` rounded to 6 digits; undefined distances come last."""
    d = candidates.where("embedding is not null").withColumn("dist", F.round(cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in taste])), 6))
    return d.orderBy("dist", "id").limit(n)


def pick_levels(pool: DataFrame, n: int, recent: list[str | None] | None, seed: str) -> list[DataFrame]:
    """What each level of the picker would choose, ``id, ord``:

    0: one poem an author, recent authors left out, dealt round the corpora;
    2: one poem an author, recent ones allowed, the first ``n`` authors by name;
    3: any poems. (A level 1 would choose among the authors of level 0 and can't give more.)
    """
    key = random_key("id", seed)
    rank = lambda *order: F.row_number().over(Window.orderBy(*order))
    one = pool.withColumn("k", F.row_number().over(Window.partitionBy("author").orderBy(key, "id"))).where("k = 1").drop("k")
    left = [a for a in recent or [] if a is not None]
    fresh = one.where(~F.col("author").isin(left)) if left else one
    turn = F.row_number().over(Window.partitionBy(F.coalesce("corpus", F.lit(NO_CORPUS))).orderBy(key, "id"))
    level0 = fresh.withColumn("turn", turn).orderBy("turn", key, "id").limit(max(0, n)).select("id", rank("turn", key, "id").alias("ord"))
    level2 = one.orderBy("author").limit(max(0, n)).select("id", rank("author").alias("ord"))
    level3 = pool.orderBy(key, "id").limit(max(0, n)).select("id", rank(key, "id").alias("ord"))
    return [level0, level2, level3]


def pick_diverse(pool: DataFrame, n: int, recent: list[str | None] | None, seed: str) -> DataFrame:
    """The first level that has ``n`` poems, else the last: ``id, ord, level``. The pool holds at most a thousand rows."""
    out = None
    for number, level in zip((0, 2, 3), pick_levels(pool, n, recent, seed), strict=True):
        level = level.withColumn("level", F.lit(number))
        out = level if out is None else out.unionAll(level)
    sizes = out.groupBy("level").agg(F.count("*").alias("n"))
    chosen = sizes.agg(F.coalesce(F.min(F.when((F.col("n") >= n) | (F.col("level") == 3), F.col("level"))), F.lit(3)).alias("level"))
    return out.join(F.broadcast(chosen), "level")


def split_counts(limit: int, explore: float = 0.5) -> tuple[int, int]:
    """(taste, explore): at least one to explore, halves rounded up."""
    n = max(1, int(limit * explore + 0.5)) if explore else 0
    return limit - n, n


def fixed(pool: DataFrame) -> DataFrame:
    """A pool as constant rows ``id, author, corpus``: it has at most the recommender's pool size (1000), so the driver may hold it.

    The reference keeps its pools as arrays of ids for the same reason: later steps must not choose them anew.
    """
    small = pool.select("id", "author", "corpus")
    return pool.sparkSession.createDataFrame(small.collect(), small.schema)


def recommend(
    poems: DataFrame, log: DataFrame, user: int, limit: int = 5, corpora: list[str | None] | None = None, short: bool = True, medium: bool = True, long: bool = True,
    recent: list[str | None] | None = None, force_random: bool | None = False, seed: str = "s", version: Version = CURRENT, line_max: int | None = None,
    index: VectorIndex | None = None,
) -> DataFrame:
    """The next poems for a reader: ``ord, id, title, author, body, line_count, slice``.

    The gate (one number) and the taste (one vector) come to the driver in one job; everything else stays lazy.
    ``force_random`` None counts as False. With an ``index`` of ``id, author, corpus, line_count,
    embedding`` the nearest poems are looked for in the probed cells instead of all poems.
    """
    if user is None:
        raise PermissionError("a reader is needed")
    log = mine = log.where(F.col("user_id") == user)
    wanted = lambda p: p.where(in_buckets(short, medium, long) & in_corpora(corpora) & under_cap(line_max))
    fits = wanted(poems)
    fresh = unseen(fits, log, user)
    taste = None
    if not force_random:
        gate = mine.agg(F.count_distinct(F.when(F.col("action").isin(*POSITIVE), F.col("poem_id"))).alias("n"))
        row = gate.join(taste_vector(poem_weights(mine, version), poems), F.lit(True), "left").first()  # one row beside one at most
        taste = row["taste"] if row["n"] >= version.min_signals else None
    if taste is None:
        pool = fixed(random_pool(fresh if version.exclude_seen_when_cold else fits, f"{seed}:random", version.pool))
        picked = pick_diverse(pool, limit, recent, f"{seed}:random").withColumn("slice", F.lit(0))
        return _shaped(picked, poems)
    near = taste_pool(fresh, taste, version.pool) if index is None else nearest(poems.sparkSession, index, taste, version.pool, lambda p: unseen(wanted(p), log, user))
    if not version.explore:
        return _shaped(near.limit(limit).select("id", F.row_number().over(Window.orderBy("dist", "id")).alias("ord")).withColumn("slice", F.lit(0)), poems)
    taste_n, explore_n = split_counts(limit, version.explore)
    near = fixed(near)
    first = pick_diverse(near, taste_n, recent, f"{seed}:taste")
    authors = [r["author"] for r in first.join(near, "id").select("author").distinct().collect()] if taste_n > 0 else []
    rest = fixed(random_pool(fresh.join(near.select("id"), "id", "left_anti"), f"{seed}:explore", version.pool))
    second = pick_diverse(rest, explore_n, [*(recent or []), *authors], f"{seed}:explore")
    return _shaped(first.where(F.lit(taste_n > 0)).withColumn("slice", F.lit(0)).unionByName(second.withColumn("slice", F.lit(1))), poems)


def _shaped(picked: DataFrame, poems: DataFrame) -> DataFrame:
    out = F.broadcast(picked.select("id", "ord", "slice")).join(poems, "id")
    return out.select(F.row_number().over(Window.orderBy("slice", "ord")).alias("ord"), "id", "title", "author", "body", "line_count", "slice")


def taste_topk(poems: DataFrame, log: DataFrame, user: int, k: int = 20) -> DataFrame:
    """The nearest unseen poems of one reader: ``id, dist``."""
    row = taste_vector(poem_weights(log.where(F.col("user_id") == user)), poems).first()
    if row is None:
        return poems.where("false").select("id", F.lit(0.0).alias("dist"))
    return taste_pool(unseen(poems, log, user), row["taste"], k).select("id", "dist")


def recommend_all(poems: DataFrame, log: DataFrame, k: int = 5, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """For every reader with a taste, the ``k`` nearest unseen poems: ``user_id, id, dist, rank`` (an extension).

    Readers are dealt into blocks of about ``block`` rows, poems into shards of about ``shard``;
    a block meets a shard in one task, which keeps ``k`` rows of a reader, so scores of all pairs are never rows.
    """
    log_ = log.select("user_id", "poem_id").distinct().groupBy("user_id").agg(F.collect_list("poem_id").alias("seen"))
    taste = taste_vector(poem_weights(log), poems).join(log_, "user_id")
    known = poems.where("embedding is not null").select("id", "embedding")
    n_u, n_p = (max(1, -(-d.count() // size)) for d, size in ((log_, block), (known, shard)))
    deal = lambda d, key, n, other, own, copy: d.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    readers, items = deal(taste, "user_id", n_u, n_p, "ub", "pb"), deal(known, "id", n_p, n_u, "pb", "ub")

    def score(u: pa.Table, p: pa.Table) -> pa.Table:
        x = _matrix(p["embedding"])
        return nearest_rows(u["user_id"], u["seen"], k, _matrix(u["taste"]), x, p["id"].to_numpy(), [(0, len(x), None)], undefined=True)

    best = readers.groupBy("ub", "pb").cogroup(items.groupBy("ub", "pb")).applyInArrow(score, "query_id long, id long, dist double").withColumnRenamed("query_id", "user_id")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("dist", "id"))).where(F.col("rank") <= k)


def index_poems(poems: DataFrame, path: str) -> VectorIndex:
    """The index that ``recommend`` and ``recommend_all_indexed`` look poems up in, written to ``path``."""
    return write_index(poems.select("id", "author", "corpus", "line_count", "embedding"), path)


def recommend_all_indexed(index: VectorIndex, poems: DataFrame, log: DataFrame, k: int = 5) -> DataFrame:
    """What ``recommend_all`` finds, from the probed cells of each reader's taste: ``user_id, id, dist, rank``."""
    taste = taste_vector(poem_weights(log), poems).select(F.col("user_id").alias("query_id"), F.col("taste").alias("vector"))
    seen = log.select(F.col("user_id").alias("query_id"), F.col("poem_id").alias("id"))
    return nearest_all(index, taste, k, seen).withColumnRenamed("query_id", "user_id")


def _newest(log: DataFrame, *actions: str) -> DataFrame:
    w = Window.partitionBy("user_id", "poem_id").orderBy(F.desc("created_at"), F.desc("id"))
    return log.where(F.col("action").isin(*actions)).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def library(log: DataFrame, poems: DataFrame) -> DataFrame:
    """Saved poems, newest first by ``pos``: the latest of save and unsave is save. super_like doesn't show here."""
    saved = _newest(log, "save", "unsave").where("action = 'save'")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("interaction_id")))
    return saved.select("user_id", "poem_id", "created_at", F.col("id").alias("interaction_id")).join(poems.select(F.col("id").alias("poem_id"), "title", "author"), "poem_id").select("user_id", pos.alias("pos"), "poem_id", "title", "author", "created_at")


def saved_count(log: DataFrame) -> DataFrame:
    return _newest(log, "save", "unsave").groupBy("user_id").agg(F.count_if(F.col("action") == "save").alias("n_saved"))


def skipped(log: DataFrame, respect_undislike: bool = False) -> DataFrame:
    """Disliked poems by their latest dislike; taking it back doesn't count unless asked for."""
    if respect_undislike:
        return _newest(log, "dislike", "undislike").where("action = 'dislike'").select("user_id", "poem_id", F.col("created_at").alias("skipped_at"))
    return log.where("action = 'dislike'").groupBy("user_id", "poem_id").agg(F.max("created_at").alias("skipped_at"))


def by_ids(poems: DataFrame, ids: list) -> DataFrame:
    """Poems in the order of a list of ids; unknown ids drop out."""
    order = poems.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "ord int, id long")
    return poems.join(F.broadcast(order), "id").select("ord", "id", "title", "author")


def corpora(poems: DataFrame) -> DataFrame:
    """One row: the sorted corpus names, then the sentinel if any poem has none."""
    return poems.agg(F.concat(F.sort_array(F.collect_set("corpus")), F.when(F.bool_or(F.col("corpus").isNull()), F.array(F.lit(NULL_CORPUS))).otherwise(F.array().cast("array<string>"))).alias("corpora"))


def corpus_filter_form(checked: list[str], known: list[str]) -> list[str]:
    """All checked is the same as no filter."""
    return [] if set(checked) == set(known) else [c for c in known if c in checked]


def toggle(state: dict[str, bool], what: str) -> tuple[dict[str, bool], list[str]]:
    """A reader's tap as log rows: like and dislike exclude each other."""
    on = {"like": "liked", "dislike": "disliked", "save": "saved"}[what]
    undo = {"like": "unlike", "dislike": "undislike", "save": "unsave"}
    new, rows = dict(state), []
    new[on] = not state.get(on, False)
    other = {"like": "dislike", "dislike": "like"}.get(what)
    if new[on] and other and state.get({"like": "liked", "dislike": "disliked"}[other], False):
        new[{"like": "liked", "dislike": "disliked"}[other]] = False
        rows.append(undo[other])
    return new, [*rows, what if new[on] else undo[what]]


def toggle_rows(taps: DataFrame) -> DataFrame:
    """The log rows that readers' taps make, ``user_id, poem_id, created_at, id, n, action``, for ``taps(id, user_id, poem_id, what, created_at)``.

    ``what`` is like, dislike or save. A tap turns its state on or off; like and dislike
    exclude each other, so a like on a disliked poem makes two rows, n 0 (undislike) and 1
    (like). Within a stretch of equal taps on a poem the state is on after every odd one,
    as the stretch before it was of the other kind: two windows tell every state, no row
    waits for the one before. Taps at one time go by id; nulls in ``what`` aren't taps.
    """
    taps = taps.where(F.col("what").isin("like", "dislike", "save")).withColumn("_kind", F.col("what") == "save")
    by = Window.partitionBy("user_id", "poem_id", "_kind").orderBy("created_at", "id")
    fresh = taps.withColumn("_fresh", ~F.col("what").eqNullSafe(F.lag("what").over(by))).withColumn("_stretch", F.sum(F.col("_fresh").cast("int")).over(by))
    on = fresh.withColumn("_on", F.row_number().over(Window.partitionBy("user_id", "poem_id", "_kind", "_stretch").orderBy("created_at", "id")) % 2 == 1)
    both = on.withColumn("_other", F.when(F.col("_fresh") & F.lag("_on").over(by), F.lag("what").over(by)))
    undo = lambda c: F.concat(F.lit("un"), F.col(c))
    rows = F.array(F.when(F.col("_other").isNotNull(), F.struct(F.lit(0).alias("n"), undo("_other").alias("action"))), F.struct(F.lit(1).alias("n"), F.when(F.col("_on"), F.col("what")).otherwise(undo("what")).alias("action")))
    return both.select("user_id", "poem_id", "created_at", "id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def nudge(n: Column) -> Column:
    """Which reminder to sign up a count of saved poems brings."""
    return F.when(n >= 10, 3).when(n >= 5, 2).when(n >= 1, 1).otherwise(0)


def recent_authors(log: DataFrame, poems: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` authors shown to each reader, newest first."""
    shown = log.join(poems.select(F.col("id").alias("poem_id"), "author"), "poem_id")
    last = shown.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("k") <= n)
    return last.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "author"))), lambda s: s["author"]).alias("authors"))


def migrate_reader(log: DataFrame, old: int, new: int) -> DataFrame:
    """All rows of one reader go to another, times unchanged; the same reader or a null changes nothing."""
    if old is None or new is None or old == new:
        return log
    return log.withColumn("user_id", F.when(F.col("user_id") == old, F.lit(new)).otherwise(F.col("user_id")))


def unskip(log: DataFrame, user: int, poem: int) -> DataFrame:
    """Without a reader's own non-positive rows of a poem."""
    gone = (F.col("user_id") == user) & (F.col("poem_id") == poem) & ~F.col("action").isin(*POSITIVE)
    return log.where(~F.coalesce(gone, F.lit(False)))
