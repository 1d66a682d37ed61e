"""Profiles, filters, cleaning and selection of a corpus."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stanzaflow.functions import similarity as S
from stanzaflow.functions import text as T
from stanzaflow.operators.dedup import near_dup_longest


def length_profile(rows: DataFrame) -> DataFrame:
    """How many texts have which length: ``label, n``."""
    return rows.groupBy(T.length_label(F.col("body")).alias("label")).agg(F.count("*").alias("n"))


def length_stats(rows: DataFrame) -> DataFrame:
    n = F.length("body")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.median(n), 6).alias("median"), F.round(F.stddev_samp(n), 4).alias("stdev"), F.min(n).alias("least"), F.max(n).alias("most"))


def quality_issues(rows: DataFrame) -> DataFrame:
    """Counts by rule: ``issue, n``. ``rows(body, title, author)``."""
    blank = lambda c: F.col(c).isNull() | F.col(c).rlike(T.BLANK)
    rules = {"empty_text": blank("body"), "missing_title": blank("title"), "missing_author": blank("author"), "control_chars": T.has_control_chars(F.col("body")), "possible_prose": T.looks_like_prose(F.col("body"))}
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in rules])).alias("r")).select("r.*")


def first_seen(rows: DataFrame, *key: str, rid: str = "rid") -> DataFrame:
    """Rows that repeat a key, with the row that had it first: ``rid, first_rid``."""
    first = F.min(rid).over(Window.partitionBy(*key))
    return rows.select(F.col(rid).alias("rid"), first.alias("first_rid")).where("rid <> first_rid")


def top_values(rows: DataFrame, column: str, n: int, rid: str = "rid") -> DataFrame:
    """The ``n`` most frequent values; ties keep the order of first occurrence."""
    g = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(rid).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(n).select(F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("rank"), column, "n")


def source_pivot(rows: DataFrame, column: str, source: str, sources: list[str]) -> DataFrame:
    """Counts of each value by source, one column each, and their sum."""
    return rows.groupBy(column).agg(F.count("*").alias("total"), *[F.count_if(F.col(source) == s).alias(s) for s in sources])


def line_score(n: Column) -> Column:
    return F.when(n < 5, 0).when(n < 10, 1).when(n <= 35, 3).when(n <= 45, 2).otherwise(1)


def char_score(n: Column) -> Column:
    return F.when(n < 150, 0).when(n < 400, 1).when(n < 2000, 3).when(n < 5000, 2).otherwise(1)


def cap_per_author(rows: DataFrame, cap: int = 20, exact: Column | None = None, score: Column | None = None, dropped: tuple[str, ...] = ()) -> DataFrame:
    """The best ``cap`` rows of an author: exact title matches, match score, line and character scores, then input order."""
    order = [] if exact is None else [F.when(exact, 0).otherwise(1)]
    order += [] if score is None else [-score]
    order += [-line_score(F.col("line_count")), -char_score(F.length("body")), F.col("rid")]
    kept = rows.where(~F.col("author").isin(*dropped)) if dropped else rows
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("author").orderBy(*order))).where(F.col("k") <= cap)


#: Different titles of a tile: a pair of tiles is one task's work.
TITLES = 4096


def _best_titles(titles: DataFrame, listed: DataFrame) -> DataFrame:
    """``author, _t, score, exact`` for ``titles(author, _t)``: the best token-sort ratio with one of ``listed(author, _l)``, and whether one is the same.

    Different titles of an author meet in tiles, so that there is no row for each pair.
    """
    a, b = titles.select("author", F.col("_t").alias("s")).where("author is not null and s is not null").distinct(), listed.select("author", F.col("_l").alias("s")).where("author is not null and s is not null").distinct()
    parts = lambda d, name: d.groupBy("author").agg(F.ceil(F.count("*") / TITLES).cast("int").alias(name))
    grid = parts(a, "n_a").join(parts(b, "n_b"), "author")
    mine = lambda n: F.pmod(F.xxhash64("s"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(grid, "author").withColumn("ta", mine("n_a")).withColumn("tb", all_("n_b")).withColumn("side", F.lit(0))
    right = b.join(grid, "author").withColumn("tb", mine("n_b")).withColumn("ta", all_("n_a")).withColumn("side", F.lit(1))
    kind = titles.schema["author"].dataType

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        own, other = (table.filter(pc.equal(table["side"], i))["s"].to_pylist() for i in (0, 1))
        own = own if other else []
        same = set(other)
        return pa.table({"author": pa.array([key[0].as_py()] * len(own), key[0].type), "_t": pa.array(own, pa.string()), "score": pa.array(S.best_token_sort(own, other) if own else [], pa.float64()), "exact": pa.array([s in same for s in own], pa.bool_())})

    cells = left.unionByName(right).select("author", "ta", "tb", "side", "s").groupBy("author", "ta", "tb")
    found = cells.applyInArrow(compare, f"author {kind.simpleString()}, _t string, score double, exact boolean")
    return found.groupBy("author", "_t").agg(F.max("score").alias("score"), F.bool_or("exact").alias("exact"))


def title_matches(rows: DataFrame, titles: DataFrame, least: float = 85.0) -> DataFrame:
    """``rid, score``: the best token-sort ratio of a row's title among its author's listed titles, from ``least`` on. ``titles(author, listed)``."""
    p = rows.select("rid", "author", T.match_title(F.col("title")).alias("_t"))
    best = _best_titles(p, titles.select("author", T.match_title(F.col("listed")).alias("_l")))
    return p.join(best.where(F.col("score") >= least), ["author", "_t"]).groupBy("rid").agg(F.max("score").alias("score"))


def clean_a(rows: DataFrame) -> DataFrame:
    """The first cleaning chain: required fields, title marks, editor lines, plain marks, prose; near duplicates are a step of their own."""
    full = rows.where(T.nonempty(F.col("title")).isNotNull() & T.nonempty(F.col("author")).isNotNull() & T.nonempty(F.col("body")).isNotNull())
    fixed = full.withColumn("title", T.clean_title(F.col("title"))).withColumn("body", T.plain_marks(T.drop_editor_line(F.col("body"))))
    return fixed.where(~T.prose_block(F.col("body")))


def clean_first(rows: DataFrame) -> DataFrame:
    """Every row with what the first cleaning chain makes of it, kept ones and removed ones.

    ``rows(rid, title, author, body, ...)``, rid unique; title and body become the cleaned
    ones (as they were, where a field is missing), ``changes`` names the steps that altered a
    row, ``removed`` why it goes: missing (a field is null or blank), duplicate (the first 200
    characters of a cleaned text agree with a longer one's, or an earlier one's as long),
    prose; null for rows that stay. A row that goes as prose still is what others duplicate.
    """
    missing = T.nonempty(F.col("title")).isNull() | T.nonempty(F.col("author")).isNull() | T.nonempty(F.col("body")).isNull()
    steps = (("editor", "body", T.drop_editor_line(F.col("body"))), ("marks", "body", T.plain_marks(F.col("body"))), ("footnote", "title", T.clean_title(F.col("title"))))
    out = rows.withColumn("_missing", missing).withColumn("changes", F.array().cast("array<string>"))
    for name, column, new in steps:
        out = out.withColumn("_new", F.when(F.col("_missing"), F.col(column)).otherwise(new))
        out = out.withColumn("changes", F.when(F.col(column).eqNullSafe(F.col("_new")), F.col("changes")).otherwise(F.array_append("changes", F.lit(name)))).withColumn(column, F.col("_new")).drop("_new")
    best = near_dup_longest(out.where(~F.col("_missing")).select("rid", "body")).select("rid", F.lit(True).alias("_best"))
    why = F.when(F.col("_missing"), "missing").when(F.col("_best").isNull(), "duplicate").when(T.prose_block(F.col("body")), "prose")
    return out.join(best, "rid", "left").withColumn("removed", why).select(*rows.columns, "changes", "removed")


def finalise(rows: DataFrame, listed: DataFrame, overrides: DataFrame | None = None, dropped: tuple[str, ...] = (), cap: int = 20, least: float = 85.0) -> DataFrame:
    """The selection: the best ``cap`` rows of an author among those whose title is one of the author's listed ones.

    ``rows(rid, author, title, body, line_count)``; ``listed(author, listed)`` and
    ``overrides`` with the same columns, whose titles replace all that are listed of an
    author; authors ``dropped`` have none. Adds ``score`` (the best token-sort ratio, from
    ``least`` on), ``exact``, the place ``k`` and ``n_matched``, how many rows of the author
    matched. Each different title of an author is compared once, however many rows have it.
    """
    titles = listed.select("author", "listed")
    if overrides is not None:
        titles = titles.join(overrides.select("author").distinct(), "author", "left_anti").unionByName(overrides.select("author", "listed"))
    if dropped:
        titles = titles.where(~F.col("author").isin(*dropped))
    titles = titles.select("author", T.match_title(F.col("listed")).alias("_l")).distinct()
    made = rows.withColumn("_t", T.match_title(F.col("title")))
    best = _best_titles(made, titles)
    matched = made.join(best.where(F.col("score") >= least), ["author", "_t"]).drop("_t")
    total = matched.groupBy("author").agg(F.count("*").alias("n_matched"))
    kept = cap_per_author(matched, cap, F.col("exact"), F.col("score"))
    return kept.join(total, "author").select(*rows.columns, "score", "exact", "k", "n_matched")


def clean_b(rows: DataFrame) -> DataFrame:
    """The second chain with a log: ``changes`` names the rules that altered a text. ``rows(source, body, ...)``."""
    pod, daily = F.col("source") == "podcast", F.col("source") == "daily"
    steps = (
        ("encoding", F.when(T.needs_charset_repair(F.col("body")), T.repair_charset(F.col("body"))).otherwise(F.col("body"))),
        ("byline", F.when(pod, T.strip_byline(F.col("body"))).otherwise(F.col("body"))),
        ("copyright", F.when(pod, T.strip_copyright_tail(F.col("body"))).otherwise(F.col("body"))),
        ("memorial", F.when(daily, T.strip_memorial(F.col("body"))).otherwise(F.col("body"))),
        ("nbsp", F.translate("body", "\xa0", " ")),
    )
    out = rows.withColumn("changes", F.array().cast("array<string>"))
    for name, new in steps:
        out = out.withColumn("_new", new).withColumn("changes", F.when(~F.col("body").eqNullSafe(F.col("_new")), F.array_append("changes", F.lit(name))).otherwise(F.col("changes"))).withColumn("body", F.col("_new")).drop("_new")
    return out.withColumn("epigraph", F.when(pod, T.leading_epigraph(F.col("body"))))


def bilingual_decisions(rows: DataFrame) -> DataFrame:
    """What to keep of each group of ``rows(group_id, url, title, translator, body)``: ``url, drop_all, keep_title, keep_translator``.

    No credited translation drops the group; one that reads as English stays; one that doesn't
    gives way to the uncredited text; several decide nothing.
    """
    credited = F.coalesce(F.col("translator"), F.lit("")).startswith("Translated by")
    r = rows.withColumn("grp", F.regexp_replace("group_id", "-[^-]*$", "")).withColumn("c", credited).withColumn("eng", T.likely_english(F.col("body")))
    row = F.struct("title", "translator", "eng")
    g = r.groupBy("grp").agg(F.min_by("url", "group_id").alias("url"), F.count_if("c").alias("n"), F.min_by(F.when(F.col("c"), row), F.when(F.col("c"), F.col("group_id"))).alias("cr"), F.min_by(F.when(~F.col("c"), row), F.when(~F.col("c"), F.col("group_id"))).alias("un"))
    g = g.where("n < 2")
    english = (F.col("n") == 1) & F.col("cr.eng")
    original = (F.col("n") == 1) & ~F.col("cr.eng") & F.col("un").isNotNull()
    return g.select("url", (~F.coalesce(english | original, F.lit(False))).alias("drop_all"), F.when(english, F.coalesce("cr.title", F.lit(""))).when(original, F.coalesce("un.title", F.lit(""))).alias("keep_title"), F.when(english, F.col("cr.translator")).when(original, "").alias("keep_translator"))


def bilingual_filter(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows that the decisions of their url leave."""
    d = decisions.select(F.col("url").alias("_u"), "drop_all", "keep_title", "keep_translator")
    same = (F.col("title") == F.col("keep_title")) & (T.bare_translator(F.col("translator")) == T.bare_translator(F.col("keep_translator")))
    stays = F.col("_u").isNull() | (~F.col("drop_all") & same)
    return rows.join(d, F.col("url") == F.col("_u"), "left").where(F.coalesce(stays, F.lit(False))).drop("_u", "drop_all", "keep_title", "keep_translator")


def pattern_hits(texts: DataFrame, patterns: DataFrame, context: int = 20, rid: str = "id", body: str = "body", most: int = 1_000) -> DataFrame:
    """How often each of many patterns occurs in each text, and where first: ``rid, pattern_id, n, at, before``.

    ``patterns(pattern_id, pattern)`` are plain strings, a list of at most ``most`` (more are
    an error); ``at`` counts characters from 1, ``before`` is the context of the first hit.
    The patterns become one alternation, the longest first, so one pass over a text finds
    the hits of all, from left to right and without overlaps; a text without any has no row. Ids are unique.
    """
    import re

    listed = patterns.where("pattern <> ''").select("pattern_id", "pattern").limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} patterns")
    if not listed:
        return texts.select(rid, F.lit(None).cast(patterns.schema["pattern_id"].dataType).alias("pattern_id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"), F.lit("").alias("before")).where("false")
    quote = lambda p: re.sub(r"([^\w\s])", r"\\\1", p)
    words = "|".join(quote(p) for p in sorted({r["pattern"] for r in listed}, key=lambda p: (-len(p), p)))
    pieces = texts.where(F.col(body).rlike(words)).select(rid, body, F.regexp_extract_all(body, F.lit(f"({words})"), F.lit(1)).alias("_hits"), F.split(body, words, -1).alias("_parts"))
    steps = F.arrays_zip(F.col("_hits").alias("hit"), F.slice("_parts", F.lit(1), F.size("_hits")).alias("part"))
    each = pieces.select(rid, F.posexplode(F.transform(steps, lambda e: F.struct(e["hit"].alias("hit"), F.length(e["part"]).alias("skip"))))).select(rid, "pos", "col.*")
    upto = F.sum(F.col("skip") + F.length("hit")).over(Window.partitionBy(rid).orderBy("pos"))
    first = each.withColumn("at", (upto - F.length("hit") + 1).cast("int")).groupBy(rid, "hit").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    names = patterns.sparkSession.createDataFrame(listed, patterns.select("pattern_id", "pattern").schema)
    found = first.join(F.broadcast(names), F.col("hit") == F.col("pattern")).join(texts.select(rid, body), rid)  # names is the bounded list
    start = F.greatest(F.lit(1), F.col("at") - context)
    return found.select(rid, "pattern_id", "n", "at", F.substring(body, start, F.col("at") - start + F.length("hit") + context).alias("before"))
