"""Requests to and results of outside scorers, and loading with completeness gates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stanzaflow.functions import text as T
from stanzaflow.sources import tables

RESULT = "struct<custom_id:string,response:struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>,data:array<struct<embedding:array<double>>>>>>"
RUBRIC = "struct<mood:int,emotional_intensity:int,imagery:int,accessibility:int,formality:int,summary:string>"
SCORES = ("mood", "emotional_intensity", "imagery", "accessibility", "formality")


def chat_request(id_: Column, prompt: Column, model: str) -> Column:
    """A request line for a batch chat service."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(id_.alias("custom_id"), F.lit("POST").alias("method"), F.struct(F.lit(model).alias("model"), F.array(message).alias("messages")).alias("body")))


def embedding_request(id_: Column, text: Column, model: str) -> Column:
    return F.to_json(F.struct(id_.alias("custom_id"), F.lit("POST").alias("method"), F.struct(F.lit(model).alias("model"), text.alias("input")).alias("body")))


def parse_results(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """``custom_id, status, content, embedding, ord``; the line of an id that comes last counts. Broken lines drop out.

    Give ``order`` wherever lines are read from more than one file or split: without it a
    line's place in the scan counts, which depends on how the files are split.
    """
    r = lines.select(F.from_json(value, RESULT).alias("r"), F.col(order).alias("ord") if order else F.monotonically_increasing_id().alias("ord")).where("r.custom_id is not null")
    r = r.select("r.custom_id", F.col("r.response.status_code").alias("status"), F.get(F.col("r.response.body.choices"), F.lit(0))["message"]["content"].alias("content"), F.get(F.col("r.response.body.data"), F.lit(0))["embedding"].alias("embedding"), "ord")
    last = F.max_by(F.struct("status", "content", "embedding", "ord"), "ord").alias("x")
    return r.groupBy("custom_id").agg(last).select("custom_id", "x.*")


def result_line(id_: Column, content: Column, error: Column | None = None) -> Column:
    """A result as its line: status 200 and the content, or 500 and the error where there is one."""
    failed = F.lit(None).cast("string") if error is None else error
    body = F.struct(F.when(failed.isNull(), F.array(F.struct(F.struct(content.alias("content")).alias("message")))).alias("choices"), failed.alias("error"))
    return F.to_json(F.struct(id_.alias("custom_id"), F.struct(F.when(failed.isNull(), 200).otherwise(500).alias("status_code"), body.alias("body")).alias("response")))


def succeeded(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """What a broken run has: the lines with status 200 (errors and broken lines are purged), and their distinct ids."""
    r = lines.withColumn("_r", F.from_json(F.trim(value), RESULT)).where("_r.response.status_code = 200 and _r.custom_id is not null")
    return r.drop("_r"), r.select("_r.custom_id").distinct()


def chunk_states(chunks: DataFrame, events: DataFrame) -> DataFrame:
    """What to do with each batch chunk: ``chunk, state, next``.

    ``chunks(chunk)``, ``events(chunk, seq, state)`` with states submitted, running,
    completed, failed, downloaded. The last event counts; a chunk without one is pending.
    Next is poll for one in flight, download for a completed one, submit for the first
    pending or failed one while none is in flight, else wait or, after the download, done.
    """
    last = events.groupBy("chunk").agg(F.max_by("state", "seq").alias("state"))
    s = chunks.join(last, "chunk", "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    flight, open_ = F.col("state").isin("submitted", "running"), F.col("state").isin("pending", "failed")
    front = s.agg(F.coalesce(F.max(flight.cast("int")), F.lit(0)).alias("busy"), F.min(F.when(open_, F.col("chunk"))).alias("first"))
    step = F.when(flight, "poll").when(F.col("state") == "completed", "download").when(F.col("state") == "downloaded", "done").when((F.col("busy") == 0) & (F.col("chunk") == F.col("first")), "submit").otherwise("wait")
    return s.join(F.broadcast(front), F.lit(True)).select("chunk", "state", step.alias("next"))


def lookups(rows: DataFrame, *guesses: Column, most: int = 8) -> DataFrame:
    """``id, ord, guess``: the distinct non-empty guesses of a row in the order given, ``most`` at most."""
    made = F.array_distinct(F.filter(F.array(*[T.collapse(F.coalesce(g, F.lit(""))) for g in guesses]), lambda x: x != ""))
    return rows.select("id", F.posexplode(F.slice(made, 1, most)).alias("ord", "guess"))


def back_off(attempt: int, limited: bool) -> float:
    """Seconds before the next attempt: 30 for each attempt where the service limits the rate, else doubled each time."""
    return 30.0 * attempt if limited else 2.0**attempt


def rubric(content: Column) -> Column:
    """The inner JSON as a struct, or null."""
    return F.from_json(content, RUBRIC)


def rubric_error(status: Column, content: Column) -> Column:
    """Why a result is no rubric: status, empty, parse, missing field, range; null if it is one."""
    r = rubric(content)
    lacks = F.reduce(F.array(*[r[s].isNull() for s in SCORES]), F.lit(False), lambda a, x: a | x)
    wide = F.reduce(F.array(*[~r[s].between(0, 10) for s in SCORES]), F.lit(False), lambda a, x: a | F.coalesce(x, F.lit(False)))
    return F.when(status.isNull() | (status != 200), "status").when(content.isNull() | (F.trim(content) == ""), "empty").when(r.isNull() | F.coalesce(F.try_parse_json(content).isNull(), F.lit(True)), "parse").when(lacks, "missing").when(wide, "range")


def join_results(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rows with the content of their successful result, null where none."""
    good = results.where("status = 200").select(F.col("custom_id").alias(key), "content", "embedding")
    return rows.join(good, key, "left")


def merge_results(rows: DataFrame, scores: DataFrame, vectors: DataFrame, key: str = "id", width: int | None = None) -> DataFrame:
    """Rows with ``rubric, summary, embedding`` from parsed results, and why one is lacking.

    ``scores`` and ``vectors`` come from ``parse_results``. ``score_error`` is absent, status,
    empty or parse, then rubric and summary are null; or missing or range, then they hold what
    the result says. ``vector_error`` is absent, status or, for vectors of another length than
    ``width``, width; the vector is null for the first two. Both are null where all is well.
    """
    s = scores.select(F.col("custom_id").alias(key), F.struct("status", "content").alias("_s"))
    v = vectors.select(F.col("custom_id").alias(key), F.struct(F.col("status"), F.col("embedding").alias("vector")).alias("_v"))
    why = F.when(F.col("_s").isNull(), "absent").otherwise(rubric_error(F.col("_s.status"), F.col("_s.content")))
    said = F.when(F.col("score_error").isNull() | F.col("score_error").isin("missing", "range"), rubric(F.col("_s.content")))
    failed = F.col("_v.status").isNull() | (F.col("_v.status") != 200) | F.col("_v.vector").isNull()
    odd = F.lit(False) if width is None else F.size("_v.vector") != width
    wrong = F.when(F.col("_v").isNull(), "absent").when(failed, "status").when(odd, "width")
    out = rows.join(s, key, "left").join(v, key, "left").withColumn("score_error", why).withColumn("vector_error", wrong).withColumn("_r", said)
    rubric_of = F.when(F.col("_r").isNotNull(), F.struct(*[F.col(f"_r.{c}").alias(c) for c in SCORES]))
    summary = F.when(F.col("_r").isNotNull(), F.coalesce("_r.summary", F.lit("")))
    vector = F.when(F.coalesce(F.col("vector_error"), F.lit("")).isin("", "width"), F.col("_v.vector"))
    return out.select(*rows.columns, rubric_of.alias("rubric"), summary.alias("summary"), vector.alias("embedding"), "score_error", "vector_error")


#: The names that title, author, text and corpus have in the three kinds of records that a table is loaded from.
RECORDS = {"plain": ("Title", "Author", "text", None), "sourced": ("title", "author", "poem_text", "primary_source"), "scored": ("title", "author", "body", "corpus")}


def table_rows(rows: DataFrame, kind: str, at: Column | None = None) -> DataFrame:
    """Rows of the poems table from records of one of the kinds ``RECORDS``, with their ``id``.

    Plain records have no results yet. Sourced and scored ones bring ``rubric, summary,
    embedding``; a blank summary or corpus is null, a sourced record's corpus is trimmed and in
    lower case, its translator '' where blank; only sourced records name translators.
    """
    title, author, body, corpus = RECORDS[kind]
    out = [F.col("id"), F.col(title).alias("title"), F.col(author).alias("author"), F.col(body).alias("body"), T.line_count(F.coalesce(body, F.lit(""))).alias("line_count")]
    if kind == "plain":
        return rows.select(*out)
    name = T.nonempty(F.lower(F.col(corpus)) if kind == "sourced" else F.col(corpus))
    translator = F.coalesce(T.nonempty(F.col("translator")), F.lit("")) if kind == "sourced" else F.lit("")
    out += [F.col("embedding"), name.alias("corpus"), translator.alias("translator"), T.nonempty(F.col("summary")).alias("summary")]
    return rows.select(*out, *[F.col(f"rubric.{c}").alias(c) for c in SCORES], (F.current_timestamp() if at is None else at).alias("enriched_at"))


def load_batch(table: DataFrame, merged: DataFrame, order: str, again: bool = False, at: Column | None = None) -> DataFrame:
    """The table with a scored batch (``merge_results``) added, if no row of it lacks its score or its vector.

    Ids go on from the table's largest number in the order given. ``again`` finishes a load
    that broke off after its last row was written: the batch's ids then end at the largest
    number, and only rows whose id isn't there are added. A batch that lacks a result is an error.
    """
    n = merged.agg(F.count("*").alias("n"), F.count_if(F.col("rubric").isNull()).alias("scores"), F.count_if(F.col("embedding").isNull()).alias("vectors")).first()
    lacking = {what: n[what] for what in ("scores", "vectors") if n[what]}
    if lacking:
        raise ValueError("incomplete: " + ", ".join(f"{k} {what} are missing" for what, k in lacking.items()))
    base = table.agg((F.coalesce(F.max(tables.numeric_suffix(F.col("id"))), F.lit(0)) - (n["n"] if again else 0)).alias("_base"))
    numbered = tables.numbered_rows(merged, order, "_i").join(F.broadcast(base), F.lit(True))  # one row
    batch = table_rows(numbered.withColumn("id", T.padded_id(F.col("_base") + F.col("_i"))), "scored", at)
    return tables.insert_ignore(table, batch.select(*table.columns))


def completeness(rows: DataFrame, **parts: tuple[DataFrame, str]) -> DataFrame:
    """``part, n_missing``: rows of ``rows(id)`` without a row in each part ``(table, key)``."""
    out = None
    for name, (part, key) in parts.items():
        gone = rows.join(part.select(F.col(key).alias("id")).distinct(), "id", "left_anti").agg(F.lit(name).alias("part"), F.count("*").alias("n_missing"))
        out = gone if out is None else out.unionByName(gone)
    return out


def require_complete(report: DataFrame) -> None:
    """Raises if a part is missing for any row."""
    bad = report.where("n_missing > 0").collect()
    if bad:
        raise ValueError("incomplete: " + ", ".join(f"{r['part']} lacks {r['n_missing']}" for r in bad))


def verify_results(results: DataFrame, width: int) -> DataFrame:
    """Counts of successes, errors and vectors of a wrong length."""
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("status") == 200).alias("ok"), F.count_if(~(F.coalesce("status", F.lit(0)) == 200)).alias("errors"), F.count_if(F.size("embedding") != width).alias("wrong_width"))


def cost(rows: DataFrame, tokens_in: str, tokens_out: str, price_in: float = 1.0, price_out: float = 4.0) -> DataFrame:
    """Tokens and their price, given for a million."""
    a, b = F.sum(tokens_in), F.sum(tokens_out)
    return rows.agg(a.alias("tokens_in"), b.alias("tokens_out"), F.round(a * price_in / 1e6 + b * price_out / 1e6, 6).alias("price"))


def call_each(rows: DataFrame, client: Callable[[str], str], key: str, prompt: str, attempts: int = 8, wait: Callable[[int], None] | None = None, at_once: int = 1) -> DataFrame:
    """One request for each row by an injected client, tried again on errors: ``key, ok, result, attempts``.

    A task has ``at_once`` requests open at most. Between attempts it waits as ``wait`` says,
    or by ``back_off``: longer where the error's ``status_code`` is 429.
    """

    def one(k, p):
        for n in range(1, attempts + 1):
            try:
                return k, True, client(p), n
            except Exception as e:  # any failure of an outside service counts as one attempt
                said = (k, False, str(e), n)
                if n < attempts:
                    (wait or (lambda n, e=e: time.sleep(back_off(n, getattr(e, "status_code", None) == 429))))(n)
        return said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(one, b[key], b[prompt])), columns=[key, "ok", "result", "attempts"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, ok boolean, result string, attempts int")


def fresh(at: Column, now: Column, hours: int = 1) -> Column:
    return now - at < F.expr(f"interval {hours} hours")


def in_range(*columns: str, least: int = 0, most: int = 10) -> Column:
    """All values are null or within the bounds."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c).between(least, most), F.lit(True))
    return ok


def latest_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
