"""Repairs as plans: a table of proposed changes, and a separate step that applies the safe ones."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.functions.text import _fold
from stanzaflow.operators import dedup


def _flat(body: str) -> list[str]:
    return [x.strip() for x in body.split("\n") if x.strip()]


def breaks_after(body: str) -> list[int]:
    """Numbers of the non-blank lines that a blank line follows."""
    out, number = [], -1
    for line in body.split("\n"):
        if line.strip():
            number += 1
        elif number >= 0 and out[-1:] != [number]:
            out.append(number)
    return out


def aligned(theirs: list[str], ours: list[str]) -> dict[int, int]:
    """Our line number by theirs, for the folded lines that an alignment finds equal."""
    a, b = ([_fold(x, "NFKD") for x in lines] for lines in (theirs, ours))
    if a == b and len(b) < 200:  # from 200 lines on difflib leaves frequent lines out
        return {i: i for i in range(len(a))}
    runs = difflib.SequenceMatcher(a=a, b=b).get_matching_blocks()
    return {r.a + i: r.b + i for r in runs for i in range(r.size)}


def transplant(stored: str, fetched: str, least_equal: float = 0.4) -> tuple[str | None, list[str]]:
    """The stored lines with the stanza breaks of the fetched text, or None, and warnings.

    A break moves only if the line before it, or else the line after it, is one that an
    alignment of the folded lines finds equal. Lines never change.
    """
    ours, theirs = _flat(stored), _flat(fetched)
    apart = abs(len(ours) - len(theirs))
    if apart > 1:
        return None, [f"{len(ours)} lines here, {len(theirs)} there"]
    place = aligned(theirs, ours)
    share = len(place) / max(1, len(theirs))
    if not apart and share < least_equal:
        return None, [f"{share:.0%} of the lines are equal"]
    # the line of ours before each of their breaks: by the line before it, else by the one after
    moved = [place.get(k, place.get(k + 1, 0) - 1) for k in breaks_after(fetched)]
    found = {k for k in moved if 0 <= k <= len(ours) - 2}
    lost = sum(k < 0 for k in moved)
    notes = [f"one line more or less, {share:.0%} of the lines are equal"] * apart + [f"{lost} breaks without a place"] * (lost > 0)
    if not found:
        return None, [*notes, "no break to move"]
    return "".join(line + ("" if k + 1 == len(ours) else "\n\n" if k in found else "\n") for k, line in enumerate(ours)), notes


def stanza_plan(rows: DataFrame) -> DataFrame:
    """A plan for ``rows(id, stored, fetched, grade)``: strict matches take the fetched text, near ones its breaks.

    Returns ``id, path, new_body, warnings, flags, skipped``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, stored, fetched, grade in zip(b["id"], b["stored"], b["fetched"], b["grade"]):
                path = {"strict": "overwrite", "near": "transplant"}.get(grade, "none")
                new, notes = None, []
                if path == "overwrite":
                    new = re.sub(r"\n{3,}", "\n\n", fetched.strip())
                    if len(_flat(new)) != len(_flat(stored)):
                        notes.append("line count drift")
                elif path == "transplant":
                    new, notes = transplant(stored, fetched)
                flags = []
                if new is not None:
                    n, stanzas = len(_flat(new)), len(re.findall(r"\n\n", new)) + 1
                    flags += ["line-count"] if abs(n - len(_flat(stored))) > 1 else []
                    flags += ["every-line"] if n > 3 and stanzas >= n else []
                out.append((i, path, new, notes, flags, new is None))
            yield pd.DataFrame(out, columns=["id", "path", "new_body", "warnings", "flags", "skipped"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "stored", "fetched", "grade").mapInPandas(run, f"id {kind}, path string, new_body string, warnings array<string>, flags array<string>, skipped boolean")


def apply_plan(poems: DataFrame, plan: DataFrame) -> DataFrame:
    """Poems with the unflagged new bodies; the line count follows the body."""
    safe = plan.where("not skipped and size(flags) = 0 and new_body is not null").select("id", "new_body")
    body = F.coalesce("new_body", "body")
    return poems.join(safe, "id", "left").withColumn("line_count", F.when(F.col("new_body").isNotNull(), T.line_count(body)).otherwise(F.col("line_count"))).withColumn("body", body).drop("new_body")


def _keys() -> list[Column]:
    """Author and body as they are compared; bodies by their SHA-256, so that no body is shuffled."""
    return [T.author_key(F.col("author")).alias("ak"), F.unhex(F.sha2(T.body_key(F.col("body")), 256)).alias("bk")]


def backfill(poems: DataFrame, parsed: DataFrame) -> DataFrame:
    """Markup for poems by author and body: ``id, html, status`` (one, none, ambiguous, conflict).

    ``poems(id, author, body)``, ``parsed(author, body, html, source)``; a poem that is given
    different markup by different sources gets none.
    """
    key = _keys()
    p = poems.select("id", *key)
    many = p.groupBy("ak", "bk").agg(F.count("*").alias("n_poems"))
    g = parsed.select(*key, "html").groupBy("ak", "bk").agg(F.count_distinct("html").alias("n_html"), F.min("html").alias("html"))
    status = F.when(F.col("n_html").isNull(), "none").when(F.col("n_poems") > 1, "ambiguous").when(F.col("n_html") > 1, "conflict").otherwise("one")
    return p.join(many, ["ak", "bk"]).join(g, ["ak", "bk"], "left").select("id", F.when(status == "one", F.col("html")).alias("html"), status.alias("status"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt that counts for each poem: the first strict one, else the near one of the largest ratio, else any of the largest ratio; ties go to the earlier.

    ``attempts(id, source_ord, grade, ratio)``, and ``ord`` where a source is tried more than once; other columns are kept.
    """
    rank = F.when(F.col("grade") == "strict", 2).when(F.col("grade") == "near", 1).otherwise(0)
    place = [-F.col(c) for c in ("source_ord", "ord") if c in attempts.columns]
    ratio = F.when(rank == 2, 0.0).otherwise(F.coalesce("ratio", F.lit(0.0)))  # a strict match ends the search
    rest = [c for c in attempts.columns if c != "id"]
    return attempts.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(rank, ratio, *place)).alias("x")).select("id", "x.*")


def scope(poems: DataFrame, attempts: DataFrame) -> DataFrame:
    """Where each poem's stanzas can be had: ``id, category, source, ref, note``.

    ``attempts(id, source_ord, ord, source, ref, n_fetched, ratio, grade, has_breaks)``: texts
    that were found for a poem, graded; ``n_fetched`` is null or 0 where there was no text.
    Categories are those of ``CATEGORIES``; source and ref are given where a text counts as
    the poem's, else ``note`` tells the best of those that don't. Attempts for poems that aren't
    there are passed over; one poem's attempts are never gathered.
    """
    best = best_attempt(attempts.withColumn("ratio", F.round("ratio", 3)))
    found = attempts.groupBy("id").agg(F.max(F.coalesce("n_fetched", F.lit(0)) > 0).alias("_found"))
    exact = best_attempt(attempts.where(F.col("grade").isin("strict", "near"))).select("id", *[F.col(c).alias(f"_{c}") for c in ("source", "ref", "grade", "has_breaks")])
    r = poems.select("id").join(best.select("id", "source", "ratio", "grade"), "id", "left").join(found, "id", "left").join(exact, "id", "left")
    kind = F.concat(F.when(F.col("_grade") == "strict", "FOUND").otherwise("FOUND_NEAR"), F.when(F.col("_has_breaks"), "_WITH_STANZAS").otherwise("_NO_STANZAS"))
    category = F.when(F.col("_grade").isNotNull(), kind).when(F.col("_found"), "FOUND_MISMATCH").otherwise("NOT_FOUND")
    note = F.when(F.col("category") == "FOUND_MISMATCH", F.concat(F.lit("best "), "source", F.lit(" ratio "), F.format_string("%.3f", "ratio"), F.lit(" ("), "grade", F.lit(")")))
    return r.withColumn("category", category).select("id", "category", F.col("_source").alias("source"), F.col("_ref").alias("ref"), F.coalesce(note, F.lit("")).alias("note"))


#: The categories of ``scope`` whose texts a stanza plan can use, and the grade that each stands for.
USABLE = {"FOUND_WITH_STANZAS": "strict", "FOUND_NEAR_WITH_STANZAS": "near"}
CATEGORIES = (*USABLE, "FOUND_NO_STANZAS", "FOUND_NEAR_NO_STANZAS", "FOUND_MISMATCH", "NOT_FOUND")


def saved_scopes(cache: DataFrame, poems: DataFrame) -> DataFrame:
    """The rows that ``stanza_plan`` takes, from saved scopes: ``id, stored, fetched, grade, skipped``.

    ``cache(id, category, fetched_body)``, ``poems(id, body, corpus)``. Scopes that can't be used
    and those of poems that are gone have no row; ``skipped`` says why a poem is left alone, else null.
    """
    grade = F.coalesce(*[F.when(F.col("category") == c, g) for c, g in USABLE.items()])
    text = F.coalesce("fetched_body", F.lit(""))
    why = (
        F.when(F.col("corpus").isNotNull(), F.concat(F.lit("corpus "), "corpus")).when(T.has_stanza_breaks(F.coalesce("body", F.lit(""))), "has stanza breaks")
        .when(text == "", "no text")
    )
    usable = cache.where(F.col("category").isin(*USABLE)).select("id", "category", "fetched_body")
    return usable.join(poems.select("id", "body", "corpus"), "id").select("id", F.col("body").alias("stored"), text.alias("fetched"), grade.alias("grade"), why.alias("skipped"))


def reparse_flags(old_lines, new_lines, old_stanzas, new_stanzas):
    """What makes a re-parsed body implausible: no lines; nearly every line a stanza, where that wasn't so before; over 40 % more or fewer lines."""
    spread = (new_lines > 3) & (new_stanzas / new_lines > 0.7) & (old_stanzas / F.greatest(old_lines, F.lit(1)) < 0.5)
    drift = (old_lines >= 3) & (F.abs(new_lines - old_lines) / old_lines > 0.4)
    some = new_lines > 0
    return F.array_compact(F.array(F.when(~some, "empty-body"), F.when(some & spread, "too-many-stanzas"), F.when(some & drift, "line-drift")))


def compared(rows: DataFrame) -> DataFrame:
    """``rows(id, old_body, new_body, ...)`` with lines and stanzas of both, ``flags`` and ``gained``: did it have one stanza and now more?"""
    sizes = {}
    for side in ("old", "new"):
        body = F.coalesce(f"{side}_body", F.lit(""))
        sizes |= {f"{side}_lines": T.line_count(body), f"{side}_stanzas": T.stanza_count(body)}
    out = rows.withColumns(sizes)
    flags = reparse_flags(*[F.col(c) for c in ("old_lines", "new_lines", "old_stanzas", "new_stanzas")])
    return out.withColumn("flags", flags).withColumn("gained", F.expr("old_stanzas <= 1 and new_stanzas > 1"))


def found_entries(poems: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, pos``: the page that each poem is on, of ``poems(id, body)`` and ``entries(pos, html)``.

    The best lines of a poem are looked for one after the other, each in the spellings that a
    page may have; the first that any page holds decides, and the first page that holds it.
    Lines that many poems share are looked for once.
    """
    keep = (lambda d: d.checkpoint()) if poems.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d.persist())
    # a search reads what it looks for many times, so the lines are picked once and kept
    lines = keep(poems.select("id", F.posexplode(T.probes(F.col("body"))).alias("i", "line")))
    pages = entries.select(F.col("pos").alias("text_id"), F.col("html").alias("body"))

    def held(asked: DataFrame) -> DataFrame:
        wanted = asked.select("probe").distinct().withColumn("probe_id", F.unhex(F.md5("probe")))
        first = dedup.containing(wanted, pages).groupBy("probe_id").agg(F.min("text_id").alias("pos"))
        best = asked.withColumn("probe_id", F.unhex(F.md5("probe"))).join(first, "probe_id").groupBy("id").agg(F.min(F.struct("i", "j", "pos")).alias("m"))
        return best.select("id", F.col("m.pos").alias("pos"))

    # most poems are found by their best line as it stands; only the others are looked for by all lines and spellings
    early = keep(held(lines.where("i = 0").select("id", "i", F.lit(0).alias("j"), F.col("line").alias("probe"))))
    rest = keep(lines.join(early.select("id"), "id", "left_anti").select("id", "i", F.posexplode(T.spellings(F.col("line"))).alias("j", "probe")))
    return early.unionByName(held(rest))


def reparse_plan(poems: DataFrame, entries: DataFrame, parse: Callable[[Column], Column]) -> DataFrame:
    """A plan for new bodies from the pages that poems came from, as ``apply_plan`` takes it.

    ``poems(id, body)``, ids unique; ``entries(pos, html)``, pos unique; ``parse`` makes the body of
    a page, null or blank where it can't. Returns ``id, pos, status, new_body``, what ``compared``
    adds, and ``skipped``; status is missed (no page holds a line of the poem), unparsed, flagged or ok.
    Only pages that hold a poem are parsed, each once.
    """
    found = found_entries(poems, entries)
    used = entries.join(found.select("pos").distinct(), "pos", "left_semi").select("pos", T.nonempty(parse(F.col("html"))).alias("new_body"))
    rows = poems.select("id", F.col("body").alias("old_body")).join(found, "id", "left").join(used, "pos", "left")
    out = compared(rows)
    status = F.when(F.col("pos").isNull(), "missed").when(F.col("new_body").isNull(), "unparsed").when(F.size("flags") > 0, "flagged").otherwise("ok")
    out = out.withColumn("status", status).withColumn("skipped", F.col("status") != "ok")
    some = ~F.col("status").isin("missed", "unparsed")
    cleared = {c: F.when(some, F.col(c)) for c in ("new_lines", "new_stanzas", "flags", "gained")}
    return out.withColumns(cleared).select("id", "pos", "status", "new_body", "old_lines", "new_lines", "old_stanzas", "new_stanzas", "flags", "gained", "skipped")


def backfill_chain(poems: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Markup for poems from several parsed sources: ``id, html, status, n_sources``.

    ``poems(id, author, body)``, each source ``(author, body, html)``. What a source gives by author
    and body counts once however often it repeats; a poem that sources (or rows of one) give
    different markup is a conflict and gets none.
    """
    said = None
    for k, source in enumerate(sources):
        part = source.select("author", "body", "html", F.lit(str(k)).alias("source"))
        said = part if said is None else said.unionByName(part)
    keys = _keys()
    n = said.select(*keys, "source").groupBy("ak", "bk").agg(F.count_distinct("source").alias("n_sources"))
    per = poems.select("id", *keys).join(n, ["ak", "bk"], "left").select("id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    return backfill(poems, said).join(per, "id")
