"""Duplicate poems: edges by cheap signals and body ratio, clusters, classes, merged records."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stanzaflow.functions import similarity as S
from stanzaflow.functions import text as T

FUZZY, BODY, LEAST_BODY, LEAST_LINE = 0.85, 0.90, 100, 10


def star_edges(rows: DataFrame, key: str, kind: str, block: str = "block", rid: str = "rid") -> DataFrame:
    """``a, b, kind``: each row with the first row of its block and key. The components are those of all pairs, with n edges.

    First rows come from an aggregate and return by a join, so a hot key is never gathered in one task.
    """
    held = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(rid).alias("b"), F.col(block).alias("_block"), F.col(key).alias("_key"))
    first = held.groupBy("_block", "_key").agg(F.min("b").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = held["_block"].eqNullSafe(first["_block"]) & (held["_key"] == first["_key"])
    return held.join(first, same).where("a < b").select("a", "b", F.lit(kind).alias("kind"))


def exact_edges(rows: DataFrame, block: str = "block", rid: str = "rid") -> DataFrame:
    """Edges of equal normalised titles and of equal first lines over 10 characters, ``rows(rid, block, title_norm, first_line)``."""
    long = rows.withColumn("first_line", F.when(F.length("first_line") > LEAST_LINE, F.col("first_line")))
    return star_edges(rows, "title_norm", "title", block, rid).unionByName(star_edges(long, "first_line", "firstline", block, rid))


#: Characters of the bodies of a tile, about; a pair of tiles is one task's work, whatever their lengths.
TILE = 1 << 20
#: Partitions of the cells for each shuffle partition: cells are small beside the work in them, so they mustn't be put together by their size.
SPREAD = 8


def _bodies(rows: DataFrame, block: str, body: str) -> tuple[DataFrame, DataFrame]:
    """The rows of long bodies with a ``key`` of block and body, and the different bodies ``key, block, body, t, f``.

    ``t`` and ``f`` are the title and the long first line that all rows of a body have, else null.
    """
    r = rows.where((F.length(body) >= LEAST_BODY) & F.col(block).isNotNull()).withColumn("key", F.sha2(F.concat(F.sha2(F.col(block).cast("string"), 256), F.col(body)), 256))
    t, f = F.when(F.col("title_norm") != "", F.col("title_norm")), F.when(F.length("first_line") > LEAST_LINE, F.col("first_line"))
    one = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    return r, r.groupBy("key").agg(F.first(F.col(block).cast("string")).alias("block"), F.first(body).alias("body"), one(t).alias("t"), one(f).alias("f"))


def _body_pairs(a: DataFrame, b: DataFrame, least: float, own: bool) -> DataFrame:
    """``x, y, xy, yx``: keys of different bodies of one block and their ratios in both orders (with ``own``), those below ``least`` null; pairs that share ``t`` or ``f`` are left out.

    ``a`` and ``b`` as ``_bodies`` gives them; with ``own`` both are the same and each pair occurs once.
    Bodies meet in bands of the logarithm of their length and, in those, in tiles of about
    ``TILE`` characters, so neither a pair that the length excludes nor a row for each pair is formed.
    With ``own`` two tiles of one band meet once.
    """
    import math

    step = math.log((2 - least) / least) * (1 + 1e-9)
    band = F.floor(F.log(F.length("body")) / F.lit(step))
    parts = lambda d, name: d.groupBy("block", "band", "apart").agg(F.ceil(F.sum(F.length("body")) / TILE).cast("int").alias(name))
    a = a.withColumn("band", band).withColumn("apart", F.explode(F.array(*[F.lit(i) for i in ((0, 1) if own else (-1, 0, 1))])))
    b = b.withColumn("apart", F.explode(F.array(*[F.lit(i) for i in ((0, 1) if own else (-1, 0, 1))]))).withColumn("band", band - F.col("apart"))
    cell = ["block", "band", "apart"]
    grid = parts(a, "n_a").join(parts(b, "n_b"), cell)
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    once = F.lit(own) & (F.col("apart") == 0)
    all_ = lambda first, last: F.explode(F.sequence(first, last))
    left = a.join(grid, cell).withColumn("ta", mine("n_a")).withColumn("tb", all_(F.when(once, F.col("ta")).otherwise(0), F.col("n_b") - 1)).withColumn("side", F.lit(0))
    right = b.join(grid, cell).withColumn("tb", mine("n_b")).withColumn("ta", all_(F.lit(0), F.when(once, F.col("tb")).otherwise(F.col("n_a") - 1))).withColumn("side", F.lit(1))
    n = SPREAD * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = left.unionByName(right).select(*cell, "ta", "tb", "side", "key", "body", "t", "f").repartition(n, *cell, "ta", "tb")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        apart, ta, tb = (k.as_py() for k in key[2:])
        itself = own and apart == 0 and ta == tb
        sides = [table.filter(pc.equal(table["side"], i)).select(["key", "body", "t", "f"]).to_pylist() for i in (0, 1)]
        if itself:
            sides[1] = sides[0]
        found = []
        for i, j in S.near_pairs(*[[r["body"] for r in side] for side in sides], least, itself):
            p, q = sides[0][i], sides[1][j]
            if p["key"] == q["key"] or any(p[c] is not None and p[c] == q[c] for c in ("t", "f")):
                continue
            if own and (len(p["body"]), p["key"]) > (len(q["body"]), q["key"]):
                p, q = q, p
            # what shares a long block is nearly always near, and its ratio costs less than the bounds
            if S._longest(p["body"], q["body"]) is None and not S._may_reach(p["body"], q["body"], least):
                continue
            xy, yx = (r if r is not None and r >= least else None for r in (S._ratio(p["body"], q["body"]), S._ratio(q["body"], p["body"]) if own else None))
            if xy is not None or yx is not None:
                found.append({"x": p["key"], "y": q["key"], "xy": xy, "yx": yx})
        return pa.Table.from_pylist(found, pa.schema([("x", pa.string()), ("y", pa.string()), ("xy", pa.float64()), ("yx", pa.float64())]))

    return cells.groupBy(*cell, "ta", "tb").applyInArrow(compare, "x string, y string, xy double, yx double")


def fuzzy_edges(rows: DataFrame, least: float = FUZZY) -> DataFrame:
    """Pairs of one block whose bodies agree by ``least`` and that share no cheaper signal, ``a, b, ratio``.

    ``rows(rid, block, body_key, title_norm, first_line)``. Different bodies are compared once,
    however many rows have them (``_body_pairs``); their rows are joined to what is found.
    """
    r, bodies = _bodies(rows.select("rid", "block", "body_key", "title_norm", "first_line"), "block", "body_key")
    r = r.select("rid", "key", F.col("title_norm").alias("t"), F.col("first_line").alias("f"))
    side = lambda i: r.select(F.col("key").alias(f"k{i}"), F.col("rid").alias(f"r{i}"), F.col("t").alias(f"t{i}"), F.col("f").alias(f"f{i}"))
    other = _body_pairs(bodies, bodies, least, True).join(side("x"), F.col("x") == F.col("kx")).join(side("y"), F.col("y") == F.col("ky"))
    first = F.col("rx") < F.col("ry")
    other = other.where("rx <> ry").withColumns({"a": F.least("rx", "ry"), "b": F.greatest("rx", "ry"), "ratio": F.when(first, F.col("xy")).otherwise(F.col("yx"))})
    # rows of one body: only where no title or line is common to all of them
    equal = bodies.where("t is null and f is null").select(F.col("key").alias("kx")).join(side("x"), "kx").join(side("y"), F.col("kx") == F.col("ky"))
    equal = equal.where("rx < ry").withColumns({"a": F.col("rx"), "b": F.col("ry"), "ratio": F.lit(1.0)})
    cheap = F.coalesce((F.col("tx") != "") & (F.col("tx") == F.col("ty")), F.lit(False)) | F.coalesce((F.length("fx") > LEAST_LINE) & (F.col("fx") == F.col("fy")), F.lit(False))
    return other.unionByName(equal, allowMissingColumns=True).where(~cheap & F.col("ratio").isNotNull()).select("a", "b", "ratio")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rid, comp`` (least rid reachable) of ``nodes(rid)`` and ``edges(a, b)``.

    Each round takes the least label of the neighbours and then the label of that label, so
    chains shorten by halves; rounds are written to the checkpoint folder if there is one.
    """
    reliable = nodes.sparkSession.sparkContext.getCheckpointDir() is not None
    keep = (lambda d: d.checkpoint()) if reliable else (lambda d: d.persist())
    drop = (lambda d: None) if reliable else (lambda d: d.unpersist())
    both = keep(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label, old = nodes.select("rid", F.col("rid").alias("comp")), None
    while True:
        near = both.join(label.select(F.col("rid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("comp").alias("m"))
        new = label.join(near, "rid", "left").select("rid", F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = new.select(F.col("rid").alias("comp"), F.col("comp").alias("to"))
        new = keep(new.join(jump, "comp").select("rid", F.col("to").alias("comp")))
        done = new.join(label.withColumnRenamed("comp", "old"), "rid").where("comp <> old").isEmpty()
        if old is not None:
            drop(old)
        if done:
            drop(both)
            return new
        old = label = new


def merge_chain(rows: DataFrame, fuzzy: DataFrame, score: str = "score", fields: tuple[str, ...] = ()) -> DataFrame:
    """The merged corpus: one record for each cluster whose class says that it is one text, and each other row by itself.

    ``rows`` as ``cluster_signals`` and ``merge`` take them. Returns ``winner, n, provenance,
    cls`` and the fields; clusters that only share a first line, are encores or ambiguous
    stay single rows.
    """
    said = classify(cluster_signals(rows, fuzzy)).select("comp", "cls")
    one = F.col("cls").isin("body_match", "fuzzy_confirmed", "keep_newer")
    comp = F.when(F.coalesce(one, F.lit(False)), F.struct(F.col("comp").alias("c"), F.lit(0).alias("k"))).otherwise(F.struct(F.col("rid").alias("c"), F.lit(1).alias("k")))
    classed = rows.join(said, "comp", "left").withColumn("cls", F.coalesce("cls", F.lit("single"))).withColumn("comp", comp)
    return merge(classed, score=score, fields=(*fields, "cls"))


def candidate_report(rows: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Clusters of two rows or more for review: ``comp, n, authors, titles, sources, deleted``, the largest first.

    ``rows(rid, comp, author, title, source)``; ``deleted(title_norm)`` are titles removed
    before, and ``deleted`` says that the cluster has one of them (``rows.title_norm``).
    """
    if deleted is not None:
        gone = deleted.select("title_norm").distinct().withColumn("_gone", F.lit(True))
        rows = rows.join(gone, "title_norm", "left")
    said = F.bool_or(F.coalesce("_gone", F.lit(False))) if deleted is not None else F.lit(False)
    each = lambda c: F.sort_array(F.collect_set(c)).alias(f"{c}s")
    g = rows.groupBy("comp").agg(F.count("*").alias("n"), each("author"), each("title"), each("source"), said.alias("deleted"))
    return g.where("n > 1").orderBy(F.desc("n"), "comp")


def cluster_signals(rows: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """The signals of each cluster of two rows or more, as ``classify`` takes them, with ``n``.

    ``rows(rid, comp, source, title_norm, first_line, body_key)``; ``fuzzy(a, b, ratio)`` are
    the pairs without a cheaper signal (``fuzzy_edges``). A cluster's ratio is the largest of
    its pairs with a signal. Equal bodies and fuzzy pairs are taken first, then each row with
    the first of its key, then all pairs of a key; a cluster leaves once a ratio reaches
    ``BODY``, so ``max_ratio`` says on which side of it the largest one lies. Boolean columns
    ``encore``, ``confirmed`` and ``keep_newer`` of the rows hold for their cluster.
    """
    keep = (lambda d: d.checkpoint()) if rows.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d.persist())
    title = F.when(F.col("title_norm") != "", F.col("title_norm"))
    r = rows.withColumn("t", title).withColumn("f", F.when(F.length("first_line") > LEAST_LINE, F.col("first_line")))
    both = r.where("t is not null and f is not null").groupBy("comp", "t", "f").count().where("count > 1").select("comp").distinct().withColumn("any_title_first", F.lit(True))
    same_line = r.where("f is not null").groupBy("comp", "f").agg(F.count("*").alias("k"), F.count("t").alias("some"), F.count_distinct("t").alias("titles"))
    first = same_line.where("k > 1 and (titles > 1 or some < k)").select("comp").distinct().withColumn("any_first_only", F.lit(True))

    by = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("t").alias("key")), F.struct(F.lit(1).alias("kind"), F.col("f").alias("key"))))
    m = r.where("body_key is not null").select("rid", "comp", "t", "body_key", by.alias("k")).select("rid", "comp", "t", "body_key", "k.*").where("key is not null")
    equal = m.groupBy("comp", "kind", "key", F.sha2("body_key", 256)).count().where("count > 1").select("comp", F.lit(1.0).alias("ratio"))
    found = keep(equal.unionByName(fuzzy.join(rows.select(F.col("rid").alias("a"), "comp"), "a").select("comp", "ratio")).groupBy("comp").agg(F.max("ratio").alias("ratio")))
    m = m.withColumn("least", F.min("rid").over(Window.partitionBy("comp", "kind", "key")))
    for a in (m.where("rid = least"), m.where("rid > least")):
        open_ = a.join(found.where(F.col("ratio") >= BODY), "comp", "left_anti")
        a, b = (d.select(F.col("rid").alias(i), "comp", "kind", "key", F.col("t").alias(f"t{i}"), F.col("body_key").alias(f"x{i}")) for d, i in ((open_, "a"), (m, "b")))
        new = F.expr("a < b and (kind = 0 or not coalesce(ta = tb, false))")
        pairs = a.join(b, ["comp", "kind", "key"]).where(new & (S.ratio_bound(F.col("xa"), F.col("xb")) >= BODY))
        ratios = pairs.select("comp", S.sequence_ratio_from("xa", "xb", BODY).alias("ratio")).where("ratio is not null")
        found = keep(found.unionByName(ratios).groupBy("comp").agg(F.max("ratio").alias("ratio")))
    said = [(F.bool_or(c) if c in rows.columns else F.lit(False)).alias(c) for c in ("encore", "confirmed", "keep_newer")]
    g = rows.groupBy("comp").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), *said).where("n > 1").withColumnRenamed("encore", "any_encore")
    g = g.join(both, "comp", "left").join(first, "comp", "left").join(found.withColumnRenamed("ratio", "max_ratio"), "comp", "left")
    return g.fillna(False, ["any_title_first", "any_first_only", "any_encore", "confirmed", "keep_newer"]).fillna(0.0, ["max_ratio"])


def classify(clusters: DataFrame) -> DataFrame:
    """The class of each cluster, from aggregated signals, by the first rule that fits.

    ``clusters(comp, n_sources, any_encore, max_ratio, any_title_first, any_first_only, confirmed, keep_newer)``.
    """
    said = (
        F.when(F.col("confirmed"), "fuzzy_confirmed").when((F.col("n_sources") == 1) & F.col("any_encore"), "encore").when(F.col("max_ratio") >= BODY, "body_match")
        .when(F.col("keep_newer"), "keep_newer").when(F.col("any_first_only") & ~F.col("any_title_first"), "not_dupe_firstline_only").otherwise("ambiguous")
    )
    return clusters.withColumn("cls", said)


def richness(book: Column, publisher: Column, year: Column, title: Column, body: Column) -> Column:
    """One for each of three source fields and a title, and the length as a tie-break."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)
    return some(book) + some(publisher) + some(year) + some(title) + F.length(F.coalesce(body, F.lit(""))) / 10000


def merge(rows: DataFrame, comp: str = "comp", score: str = "score", rid: str = "rid", fields: tuple[str, ...] = ("title",)) -> DataFrame:
    """One record for each cluster: the richest row (the first in order on ties) and where all rows came from."""
    best = F.max_by(F.struct(rid, *fields), F.struct(F.col(score), -F.col(rid))).alias("w")
    came = F.transform(F.array_sort(F.collect_list(F.struct(rid, "source"))), lambda s: s["source"])
    return rows.groupBy(comp).agg(best, F.count("*").alias("n"), came.alias("provenance")).select(F.col(f"w.{rid}").alias("winner"), *[F.col(f"w.{f}").alias(f) for f in fields], "n", "provenance")


def near_dup_longest(rows: DataFrame, least: int = 50) -> DataFrame:
    """Of rows with the same key (first 200 characters) the longest stays, the first on ties; short keys all stay."""
    key = T.near_dup_key(F.col("body"))
    g = F.when(F.length("k") < least, F.concat(F.lit("id:"), F.col("rid").cast("string"))).otherwise(F.concat(F.lit("k:"), F.col("k")))
    best = rows.select("rid", F.length("body").alias("n"), key.alias("k")).groupBy(g.alias("g")).agg(F.max_by("rid", F.struct("n", -F.col("rid"))).alias("rid"))
    return rows.join(best.select("rid"), "rid", "left_semi")


def live_dupes(live: DataFrame, scraped: DataFrame, least: float = FUZZY) -> DataFrame:
    """Scraped rows that agree with a live row of their author: ``rid, live_id, why`` (title, first line, else body ratio).

    Titles and first lines are joined as keys. Different bodies are compared once
    (``_body_pairs``), and the rows that have them are joined to what is found.
    """
    s = scraped.select("rid", "author_norm", "title_norm", "first_line", "body_key")
    l = live.select(F.col("rid").alias("live_id"), "author_norm", "title_norm", "first_line", F.col("body_key").alias("live_key"))
    title = s.where("title_norm <> ''").join(l, ["author_norm", "title_norm"]).select("rid", "live_id", F.lit(0).alias("k"))
    line = s.where(F.length("first_line") > LEAST_LINE).join(l, ["author_norm", "first_line"]).select("rid", "live_id", F.lit(1).alias("k"))
    exact = title.unionByName(line).groupBy("rid", "live_id").agg(F.min("k").alias("k")).select("rid", "live_id", F.when(F.col("k") == 0, "title").otherwise("firstline").alias("why"))
    mine, bodies = _bodies(s, "author_norm", "body_key")
    theirs, live_bodies = _bodies(l, "author_norm", "live_key")
    rows, lives = mine.select("rid", F.col("key").alias("x")), theirs.select("live_id", F.col("key").alias("y"))
    near = _body_pairs(bodies, live_bodies, least, False).where("xy is not null").select("x", "y")
    known = live_bodies.select("key", F.col("t").alias("lt"), F.col("f").alias("lf"))
    same = bodies.join(known, "key").where("not coalesce(t = lt or f = lf, t = lt, f = lf, false)").select(F.col("key").alias("x"), F.col("key").alias("y"))
    fuzzy = near.unionByName(same).join(rows, "x").join(lives, "y").select("rid", "live_id").join(exact, ["rid", "live_id"], "left_anti").withColumn("why", F.lit("body"))
    return exact.unionByName(fuzzy)


#: Bytes of probes, about, up to which they are sent to every task.
SMALL = 8 << 20
#: Characters of the pieces by which many short probes are looked for.
PIECE = 10


def _containing_pieces(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """As ``containing`` for probes of 2 * PIECE - 1 characters or more, of any words.

    A text is cut into pieces of PIECE characters; wherever it holds a probe, one of its
    pieces lies within the probe's first 2 * PIECE - 1 characters, so both meet at its hash.
    """
    cuts = F.array(*[F.xxhash64(F.substring("probe", k + 1, PIECE)) for k in range(PIECE)])
    p = probes.select("probe_id", "probe", F.explode(F.array_distinct(cuts)).alias("k"))
    pieces = F.transform(F.regexp_extract_all("body", F.lit(f"(?s).{{{PIECE}}}"), F.lit(0)), lambda x: F.xxhash64(x))
    places = texts.select("text_id", F.explode(F.array_distinct(pieces)).alias("k")).join(p.select("k").distinct(), "k", "left_semi")
    pairs = places.join(p, "k").select("probe_id", "probe", "text_id").distinct()
    return pairs.join(texts, "text_id").where(F.contains("body", "probe")).select("probe_id", "text_id")


def containing(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """Which texts hold which probes, ``probe_id, text_id``, for ``probes(probe_id, probe)`` and ``texts(text_id, body)``.

    A probe is looked for by its rarest key: of the three-word keys inside it (its first and
    last word may be parts of words), the one that fewest texts hold. Only keys of probes
    are counted, and of a text only rows with a probe's rarest key are formed, so a key that
    is common in the corpus is joined only where a probe has no other. What is found is then
    checked. Probes of fewer than five words are found by pieces of the texts if they have 19
    characters or more; shorter ones are compared with all texts in blocks, a small table, an
    error beyond ``SMALL`` bytes. Probe ids are unique.
    """
    p = probes.where("probe is not null").withColumn("w", F.split("probe", r"\s+"))

    def keys(w: Column, first: int, less: int) -> Column:
        """Hashes of three words in a row, from the ``first`` place on, the last ``less`` places left out."""
        shifted = [F.slice(w, F.lit(k + 1), F.greatest(F.lit(0), F.size(w) - k)).alias(f"w{k}") for k in range(3)]
        places = F.slice(F.arrays_zip(*shifted), F.lit(first), F.greatest(F.lit(0), F.size(w) - 1 - first - less))
        return F.transform(places, lambda e: F.xxhash64(e["w0"], e["w1"], e["w2"]))

    long = p.where(F.size("w") >= 5).select("probe_id", F.explode_outer(F.array_distinct(keys(F.col("w"), 2, 1))).alias("k"))
    asked = long.select("k").distinct()
    places = texts.select("text_id", F.explode_outer(keys(F.split("body", r"\s+"), 1, 0)).alias("k")).join(asked, "k", "left_semi").dropDuplicates(["k", "text_id"]).repartition("k")
    held = places.groupBy("k").agg(F.count("*").alias("held"))
    rarest = long.join(held, "k").groupBy("probe_id").agg(F.min(F.struct("held", "k")).alias("r"), F.count("*").alias("found"))
    # a probe with a key that no text holds is in no text
    wanted = long.groupBy("probe_id").agg(F.count("*").alias("all")).join(rarest, "probe_id").where("found = all").select("probe_id", F.col("r.k").alias("k"))
    pairs = places.join(wanted, "k").select("probe_id", "text_id").join(p.select("probe_id", "probe"), "probe_id")
    found = pairs.join(texts, "text_id").where(F.contains("body", "probe")).select("probe_id", "text_id")
    short = p.where(F.size("w") < 5).select("probe_id", "probe")
    fits = F.length("probe") >= 2 * PIECE - 1
    found, short = found.unionByName(_containing_pieces(short.where(fits), texts)), short.where(~fits)
    size = short.agg(F.coalesce(F.sum(F.octet_length("probe") + 16), F.lit(0))).first()[0]
    if size > SMALL:
        raise ValueError(f"{size} bytes of probes of fewer than five words and {2 * PIECE - 1} characters; {SMALL} at most")
    return found.unionByName(texts.join(F.broadcast(short), F.contains(F.col("body"), F.col("probe"))).select("probe_id", "text_id"))
