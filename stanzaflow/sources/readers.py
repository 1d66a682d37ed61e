"""Sources: files of records, review sheets, link lists and page snapshots."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.functions import text as T


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file (or a folder of files) that holds one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_by_file(spark: SparkSession, folder: str, schema: str, only: list[str] | None = None) -> DataFrame:
    """One JSON object a file, with ``file_id``, the file's name without its ending; of the files named ``only``, if given, no other is opened."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    name = F.col("_metadata.file_name")
    if only is not None:
        rows = rows.where(name.isin([f"{x}.json" for x in only]))
    return rows.select("*", F.regexp_replace(name, r"\.json$", "").alias("file_id"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped."""
    raw = spark.read.text(path).where(~F.col("value").rlike(T.BLANK))
    return raw.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed name list, ``canonical, confirmed, variant``: blocks of ``- canonical:`` with ``- name:`` entries."""
    doc = spark.read.text(path, wholetext=True)
    block = doc.select(F.explode(F.slice(F.split("value", r"\n  - canonical:"), 2, 1_000_000)).alias("b"))
    name = F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^ {6}- name:[ \t]*(.*)$"), 1))
    return block.select(T.yaml_unquote(F.split("b", "\n")[0]).alias("canonical"), F.col("b").rlike(r"confirmed:\s*true").alias("confirmed"), name.alias("v")).select("canonical", "confirmed", T.yaml_unquote(F.col("v")).alias("variant"))


def variant_map(sheet: DataFrame) -> DataFrame:
    """``variant, canonical`` of the confirmed blocks, without names that map to themselves."""
    return sheet.where("confirmed and variant <> canonical").select("variant", "canonical").distinct()


def sitemap_urls(pages: DataFrame, text: str = "html") -> DataFrame:
    """The distinct addresses in <loc> elements."""
    return pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url")).distinct()


def archive_links(pages: DataFrame, base: str, text: str = "html") -> DataFrame:
    """Addresses of dated pages in an archive index, made absolute, in order of first occurrence."""
    found = pages.select(F.posexplode(F.regexp_extract_all(text, F.lit(r'href="((?:https?://[^"/]+)?/\d{4}/[^"]+\.shtml)"'), 1)).alias("pos", "href"))
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href"))
    return found.where(~F.contains(F.col("href"), F.lit("/about"))).groupBy(url.alias("url")).agg(F.min("pos").alias("pos"))


def latest_snapshots(index: DataFrame) -> DataFrame:
    """The newest capture of each address ``url, timestamp`` (14 digits); only dated .shtml pages."""
    fits = F.col("url").rlike(r"/\d{4}/[^/]+\.shtml$") & ~F.col("url").rlike("/(archive|about)")
    return index.where(fits).groupBy("url").agg(F.max("timestamp").alias("timestamp"))


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to fetch."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def reachable(links: DataFrame, start: DataFrame, most: int = 200) -> DataFrame:
    """Breadth-first pages from ``start(url)`` over ``links(src, dst)``, ``url, depth``, at most ``most`` of them, in order of depth and url."""
    seen = front = start.select("url", F.lit(0).alias("depth"))
    depth = 0
    while True:
        depth += 1
        nxt = links.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        nxt = nxt.orderBy("url").limit(most)  # which pages stay doesn't depend on the partitioning
        front = nxt.checkpoint() if nxt.sparkSession.sparkContext.getCheckpointDir() else nxt.persist()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(most)


def has_text(df: DataFrame) -> Column:
    """has_poem as a flag of the row or inside a flags struct."""
    flags = F.col("flags.has_poem") if "flags" in df.columns else F.lit(None).cast("boolean")
    return F.coalesce(flags, F.col("has_poem") if "has_poem" in df.columns else F.lit(None).cast("boolean"), F.lit(False))


def author_rows(*sources: tuple[str, DataFrame]) -> DataFrame:
    """``name, source`` over several sources; blank names and rows marked as without text are left out."""
    out = None
    for source, df in sources:
        if "has_poem" in df.columns:
            df = df.where(F.coalesce("has_poem", F.lit(True)))
        part = df.where(T.nonempty(F.col("name")).isNotNull()).select(T.collapse(F.col("name")).alias("name"), F.lit(source).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def paged(fetch: Callable[[int], list | None], most: int = 500, empty: int = 2) -> Iterator:
    """The items of numbered pages: a page that fails (None) is asked for once more and then ends the scan, as ``empty`` empty pages in a row do."""
    blank = 0
    for page in range(1, most + 1):
        items = fetch(page)
        if items is None:
            items = fetch(page)
        if items is None:
            return
        blank = 0 if items else blank + 1
        if blank == empty:
            return
        yield from items


def series(fetch: Callable[[int], str | None], links: Callable[[str], list[str]], most: int = 50, stale: int = 2) -> list[str]:
    """The links of numbered index pages, each once in order: ends at an empty page or after ``stale`` pages in a row without a new link."""
    seen: dict[str, None] = {}
    old = 0
    for page in range(1, most + 1):
        html = fetch(page)
        if not html:
            break
        new = [u for u in links(html) if u not in seen]
        old = 0 if new else old + 1
        if old == stale:
            break
        seen |= dict.fromkeys(new)
    return list(seen)


def program_urls(html: str, base: str) -> list[str]:
    """Absolute links to programs, without query, fragment and the slash at the end."""
    paths = re.findall(r"""href=["'](?:https?://[^/"']+)?(/programs/[^"'?#]+)""", html)
    return list(dict.fromkeys(base + p.rstrip("/") for p in paths))


def values_table(spark, titles: dict[str, list[str]]) -> DataFrame:
    """A table in code, ``author, title``, one row for each title: canonical titles or overrides."""
    return spark.createDataFrame([(a, t) for a, ts in titles.items() for t in ts], "author string, title string")
