"""Search results: shaping, deduplication, yield and state as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, query_text
from ..functions.text import strip, text_or_empty

RESPONSE = "organic array<struct<link:string,title:string,domain:string,snippet:string>>"


def expanded(config: DataFrame) -> DataFrame:
    """(ord, query): templates x segments x cities of config (templates, segments, cities, suffix), first of equal ones kept.

    The product is of three lists in one configuration row, exploded in order."""
    c = config.select(
        F.posexplode("templates").alias("t", "template"), "segments", "cities", F.coalesce(F.trim("suffix"), F.lit("")).alias("suffix")
    ).select("t", "template", F.posexplode("segments").alias("s", "segment"), "cities", "suffix")
    c = c.select("t", "s", "template", "segment", F.posexplode("cities").alias("c", "city"), "suffix")
    made = strip(F.replace(F.replace("template", F.lit("{segment}"), F.col("segment")), F.lit("{city}"), F.col("city")))
    c = c.withColumn("made", made).where("made <> ''").withColumn("query", F.when(F.col("suffix") != "", F.concat_ws(" ", "made", "suffix")).otherwise(F.col("made")))
    first = c.groupBy("query").agg(F.min(F.struct("t", "s", "c")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("ord"), "query")


def parsed_responses(raw: DataFrame) -> DataFrame:
    """raw: query, body (JSON), scraped_at. Organic results with a link, in order; other blocks are ignored."""
    rows = raw.select("query", "scraped_at", F.from_json("body", RESPONSE).alias("r"))
    rows = rows.select("query", "scraped_at", F.posexplode("r.organic").alias("ord", "x")).where("x.link <> ''")
    text = lambda c: text_or_empty(F.col(c))
    return rows.select(text("x.title").alias("title"), F.col("x.link").alias("url"), text("x.domain").alias("display_url"), text("x.snippet").alias("description"), "query", "scraped_at", F.col("ord").cast("long").alias("ord"))


def first_by_url(results: DataFrame) -> DataFrame:
    """The first result of each URL by ord: a grouped minimum, so a URL that many queries found costs one row a task."""
    rest = [c for c in results.columns if c != "url"]
    g = results.where(text_or_empty(F.col("url")) != "").groupBy("url").agg(F.min_by(F.struct(*rest), "ord").alias("x"))
    return g.select("url", "x.*").select(*results.columns)


def per_query_limit(results: DataFrame, n: int) -> DataFrame:
    """The first n results of each query."""
    w = Window.partitionBy("query").orderBy("ord")
    return results.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def fresh(results: DataFrame, seen: DataFrame) -> DataFrame:
    """Results whose (query_key, url) isn't in seen."""
    return results.join(seen.select("query_key", "url"), ["query_key", "url"], "left_anti").select(*results.columns)


def unscraped(pages: DataFrame, scraped: DataFrame) -> DataFrame:
    """Pages whose URL has no settled status; errors are tried again."""
    return pages.join(scraped.where(F.col("status").isin(*fixed.SETTLED_STATUSES)).select("url"), "url", "left_anti").select(*pages.columns)


def with_query(pages: DataFrame, origins: DataFrame) -> DataFrame:
    """pages and the query that found them first, or an empty one."""
    return pages.join(origins.groupBy("url").agg(F.min_by("query", "ord").alias("search_query")), "url", "left").withColumn("search_query", text_or_empty(F.col("search_query")))


def yields(found: DataFrame) -> DataFrame:
    """found: qord, query, url. (qord, query, urls, new): URLs of each query, and those that no earlier query had.

    Equal URLs inside one query all count. The first query of a URL is a grouped minimum that is joined back."""
    first = found.groupBy("url").agg(F.min("qord").alias("first"))
    rows = found.join(first, "url")
    return rows.groupBy("qord", "query").agg(F.count("*").alias("urls"), F.count_if(F.col("qord") == F.col("first")).alias("new")).select("qord", query_text.without_negative_operators(F.col("query")).alias("query"), "urls", "new")


def with_contacts(of_queries: DataFrame, companies: DataFrame) -> DataFrame:
    """Yield rows and the companies with a found address or WhatsApp number that came from each query."""
    real = companies.where("email_source = 'found' OR whatsapp <> ''")
    n = real.groupBy(query_text.without_negative_operators(F.col("search_query")).alias("query")).agg(F.count("*").alias("contacts"))
    return of_queries.join(n, "query", "left").withColumn("contacts", F.coalesce("contacts", F.lit(0).cast("long")))


def with_overlap(rows: DataFrame) -> DataFrame:
    return rows.withColumn("overlap", (F.col("urls") > 0) & (F.col("new") / F.col("urls") < 0.25))


def typed_queries(sent: DataFrame, names: DataFrame) -> DataFrame:
    """sent queries and what was typed for them; itself where nothing is known."""
    return sent.join(names, sent["query"] == names["sent"], "left").select("query", F.coalesce("typed", "query").alias("typed"))


def streaks(pages: DataFrame, *, stored: str | None = None) -> DataFrame:
    """pages: query_key, page, fresh. The streak of pages without fresh URLs, and whether it has exhausted the query.

    Pages with fresh URLs begin islands; within an island the empty ones are counted. A stored streak goes on in the first."""
    w = Window.partitionBy("query_key").orderBy("page")
    p = pages.withColumn("island", F.sum(F.when(F.col("fresh") > 0, 1).otherwise(0)).over(w))
    inside = Window.partitionBy("query_key", "island").orderBy("page")
    n = F.sum(F.when(F.col("fresh") == 0, 1).otherwise(0)).over(inside)
    start = F.when(F.col("island") == 0, F.coalesce(stored, F.lit(0))).otherwise(0) if stored else F.lit(0)
    p = p.withColumn("streak", (n + start).cast("long"))
    return p.withColumn("exhausted", F.col("streak") >= fixed.STALE_PAGES).drop("island")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: an upsert's result, as a grouped maximum."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*").select(*rows.columns)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """Rows to insert: the first of each key that isn't stored."""
    return first_by_url(rows).join(stored.select(key), key, "left_anti").select(*rows.columns)


def result_pages(n: int) -> list[int]:
    """First result of each page of ten that n results need."""
    return [10 * p + 1 for p in range(-(-n // 10))]
