"""Queries over search results, their yield and their state; events stand in for results: a user's events are a query's URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query_text
from ..operators import search
from ..sources import search_api  # noqa: F401
from ..streaming import resume
from . import sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    url = F.concat(F.lit("https://e.example/"), F.col("event_type"), F.lit("/"), (F.col("event_id") % 97).cast("string"))
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("qord"), F.concat(F.lit("Hotel "), (F.col("user_id") % 50).cast("string"), F.lit("  kontak -site:agg.example")).alias("query"), url.alias("url"))


EVENTS = "e AS (SELECT event_id AS ord, user_id AS qord, 'Hotel ' || (user_id % 50) || '  kontak -site:agg.example' AS query, 'https://e.example/' || event_type || '/' || (event_id % 97) AS url FROM events)"


def first_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_by_url(_events(spark, sf_dir))


def query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.per_query_limit(_events(spark, sf_dir), 10)


def query_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_overlap(search.yields(_events(spark, sf_dir)))


def yield_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    made = e.where("ord % 5 = 0").select(F.col("query").alias("search_query"), F.when(F.col("ord") % 2 == 0, "found").otherwise("").alias("email_source"), F.when(F.col("ord") % 3 == 0, "+628").otherwise("").alias("whatsapp"))
    return search.with_contacts(search.yields(e), made)


def fresh_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("query_key", query_text.key(F.col("query"), F.lit("API")))
    return search.fresh(e.where("ord % 3 > 0"), e.where("ord % 3 = 0")).select("ord", "query_key", "url")


def unscraped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, ("ok", "error", "robots_blocked", "error", "blocked_domain", "error"))), (F.col("ord") % 6 + 1).cast("int"))
    done = search.latest(e.where("ord % 10 = 0").select("url", "ord", status.alias("status")), "url", "ord")
    return search.unscraped(e.select("ord", "url"), done)


def url_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return search.with_query(e.select("ord", "url"), e.where("ord % 4 = 0").select("url", "query", "ord"))


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return search.latest(e.select("url", "ord", (F.col("ord") % 5).alias("contacts_found")), "url", "ord")


def inserted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return search.new_rows(e.select("ord", "url", "query"), e.where("ord % 50 = 0").select("url").distinct())


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.concat(F.lit("api_"), "query", F.lit("_10")).alias("cache_key"))
    return search.cache_misses(e.distinct(), e.where(F.col("cache_key").contains("Hotel 1")))


def page_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are the days of an event type; fresh are users that no earlier day of it had."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("query_key"), F.datediff(F.col("ts").cast("date"), F.lit("2020-01-01").cast("date")).alias("page"), F.col("user_id").cast("string").alias("url"))
    first = e.groupBy("query_key", "url").agg(F.min("page").alias("first"))
    pages = e.join(first, ["query_key", "url"]).groupBy("query_key", "page").agg(F.count_if(F.col("page") == F.col("first")).alias("fresh"))
    return search.streaks(pages)


def batch_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of resumable search."""
    e = _events(spark, sf_dir)
    feed = e.select(F.concat(F.lit("q"), (F.col("qord") % 20).cast("string")).alias("query_key"), (F.col("ord") % 30).cast("int").alias("page"), F.col("ord").cast("int").alias("pos"), "url")
    seen = feed.where("pos % 11 = 0").select("query_key", "url").distinct()
    return resume.fresh_urls_of_batch(feed, seen).select("query_key", "page", "pos", "url")


def typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("query").distinct()
    names = e.where(F.col("query").contains("Hotel 2")).select(F.col("query").alias("sent"), query_text.without_negative_operators(F.col("query")).alias("typed"))
    return search.typed_queries(e, names)


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates, customers' segments and nations' names as a fan-out."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.array_sort(F.collect_set("n_name")).alias("cities"))
    s = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.array_sort(F.collect_set(F.lower("c_mktsegment"))).alias("segments"))
    config = s.crossJoin(n).withColumns({"templates": F.array(F.lit("{segment} {city} email"), F.lit("kontak {segment}"), F.lit("  ")), "suffix": F.lit(" 2024 ")})  # one row and one row
    return search.expanded(config)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the API made from the pages, a few of them with results without a link, with other blocks, or broken."""
    i = F.col("page_id")
    organic = F.concat(F.lit('{"organic": [{"link": "https://a'), i.cast("string"), F.lit('.example/", "title": "A", "domain": "a.example", "snippet": "x"}, {"title": "no link"}, {"link": "https://b'), i.cast("string"), F.lit('.example/p", "title": "B", "position": 3}]'))
    body = F.when(i % 5 == 0, F.concat(organic, F.lit(', "answerBox": {"link": "https://c.example"}}'))).when(i % 5 == 1, '{"message": "none"}').when(i % 5 == 2, F.concat(organic, F.lit("}"))).when(i % 5 == 3, '{"organic": []}').otherwise("not json")
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("q"), i.cast("string")).alias("query"), body.alias("body"), F.lit("2024-01-01T00:00:00").alias("scraped_at"))
    return search.parsed_responses(raw).select("query", "ord", "url", "title", "display_url", "description")


RESPONSES = """
WITH o AS (SELECT page_id, '{"organic": [{"link": "https://a' || page_id || '.example/", "title": "A", "domain": "a.example", "snippet": "x"}, {"title": "no link"}, {"link": "https://b' || page_id || '.example/p", "title": "B", "position": 3}]' AS organic FROM pages),
r AS (SELECT 'q' || page_id AS query, CASE page_id % 5 WHEN 0 THEN organic || ', "answerBox": {"link": "https://c.example"}}' WHEN 1 THEN '{"message": "none"}' WHEN 2 THEN organic || '}' WHEN 3 THEN '{"organic": []}' END AS body FROM o),
x AS (SELECT query, CAST(k AS BIGINT) AS ord, json_extract(body, '$.organic[' || k || ']') AS x FROM r, range(4) AS t(k) WHERE body IS NOT NULL)
SELECT query, ord, x->>'link' AS url, coalesce(x->>'title', '') AS title, coalesce(x->>'domain', '') AS display_url, coalesce(x->>'snippet', '') AS description FROM x WHERE x->>'link' <> ''"""


_FIRST = "first AS (SELECT url, min(qord) AS first FROM e GROUP BY url)"
_YIELD = f"y AS (SELECT qord, {sql.without_negative('query')} AS query, count(*) AS urls, count_if(qord = first) AS new FROM e JOIN first USING (url) GROUP BY qord, e.query)"
_KEY = "lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) || '|api'"
QUERIES = {
    "first_urls": (first_urls, f"WITH {EVENTS} SELECT min(ord) AS ord, min_by(qord, ord) AS qord, min_by(query, ord) AS query, url FROM e GROUP BY url"),
    "query_limit": (query_limit, f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS k FROM e) SELECT ord, qord, query, url FROM r WHERE k <= 10"),
    "query_yield": (query_yield, f"WITH {EVENTS}, {_FIRST}, {_YIELD} SELECT *, urls > 0 AND new / urls < 0.25 AS overlap FROM y"),
    "yield_contacts": (yield_contacts, f"WITH {EVENTS}, {_FIRST}, {_YIELD}, c AS (SELECT {sql.without_negative('query')} AS query, count(*) AS contacts FROM e WHERE ord % 5 = 0 AND (ord % 2 = 0 OR ord % 3 = 0) GROUP BY 1) SELECT y.*, coalesce(contacts, 0) AS contacts FROM y LEFT JOIN c USING (query)"),
    "fresh_urls": (fresh_urls, f"WITH {EVENTS}, k AS (SELECT *, {_KEY} AS query_key FROM e) SELECT ord, query_key, url FROM k WHERE ord % 3 > 0 AND NOT EXISTS (SELECT 1 FROM k s WHERE s.ord % 3 = 0 AND s.query_key = k.query_key AND s.url = k.url)"),
    "unscraped_urls": (unscraped_urls, f"WITH {EVENTS}, d AS (SELECT url, max(ord) AS o FROM e WHERE ord % 10 = 0 GROUP BY url) SELECT ord, url FROM e WHERE url NOT IN (SELECT url FROM d WHERE o % 6 IN (0, 2, 4))"),
    "url_origins": (url_origins, f"WITH {EVENTS}, o AS (SELECT url, min_by(query, ord) AS q FROM e WHERE ord % 4 = 0 GROUP BY url) SELECT ord, url, coalesce(q, '') AS search_query FROM e LEFT JOIN o USING (url)"),
    "latest_status": (latest_status, f"WITH {EVENTS} SELECT url, max(ord) AS ord, max_by(ord % 5, ord) AS contacts_found FROM e GROUP BY url"),
    "inserted_results": (inserted_results, f"WITH {EVENTS} SELECT min(ord) AS ord, url, min_by(query, ord) AS query FROM e WHERE url NOT IN (SELECT url FROM e WHERE ord % 50 = 0) GROUP BY url"),
    "cache_misses": (cache_misses, f"WITH {EVENTS} SELECT DISTINCT 'api_' || query || '_10' AS cache_key FROM e WHERE NOT contains(query, 'Hotel 1')"),
    "page_streaks": (
        page_streaks,
        """WITH p AS (SELECT event_type AS query_key, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS page, user_id AS url FROM events),
f AS (SELECT query_key, url, min(page) AS first FROM p GROUP BY ALL),
g AS (SELECT query_key, page, count_if(page = first) AS fresh FROM p JOIN f USING (query_key, url) GROUP BY ALL),
i AS (SELECT *, sum(CASE WHEN fresh > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_key ORDER BY page) AS island FROM g),
s AS (SELECT query_key, page, fresh, CAST(sum(CASE WHEN fresh = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_key, island ORDER BY page) AS BIGINT) AS streak FROM i)
SELECT *, streak >= 2 AS exhausted FROM s""",
    ),
    "batch_fresh": (batch_fresh, f"WITH {EVENTS}, f AS (SELECT 'q' || (qord % 20) AS query_key, CAST(ord % 30 AS INTEGER) AS page, CAST(ord AS INTEGER) AS pos, url FROM e), m AS (SELECT query_key, url, min(page) AS page FROM f GROUP BY ALL) SELECT query_key, page, pos, url FROM f JOIN m USING (query_key, url, page) WHERE NOT EXISTS (SELECT 1 FROM f s WHERE s.pos % 11 = 0 AND s.query_key = f.query_key AND s.url = f.url)"),
    "typed_queries": (typed_queries, f"WITH {EVENTS} SELECT DISTINCT query, CASE WHEN contains(query, 'Hotel 2') THEN {sql.without_negative('query')} ELSE query END AS typed FROM e"),
    "expanded_queries": (
        expanded,
        """WITH c AS (SELECT DISTINCT n_name AS city FROM nation), s AS (SELECT DISTINCT lower(c_mktsegment) AS segment FROM customer),
q AS (SELECT 0 AS t, segment, city, segment || ' ' || city || ' email 2024' AS query FROM s, c UNION ALL SELECT 1, segment, city, 'kontak ' || segment || ' 2024' FROM s, c),
f AS (SELECT query, min({'t': t, 's': segment, 'c': city}) AS place FROM q GROUP BY query)
SELECT row_number() OVER (ORDER BY place) - 1 AS ord, query FROM f""",
    ),
    "api_responses": (responses, RESPONSES),
}
