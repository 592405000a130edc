"""Search results from an API, as a Spark data source with an injected transport, and from result pages."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import dom, fixed, urls
from ..functions.text import collapse, text_or_empty
from .fetch import Transport, bounded, decode

Post = Callable[[dict, dict], tuple[int, str]]
BODY = "query string, page int, status int, body string"


class AuthError(Exception):
    """The key isn't accepted; the batch ends."""


class OutOfCredit(Exception):
    """No more calls; what came so far is kept."""


def payload(query: str, num: int, page: int = 1) -> dict:
    return {"q": query, "gl": "id", "hl": "id", "num": num} | ({"page": page} if page > 1 else {})


def call(post: Post, key: str, query: str, num: int, page: int = 1, *, attempts: int = 3, sleep: Callable[[float], None] = lambda s: None) -> str | None:
    """The answer's body, or None if the query is to be skipped. Server errors and silence are tried again."""
    for k in range(attempts):
        try:
            status, body = post(payload(query, num, page), {"X-API-KEY": key})
        except OSError:
            status, body = 0, ""
        if status == 200:
            return body
        if status in (401, 403):
            raise AuthError(status)
        if status == 429:
            raise OutOfCredit(query)
        if status and status < 500:
            return None
        if k < attempts - 1:
            sleep(2.0 * 2**k)
    return None


def search_many(post: Post, key: str, queries: list[str], num: int) -> list[tuple[str, int, str]]:
    """(query, page, body) of each query that was answered, up to the one that found no credit left."""
    if not key:
        raise AuthError("a key is required")
    out = []
    for q in queries:
        try:
            if (body := call(post, key, q, num)) is not None:
                out.append((q, 1, body))
        except OutOfCredit:
            break
    return out


FOUND = "qord long, query_text string, query string, query_key string, page int, pos int, url string, title string, display_url string, description string, fresh boolean, kept boolean, credits int, outcome string"
AUTH, DRY = "the key isn't accepted", "no credit left"


def _results(body: str) -> list[tuple]:
    """(url, title, display_url, description) of an answer's organic results that have a link."""
    try:
        organic = json.loads(body).get("organic") or []
    except (ValueError, AttributeError):
        return []
    return [tuple(x.get(k) or "" for k in ("link", "title", "domain", "snippet")) for x in organic if isinstance(x, dict) and x.get("link")]


def _walk(post: Post, key: str, q: dict, most: int, resume: bool) -> Iterator[tuple]:
    """Rows of FOUND for one query: each result, and a row of its own (pos -1) for each page that was paid for."""
    page, streak, seen, kept = (q["next_page"], q["empty_streak"], set(q["seen"]), 0) if resume else (1, 0, set(), 0)
    head, cost = (q["qord"], q["query_text"], q["query"], q["query_key"]), 1 if q["num"] <= 10 else 2
    while kept < most:
        try:
            body = call(post, key, q["query"], q["num"], page)
        except AuthError:
            yield *head, page, -1, None, None, None, None, False, False, 0, AUTH
            return
        except OutOfCredit:
            yield *head, page, -1, None, None, None, None, False, False, 0, DRY
            return
        if body is None:
            return
        yield *head, page, -1, None, None, None, None, False, False, cost, None
        found = _results(body)
        fresh = [r[0] not in seen for r in found]  # equal URLs within a page all count
        for pos, (r, new) in enumerate(zip(found, fresh, strict=True)):
            seen.add(r[0])
            yield *head, page, pos, *r, new, (new or not resume) and kept < most, 0, None
            kept += new or not resume
        if not resume or not found:
            return
        page, streak = page + 1, 0 if any(fresh) else streak + 1
        if streak >= fixed.STALE_PAGES:
            return


def walked(queries: DataFrame, post: Post, key: str, most: int, *, resume: bool = False) -> DataFrame:
    """FOUND for queries (qord, query_text, query, query_key, num; to resume also next_page, empty_streak, seen): one page each,
    or from next_page on until `most` URLs are new or two pages in a row bring none.

    One task asks, query after query, since calls cost money and the first that finds no credit ends all."""
    if not key:
        raise AuthError("a key is required")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q in b.to_dict("records"):
                rows = list(_walk(post, key, q, most, resume))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
                if rows and rows[-1][-1]:
                    return

    return queries.repartition(1).sortWithinPartitions("qord").mapInPandas(run, FOUND)


class _Part(InputPartition):
    def __init__(self, query: str):
        super().__init__(query)


class _Reader(DataSourceReader):
    def __init__(self, post: Post, options: dict):
        self.post, self.options = post, options

    def partitions(self) -> list[_Part]:
        return [_Part(q) for q in json.loads(self.options["queries"])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        body = call(self.post, self.options.get("key", ""), partition.value, int(self.options.get("num", 10)))
        if body is not None:
            yield partition.value, 1, 200, body


def data_source(post: Post) -> type[DataSource]:
    """A data source class that asks `post`: spark.dataSource.register(it), then format("contact_search") with the options
    queries (a JSON list), key and num. Each query is a partition of its own."""

    class ContactSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "contact_search"

        def schema(self) -> str:
            return BODY

        def reader(self, schema) -> DataSourceReader:
            return _Reader(post, dict(self.options))

    return ContactSearch


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers of the API."""
    return spark.read.schema(BODY).parquet(path)


def cache_key(engine: str, query: Column, num: int) -> Column:
    return F.concat(F.lit(f"{engine}_"), query, F.lit(f"_{num}"))


def cacheable(results: DataFrame, engine: str, num: int) -> DataFrame:
    """(cache_key, results) to append to a cache: one row for each query that brought results; others are asked again."""
    columns = [c for c in results.columns if c not in ("query", "ord")]
    grouped = results.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", *columns))).alias("results"))
    return grouped.where(F.size("results") > 0).select(cache_key(engine, F.col("query"), num).alias("cache_key"), "query", "results")


def from_cache(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Results of wanted (cache_key) that a cache holds; a resumed search doesn't ask the cache."""
    return cache.join(wanted.select("cache_key").distinct(), "cache_key", "left_semi").select("query", F.explode("results").alias("x")).select("query", "x.*")


def needs_script(html: Column) -> Column:
    """A result page that only a browser's scripts could fill."""
    return html.contains("enablejs") | html.contains("/httpservice/retry")


def results_of_pages(raw: DataFrame, *, items: bool = False) -> DataFrame:
    """raw: query, page, html of result pages. (query, ord, url, title, display_url, description) of their results, links unwrapped:
    items: those in an engine's result items; else, where the markup isn't known, every labelled link that leads off the engine."""
    pages = raw.where(~needs_script(text_or_empty(F.col("html"))))
    at = (F.col("page") * 1000 + F.col("pos")).cast("long").alias("ord")
    if items:
        x = pages.select("query", "page", F.posexplode(dom.results(F.col("html"))).alias("pos", "x")).where("x.href <> ''")
        return x.select("query", at, urls.unwrapped(F.col("x.href")).alias("url"), "x.title", "x.display_url", "x.description")
    x = pages.select("query", "page", F.explode(dom.facts(F.col("html"), F.lit("https://search.invalid/"))["links"]).alias("l")).select("query", "page", "l", F.col("l.pos").alias("pos"))
    rows = x.select("query", at, urls.unwrapped(F.col("l.target")).alias("url"), collapse(text_or_empty(F.col("l.label"))).alias("title"), F.lit("").alias("display_url"), F.lit("").alias("description"))
    return rows.where(rows["url"].rlike("(?i)^https?://") & (urls.host(rows["url"]) != "search.invalid") & (rows["title"] != ""))


def result_pages(queries: DataFrame, get: Transport, most: int, *, address: Callable[[str, int], str], home: str | None = None, pause: float = 2.0, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(qord, query, page, html) of the pages that `most` results of each query (qord, query) need; address gives a page's URL from
    the query and the place of its first result. home is asked first, so that the engine knows its guest; a first page
    without results is asked for once more after another such visit. Busy answers (429, 503) and silence are tried again."""
    starts = [fixed.RESULTS_PER_PAGE * k + 1 for k in range(-(-most // fixed.RESULTS_PER_PAGE))]

    def page_of(url: str) -> str | None:
        for k in range(attempts):
            answer = get(url)
            if not answer.failure and answer.status < 400:
                return decode(bounded(answer.body) or b"", answer.headers.get("Content-Type", ""))
            if not answer.failure and answer.status not in (429, 503):
                return None
            if k < attempts - 1:
                sleep(pause * 2**k)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = False
        for b in batches:
            for qord, query in zip(b["qord"], b["query"], strict=True):
                out = []
                for k, first in enumerate(starts):
                    if home and not met:
                        get(home)
                        met = True
                    html = page_of(address(query, first))
                    if k == 0 and html is not None and not dom.result_items(html) and home:
                        get(home)
                        html = page_of(address(query, first))
                    if html is None:
                        break
                    out.append((qord, query, k + 1, html))
                    if not dom.result_items(html):
                        break
                yield pd.DataFrame(out, columns=["qord", "query", "page", "html"])

    return queries.select("qord", "query").repartition(1).sortWithinPartitions("qord").mapInPandas(run, "qord long, query string, page int, html string")
