"""The whole way from queries to published company rows, one action for each sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, query_text
from ..functions.text import scrape_status
from ..operators import blocklist, collapse, extract, search
from ..sinks import publish
from ..sinks.tables import discard, written
from ..sources import fetch, search_api
from ..sources.files import table_or_empty
from ..streaming.resume import State

ENGINE = "api"
CACHE = "cache_key string, query string, results array<struct<ord:bigint,url:string,title:string,display_url:string,description:string>>"


def quiet(line: str) -> None:
    """Says nothing."""


@dataclass
class Options:
    results: int = 10
    negative_operators: bool = True
    emails_only: bool = False
    high_confidence: bool = False
    guess_email: bool = False
    drop_free_mail: bool = False
    follow: bool = True
    respect_robots: bool = True
    skip_scraped: bool = False
    resume: bool = False
    cache: str | None = None  # folder of answers that came before
    workers: int = fixed.MAX_WORKERS
    tasks: int | None = None  # hosts fetched at once, in place of the clamped workers
    delay: float = 2.0
    checkpoint_every: int = 0  # pages between partial files; 0: none
    credit_gate: int = fixed.CREDIT_GATE
    confirm: Callable[[int], bool] = field(default=lambda credits: False)  # asked when a batch costs over credit_gate
    say: Callable[[str], None] = quiet


def sent(queries: DataFrame, negative: bool = True) -> DataFrame:
    """queries (qord, query_text) with query: as sent, with -site: operators for the domains that flood results."""
    q = F.col("query_text")
    return queries.withColumn("query", query_text.with_negative_operators(q, F.array(*map(F.lit, fixed.NEGATIVE_DOMAINS))) if negative else q)


def cost(n_queries: int, results: int) -> int:
    return n_queries * (1 if results <= 10 else 2)


def key_of(spark: SparkSession, query: str) -> str:
    """The name under which a query's progress is remembered."""
    return spark.range(1).select(query_text.key(F.lit(query), F.lit(ENGINE))).first()[0]


def _asked(spark: SparkSession, queries: list[str], options: Options) -> DataFrame:
    """(qord, query_text, query, query_key, num, cache_key): what is typed, what is sent, and under which names it is remembered."""
    typed = spark.createDataFrame(list(enumerate(dict.fromkeys(queries))), "qord long, query_text string")
    rows = sent(typed, options.negative_operators)
    num = query_text.request_size(F.col("query"), F.lit(options.results)).cast("int")
    return rows.withColumns({"query_key": query_text.key(F.col("query_text"), F.lit(ENGINE)), "num": num, "cache_key": search_api.cache_key(ENGINE, F.col("query"), options.results)})


def _resumable(asked: DataFrame, state: State) -> DataFrame:
    """asked queries that aren't exhausted, with where each goes on and the URLs that it has brought."""
    seen = state.read("seen_urls").groupBy("query_key").agg(F.collect_list("url").alias("seen"))
    rows = asked.join(state.read("query_state").select("query_key", "next_page", "empty_streak", "exhausted_at"), "query_key", "left").join(seen, "query_key", "left")
    none = F.array().cast("array<string>")
    return rows.where("exhausted_at IS NULL").withColumns({"next_page": F.greatest(F.lit(1), F.coalesce("next_page", F.lit(1))), "empty_streak": F.coalesce("empty_streak", F.lit(0)), "seen": F.coalesce("seen", none)}).drop("exhausted_at")


def answers(spark: SparkSession, queries: list[str], post: search_api.Post, key: str, options: Options, state: State | None = None) -> DataFrame:
    """(qord, ord, query, url, title, display_url, description) of the queries' results, from the cache or the API, and what state asks for.

    To resume passes by the cache. What came before the credit ended is kept."""
    asked = written(_asked(spark, queries, options))
    resume = options.resume and state is not None
    columns = ("url", "title", "display_url", "description")
    known = None
    if options.cache and not resume:
        cache = table_or_empty(spark, options.cache, CACHE)
        known = written(search_api.from_cache(asked, cache).join(asked.select("query", "qord"), "query"))
        wanted = search.cache_misses(asked, cache)
    else:
        wanted = _resumable(asked, state) if resume else asked
    price = cost(wanted.count(), options.results)
    if price > options.credit_gate and not options.confirm(price):
        raise SystemExit("declined: the searches would cost too much")
    found = written(search_api.walked(wanted, post, key, options.results, resume=resume))
    if found.where(F.col("outcome") == search_api.AUTH).count():
        raise search_api.AuthError(search_api.AUTH)
    if state is not None:
        pages = found.where("outcome IS NULL").withColumn("engine", F.lit(ENGINE)).withColumn("fresh", F.col("fresh") & F.col("url").isNotNull())
        state.record_results(pages, runs=1)
    rows = found.where("kept AND pos >= 0").select("qord", (F.shiftleft(F.col("page").cast("long"), 12) + F.col("pos")).alias("ord"), "query", *columns)
    if options.cache and not resume:
        # A query without results isn't stored: it is asked again.
        search_api.cacheable(rows.drop("qord"), ENGINE, options.results).select("cache_key", "query", "results").write.mode("append").parquet(options.cache)
        rows = rows.unionByName(known.select(*rows.columns))
    options.say(f"credits used: {found.agg(F.coalesce(F.sum('credits'), F.lit(0))).first()[0]}")
    return rows.withColumn("ord", F.shiftleft("qord", 32) + F.col("ord"))


def stage_search(spark: SparkSession, queries: list[str], post: search_api.Post, key: str, entries: DataFrame, options: Options, state: State | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages to scrape, yield rows): search, drop blocked hosts, keep each URL's first query."""
    rows = written(blocklist.kept(search.per_query_limit(answers(spark, queries, post, key, options, state), options.results), entries))
    found = search.first_by_url(rows).select("ord", "url", query_text.without_negative_operators(F.col("query")).alias("search_query"), "title", "display_url", "description")
    return found, search.yields(rows.select("qord", "query", "url"))


def _with_contact_pages(found: DataFrame, rules: DataFrame | None, fetch_pages, rules_of, options: Options) -> DataFrame:
    """found and what contact pages add. The pages' links are taken by rank, one round for each: a page follows its next link
    only if it has no address yet, no page is fetched twice, and robots rules hold for links as for pages."""
    links = written(extract.contact_links(found.where((F.size("emails") == 0) & F.col("error").isNull())))
    linked, served = None, None
    for rank in range(1, fixed.MAX_CONTACT_PAGES + 1):
        due = links.where(F.col("rank") == rank)
        if linked is not None:
            due = due.join(served, "url", "left_anti").join(linked.select(F.col("url").alias("target")), "target", "left_anti")
        targets = written(due.select("target").distinct().select(F.xxhash64("target").alias("ord"), F.col("target").alias("url")))
        if rules is not None:
            bases = rules.select("base")
            rules = written(rules.unionByName(rules_of(targets.where(fetch.base_of(F.col("url")) != "").join(bases, fetch.base_of(F.col("url")) == bases["base"], "left_anti"))))
            targets = fetch.with_robots(targets, rules).where("allowed").drop("allowed")
        new = written(extract.contacts(written(fetch_pages(targets)), drop_free_mail=options.drop_free_mail))
        linked = new if linked is None else linked.unionByName(new)
        served = links.join(linked.where(F.size("emails") > 0).select(F.col("url").alias("target")), "target", "left_semi").select("url").distinct()
    return extract.with_followed(found, linked)


def scraped(wanted: DataFrame, transport: fetch.Transport, options: Options, *, robots: DataFrame | None = None, renderer: fetch.Transport | None = None) -> DataFrame:
    """Contacts of wanted pages (ord, url), as a table: robots rules, fetch, extraction, contact pages, browser.

    robots: rules at hand (base, body, status); without them they are asked for, once for each base. Every answer is
    stored before it is read, so that a page is asked for once, whatever becomes of executors."""
    tasks = options.tasks or fetch.workers_of(options.workers)
    fetch_pages = lambda rows: fetch.pages(rows, transport, tasks=tasks, delay=options.delay)
    rules_of = lambda rows: fetch.robots_rules(rows, transport, tasks=tasks)
    wanted, refused, rules = wanted.select("ord", "url"), None, None
    if options.respect_robots:
        rules = robots.select("base", "body", "status") if robots is not None else written(rules_of(wanted))
        judged = written(fetch.with_robots(wanted, rules))
        wanted = judged.where("allowed").drop("allowed")
        refused = judged.where("NOT allowed").select("ord", "url", F.lit(None).cast("string").alias("html"), F.lit("blocked by robots.txt").alias("error"))
    pages = written(fetch_pages(wanted))
    found = written(extract.contacts(pages if refused is None else pages.unionByName(refused), drop_free_mail=options.drop_free_mail))
    found = _with_contact_pages(found, rules, fetch_pages, rules_of, options) if options.follow else found.withColumn("followed", F.array().cast("array<string>"))
    found = written(found)
    if renderer is not None:
        # What robots refused was never fetched, so it has no body that asks for a browser.
        need = written(found.where(extract.needs_render(found)).select("ord", "url"))
        made = written(fetch.pages(need, renderer, tasks=fetch.workers_of(options.workers, render=True), delay=0))
        found = written(extract.with_rendered(found, extract.contacts(made, drop_free_mail=options.drop_free_mail)))
    return found


def _told(found: DataFrame, options: Options) -> None:
    """What became of each page, said line by line if anyone listens."""
    if options.say is not quiet:
        for r in found.select("ord", "url", extract.outcome_line(found).alias("line")).orderBy("ord").toLocalIterator():
            options.say(f"{r.url}: {r.line}")


def _rows(found: DataFrame, origins: DataFrame, options: Options) -> DataFrame:
    named = found.join(origins, "url", "left").withColumn("search_query", F.coalesce("search_query", F.lit("")))
    return collapse.companies(named, guess_email=options.guess_email)


def stage_parse(
    spark: SparkSession, wanted: DataFrame, transport: fetch.Transport, options: Options, *, robots: DataFrame | None = None, state: State | None = None, renderer: fetch.Transport | None = None, output: str | Path | None = None
) -> DataFrame:
    """Company rows of pages: gates before the fetch, extraction, contact pages, collapse, filters.

    With checkpoint_every, pages go in waves, and after each the output's partial file has all rows so far, filters apart."""
    if options.skip_scraped and state is not None:
        wanted = search.unscraped(wanted, state.read("scraped_urls"))
    wanted = written(wanted)
    origins = wanted.select("url", "search_query") if "search_query" in wanted.columns else wanted.select("url", F.lit("").alias("search_query"))
    if options.checkpoint_every and output is not None:
        wave = ((F.row_number().over(Window.orderBy("ord", "url")) - 1) / options.checkpoint_every).cast("int")
        waves, found = written(wanted.withColumn("wave", wave)), None
        for k in range((waves.agg(F.max("wave")).first()[0] if not waves.isEmpty() else 0 or 0) + 1):
            new = scraped(waves.where(F.col("wave") == k), transport, options, robots=robots, renderer=renderer)
            found = new if found is None else found.unionByName(new)
            publish.write_partial(collapse.ordered(_rows(found, origins, options)), output)
            _told(new, options)
        discard(waves)
    else:
        found = scraped(wanted, transport, options, robots=robots, renderer=renderer)
        _told(found, options)
    if state is not None:
        n = F.size("emails") + F.size("whatsapp") + F.size("phones")
        state.record_scraped(found.select("url", scrape_status(F.col("error")).alias("status"), n.alias("contacts_found")))
    rows = _rows(found, origins, options)
    if options.emails_only:
        return collapse.emails_only(rows)
    return collapse.high_confidence(rows) if options.high_confidence else rows


def published(rows: DataFrame, path: str | Path) -> Path:
    """The final CSV; partial files of earlier runs go if it has rows."""
    out = publish.write_csv(collapse.ordered(rows), path)
    publish.remove_partials(path, publish.count_rows(out))
    return out
