"""Command line: from queries to company rows, companies from stored pages, an audit of a CSV, encrypted files, progress of searches.

A host program may inject its own transports; otherwise pages and the search API are asked over HTTP."""

from __future__ import annotations

import argparse
import getpass
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import audit, blocklist, collapse, extract, search
from ..sinks import crypto, publish
from ..sinks.tables import release
from ..sources import fetch, files, http, search_api
from ..streaming.resume import State
from . import pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kontaktor")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="search, extract contacts, publish, in one run")
    r.add_argument("query", help="a query, or a file of queries (--batch) or of URLs (--skip-search)")
    r.add_argument("-o", "--output", default="contacts.csv")
    r.add_argument("--batch", action="store_true")
    r.add_argument("--skip-search", action="store_true")
    r.add_argument("--expand", metavar="PATH", help="fan-out configuration, in place of the query")
    r.add_argument("--dry-run", action="store_true", help="search only, print the URLs")
    r.add_argument("--api-url", default=os.environ.get("SEARCH_API_URL", ""))
    r.add_argument("--num-results", type=int, default=10)
    r.add_argument("--credit-budget", type=int, default=fixed.CREDIT_GATE, help="ask before searches that cost more")
    r.add_argument("--yes", action="store_true", help="don't ask")
    r.add_argument("--cache", metavar="FOLDER", help="answers of earlier runs")
    r.add_argument("--save-urls", metavar="PATH")
    r.add_argument("--save-yield", metavar="PATH")
    r.add_argument("--blocklist")
    r.add_argument("--no-negative-ops", action="store_true")
    r.add_argument("--state", metavar="FOLDER", help="what earlier runs searched and scraped")
    r.add_argument("--continue", dest="resume", action="store_true", help="go on where the queries ended")
    r.add_argument("--restart", action="store_true", help="forget the queries' progress first")
    r.add_argument("--skip-scraped", action="store_true")
    r.add_argument("--render", action="store_true", help="ask a browser for pages that scripts fill")
    r.add_argument("--scrape-delay", type=float, default=2.0)
    r.add_argument("--workers", type=int, default=1, help=f"hosts at once, {fixed.MAX_WORKERS} at most")
    r.add_argument("--ignore-robots", action="store_true")
    r.add_argument("--guess-email", action="store_true")
    r.add_argument("--no-free-mail", action="store_true")
    r.add_argument("--no-follow", action="store_true")
    r.add_argument("--checkpoint-every", type=int, default=fixed.CHECKPOINT_EVERY)
    kept = r.add_mutually_exclusive_group()
    kept.add_argument("--emails-only", action="store_true")
    kept.add_argument("--high-confidence-only", action="store_true")
    r.add_argument("--encrypt", action="store_true")
    c = sub.add_parser("companies", help="stored pages (Parquet: url, html) to a CSV of company rows")
    c.add_argument("pages")
    c.add_argument("output")
    c.add_argument("--blocklist")
    c.add_argument("--guess-email", action="store_true")
    c.add_argument("--no-free-mail", action="store_true")
    c.add_argument("--no-follow", action="store_true")
    only = c.add_mutually_exclusive_group()
    only.add_argument("--emails-only", action="store_true")
    only.add_argument("--high-confidence-only", action="store_true")
    c.add_argument("--encrypt", action="store_true")
    a = sub.add_parser("audit", help="quality of CSVs of company rows")
    a.add_argument("files", nargs="+")
    a.add_argument("--blocklist")
    a.add_argument("--config")
    e = sub.add_parser("expand", help="queries of a fan-out configuration")
    e.add_argument("config")
    d = sub.add_parser("decrypt", help="an encrypted CSV")
    d.add_argument("source")
    d.add_argument("--stdout", action="store_true")
    d.add_argument("--preview", type=int)
    d.add_argument("--output")
    s = sub.add_parser("progress", help="searches that can go on")
    s.add_argument("state")
    s.add_argument("--restart", metavar="KEY")
    return p


def _search(spark: SparkSession, o: argparse.Namespace, options: pipeline.Options, entries, state: State | None, post: search_api.Post | None):
    """(pages to scrape, yield rows or None)."""
    if o.skip_search:
        return files.url_list(spark, o.query), None
    if o.expand:
        queries = [r.query for r in search.expanded(files.fanout(spark, o.expand)).orderBy("ord").collect()]
    else:
        queries = [r.query for r in files.queries(spark, o.query).orderBy("ord").collect()] if o.batch else [o.query]
    if not queries:
        raise SystemExit("no queries")
    if o.restart and state is not None:
        for q in queries:
            state.reset(pipeline.key_of(spark, q))
    if post is None and not o.api_url:
        raise SystemExit("--api-url, or SEARCH_API_URL, must name the search API")
    found, rows = pipeline.stage_search(spark, queries, post or http.poster(o.api_url), os.environ.get("SEARCH_API_KEY", ""), entries, options, state)
    if o.save_urls:
        publish.export_results(found.orderBy("ord").drop("ord"), o.save_urls)
    return found, rows


def run(spark: SparkSession, o: argparse.Namespace, post: search_api.Post | None, transport: fetch.Transport | None, renderer: fetch.Transport | None) -> int:
    if o.render and renderer is None:
        raise SystemExit("--render needs a program that brings a browser")
    for p in publish.partials(o.output):
        print(f"rows of an earlier run: {p} ({publish.count_rows(p)}); this run replaces them")
    entries = files.blocklist(spark, o.blocklist) if o.blocklist else spark.createDataFrame([], "domain string")
    state = State(spark, o.state) if o.state else None
    if (o.resume or o.restart or o.skip_scraped) and state is None:
        raise SystemExit("--continue, --restart and --skip-scraped need --state")
    options = pipeline.Options(
        results=o.num_results, negative_operators=not o.no_negative_ops, emails_only=o.emails_only, high_confidence=o.high_confidence_only, guess_email=o.guess_email, drop_free_mail=o.no_free_mail,
        follow=not o.no_follow, respect_robots=not o.ignore_robots, skip_scraped=o.skip_scraped, resume=o.resume, cache=o.cache, workers=o.workers, delay=o.scrape_delay, checkpoint_every=o.checkpoint_every,
        credit_gate=o.credit_budget, confirm=lambda n: o.yes or input(f"about {n} credits; go on? [y/N] ").strip().lower() == "y", say=print,
    )
    found, yields = _search(spark, o, options, entries, state, post)
    if o.dry_run:
        for r in found.orderBy("ord").toLocalIterator():
            print(r.url)
        return 0
    rows = pipeline.stage_parse(spark, found, transport or http.get, options, state=state, renderer=renderer if o.render else None, output=o.output)
    out = pipeline.published(rows, o.output)
    if o.save_yield and yields is not None:
        publish.write_yield(search.with_contacts(yields, rows), o.save_yield)
    n = publish.count_rows(out)
    if o.encrypt:
        out = crypto.encrypt_file(spark, out, f"{out}.enc", crypto.password_from(None, ask=getpass.getpass, confirm=True), delete_source=True)
    print(f"{n} rows: {out}")
    release(spark)
    return 0 if n else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None, *, post: search_api.Post | None = None, transport: fetch.Transport | None = None, renderer: fetch.Transport | None = None) -> int:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kontaktor").getOrCreate()
    if o.command == "run":
        return run(spark, o, post, transport, renderer)
    entries = files.blocklist(spark, o.blocklist) if getattr(o, "blocklist", None) else spark.createDataFrame([], "domain string")
    if o.command == "companies":
        pages = spark.read.parquet(o.pages)
        pages = blocklist.kept(pages.withColumn("ord", F.col("page_id")) if "page_id" in pages.columns else pages.withColumn("ord", F.xxhash64("url")), entries)
        found = extract.contacts(pages.select("ord", "url", "html"), drop_free_mail=o.no_free_mail)
        if not o.no_follow:
            found = extract.with_followed(found, found).drop("followed")
        rows = collapse.companies(found.withColumn("search_query", F.lit("")), guess_email=o.guess_email)
        rows = collapse.emails_only(rows) if o.emails_only else collapse.high_confidence(rows) if o.high_confidence_only else rows
        out = pipeline.published(rows, o.output)
        if o.encrypt:
            out = crypto.encrypt_file(spark, out, f"{out}.enc", crypto.password_from(None, ask=getpass.getpass, confirm=True), delete_source=True)
        print(out)
        return 0 if publish.count_rows(out) or o.encrypt else 1
    if o.command == "audit":
        places = audit.vocabulary(spark, files.cities(spark, o.config) if o.config else None)
        for f in o.files:
            counts = audit.audited(files.companies(spark, f), entries, places)
            print(f, counts.first().asDict(), audit.percentages(counts).first().asDict())
        return 0
    if o.command == "expand":
        for r in search.expanded(files.fanout(spark, o.config)).orderBy("ord").toLocalIterator():
            print(r.query)
        return 0
    if o.command == "decrypt":
        data = crypto.decrypt_file(spark, o.source, crypto.password_from(None, ask=getpass.getpass), o.output)
        if o.preview is not None:
            print(crypto.preview(data, o.preview))
        elif o.stdout:
            sys.stdout.write(data.decode("utf-8-sig"))
        return 0
    state = State(spark, o.state)
    if o.restart:
        state.reset(o.restart)
    state.listed().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
