"""Resumable search: which URLs of a page are new, when a query is exhausted, and the tables that remember it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators import search
from ..sources.files import table_or_empty

QUERY_STATE = "query_key string, query_text string, engine string, next_page int, total_seen long, run_count long, empty_streak int, exhausted_at string, first_run_at string, last_run_at string"
SEEN = "query_key string, url string, first_seen string"
SCRAPED = "url string, scraped_at string, status string, contacts_found long"

_FRESH = "query_key string, page int, pos int, url string, streak int, exhausted boolean"
_KEPT = "next_page int, streak int, exhausted boolean, seen array<string>"


def _take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    next_page, streak, exhausted, seen = state.get if state.exists else (1, 0, False, [])
    known, rows = set(seen), pd.concat(list(batches))
    out = []
    for page, own in rows.sort_values(["page", "pos"]).groupby("page"):
        if exhausted or page < next_page:
            continue
        fresh = own[~own["url"].isin(known)]  # equal URLs within a page all count
        known.update(fresh["url"])
        streak = 0 if len(fresh) else streak + 1
        exhausted = streak >= fixed.STALE_PAGES
        next_page = int(page) + 1
        out.append(fresh.assign(query_key=key[0], streak=streak, exhausted=exhausted))
    state.update((next_page, streak, exhausted, sorted(known)))
    if out:
        yield pd.concat(out)[["query_key", "page", "pos", "url", "streak", "exhausted"]]


def fresh_urls(feed: DataFrame) -> DataFrame:
    """A stream of pages (query_key, page, pos, url) to the URLs that no earlier page of the query had. A query whose last two
    pages brought nothing is exhausted: later pages are passed over. The state of a query holds its own URLs only."""
    return feed.groupBy("query_key").applyInPandasWithState(_take, _FRESH, _KEPT, "append", GroupStateTimeout.NoTimeout)


def fresh_urls_of_batch(feed: DataFrame, seen: DataFrame) -> DataFrame:
    """The same over a table: the page of a URL's first sight is a grouped minimum, URLs seen in earlier runs go."""
    first = feed.groupBy("query_key", "url").agg(F.min("page").alias("page"))
    rows = feed.join(first, ["query_key", "url", "page"])
    return search.fresh(rows, seen)


class State:
    """The three tables, each a folder of numbered versions; a version is whole before it is the last, and readers take the last.

    URLs seen and progress change together: a version of seen_urls counts once query_state has one of that number, so a
    crash between the two changes nothing. The version before the last stays for readers at work; older ones go."""

    TABLES = {"query_state": QUERY_STATE, "seen_urls": SEEN, "scraped_urls": SCRAPED}

    def __init__(self, spark: SparkSession, folder: str, *, now=lambda: datetime.now().isoformat(timespec="seconds")):
        self.spark, self.folder, self.now = spark, folder.rstrip("/"), now

    def _versions(self, table: str) -> list[int]:
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        fs = path.getFileSystem(hadoop)
        if not fs.exists(path):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n, p in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _last(self, table: str) -> int:
        versions = self._versions(table)
        if table == "seen_urls":
            whole = self._last("query_state")
            versions = [v for v in versions if v <= whole]
        return versions[-1] if versions else 0

    def read(self, table: str) -> DataFrame:
        return table_or_empty(self.spark, f"{self.folder}/{table}/v={self._last(table)}", self.TABLES[table])

    def _publish(self, table: str, rows: DataFrame, number: int | None = None) -> None:
        last = self._last(table)
        rows.select(*self.read(table).columns).write.mode("overwrite").parquet(f"{self.folder}/{table}/v={number or last + 1}")
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for v in self._versions(table):
            if v < last:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/v={v}")
                path.getFileSystem(hadoop).delete(path, True)

    def record_results(self, pages: DataFrame, *, runs: int = 0) -> None:
        """pages: query_key, query_text, engine, page, url, fresh (boolean). Totals grow, the streak follows the last pages;
        runs: how many runs of each query this is."""
        now, old = self.now(), self.read("query_state")
        per_page = pages.groupBy("query_key", "page").agg(F.count_if("fresh").alias("fresh"), F.first("query_text").alias("query_text"), F.first("engine").alias("engine"))
        stored = per_page.join(old.select("query_key", F.col("empty_streak").alias("stored")), "query_key", "left")
        marked = search.streaks(stored, stored="stored")
        new = marked.groupBy("query_key").agg(F.max_by("query_text", "page").alias("query_text"), F.max_by("engine", "page").alias("engine"), (F.max("page") + 1).cast("int").alias("np"), F.sum("fresh").alias("more"), F.max_by("streak", "page").cast("int").alias("streak"))
        both = new.join(old.drop("query_text", "engine"), "query_key", "left")
        upsert = both.select(
            "query_key", "query_text", "engine", F.greatest("np", F.coalesce("next_page", F.lit(1))).alias("next_page"), (F.coalesce("total_seen", F.lit(0)) + F.col("more")).alias("total_seen"),
            F.greatest(F.coalesce("run_count", F.lit(0)) + runs, F.lit(1)).alias("run_count"), F.col("streak").alias("empty_streak"), F.when(F.col("streak") >= fixed.STALE_PAGES, F.coalesce("exhausted_at", F.lit(now))).otherwise(F.col("exhausted_at")).alias("exhausted_at"),
            F.coalesce("first_run_at", F.lit(now)).alias("first_run_at"), F.lit(now).alias("last_run_at"),
        )
        seen = pages.where("fresh").select("query_key", "url").distinct().withColumn("first_seen", F.lit(now))
        fresh = seen.join(self.read("seen_urls"), ["query_key", "url"], "left_anti")
        number = self._last("query_state") + 1
        self._publish("seen_urls", self.read("seen_urls").unionByName(fresh), number)
        self._publish("query_state", old.join(upsert.select("query_key"), "query_key", "left_anti").unionByName(upsert))

    def _change(self, key: str, **columns) -> None:
        rows = self.read("query_state")
        self._publish("query_state", rows.withColumns({c: F.when(F.col("query_key") == key, v).otherwise(F.col(c)) for c, v in columns.items()}))

    def bump_run_count(self, key: str) -> None:
        self._change(key, run_count=F.col("run_count") + 1, last_run_at=F.lit(self.now()))

    def mark_exhausted(self, key: str) -> None:
        self._change(key, exhausted_at=F.lit(self.now()))

    def reset(self, key: str) -> None:
        """Forget one query, in both tables."""
        number = self._last("query_state") + 1
        for table in ("seen_urls", "query_state"):
            self._publish(table, self.read(table).where(F.col("query_key") != key), number)

    def record_scraped(self, rows: DataFrame) -> None:
        """rows: url, status, contacts_found; the latest of each URL stays."""
        fresh = rows.select("url", F.lit(self.now()).alias("scraped_at"), "status", F.col("contacts_found").cast("long").alias("contacts_found")).dropDuplicates(["url"])
        old = self.read("scraped_urls")
        self._publish("scraped_urls", old.join(fresh.select("url"), "url", "left_anti").unionByName(fresh))

    def listed(self) -> DataFrame:
        return self.read("query_state").orderBy(F.desc("last_run_at"), "query_key")


def checkpointed(stream: DataFrame, write, checkpoint: str, **trigger):
    """Start a stream whose every micro-batch goes to write(df, number); a failing snapshot doesn't stop it."""

    def each(df: DataFrame, number: int) -> None:
        try:
            write(df, number)
        except Exception as e:
            print(f"snapshot {number}: {type(e).__name__}: {e}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
