"""Blocklists: hosts that equal an entry or lie below it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, urls

#: A blocklist is a configuration file. Up to so many entries it is broadcast; beyond, the join shuffles by entry.
BROADCAST_ENTRIES = 100_000


def _entries(blocklist: DataFrame) -> DataFrame:
    """Distinct entries; the size of a broadcast is checked by counting one row more than the bound."""
    entries = blocklist.select(F.lower(F.trim("domain")).alias("domain")).where("domain <> ''").distinct()
    small = entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    return F.broadcast(entries) if small else entries


def hosts_matched(rows: DataFrame, blocklist: DataFrame, *, url: str = "url") -> DataFrame:
    """(host, domain): each distinct host of rows that is blocked, and the shortest entry it falls under.

    Hosts are made distinct first, and an entry must equal one of the host's suffixes: an equi-join of few rows."""
    hosts = rows.select(urls.host(F.col(url)).alias("host")).where("host <> ''").distinct()
    suffixes = hosts.select("host", F.explode(urls.host_suffixes(F.col("host"))).alias("domain"))
    hit = suffixes.join(_entries(blocklist), "domain")
    return hit.groupBy("host").agg(F.min(F.struct(F.length("domain").alias("n"), "domain")).alias("m")).select("host", F.col("m.domain").alias("domain"))


def tagged(rows: DataFrame, blocklist: DataFrame, *, url: str = "url") -> DataFrame:
    """rows and their host and the entry that blocks it, or null."""
    hit = hosts_matched(rows, blocklist, url=url).withColumnRenamed("domain", "blocked_by")
    return rows.withColumn("host", urls.host(F.col(url))).join(hit, "host", "left")


def kept(rows: DataFrame, blocklist: DataFrame, *, url: str = "url") -> DataFrame:
    """rows that no entry blocks, columns unchanged. Rows without a host stay."""
    return tagged(rows, blocklist, url=url).where("blocked_by IS NULL").select(*rows.columns)


def dropped(rows: DataFrame, blocklist: DataFrame, *, url: str = "url") -> DataFrame:
    """(host, n): blocked rows by full host."""
    return tagged(rows, blocklist, url=url).where("blocked_by IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"))


def top_domains(counts: DataFrame, blocklist: DataFrame, *, limit: int = fixed.MAX_NEGATIVE) -> DataFrame:
    """(domain, n): counts (host, n) rolled up to blocklist entries, the most frequent first; the fixed list without any."""
    of = counts.withColumn("url", F.concat(F.lit("http://"), F.col("host")))
    rolled = of.join(hosts_matched(of, blocklist), "host", "left").groupBy(F.coalesce("domain", "host").alias("domain")).agg(F.sum("n").alias("n"))
    top = rolled.orderBy(F.desc("n"), "domain").limit(limit)
    seed = counts.sparkSession.createDataFrame([(d, -k) for k, d in enumerate(fixed.NEGATIVE_DOMAINS[:limit])], "domain string, n long")
    none = top.agg(F.count("*").alias("found")).where("found = 0")
    return top.union(seed.join(F.broadcast(none), how="inner").select("domain", "n"))


def top_dropped(counts: DataFrame, limit: int = 8) -> DataFrame:
    return counts.orderBy(F.desc("n"), "host").limit(limit)


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
