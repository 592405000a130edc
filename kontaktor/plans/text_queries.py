"""Queries over strings made from the tables: numbers, addresses, query text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, phones, query_text, text, urls
from . import sql


def phone_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in seven spellings made from orders' keys, in one form, and what they can be."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, digits = F.col("o_orderkey"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    raw = (
        F.when(k % 7 == 0, F.concat(F.lit("0812-"), digits))
        .when(k % 7 == 1, F.concat(F.lit("+62 (812) "), digits))
        .when(k % 7 == 2, F.concat(F.lit("62081"), digits))
        .when(k % 7 == 3, F.concat(F.lit("81"), digits))
        .when(k % 7 == 4, F.concat(F.lit("0251 "), F.substring(digits, 2, 7)))
        .when(k % 7 == 5, F.concat(F.lit("971"), digits))
        .otherwise(F.lit(" n/a - "))
    )
    n = F.col("number")
    return o.select("o_orderkey", phones.normalized(raw).alias("number")).select("o_orderkey", "number", phones.is_mobile(n).alias("mobile"), phones.is_landline(n).alias("landline"), phones.is_plausible(n).alias("plausible"))


PHONES = f"""
WITH r AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS d FROM orders),
w AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '0812-' || d WHEN 1 THEN '+62 (812) ' || d WHEN 2 THEN '62081' || d WHEN 3 THEN '81' || d
  WHEN 4 THEN '0251 ' || substr(d, 2, 7) WHEN 5 THEN '971' || d ELSE ' n/a - ' END AS raw FROM r),
n AS (SELECT o_orderkey, {sql.phone("raw")} AS number FROM w)
SELECT o_orderkey, number, {sql.is_mobile("number")} AS mobile, {sql.is_landline("number")} AS landline, {sql.is_mobile("number")} OR {sql.is_landline("number")} AS plausible FROM n"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    q = F.concat(F.lit("Kontak  "), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, " Bali ").otherwise(" "), F.initcap("n_name"), F.when(F.col("c_custkey") % 3 == 0, " -site:Scribd.com site:x.example").otherwise(""))
    return c.select("c_custkey", q.alias("q"))


ASKED = "a AS (SELECT c_custkey, 'Kontak  ' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' Bali ' ELSE ' ' END || {title} || CASE WHEN c_custkey % 3 = 0 THEN ' -site:Scribd.com site:x.example' ELSE '' END AS q FROM customer JOIN nation ON c_nationkey = n_nationkey)"
ASKED = ASKED.replace("{title}", "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, domains = F.col("q"), F.array(*map(F.lit, ("", " Scribd.com", "x.example", "Y.example", "y.example", *fixed.NEGATIVE_DOMAINS)))
    n = F.col("c_custkey") % 150
    return _asked(spark, sf_dir).select(
        "c_custkey",
        query_text.key(q, F.lit("API")).alias("key"),
        query_text.with_negative_operators(q, domains).alias("sent"),
        query_text.without_negative_operators(q).alias("shown"),
        F.array_join(query_text.terms(q), ",").alias("terms"),
        query_text.credits(F.col("c_custkey"), n).cast("long").alias("credits"),
        query_text.request_size(q, n).cast("long").alias("size"),
    )


_DOMAINS = sql.array(("", " Scribd.com", "x.example", "Y.example", "y.example", *fixed.NEGATIVE_DOMAINS))
QUERY_TEXTS = f"""
WITH {ASKED}
SELECT c_custkey, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) || '|api' AS key, {sql.with_negative("q", _DOMAINS)} AS sent, {sql.without_negative("q")} AS shown,
  array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(q, '(?i)-?site:\\S+', ' ', 'g')), '[a-z0-9]+'), lambda w: w NOT IN {sql.strings(fixed.INTENT_WORDS)} AND length(w) > 2), ',') AS terms,
  CAST(c_custkey * CASE WHEN c_custkey % 150 <= 10 THEN 1 ELSE 2 END AS BIGINT) AS credits,
  CAST(CASE WHEN greatest(1, least(100, c_custkey % 150)) > 10 AND (contains(lower(q), 'site:') OR contains(lower(q), ' or ')) THEN 10 ELSE greatest(1, least(100, c_custkey % 150)) END AS BIGINT) AS size
FROM a"""


def query_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, sorted(fixed.LOCATIONS)))
    return _asked(spark, sf_dir).select("c_custkey", F.array_join(query_text.places(F.col("q"), words), ",").alias("places"), F.array_join(query_text.topics(F.col("q"), words), ",").alias("topics"))


_V = sql.array(sorted(fixed.LOCATIONS))
QUERY_PLACES = f"WITH {ASKED}, b AS (SELECT *, {_V} AS vocabulary FROM a) SELECT c_custkey, array_to_string({sql.places('q', 'vocabulary')}, ',') AS places, array_to_string({sql.topics('q', 'vocabulary')}, ',') AS topics FROM b"


def labels_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click labels, interstitials and error texts made from parts' names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    label = F.concat(F.when(k % 3 == 0, "Show  number ").when(k % 3 == 1, "Hubungi kami - kirim ").otherwise("lihat kontak "), "p_name", F.repeat(F.lit("x"), (k % 80).cast("int")))
    page = F.concat(F.when(k % 2 == 0, "Just a Moment... ").otherwise("Welcome "), F.repeat(F.lit("ab "), (k % 200).cast("int")))
    error = F.when(k % 4 == 0, "Blocked by ROBOTS").when(k % 4 == 1, "blocked").when(k % 4 == 2, "timeout")
    return p.select("p_partkey", text.is_safe_to_click(label).alias("safe"), text.is_bot_check(page).alias("bot"), text.scrape_status(error).alias("status"))


def _contains(hay: str, words) -> str:
    return "(" + " OR ".join(f"contains({hay}, {sql.quoted(w)})" for w in words) + ")"


LABELS = f"""
WITH l AS (SELECT p_partkey, lower(trim(regexp_replace(CASE p_partkey % 3 WHEN 0 THEN 'Show  number ' WHEN 1 THEN 'Hubungi kami - kirim ' ELSE 'lihat kontak ' END || p_name || repeat('x', p_partkey % 80), '\\s+', ' ', 'g'))) AS l,
  CASE WHEN p_partkey % 2 = 0 THEN 'Just a Moment... ' ELSE 'Welcome ' END || repeat('ab ', p_partkey % 200) AS page FROM part)
SELECT p_partkey, length(l) <= 60 AND NOT {_contains("l", fixed.FORBIDDEN_CLICK_WORDS)} AND {_contains("l", fixed.REVEAL_PHRASES)} AS safe,
  length(page) <= {fixed.BOT_CHECK_MOST} AND {_contains("lower(page)", fixed.BOT_CHECK_MARKERS)} AS bot,
  CASE p_partkey % 4 WHEN 0 THEN 'robots_blocked' WHEN 1 THEN 'blocked_domain' WHEN 2 THEN 'error' ELSE 'ok' END AS status FROM l"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped and plain links of suppliers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    target = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example/a?b=c"))
    code = F.translate(F.regexp_replace(F.base64(target.cast("binary")), "=", ""), "+/", "-_")
    link = F.when(F.col("s_suppkey") % 3 == 0, target).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://e.example/ck?x=1&u=a1"), code, F.lit("&n=2"))).otherwise("https://e.example/ck?u=a1***")
    return s.select("s_suppkey", urls.unwrapped(link).alias("url"))


REDIRECTS = """
WITH t AS (SELECT s_suppkey, 'https://s' || s_suppkey || '.example/a?b=c' AS target FROM supplier),
l AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN target WHEN 1 THEN 'https://e.example/ck?x=1&u=a1' || translate(replace(to_base64(encode(target)), '=', ''), '+/', '-_') || '&n=2' ELSE 'https://e.example/ck?u=a1***' END AS link FROM t),
c AS (SELECT s_suppkey, link, translate(replace(regexp_extract(link, '[?&]u=a1([A-Za-z0-9_%=-]+)', 1), '=', ''), '-_', '+/') AS code FROM l),
d AS (SELECT s_suppkey, link, CASE WHEN code <> '' THEN decode(from_base64(code || repeat('=', CAST((4 - length(code) % 4) % 4 AS INTEGER)))) END AS target FROM c)
SELECT s_suppkey, CASE WHEN starts_with(target, 'http') THEN target ELSE link END AS url FROM d"""

QUERIES = {
    "phone_forms": (phone_forms, PHONES),
    "query_texts": (query_texts, QUERY_TEXTS),
    "query_places": (query_places, QUERY_PLACES),
    "labels_and_errors": (labels_and_errors, LABELS),
    "redirects": (redirects, REDIRECTS),
}
