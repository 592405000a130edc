"""Queries over pages and answers made by rule: gates, links, extraction from markup, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, phones, urls
from ..operators import extract
from ..sources import fetch
from . import sql


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, d): each page's number, and eight digits of it."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("d"))


IDS = "i AS (SELECT page_id AS id, lpad(CAST(page_id AS VARCHAR), 8, '0') AS d FROM pages)"


def _text(*parts) -> F.Column:
    """Strings and columns of _ids in a row; a number k stands for the digits' half."""
    half = {1: F.substring("d", 1, 4), 2: F.substring("d", 5, 4)}
    return F.concat(*(half[p] if isinstance(p, int) else F.col(p[1:]).cast("string") if p.startswith("=") else F.lit(p) for p in parts))


def fetch_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from order lines: a status, a type and a length."""
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    status = F.when(n % 5 == 0, 404).when(n % 11 == 0, 503).otherwise(200)
    kind = F.when(n % 7 == 0, "image/png").when(n % 13 == 0, F.lit(None)).when(n % 3 == 0, "TEXT/plain").otherwise("text/html; charset=utf-8")
    length = F.when(n % 17 == 0, fixed.MAX_BODY + n).otherwise(n)
    return r.select("l_orderkey", "l_linenumber", fetch.rejection(status, kind, length).alias("error"))


REJECTIONS = f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS n FROM lineitem),
a AS (SELECT *, CASE WHEN n % 5 = 0 THEN 404 WHEN n % 11 = 0 THEN 503 ELSE 200 END AS status, CASE WHEN n % 7 = 0 THEN 'image/png' WHEN n % 13 = 0 THEN NULL WHEN n % 3 = 0 THEN 'TEXT/plain' ELSE 'text/html; charset=utf-8' END AS kind,
  CASE WHEN n % 17 = 0 THEN {fixed.MAX_BODY} + n ELSE n END AS length FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN status >= 400 THEN 'HTTPError: ' || status WHEN NOT contains(lower(coalesce(kind, '')), 'html') AND NOT contains(lower(coalesce(kind, '')), 'text') THEN 'skipped non-HTML content (' || coalesce(kind, '') || ')'
  WHEN length > {fixed.MAX_BODY} THEN 'response too large' END AS error FROM a"""


def fetch_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each page's turn comes within its host."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("ord"), "url")
    return fetch.slots(p, delay=1.5).select("ord", urls.host(F.col("url")).alias("host"), "slot")


SLOTS = f"WITH p AS (SELECT page_id AS ord, {sql.host('url')} AS host FROM pages) SELECT ord, host, (row_number() OVER (PARTITION BY host ORDER BY ord) - 1) * CAST(1.5 AS DOUBLE) AS slot FROM p"

ROBOTS = (
    ("https://h0.example", "User-agent: *\nDisallow: /private", 200),
    ("https://h1.example", "User-agent: *\nDisallow: /private", 404),
    ("https://h2.example", "User-agent: *\nDisallow: /", 200),
    ("https://h3.example", "User-agent: OtherBot\nDisallow: /\n\nUser-agent: *\nDisallow:", 200),
    ("https://h4.example", None, None),
    ("https://h5.example", "User-agent: *\nAllow: /private/x\nDisallow: /private", 200),
)


def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the pages of seven hosts their rules allow; the last host has no rules at hand."""
    url = F.concat(F.lit("https://h"), (F.col("id") % 7).cast("string"), F.lit(".example/"), F.when(F.col("id") % 3 == 0, "private/").when(F.col("id") % 3 == 1, "open/").otherwise("private/x"), F.col("id").cast("string"))
    rules = spark.createDataFrame(list(ROBOTS), "base string, body string, status int")
    return fetch.with_robots(_ids(spark, sf_dir).select("id", url.alias("url")), rules).select("id", "allowed")


ROBOTS_GATE = f"""
WITH {IDS}, r(k, prefix, opened) AS (VALUES (0, '/private', NULL), (2, '/', NULL), (5, '/private', '/private/x')),
w AS (SELECT id, id % 7 AS k, CASE id % 3 WHEN 0 THEN '/private/' WHEN 1 THEN '/open/' ELSE '/private/x' END || id AS path FROM i)
SELECT id, NOT coalesce(starts_with(path, prefix) AND NOT coalesce(starts_with(path, opened), false), false) AS allowed FROM w LEFT JOIN r USING (k)"""

LINKS = (("/about", "About us"), ("/kontak?x=1", "Reach"), ("mailto:a@b.example", "kontak"), ("https://other.example/contact", "Contact"), ("/hubungi/a/long/way", "Hubungi"), ("/p", "CONTACT"), ("/kontak", ""), ("/x", "home"))


def _with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def link(k: int, href: str, label: str):
        target = F.lit(href) if ":" in href else F.concat(F.lit("https://p"), F.col("id").cast("string"), F.lit(f".example{href}"))
        return F.when((F.col("id") + k) % 3 != 0, F.struct(F.lit(k).alias("pos"), F.lit(href).alias("href"), target.alias("target"), F.lit(label).alias("label")))

    links = F.filter(F.array(*(link(k, *x) for k, x in enumerate(LINKS))), lambda x: x.isNotNull())
    return _ids(spark, sf_dir).select("id", _text("https://p", "=id", ".example/x").alias("url"), links.alias("links"))


def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of made pages to contact pages of their own host, ranked."""
    return extract.contact_links(_with_links(spark, sf_dir))


_TEMPLATES = ", ".join(f"({k}, {sql.quoted(h)}, {sql.quoted(t)})" for k, (h, t) in enumerate(LINKS))
_WORD = "CASE " + " ".join(f"WHEN contains(hay, {sql.quoted(w)}) THEN {k}" for k, w in enumerate(fixed.CONTACT_LINK_WORDS)) + " END"
RANKED = f"""
t(pos, href, label) AS (VALUES {_TEMPLATES}),
l AS (SELECT id, 'https://p' || id || '.example/x' AS url, pos, href, CASE WHEN contains(href, ':') THEN href ELSE 'https://p' || id || '.example' || href END AS target, lower(href || ' ' || label) AS hay FROM i, t WHERE (id + pos) % 3 <> 0),
m AS (SELECT url, target, min({_WORD}) AS word, min(pos) AS pos FROM l WHERE NOT starts_with(href, 'mailto:') AND target <> url AND {sql.host("target")} = {sql.host("url")} AND {_WORD} IS NOT NULL GROUP BY url, target),
ranked AS (SELECT url, target, CAST(row_number() OVER (PARTITION BY url ORDER BY word, length(target), pos) AS INTEGER) AS rank FROM m)"""


def _contacts_of_target(target):
    """Contacts that a made contact page has, by the length of its address."""
    n, none = F.length(target), F.array().cast("array<string>")
    return [
        F.when(n % 3 == 0, F.array(F.concat(F.lit("t"), n.cast("string"), F.lit("@mail.example")))).otherwise(none).alias("emails"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("+628110000"), n.cast("string")))).otherwise(none).alias("whatsapp"),
        F.array(F.concat(F.lit("+628110000"), n.cast("string")), F.lit("+62215550100")).alias("phones"),
        F.when(n % 5 == 0, "HTTPError: 404").alias("error"),
    ]


def followed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made pages and what their contact pages add, in rank order up to the first address."""
    none, i = F.array().cast("array<string>"), F.col("id")
    found = _with_links(spark, sf_dir).select(
        "url", "links", F.when(i % 4 == 0, F.array(F.lit("own@mail.example"))).otherwise(none).alias("emails"), none.alias("whatsapp"), F.when(i % 2 == 0, F.array(F.lit("+62215550199"))).otherwise(none).alias("phones"), F.when(i % 9 == 0, "timeout").alias("error")
    )
    targets = extract.contact_links(found).select("target").distinct()
    linked = targets.select(F.col("target").alias("url"), *_contacts_of_target(F.col("target")))
    out = extract.with_followed(found, linked)
    return out.select("url", *(F.array_join(c, ",").alias(c) for c in ("emails", "whatsapp", "phones", "followed")))


FOLLOWED = f"""
WITH {IDS}, {RANKED},
f AS (SELECT id, 'https://p' || id || '.example/x' AS url, CASE WHEN id % 4 = 0 THEN ['own@mail.example'] ELSE CAST([] AS VARCHAR[]) END AS e, CASE WHEN id % 2 = 0 THEN ['+62215550199'] ELSE CAST([] AS VARCHAR[]) END AS p, id % 9 = 0 AS failed FROM i),
h AS (SELECT url, target, rank, length(target) AS n FROM ranked WHERE rank <= {fixed.MAX_CONTACT_PAGES} AND length(target) % 5 <> 0),
u AS (SELECT *, min(CASE WHEN n % 3 = 0 THEN rank END) OVER (PARTITION BY url) AS until FROM h),
b AS (SELECT url, list('t' || n || '@mail.example') FILTER (n % 3 = 0) AS te, list('+628110000' || n) FILTER (n % 2 = 0) AS tw, list('+628110000' || n) AS tp, string_agg(target, ',' ORDER BY rank) AS followed FROM u WHERE until IS NULL OR rank <= until GROUP BY url),
j AS (SELECT f.url, e, p, te, tw, tp, followed, b.url IS NOT NULL AND len(e) = 0 AND NOT failed AS takes FROM f LEFT JOIN b USING (url)),
k AS (SELECT url, CASE WHEN takes THEN list_sort(list_distinct(e || coalesce(te, []))) ELSE e END AS emails, CASE WHEN takes THEN list_sort(list_distinct(coalesce(tw, []))) ELSE CAST([] AS VARCHAR[]) END AS w,
  CASE WHEN takes THEN list_sort(list_distinct(p || tp || ['+62215550100'])) ELSE p END AS p, CASE WHEN takes THEN followed ELSE '' END AS followed FROM j)
SELECT url, array_to_string(emails, ',') AS emails, array_to_string(w, ',') AS whatsapp, array_to_string(list_filter(p, lambda x: NOT list_contains(w, x)), ',') AS phones, followed FROM k"""


def rendered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made pages that may need a browser, and what their rendered forms add."""
    none, i = F.array().cast("array<string>"), F.col("id")
    found = _ids(spark, sf_dir).select(
        i.alias("ord"), _text("https://p", "=id", ".example/").alias("url"), F.when(i % 6 == 0, F.repeat(F.lit("x"), 6000)).when(i % 6 == 1, "").otherwise("<html></html>").alias("html"),
        F.when(i % 4 == 0, "Own").otherwise("").alias("company"), F.when(i % 5 == 0, F.array(F.lit("own@mail.example"))).otherwise(none).alias("emails"), none.alias("whatsapp"), none.alias("phones"),
        F.when(i % 8 == 2, fixed.BOT_CHECK_ERROR).alias("error"), F.lit("static").alias("render_mode"), (i % 12 == 0).alias("looks_scripted"),
    )
    rendered = found.where(F.col("ord") % 7 != 3).select("url", F.when(F.col("ord") % 2 == 0, F.array(F.lit("js@mail.example"))).otherwise(none).alias("emails"), none.alias("whatsapp"), none.alias("phones"), F.lit("Made").alias("company"), F.when(F.col("ord") % 10 == 4, "timeout").alias("error"))
    out = extract.with_rendered(found, rendered)
    return out.select("ord", F.array_join("emails", ",").alias("emails"), "company", "error", "render_mode", extract.needs_render(found).alias("needed"))


RENDERED = f"""
WITH {IDS}, f AS (SELECT id, id % 5 = 0 AS has, id % 6 <> 1 AND id % 5 <> 0 AND (id % 6 <> 0 OR id % 12 = 0) AS need, id % 7 <> 3 AS tried, CASE WHEN id % 8 = 2 THEN '{fixed.BOT_CHECK_ERROR}' END AS error FROM i),
u AS (SELECT *, need AND tried AND id % 10 <> 4 AS used FROM f), g AS (SELECT *, used AND id % 2 = 0 AS grew FROM u)
SELECT id AS ord, CASE WHEN has THEN 'own@mail.example' WHEN grew THEN 'js@mail.example' ELSE '' END AS emails, CASE WHEN id % 4 = 0 THEN 'Own' WHEN used THEN 'Made' ELSE '' END AS company, CASE WHEN grew THEN NULL ELSE error END AS error,
  CASE WHEN need AND tried THEN CASE WHEN grew THEN 'rendered' ELSE 'rendered_empty' END ELSE 'static' END AS render_mode, CASE WHEN grew THEN false ELSE need END AS needed FROM g"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of WhatsApp and telephone links in the stored pages, to which links made by rule are added."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    d = F.lpad(F.col("page_id").cast("string"), 8, "0")
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a href='https://wa.me/62812"), d, F.lit("'>a</a><a HREF = \" tel:0361 (55) "), F.substring(d, 4, 5), F.lit("\">b</a>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<a href='https://api.whatsapp.com/send?phone=0813"), d, F.lit("&t=1'>c</a>"))).otherwise("")
    html = F.concat("html", more)
    return p.select("page_id", F.array_join(F.array_sort(phones.in_links(html, fixed.WHATSAPP_LINK)), ",").alias("whatsapp"), F.array_join(F.array_sort(phones.in_links(html, fixed.TEL_LINK)), ",").alias("tel"))


def _links_of(pattern: str) -> str:
    found = f"regexp_extract_all(h, {sql.quoted(pattern)}, 1)"
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({found}, lambda x: {sql.phone('x')}), lambda x: x <> ''))), ',')"


PAGE_LINKS = f"""
WITH p AS (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '<a href=''https://wa.me/62812' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '''>a</a><a HREF = " tel:0361 (55) ' || substr(lpad(CAST(page_id AS VARCHAR), 8, '0'), 4, 5) || '">b</a>'
  WHEN 1 THEN '<a href=''https://api.whatsapp.com/send?phone=0813' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '&t=1''>c</a>' ELSE '' END AS h FROM pages)
SELECT page_id, {_links_of(fixed.WHATSAPP_LINK)} AS whatsapp, {_links_of(fixed.TEL_LINK)} AS tel FROM p"""


def structured_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction from pages made by rule: structured data, labelled lines near a heading, plain links, an interstitial."""
    i = F.col("id")
    data = _text('<html><head><title>Site ', "=id", '</title><script type="application/ld+json">{"@graph": [{"@type": ["Thing", "Hotel"], "name": " Hotel  ', "=id", '", "telephone": "0812-', 1, "-", 2, '", "email": "mailto:Info@H', "=id", '.example", "address": {"streetAddress": "Jl. Raya ', "=id", '", "addressLocality": "Bali", "postalCode": "80361"}}]}</script></head><body>Hello</body></html>')
    lines = _text("<html><head><title>Shop ", "=id", " | Home</title></head><body><div><h2>Hubungi Kami</h2><p>Alamat: Jalan Melati ", "=id", " Denpasar</p><p>Telp: (0361) 7", 1, "55</p><p>Email: sales@b", "=id", ".example</p><p>WhatsApp: 0813-", 1, "-", 2, "</p></div></body></html>")
    flat = _text("<html><head><title>Flat ", "=id", "</title></head><body>write to Cs@F", "=id", ".example or <a href=\"tel:+62 812 ", 1, " ", 2, "\">call</a> <a href='https://wa.me/62811", "=d", "'>wa</a><script>x@hidden.example</script></body></html>")
    wall = _text("<html><head><title>Just a moment...</title></head><body>Checking your browser ", "=id", "</body></html>")
    html = F.when(i % 4 == 0, data).when(i % 4 == 1, lines).when(i % 4 == 2, flat).otherwise(wall)
    found = extract.contacts(_ids(spark, sf_dir).select(i.alias("ord"), _text("https://s", "=id", ".example/").alias("url"), html.alias("html")))
    return found.select("ord", "company", *(F.array_join(c, ",").alias(c) for c in ("emails", "whatsapp", "phones")), "error", "page_type", "address", (F.size("emails") + F.size("whatsapp") + F.size("phones")).cast("long").alias("total"))


STRUCTURED = f"""
WITH {IDS}
SELECT id AS ord, CASE id % 4 WHEN 0 THEN 'Hotel ' || id WHEN 1 THEN 'Shop ' || id WHEN 2 THEN 'Flat ' || id ELSE '' END AS company,
  CASE id % 4 WHEN 0 THEN 'info@h' || id || '.example' WHEN 1 THEN 'sales@b' || id || '.example' WHEN 2 THEN 'cs@f' || id || '.example' ELSE '' END AS emails,
  CASE id % 4 WHEN 1 THEN '+62813' || d WHEN 2 THEN '+62811' || d ELSE '' END AS whatsapp,
  CASE id % 4 WHEN 0 THEN '+62812' || d WHEN 1 THEN '+623617' || substr(d, 1, 4) || '55' WHEN 2 THEN '+62812' || d ELSE '' END AS phones,
  CASE id % 4 WHEN 3 THEN '{fixed.BOT_CHECK_ERROR}' END AS error, CASE WHEN id % 4 < 2 THEN 'structured' ELSE 'flat' END AS page_type,
  CASE id % 4 WHEN 0 THEN 'Jl. Raya ' || id || ' Bali 80361' WHEN 1 THEN 'Jalan Melati ' || id || ' Denpasar' ELSE '' END AS address, CAST([2, 3, 3, 0][id % 4 + 1] AS BIGINT) AS total FROM i"""


def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run says of each page of made results."""
    i, none = F.col("id"), F.array().cast("array<string>")
    some = lambda n, x: F.when(i % n == 0, F.array(F.lit(x))).otherwise(none)
    found = _ids(spark, sf_dir).select("id", F.when(i % 7 == 0, "timeout").alias("error"), some(2, "a@b.example").alias("emails"), some(3, "+62811").alias("whatsapp"), some(5, "+6221").alias("phones"), some(4, "https://x.example/kontak").alias("followed"))
    return found.select("id", extract.outcome_line(found).alias("line"))


OUTCOMES = f"""
WITH {IDS} SELECT id, CASE WHEN id % 7 = 0 THEN 'skipped (timeout)' WHEN id % 2 > 0 AND id % 3 > 0 AND id % 5 > 0 THEN 'no contacts found'
  ELSE format('emails={{}} whatsapp={{}} phone={{}}', CAST(id % 2 = 0 AS INTEGER), CAST(id % 3 = 0 AS INTEGER), CAST(id % 5 = 0 AS INTEGER)) || CASE WHEN id % 4 = 0 THEN ' (via /kontak)' ELSE '' END END AS line FROM i"""

QUERIES = {
    "fetch_rejections": (fetch_rejections, REJECTIONS),
    "fetch_slots": (fetch_slots, SLOTS),
    "robots_gate": (robots_gate, ROBOTS_GATE),
    "contact_links": (contact_links, f"WITH {IDS}, {RANKED} SELECT url, target, rank FROM ranked WHERE rank <= {fixed.MAX_CONTACT_PAGES}"),
    "followed_contacts": (followed_contacts, FOLLOWED),
    "rendered_merge": (rendered_merge, RENDERED),
    "page_links": (page_links, PAGE_LINKS),
    "structured_contacts": (structured_contacts, STRUCTURED),
    "outcome_lines": (outcome_lines, OUTCOMES),
}
