"""Operators over small fixtures, and every registered query against the second engine."""

import gc
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kontaktor.functions import dom, fixed
from kontaktor.operators import audit, blocklist, collapse, extract, search
from kontaktor.plans import registry


def page(spark, *bodies, url="https://a.example/"):
    return spark.createDataFrame([(i, url if isinstance(b, str) else b[0], b if isinstance(b, str) else b[1]) for i, b in enumerate(bodies)], "ord long, url string, html string")


def one(df):
    return df.orderBy("ord").collect()


def test_noise_of_scripts_is_left_out(spark):
    body = "<script>var a='x@noise.example'</script><style>b@noise.example</style><noscript>c@noise.example</noscript><p>d@shop.example <a href='mailto:e@shop.example'>m</a> <a href='https://wa.me/6281200000009'>w</a> 0812 0000 0001</p>"
    r = one(extract.contacts(page(spark, body)))[0]
    assert (r.emails, r.whatsapp, r.phones, r.error, r.page_type) == (["d@shop.example", "e@shop.example"], ["+6281200000009"], ["+6281200000001"], None, "flat")


def test_a_whatsapp_number_is_no_phone(spark):
    r = one(extract.contacts(page(spark, "<a href='https://wa.me/6281200000001'>w</a> 0812 0000 0001")))[0]
    assert (r.whatsapp, r.phones) == (["+6281200000001"], [])


def test_interstitials(spark):
    short, long_ = one(extract.contacts(page(spark, "<title>Just a moment...</title><p>One moment, please</p>", "<title>T shop</title>captcha " + "word " * 120)))
    assert (short.error, short.company, short.emails) == (fixed.BOT_CHECK_ERROR, "", [])
    assert long_.error is None and long_.company == "T shop"


def test_structured_data(spark):
    ld = '<script type="application/ld+json">{}</script>'.format
    bodies = [
        ld('{"@type": "Hotel", "name": "Hotel  X", "email": "mailto:Book@x.example", "telephone": "021 555 0000", "address": {"streetAddress": "Jl. A 1", "postalCode": "12345"}}'),
        ld('{"@graph": [{"contactPoint": {"email": "deep@x.example", "telephone": "0812-0000-0002"}}]}'),
        ld("{broken") + ld('{"email": "ok@x.example"}'),
        ld('{"email": "info@example.com"}'),
        '<script>{"email": "no@x.example"}</script>',
    ]
    a, b, c, d, e = one(extract.contacts(page(spark, *bodies)))
    assert (a.company, a.emails, a.phones, a.address, a.page_type) == ("Hotel X", ["book@x.example"], ["+62215550000"], "Jl. A 1 12345", "structured")
    assert (b.emails, b.phones, b.page_type) == (["deep@x.example"], ["+6281200000002"], "flat")
    assert (c.emails, d.emails, e.emails) == (["ok@x.example"], [], [])


def test_tel_links(spark):
    r = one(extract.contacts(page(spark, '<a href="tel:021 555-0000">a</a><a href="tel:0812-0000-0003">b</a><a href="tel:()()()()()">c</a>')))[0]
    assert r.phones == ["+62215550000", "+6281200000003"] or set(r.phones) == {"+62215550000", "+6281200000003"}


def test_labelled_footer(spark):
    body = "<div><h3>KONTAK</h3><p>Jl. Contoh No. 5 Bandung 40111</p><p>Telephone : 022-4232286</p><p>Email：cs@toko.example</p></div>"
    r = one(extract.contacts(page(spark, body)))[0]
    assert (r.page_type, r.address, r.phones, r.emails) == ("structured", "Jl. Contoh No. 5 Bandung 40111", ["+62224232286"], ["cs@toko.example"])


def test_structured_data_wins_over_labels(spark):
    body = '<script type="application/ld+json">{"@type": ["Store"], "email": "ld@x.example"}</script><div id="contact">Email: label@x.example\nAlamat: Jalan Panjang Sekali 10</div>'
    r = one(extract.contacts(page(spark, body)))[0]
    assert "ld@x.example" in r.emails and r.address.startswith("Jalan Panjang")


def test_contact_links(spark):
    body = """<a href="/about">x</a><a href="/kontak-panjang-2019">y</a><a href="/kontak/">z</a><a href="https://b.example/contact">f</a>
    <a href="mailto:a@b.c">contact</a><a href="#contact">c</a><a href="javascript:contact()">j</a><a href="/">kontak</a><a href="/p?id=1">Hubungi kami</a>"""
    got = extract.contact_links(extract.contacts(page(spark, body))).orderBy("rank").collect()
    assert [r.target for r in got] == ["https://a.example/kontak", "https://a.example/kontak-panjang-2019"]


def test_followed_pages_stop_at_the_first_address(spark):
    start = '<title>Toko</title><a href="/kontak">k</a><a href="/contact">c</a>'
    pages = page(spark, start, ("https://a.example/kontak", "k@toko.example"), ("https://a.example/contact/", "c@toko.example"))
    found = extract.contacts(pages)
    r = extract.with_followed(found.where("ord = 0"), found.where("ord > 0")).collect()[0]
    assert (r.emails, r.followed) == (["k@toko.example"], ["https://a.example/kontak"])


def test_rendered_bodies_add(spark):
    found = extract.contacts(page(spark, "<div id='root'></div>", ("https://b.example/", "x@b.example"), ("https://c.example/", "<p>tiny</p>")))
    rendered = extract.contacts(page(spark, "new@a.example", ("https://b.example/", "never@b.example"), ("https://c.example/", "")))
    a, b, c = one(extract.with_rendered(found, rendered))
    assert (a.emails, a.render_mode) == (["new@a.example"], "rendered")
    assert (b.emails, b.render_mode) == (["x@b.example"], "static")
    assert c.render_mode == "rendered_empty"


@pytest.mark.parametrize(
    ("body", "want"),
    [("<div id='__next'></div>" + "<p>text</p>" * 900, True), ("tiny", True), ("<noscript>Please enable JavaScript</noscript>" + "<p>text</p>" * 900, True), ("<div id='root'>full</div>" + "<p>text</p>" * 900, False), ("a@shop.example", False), ("", False)],
)
def test_needs_render(spark, body, want):
    found = extract.contacts(page(spark, body))
    assert found.select(extract.needs_render(found).alias("x")).collect()[0].x is want


def test_trees_of_broken_pages():
    f = dom.facts_of("<p>one<p>two <b>bold<i>x</b> &amp; <br><!-- kept --><img src='a&b'>", "https://a.example")
    assert f["text"] == "one two bold x &"
    assert "<!-- kept -->" in f["markup"] and 'src="a&amp;b"' in f["markup"]
    assert dom.facts_of(None, None)["text"] == "" and dom.facts_of("<a href='http://[bad'>x</a>", "https://a.example")["links"] == []


def results(spark, *rows):
    names = ("ord", "url", "company", "emails", "whatsapp", "phones", "error", "page_type", "address", "render_mode", "search_query")
    default = {"company": "", "emails": [], "whatsapp": [], "phones": [], "error": None, "page_type": "flat", "address": "", "render_mode": "static", "search_query": ""}
    schema = "ord long, url string, company string, emails array<string>, whatsapp array<string>, phones array<string>, error string, page_type string, address string, render_mode string, search_query string"
    return spark.createDataFrame([tuple((default | {"ord": i} | r)[n] for n in names) for i, r in enumerate(rows)], schema)


def test_company_rows(spark):
    rows = results(
        spark,
        {"url": "https://www.a.example/x", "error": "HTTPError: 404", "company": "A first"},
        {"url": "http://a.example:443/y", "emails": ["long@a.example", "info@a.example"], "whatsapp": ["+622", "+621"], "phones": ["+621", "+629"], "page_type": "structured", "render_mode": "rendered_empty", "search_query": "q"},
        {"url": "https://sub.a.example/", "error": "timeout"},
        {"url": "nohost"},
    )
    a, b = collapse.companies(rows).orderBy("host").collect()
    assert (a.company, a.website, a.status, a.email, a.other_emails) == ("A first", "http://a.example:443/y", "ok", "info@a.example", "long@a.example")
    assert (a.whatsapp, a.other_whatsapp, a.phone, a.page_type, a.render_mode, a.search_query) == ("+621", "+622", "+629", "structured", "rendered_empty", "q")
    assert (b.company, b.email, b.email_source, b.status) == ("sub.a.example", "", "", "timeout")
    guessed = collapse.companies(rows, guess_email=True).orderBy("host").collect()[1]
    assert (guessed.email, guessed.email_source) == ("cs@a.example", "guessed")
    assert "+621" in collapse.companies(rows, repeat_whatsapp=True).orderBy("host").collect()[0].phone


def test_company_rows_do_not_depend_on_partitions(spark):
    rows = results(spark, *({"url": f"https://h{i % 3}.example/{i}", "company": f"c{i}", "emails": [f"e{i % 7}@x.example"], "error": "e" if i % 4 == 0 else None} for i in range(60)))
    want = collapse.companies(rows).orderBy("host").collect()
    assert collapse.companies(rows.repartition(7, (F.col("ord") * 7919) % 60)).orderBy("host").collect() == want


def test_filters_of_companies(spark):
    rows = collapse.companies(results(spark, {"url": "https://a.example", "emails": ["x@a.example"]}, {"url": "https://b.example", "whatsapp": ["+62"]}, {"url": "https://c.example"}), guess_email=True)
    assert [r.host for r in collapse.emails_only(rows).collect()] == ["a.example"]
    kept = {r.host: (r.email, r.email_source) for r in collapse.high_confidence(rows).collect()}
    assert kept == {"a.example": ("x@a.example", "found"), "b.example": ("", "")}


def test_blocklists(spark):
    entries = spark.createDataFrame([("agg.example",), (" Trip.example ",), ("",)], "domain string")
    rows = spark.createDataFrame([(u,) for u in ("https://agg.example/", "https://WWW.agg.example:80", "https://a.b.trip.example", "https://nottrip.example", "https://x.example/agg.example", "nohost")], "url string")
    assert {r.url for r in blocklist.kept(rows, entries).collect()} == {"https://nottrip.example", "https://x.example/agg.example", "nohost"}
    counts = blocklist.dropped(rows, entries)
    assert {tuple(r) for r in counts.collect()} == {("agg.example", 2), ("a.b.trip.example", 1)}
    assert [r.domain for r in blocklist.top_domains(counts, entries).collect()] == ["agg.example", "trip.example"]
    assert [r.domain for r in blocklist.top_domains(counts.limit(0), entries, limit=3).collect()] == list(fixed.NEGATIVE_DOMAINS[:3])
    assert blocklist.kept(rows, entries.limit(0)).count() == 6


def test_yield(spark):
    rows = [(1, "a", "u1"), (1, "a", "u2"), (2, "b -site:x", "u2"), (2, "b -site:x", "u3"), (2, "b -site:x", "u3"), (3, "c", "u1")]
    got = {r.qord: (r.query, r.urls, r.new, r.overlap) for r in search.with_overlap(search.yields(spark.createDataFrame(rows, "qord int, query string, url string"))).collect()}
    assert got == {1: ("a", 2, 2, False), 2: ("b", 3, 2, False), 3: ("c", 1, 0, True)}


def test_streaks(spark):
    pages = spark.createDataFrame([("q", p, f) for p, f in enumerate([3, 0, 1, 0, 0], 1)], "query_key string, page int, fresh long").withColumn("stored", F.lit(1))
    assert [r.streak for r in search.streaks(pages).orderBy("page").collect()] == [0, 1, 0, 1, 2]
    assert [r.streak for r in search.streaks(pages.where("page in (2)"), stored="stored").collect()] == [2]
    assert search.result_pages(25) == [1, 11, 21]


def test_audit(spark):
    schema = ", ".join(f"{c} string" for c in fixed.COMPANY_COLUMNS)
    base = dict.fromkeys(fixed.COMPANY_COLUMNS, "")
    rows = [
        base | {"company": "Hotel Surabaya", "website": "https://s.example/1", "search_query": "hotel Bali", "phone": "+6281200000001; +6221555000", "status": "OK"},
        base | {"company": "Hotel Bali", "website": "https://s.example/2", "search_query": "hotel Bali", "email_source": "found", "status": "timeout"},
        base | {"company": "Pabrik", "website": "https://agg.example/", "search_query": "pabrik", "whatsapp": "+1"},
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    r = audit.audited(df, spark.createDataFrame([("agg.example",)], "domain string"), audit.vocabulary(spark)).first()
    assert r.asDict() == {"rows": 3, "relevant": 2, "located": 2, "mismatched": 1, "non_aggregator": 2, "numbers": 3, "valid_numbers": 2, "mobiles": 1, "landlines": 1, "unique_hosts": 2, "with_contact": 2, "errors": 1}
    empty = audit.audited(df.limit(0), spark.createDataFrame([("x",)], "domain string"), audit.vocabulary(spark))
    assert empty.first().rows == 0 and audit.percentages(empty).first().relevant_pct is None
    assert audit.vocabulary(spark, ["Kota Baru", "ab"])[-1] >= "a" and {"kota", "baru"} <= set(audit.vocabulary(spark, ["Kota Baru", "ab"]))


def test_first_invalid_numbers_and_the_rest(spark):
    rows = spark.createDataFrame([("+621", f"+62{k}; +621", "") for k in range(10, 14)], "whatsapp string, phone string, other_whatsapp string")
    shown, others = audit.first_invalid(rows, 3)
    assert [(r["column"], r.number, r.n) for r in shown] == [("phone", "+621", 4), ("whatsapp", "+621", 4), ("phone", "+6210", 1)] and others == 3


@pytest.fixture(scope="module")
def second(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, second, name):
    a, b = registry.queries()[name](spark, data).toPandas(), second.execute(registry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    c = sorted(a.columns)
    plain = lambda v: "" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    rows = lambda d: sorted(tuple(map(str, map(plain, r))) for r in d[c].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)


def test_pages_are_parsed_in_pieces(spark):
    assert list(dom.pieces([])) == [] and list(dom.pieces([1] * 600)) == [(0, 256), (256, 256), (512, 88)]
    big = dom.PIECE_BYTES
    assert list(dom.pieces([5 * big, 1, big - 1, 1, big])) == [(0, 1), (1, 2), (3, 1), (4, 1)]
    seen, kind = [], pa.struct([("n", pa.int32())])
    sizes = [0, 10, big // 2, big // 2, 9] + [3] * 600
    run = dom._in_pieces(lambda s: seen.append(s) or {"n": len(s or "")}, "struct<n:int>").func
    out, rows = run(iter([pa.array([None if not n else "x" * n for n in sizes])])), []
    for piece in out:  # what is parsed beyond what has gone back stays within the bounds
        assert len(piece) <= 256 and sum(len(s or "") for s in seen[len(rows) :]) <= big and len(seen) == len(rows) + len(piece) and piece.type == kind
        rows += piece.to_pylist()
    assert [r["n"] for r in rows] == sizes
    rows = one(extract.contacts(page(spark, *(f"<p>n{i}@shop.example</p>" for i in range(700))).coalesce(1)))
    assert [r.emails for r in rows] == [[f"n{i}@shop.example"] for i in range(700)]


def test_a_parsed_page_leaves_no_cycles():
    body = "<div id=kontak><p>a<p>b<!-- c --><ul><li class='b_algo'><h2><a href='/x'>t</a></h2></ul></div>"
    gc.collect()
    gc.disable()
    try:
        for parse in (lambda: dom.facts_of(body, "https://a.example/"), lambda: dom.result_items(body)):
            assert parse() and gc.collect() == 0
    finally:
        gc.enable()


def test_page_names_equal_their_sql_on_odd_pages(spark, tmp_path):
    titles = ("to", "le. | a", "Home | Hotel A", "Hotel\u00a0 A\u2028", "\u3000Toko\x0b-B", "\u0130ndex", "&amp;&lt;lt;b&lt;/b", "", None)
    bodies = [t if t is None else f"<title>{t}</title>" for t in titles] + ['<title>B C</title><meta property="og:site_name" content="Toko">', "no title"]
    links = ("http://hotel-a.example/x", "http://:80/", "", None)
    rows = [(i, u, b) for i, (u, b) in enumerate((u, b) for u in links for b in bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(registry.oracle_sql()["page_names"]).fetchall())
    assert sorted(map(tuple, registry.queries()["page_names"](spark, str(tmp_path)).collect())) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
