"""Column expressions: each case by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontaktor.functions import emails, names, phones, query_text, text, urls


def values(spark, expression, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_hosts(spark):
    cases = {"http://www.A.Example:443/x": "a.example", "https://www.www.b.example": "www.b.example", "ftp://u:p@h/": "u", "no scheme.example": "", "": "", "https://exa_mple.com/a b": "exa_mple.com", None: ""}
    assert values(spark, urls.host, cases) == list(cases.values())


def test_registrable_and_guess(spark):
    cases = {"http://a.b.c.co.id/": "c.co.id", "http://x.y.example": "y.example", "http://hotel.co.id": "hotel.co.id", "http://local": "local", "x": ""}
    assert values(spark, urls.registrable, cases) == list(cases.values())
    assert values(spark, urls.guessed_email, ["http://www.y.example/", "http://local"]) == ["cs@y.example", ""]


def test_host_suffixes(spark):
    assert values(spark, urls.host_suffixes, ["a.b.c"]) == [["a.b.c", "b.c", "c"]]


PHONES = {
    "0812-0000-0001": ("+6281200000001", True),
    "+62 812 0000 0001": ("+6281200000001", True),
    "62081200000001": ("+6281200000001", True),
    "81200000001": ("+6281200000001", True),
    "8123456": ("+8123456", False),
    "8610000000000": ("+8610000000000", False),
    "97100000000": ("+97100000000", False),
    "021 5550000": ("+62215550000", False),
    "6281234567": ("+6281234567", False),
    "62812345678": ("+62812345678", True),
    "62812345678901": ("+62812345678901", True),
    "628123456789012": ("+628123456789012", False),
    "": ("", False),
    "  ": ("", False),
    "-": ("", False),
    "n/a": ("", False),
    None: ("", False),
}


def test_phones(spark):
    got = values(spark, lambda x: F.struct(phones.normalized(x).alias("n"), phones.is_mobile(phones.normalized(x)).alias("m")), PHONES)
    assert [(r.n, r.m) for r in got] == list(PHONES.values())
    assert values(spark, phones.is_landline, ["+62215550000", "+622515550", "+6299912345", "+6281200000001", "+622112345678901"]) == [True, False, False, False, False]


def test_phones_in_text(spark):
    t = ["call 0812 0000 0001 or +62 812-0000-0001", "Rp 1.250.000.000", "id 7708120000000199"]
    assert values(spark, phones.in_text, t) == [["+6281200000001"], [], []]


def test_links(spark):
    from kontaktor.functions import fixed

    page = '<a href="https://WA.me/6281200000001">x</a> <a href="https://api.whatsapp.com/send?phone=+6281200000002">y</a> <a href = "tel: 021-555 0000">z</a>'
    assert values(spark, lambda x: phones.in_links(x, fixed.WHATSAPP_LINK), [page]) == [["+6281200000001", "+6281200000002"]]
    assert values(spark, lambda x: phones.in_links(x, fixed.TEL_LINK), [page]) == [["+62215550000"]]


def test_emails(spark):
    t = "A.B@Shop.Example x@y.png info@example.com ..z@w.example me@gmail.com me@gmail.com"
    assert values(spark, lambda x: emails.cleaned(emails.found(x)), [t]) == [["a.b@shop.example", "me@gmail.com", "z@w.example"]]
    assert values(spark, lambda x: emails.cleaned(emails.found(x), drop_free_mail=True), [t]) == [["a.b@shop.example", "z@w.example"]]
    assert values(spark, lambda x: emails.free_mail_dropped(emails.found(x)), [t]) == [2]
    assert values(spark, lambda x: emails.primary(F.split(x, ",")), ["long.name@a.example,info@bbb.example,cs@cc.example", "bb@x.example,a@x.example"]) == ["cs@cc.example", "a@x.example"]


def test_company_names(spark):
    cases = [
        ("<title>Home | Hotel Contoh &amp; Spa - Bali</title>", "http://a.example/", "Hotel Contoh & Spa"),
        ('<meta property="og:site_name" content=" Toko  A "><title>B</title>', "http://a.example/", "Toko  A"),
        ('<meta content="Toko B" property="og:site_name">', "http://a.example/", "Toko B"),
        ("<title>Contact Us</title>", "http://www.toko-o'neil.example/", "Toko O'Neil"),
        ("", "http://hotel.co.id", "Hotel.Co"),
        ("", "", ""),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, html string, url string, want string")
    for r in rows.select("want", names.company(F.col("html"), F.col("url")).alias("got")).collect():
        assert r.got == r.want


def test_query_text(spark):
    assert values(spark, lambda x: query_text.key(x, F.lit("API")), ["  Hotel  Bali\n"]) == ["hotel bali|api"]
    domains = F.array(*map(F.lit, ("x.com", "A.example", "a.example", " ", "b.example")))
    assert values(spark, lambda x: query_text.with_negative_operators(x, domains, 2), ["netflix.com", "q", "", None]) == ["netflix.com -site:a.example -site:b.example", "q -site:x.com -site:a.example", "", None]
    assert values(spark, query_text.without_negative_operators, ["a  -SITE:x b site:y", None]) == ["a b site:y", ""]
    assert values(spark, query_text.terms, ["Hotel hotel di Bali -Site:x.example kontak"]) == [["hotel", "hotel", "bali"]]
    words = F.array(F.lit("bali"))
    q = ["hotel bali Ubud PT site:z.example email", None]
    assert values(spark, lambda x: query_text.places(x, words), q) == [["bali", "ubud"], []]
    assert values(spark, lambda x: query_text.topics(x, words), q) == [["hotel"], []]
    rows = spark.createDataFrame([("q", 0), ("q", 11), ("q", 500), ("site:a", 50), ("a OR b", 50), ("site:a", 5)], "q string, n int")
    assert [r[0] for r in rows.select(query_text.request_size(F.col("q"), F.col("n"))).collect()] == [1, 11, 100, 10, 10, 5]


def test_small_texts(spark):
    assert values(spark, text.title_case, ["o'neil 3abc élan"]) == ["O'Neil 3Abc Élan"]
    assert values(spark, text.is_safe_to_click, ["Show  Number", "hubungi kami - kirim pesan", "x" * 61 + " hubungi", None]) == [True, False, False, False]
    assert values(spark, text.is_bot_check, ["Just a moment...", "captcha " * 60, "hello", "", None]) == [True, False, False, False, False]
    assert values(spark, text.scrape_status, ["", None, "Blocked by robots.txt", "blocked", "timeout"]) == ["ok", "ok", "robots_blocked", "blocked_domain", "error"]


def test_unwrapped_links(spark):
    cases = {"https://e.example/ck?x=1&u=a1aHR0cHM6Ly9hLmV4YW1wbGUvP3E9MQ&n=1": "https://a.example/?q=1", "https://e.example/ck?u=a1!!": "https://e.example/ck?u=a1!!", "https://a.example/": "https://a.example/"}
    assert values(spark, urls.unwrapped, cases) == list(cases.values())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("0123456789+-. ()x", max_size=18), min_size=20, max_size=40))
def test_normalising_twice_changes_nothing(spark, raw):
    once = values(spark, phones.normalized, raw)
    assert values(spark, phones.normalized, [x for x in once if x.startswith("+62")]) == [x for x in once if x.startswith("+62")]


@pytest.mark.parametrize("n", [10, 11])
def test_credits(spark, n):
    assert values(spark, lambda x: query_text.credits(F.lit(3), F.lit(n)), ["x"]) == [3 if n <= 10 else 6]
