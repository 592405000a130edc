"""Sources, sinks, encryption, state and streams."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from kontaktor.functions import fixed
from kontaktor.sinks import crypto, publish, tables
from kontaktor.sources import fetch, files, search_api
from kontaktor.streaming import resume


def test_list_files(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text("# a\n  hotel bali \n\n  # indented\nhttps://a.example\n")
    assert [r.query for r in files.queries(spark, str(p)).orderBy("ord").collect()] == ["hotel bali", "https://a.example"]
    assert [r.url for r in files.url_list(spark, str(p)).orderBy("ord").collect()] == ["hotel bali", "# indented", "https://a.example"]
    p.write_text("Agg.example # why\n#x\n\nagg.example\n")
    assert [r.domain for r in files.blocklist(spark, str(p)).collect()] == ["agg.example"]
    assert files.blocklist(spark, str(tmp_path / "none")).count() == 0


def test_configuration_and_old_csv(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"templates": ["a {city}"], "segments": ["s"], "cities": ["Kota Baru"], "suffix": ""}, indent=1))
    assert files.cities(spark, str(p)) == ["Kota Baru"] and files.cities(spark, str(tmp_path / "none")) == []
    q = tmp_path / "old.csv"
    q.write_text('﻿company,email,note\n"A, B",a@b.example,x\n', encoding="utf-8")
    r = files.companies(spark, str(q)).first()
    assert (r.company, r.email, r.status, r.note) == ("A, B", "a@b.example", "", "x")


def test_published_csv(spark, tmp_path):
    rows = spark.createDataFrame([("A; \"x\"", "n")], "company string, extra string").select(*(F.col(c) if c == "company" else F.lit("").alias(c) for c in fixed.COMPANY_COLUMNS), "extra")
    p = publish.write_csv(rows, tmp_path / "out.csv")
    raw = p.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfcompany,") and raw.split(b"\r\n")[0].endswith(b",status,extra")
    assert stat.S_IMODE(os.stat(p).st_mode) == 0o600
    assert publish.count_rows(p) == 1
    (tmp_path / "busy.csv").mkdir()
    assert publish.write_csv(rows.limit(0), tmp_path / "busy.csv").name == "busy-2.csv"
    assert publish.count_rows(tmp_path / "busy-2.csv") == 0


def test_partial_files(tmp_path):
    assert publish.partial_path("d/out.csv").name == "out.partial.csv"
    for n in ("out.partial.csv", "out.partial-2.csv", "other.partial.csv"):
        (tmp_path / n).write_text("x")
    assert publish.remove_partials(tmp_path / "out.csv", 0) == 0
    assert publish.remove_partials(tmp_path / "out.csv", 3) == 2
    assert publish.managed("../../x.enc", tmp_path / "m") == tmp_path / "m" / "x.enc"
    assert stat.S_IMODE(os.stat(tmp_path / "m").st_mode) == 0o700


def test_a_crash_between_urls_and_progress_changes_nothing(spark, tmp_path):
    s = resume.State(spark, str(tmp_path / "state"), now=lambda: "t")
    pages = spark.createDataFrame([("q|api", "q", "api", 1, "u1", True)], "query_key string, query_text string, engine string, page int, url string, fresh boolean")
    s.record_results(pages)
    publish_ = s._publish

    def crash(table, rows, number=None):
        if table == "query_state":
            raise OSError("gone")
        publish_(table, rows, number)

    s._publish = crash
    with pytest.raises(OSError):
        s.record_results(pages.selectExpr("query_key", "query_text", "engine", "2 AS page", "'u2' AS url", "fresh"))
    s._publish = publish_
    assert [r.url for r in s.read("seen_urls").collect()] == ["u1"] and s.read("query_state").first().next_page == 2
    for k in range(3, 7):
        s.record_results(pages.selectExpr("query_key", "query_text", "engine", f"{k} AS page", f"'u{k}' AS url", "fresh"))
    assert sorted(r.url for r in s.read("seen_urls").collect()) == ["u1", "u3", "u4", "u5", "u6"]
    assert max(len(s._versions(t)) for t in ("seen_urls", "query_state")) <= 2


def test_intermediate_tables(spark, monkeypatch):
    rows = spark.range(10).selectExpr("id", "id % 2 AS o")
    t = tables.written(rows, by="o")
    assert sorted(t.columns) == ["id", "o"] and t.count() == 10
    tables.discard(t, part="o=1")
    assert spark.read.parquet(t.written_at).where("o = 0").count() == 5 and not os.path.exists(f"{t.written_at}/o=1".removeprefix("file:"))
    tables.discard(t)
    assert not os.path.exists(t.written_at.removeprefix("file:"))
    one, two = tables.written(rows), tables.written(rows)
    tables.release(spark)
    assert not any(os.path.exists(x.written_at.removeprefix("file:")) for x in (one, two))

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError):
        tables.shared_folder(Cluster)


def test_results_are_inserted_once(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "")], "ord long, url string")
    assert publish.insert_results(rows, str(tmp_path / "store")) == (2, 2)
    assert publish.insert_results(rows.union(spark.createDataFrame([(9, "c")], rows.schema)), str(tmp_path / "store")) == (1, 4)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "store")).collect())) == [(0, "a"), (1, "b"), (9, "c")]
    said = []
    (tmp_path / "x.enc").write_text("")
    publish.managed("x.enc", tmp_path, said.append)
    publish.managed("y.enc", tmp_path, said.append)
    assert len(said) == 1 and "x.enc" in said[0]


def test_bodies_are_read_no_further_than_the_limit():
    taken = []

    def chunks():
        for k in range(100):
            taken.append(k)
            yield b"x" * (fixed.MAX_BODY // 4)

    assert fetch.page_of(fetch.Answer(200, {"Content-Type": "text/html"}, chunks())) == (None, "response too large") and len(taken) == 5
    assert fetch.page_of(fetch.Answer(200, {"Content-Type": "text/html"}, iter([b"a", b"b"]))) == ("ab", None)


def test_robots_rules_are_asked_once_for_each_base(spark):
    wanted = spark.createDataFrame([("https://a.example/x",), ("https://a.example/y",), ("http://a.example/",), ("https://down.example/",), ("nonsense",)], "url string")

    def get(url):
        if "down" in url:
            return fetch.Answer(failure="Timeout")
        return fetch.Answer(200, {}, b"User-agent: *\nDisallow: /x") if url.startswith("https") else fetch.Answer(404)

    got = sorted((r.base, r.status, bool(r.body)) for r in fetch.robots_rules(wanted, get).collect() if r.status) + [r.base for r in fetch.robots_rules(wanted, get).where("status IS NULL").collect()]
    assert got == [("http://a.example", 404, False), ("https://a.example", 200, True), "https://down.example"]
    assert fetch.workers_of(99) == fixed.MAX_WORKERS and fetch.workers_of(0) == 1 and fetch.workers_of(4, render=True) == 1


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("é", 1)], "title string, n int")
    assert publish.export_results(rows.limit(0), tmp_path / "x.csv") is None
    assert json.loads(publish.export_results(rows, tmp_path / "x.json").read_text()) == [{"title": "é", "n": 1}]


def test_fernet_specification_vector(spark):
    """The public test vector of the Fernet specification."""
    import base64

    key = base64.urlsafe_b64decode("cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4=")
    token = b"gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
    assert crypto.open_token(spark, token, key) == b"hello"
    assert crypto.fernet_token(spark, b"hello", key, iv=bytes(range(16)), at=499162800) == token


def test_encrypted_files(spark, tmp_path):
    source = tmp_path / "a.csv"
    source.write_bytes("﻿company,email\r\nÁ,a@b.example\r\n".encode())
    sealed = crypto.encrypt_file(spark, source, tmp_path / "a.enc", "secret", delete_source=True)
    assert not source.exists() and stat.S_IMODE(os.stat(sealed).st_mode) == 0o600
    assert crypto.read_encrypted_csv(spark, sealed, "secret").first().asDict() == {"company": "Á", "email": "a@b.example"}
    assert crypto.preview(crypto.decrypt_file(spark, sealed, "secret"), 1) == "company,email"
    with pytest.raises(ValueError):
        crypto.decrypt_file(spark, sealed, "wrong")
    blob = bytearray(sealed.read_bytes())
    blob[40] ^= 1
    with pytest.raises(ValueError):
        crypto.decrypt_bytes(spark, bytes(blob), "secret")
    with pytest.raises(ValueError, match="zip"):
        crypto.decrypt_bytes(spark, b"PK\x03\x04" + b"x" * 40, "secret")
    with pytest.raises(ValueError, match="short"):
        crypto.decrypt_bytes(spark, b"x" * 16, "secret")


def test_passwords(monkeypatch):
    monkeypatch.setenv("CONTACT_FILE_PASSWORD", "env")
    assert crypto.password_from("arg") == "arg" and crypto.password_from(None) == "env"
    monkeypatch.delenv("CONTACT_FILE_PASSWORD")
    assert crypto.password_from(None, ask=lambda _: "x", confirm=True) == "x"
    answers = iter("ab")
    with pytest.raises(ValueError):
        crypto.password_from(None, ask=lambda _: next(answers), confirm=True)


def test_bodies_are_decoded(spark):
    cases = [("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"), (b'<meta charset="latin-1">\xe9', "text/html", '<meta charset="latin-1">é'), ("é".encode(), "", "é"), (b"\xff", "text/html; charset=nope", "�")]
    rows = spark.createDataFrame([(i, bytearray(b), t) for i, (b, t, _) in enumerate(cases)], "i int, b binary, t string")
    assert [r[0] for r in rows.orderBy("i").select(fetch.decoded(F.col("b"), F.col("t"))).collect()] == [c[2] for c in cases]


def test_answers_become_pages():
    html = {"Content-Type": "text/html"}
    assert fetch.page_of(fetch.Answer(200, html, b"x")) == ("x", None)
    assert fetch.page_of(fetch.Answer(404, html))[1] == "HTTPError: 404"
    assert fetch.page_of(fetch.Answer(200, {"Content-Type": "image/png"}))[1] == "skipped non-HTML content (image/png)"
    assert fetch.page_of(fetch.Answer(200, html | {"Content-Length": str(fixed.MAX_BODY + 1)}))[1] == "response too large"
    assert fetch.page_of(fetch.Answer(200, html, b"x" * (fixed.MAX_BODY + 1)))[1] == "response too large"


def test_attempts():
    waits, answers = [], iter([fetch.Answer(failure="Timeout"), fetch.Answer(failure="Timeout"), fetch.Answer(200, {"Content-Type": "text/plain"}, b"ok")])
    assert fetch.fetched("u", lambda _: next(answers), sleep=waits.append) == ("ok", None) and waits == [2.0, 4.0]
    assert fetch.fetched("u", lambda _: fetch.Answer(failure="Timeout"), sleep=waits.append) == (None, "Timeout")


def test_pages_of_a_host_stay_together(spark):
    wanted = spark.createDataFrame([(i, f"https://h{i % 3}.example/{i}") for i in range(12)], "ord long, url string")
    got = fetch.pages(wanted, lambda u: fetch.Answer(200, {"Content-Type": "text/html"}, u.encode()), delay=0).collect()
    assert {r.url: r.html for r in got} == {r.url: r.url for r in wanted.collect()}
    assert [r.slot for r in fetch.slots(wanted).where("url like '%h0.%'").orderBy("ord").collect()] == [0, 2, 4, 6]


def test_robots(spark):
    wanted = spark.createDataFrame([("https://a.example/private/x",), ("https://a.example/x",), ("https://b.example/private/x",), ("https://c.example/private/x",)], "url string")
    rules = "User-agent: *\nDisallow: /private\n"
    robots = spark.createDataFrame([("https://a.example", rules, 200), ("https://b.example", rules, 500)], "base string, body string, status int")
    assert [r.allowed for r in fetch.with_robots(wanted, robots).orderBy("url").collect()] == [False, True, True, True]


def test_rejections(spark):
    rows = spark.createDataFrame([(500, "text/html", 1), (200, "image/png", 1), (200, "TEXT/HTML", fixed.MAX_BODY + 1), (200, "text/html", 1)], "s int, t string, n long")
    assert [r[0] for r in rows.select(fetch.rejection(F.col("s"), F.col("t"), F.col("n"))).collect()] == ["HTTPError: 500", "skipped non-HTML content (image/png)", "response too large", None]


def test_search_calls():
    seen = []

    def post(payload, headers):
        seen.append((payload, headers))
        return {"bad": (400, ""), "down": (503, ""), "key": (401, ""), "dry": (429, "")}.get(payload["q"], (200, "{}"))

    assert search_api.call(post, "k", "q", 10, 2) == "{}" and seen[0] == ({"q": "q", "gl": "id", "hl": "id", "num": 10, "page": 2}, {"X-API-KEY": "k"})
    assert search_api.call(post, "k", "bad", 10) is None and len(seen) == 2
    assert search_api.call(post, "k", "down", 10) is None and len(seen) == 5
    with pytest.raises(search_api.AuthError):
        search_api.search_many(post, "k", ["key"], 10)
    with pytest.raises(search_api.AuthError):
        search_api.search_many(post, "", ["q"], 10)
    assert search_api.search_many(post, "k", ["a", "dry", "b"], 10) == [("a", 1, "{}")]


def test_search_data_source(spark):
    spark.dataSource.register(search_api.data_source(lambda p, h: (200, json.dumps({"organic": [{"link": "https://x.example/" + p["q"]}]}))))
    got = spark.read.format("contact_search").option("queries", '["a", "b"]').option("key", "k").load().collect()
    assert sorted(r.query for r in got) == ["a", "b"]


def test_result_pages(spark):
    html = '<li><h2><a href="https://e.example/ck?u=a1aHR0cHM6Ly9hLmV4YW1wbGUv">A <b>name</b></a></h2></li><a href="/own">own</a>'
    rows = spark.createDataFrame([("q", 0, html), ("q", 1, "<script src='/httpservice/retry'></script>" + html)], "query string, page int, html string")
    assert [(r.url, r.title) for r in search_api.results_of_pages(rows).collect()] == [("https://a.example/", "A name")]


ITEMS = """<ol><li class="b_algo x"><h2><a href="https://e.example/ck?u=a1aHR0cHM6Ly9hLmV4YW1wbGUvP3g9MQ">A <b>name</b></a></h2><div class="b_caption"><p>what <i>it</i> is</p></div>
<div class="b_attribution"><cite>a.<b>example</b></cite></div></li><li class="b_algo"><p class="b_lineclamp2">two</p><h2><a href="https://b.example/">B</a></h2><p>one</p><cite>b</cite></li>
<li class="b_algo"><a href="https://c.example">no heading</a></li><li class="b_ad"><h2><a href="https://ad.example">ad</a></h2></li></ol>"""


def test_result_items(spark):
    rows = spark.createDataFrame([("q", 1, ITEMS), ("q", 2, "<p>none</p>"), ("r", 1, "enablejs " + ITEMS), ("s", 1, None)], "query string, page int, html string")
    got = [tuple(r) for r in search_api.results_of_pages(rows, items=True).orderBy("ord").collect()]
    assert got == [("q", 1000, "https://a.example/?x=1", "A name", "a.example", "what it is"), ("q", 1001, "https://b.example/", "B", "b", "two")]


def test_result_pages_are_warmed_up_and_tried_again(spark, tmp_path):
    asked, page = str(tmp_path / "asked"), ITEMS

    def get(url):
        with open(asked, "a") as f:
            f.write(url + "\n")
        n = open(asked).read().count(url + "\n")
        if url == "home":
            return fetch.Answer(200, {}, b"")
        if "busy" in url:
            return fetch.Answer(503) if n < 3 else fetch.Answer(200, {}, page.encode())
        if "gone" in url:
            return fetch.Answer(404)
        return fetch.Answer(200, {}, page.encode() if n > 1 or "first=11" in url else b"<p>who are you?</p>")

    queries = spark.createDataFrame([(0, "cold"), (1, "busy"), (2, "gone")], "qord long, query string")
    got = search_api.result_pages(queries, get, 15, address=lambda q, first: f"{q}&first={first}", home="home", sleep=lambda s: None).collect()
    assert [(r.query, r.page, "b_algo" in r.html) for r in got] == [("cold", 1, True), ("cold", 2, True), ("busy", 1, True), ("busy", 2, True)]
    assert open(asked).read().split() == ["home", "cold&first=1", "home", "cold&first=1", "cold&first=11", *["busy&first=1"] * 3, *["busy&first=11"] * 3, "gone&first=1"]


def test_cache(spark):
    results = spark.createDataFrame([("q", 1, "u2"), ("q", 0, "u1"), ("r", 0, "u3")], "query string, ord long, url string")
    cache = search_api.cacheable(results, "api", 10)
    wanted = spark.createDataFrame([("api_q_10",), ("api_none_10",)], "cache_key string")
    assert [(r.query, r.ord, r.url) for r in search_api.from_cache(wanted, cache).orderBy("ord").collect()] == [("q", 0, "u1"), ("q", 1, "u2")]


def test_partial_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("A",)], "company string").select(*(F.col(c) if c == "company" else F.lit("").alias(c) for c in fixed.COMPANY_COLUMNS))
    assert publish.count_rows(publish.write_partial(rows, tmp_path / "o.csv")) == 1
    assert publish.write_partial(rows.limit(0), tmp_path / "o.csv").name == "o.partial.csv" and publish.partials(tmp_path / "o.csv")


FEED = "query_key string, page int, pos int, url string"


def test_resumable_stream(spark, tmp_path):
    source = str(tmp_path / "feed")
    os.makedirs(source)
    feed = spark.readStream.schema(FEED).parquet(source)

    def add(*rows):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(source)

    add(("q", 1, 0, "a"), ("q", 1, 1, "a"), ("q", 1, 2, "b"), ("r", 1, 0, "a"))
    out: list = []
    run = lambda: resume.checkpointed(resume.fresh_urls(feed), lambda df, n: out.extend(map(tuple, df.collect())), str(tmp_path / "at")).awaitTermination(120)
    run()
    assert sorted(r[:4] for r in out) == [("q", 1, 0, "a"), ("q", 1, 1, "a"), ("q", 1, 2, "b"), ("r", 1, 0, "a")]
    out.clear()
    add(("q", 2, 0, "b"), ("q", 2, 1, "c"), ("q", 3, 0, "a"), ("q", 4, 0, "b"), ("q", 5, 0, "new"))
    run()
    assert [r[:4] for r in out] == [("q", 2, 1, "c")]


def test_state_tables(spark, tmp_path):
    s = resume.State(spark, str(tmp_path), now=lambda: "t1")
    assert s.read("query_state").count() == 0
    pages = "query_key string, query_text string, engine string, page int, url string, fresh boolean"
    s.record_results(spark.createDataFrame([("q|api", "Q", "api", 1, "a", True), ("q|api", "Q", "api", 1, "b", True), ("q|api", "Q", "api", 2, "a", False)], pages))
    r = s.read("query_state").first()
    assert (r.next_page, r.total_seen, r.run_count, r.empty_streak, r.exhausted_at) == (3, 2, 1, 1, None)
    s.record_results(spark.createDataFrame([("q|api", "Q", "api", 3, "a", False), ("z|api", "Z", "api", 1, "a", True)], pages))
    by = {r.query_key: r for r in s.read("query_state").collect()}
    assert (by["q|api"].empty_streak, by["q|api"].exhausted_at, by["q|api"].next_page) == (2, "t1", 4)
    s.bump_run_count("q|api")
    s.mark_exhausted("z|api")
    assert {r.query_key: (r.run_count, r.exhausted_at) for r in s.listed().collect()} == {"q|api": (2, "t1"), "z|api": (1, "t1")}
    s.reset("q|api")
    assert [r.query_key for r in s.read("query_state").collect()] == ["z|api"] and [r.query_key for r in s.read("seen_urls").collect()] == ["z|api"]
    s.record_scraped(spark.createDataFrame([("u", "error", 0), ("v", "ok", 2)], "url string, status string, contacts_found int"))
    s.record_scraped(spark.createDataFrame([("u", "ok", 3)], "url string, status string, contacts_found int"))
    assert {(r.url, r.status, r.contacts_found) for r in s.read("scraped_urls").collect()} == {("u", "ok", 3), ("v", "ok", 2)}
