"""Search to company rows with injected transports, and the command line."""

import json

import pytest

from kontaktor.plans import cli, pipeline
from kontaktor.sinks import publish
from kontaktor.sources import fetch
from kontaktor.sources.search_api import AuthError
from kontaktor.streaming.resume import State

SITE = {
    "https://toko.example/": "<title>Toko A</title><a href='/kontak'>k</a>",
    "https://toko.example/kontak": "cs@toko.example",
    "https://b.example/": "<title>B Shop</title>wa: <a href='https://wa.me/6281200000001'>x</a>",
}


def transport_of(site):
    """A closure, which travels to workers whole."""
    return lambda url: fetch.Answer(200, {"Content-Type": "text/html"}, site[url].encode()) if url in site else fetch.Answer(404, {"Content-Type": "text/html"})


def poster():
    def post(payload, headers):
        links = ["https://toko.example/", "https://agg.example/x"] if "toko" in payload["q"] else ["https://toko.example/", "https://b.example/", "https://c.example/"]
        return 200, json.dumps({"organic": [{"link": u} for u in links]})

    return post


post = poster()


def test_search_to_companies(spark, tmp_path):
    entries, transport = spark.createDataFrame([("agg.example",)], "domain string"), transport_of(dict(SITE))
    o = pipeline.Options(delay=0)
    found, rows = pipeline.stage_search(spark, ["toko", "hotel"], post, "key", entries, o)
    assert [(r.query, r.urls, r.new) for r in rows.orderBy("qord").collect()] == [("toko", 1, 1), ("hotel", 3, 2)]
    robots = spark.createDataFrame([("https://c.example", "User-agent: *\nDisallow: /", 200)], "base string, body string, status int")
    state = State(spark, str(tmp_path / "state"))
    got = {r.host: r for r in pipeline.stage_parse(spark, found, transport, o, robots=robots, state=state).collect()}
    assert (got["toko.example"].email, got["toko.example"].company, got["toko.example"].search_query) == ("cs@toko.example", "Toko A", "toko")
    assert got["b.example"].whatsapp == "+6281200000001" and got["c.example"].status == "blocked by robots.txt"
    assert {r.url: r.status for r in state.read("scraped_urls").collect()} == {"https://toko.example/": "ok", "https://b.example/": "ok", "https://c.example/": "robots_blocked"}
    again = pipeline.stage_parse(spark, found, transport, pipeline.Options(delay=0, skip_scraped=True), state=state)
    assert again.count() == 0


def counting(site, folder):
    """A transport that leaves a line in a file for each URL that it is asked for."""

    def get(url):
        with open(f"{folder}/asked", "a") as f:
            f.write(url + "\n")
        return fetch.Answer(200, {"Content-Type": "text/html"}, site[url].encode()) if url in site else fetch.Answer(404, {"Content-Type": "text/html"})

    return get


def test_robots_hold_for_links_and_each_page_is_asked_once(spark, tmp_path):
    site = dict(SITE) | {
        "https://toko.example/robots.txt": "User-agent: *\nDisallow: /kontak",
        "https://d.example/": "<title>D</title><a href='/kontak'>k</a><a href='/about'>a</a>",
        "https://d.example/x": "<title>D</title><a href='/kontak'>k</a>",
        "https://d.example/kontak": "cs@d.example",
        "https://d.example/about": "info@d.example",
    }
    urls = ["https://toko.example/", "https://d.example/", "https://d.example/x", "https://b.example/"]
    wanted = spark.createDataFrame(list(enumerate(urls)), "ord long, url string")
    state = State(spark, str(tmp_path / "state"))
    rows = pipeline.stage_parse(spark, wanted, counting(site, str(tmp_path)), pipeline.Options(delay=0), state=state)
    got = {r.host: r.email for r in rows.collect()}
    assert got == {"toko.example": "", "d.example": "cs@d.example", "b.example": ""}
    asked = (tmp_path / "asked").read_text().split()
    assert sorted(asked) == sorted({*urls, "https://d.example/kontak", *(f"https://{h}.example/robots.txt" for h in ("toko", "d", "b"))})
    assert state.read("scraped_urls").count() == 4


def test_rules_of_other_bases_are_asked_for_links(spark, tmp_path):
    site = {"https://a.example/": "<a href='http://a.example/kontak'>k</a>", "http://a.example/kontak": "cs@a.example", "http://a.example/robots.txt": "User-agent: *\nDisallow: /"}
    wanted = spark.createDataFrame([(0, "https://a.example/")], "ord long, url string")
    assert pipeline.stage_parse(spark, wanted, counting(site, str(tmp_path)), pipeline.Options(delay=0)).first().email == ""
    assert "http://a.example/kontak" not in (tmp_path / "asked").read_text().split()
    free = pipeline.stage_parse(spark, wanted, transport_of(site), pipeline.Options(delay=0, respect_robots=False))
    assert free.first().email == "cs@a.example"


def test_browser_adds_to_pages_that_scripts_fill(spark, tmp_path):
    site = {"https://js.example/": "<html><div id='root'></div></html>", "https://b.example/": SITE["https://b.example/"]}
    wanted = spark.createDataFrame(list(enumerate(site)), "ord long, url string")
    browser = transport_of({"https://js.example/": "<title>JS</title>cs@js.example"})
    found = {r.url: r for r in pipeline.scraped(wanted, transport_of(site), pipeline.Options(delay=0), renderer=browser).collect()}
    assert (found["https://js.example/"].render_mode, found["https://js.example/"].emails) == ("rendered", ["cs@js.example"])
    assert found["https://b.example/"].render_mode == "static"


def test_waves_leave_partial_files(spark, tmp_path):
    wanted = spark.createDataFrame([(i, u) for i, u in enumerate(SITE)], "ord long, url string")
    out = tmp_path / "out.csv"
    rows = pipeline.stage_parse(spark, wanted, transport_of(dict(SITE)), pipeline.Options(delay=0, checkpoint_every=1, emails_only=True), output=out)
    assert publish.count_rows(publish.partial_path(out)) == 2  # both hosts, though the filter keeps one
    assert pipeline.published(rows, out) == out and not publish.partial_path(out).exists() and publish.count_rows(out) == 1


def paged(asked):
    def post(payload, headers):
        page = payload.get("page", 1)
        with open(asked, "a") as f:
            f.write(f"{payload['q']} {page} {payload['num']}\n")
        if payload["q"] == "dry":
            return 429, ""
        links = {1: ["u1", "u2", "u2"], 2: ["u2", "u3"]}.get(page, ["u1"])
        return 200, json.dumps({"organic": [{"link": f"https://{u}.example/"} for u in links]})

    return post


def test_search_goes_on_where_it_ended(spark, tmp_path):
    state, asked = State(spark, str(tmp_path / "state")), tmp_path / "asked"
    entries, post = spark.createDataFrame([], "domain string"), paged(str(asked))
    o = pipeline.Options(results=3, resume=True, negative_operators=False)
    found, _ = pipeline.stage_search(spark, ["q"], post, "k", entries, o, state)
    assert [r.url for r in found.orderBy("ord").collect()] == ["https://u1.example/", "https://u2.example/"]
    assert asked.read_text().split("\n")[:-1] == ["q 1 3"]
    found, _ = pipeline.stage_search(spark, ["q"], post, "k", entries, o, state)
    assert [r.url for r in found.collect()] == ["https://u3.example/"]
    assert asked.read_text().split("\n")[1:-1] == ["q 2 3", "q 3 3", "q 4 3"]  # two pages without fresh URLs end it
    r = state.read("query_state").first()
    assert (r.next_page, r.total_seen, r.run_count, r.empty_streak) == (5, 4, 2, 2) and r.exhausted_at
    found, _ = pipeline.stage_search(spark, ["q"], post, "k", entries, o, state)
    assert found.count() == 0 and len(asked.read_text().split("\n")) == 5


def test_cache_is_asked_first_and_credit_ends_a_batch(spark, tmp_path):
    asked, entries = tmp_path / "asked", spark.createDataFrame([], "domain string")
    o = pipeline.Options(results=10, cache=str(tmp_path / "cache"), negative_operators=False)
    for _ in range(2):
        found, rows = pipeline.stage_search(spark, ["a", "dry", "b"], paged(str(asked)), "k", entries, o)
        assert [r.url for r in found.orderBy("ord").collect()] == ["https://u1.example/", "https://u2.example/"]
        assert [(r.query, r.urls) for r in rows.collect()] == [("a", 3)]
    assert asked.read_text().split("\n")[:-1] == ["a 1 10", "dry 1 10", "dry 1 10"]
    with pytest.raises(AuthError):
        pipeline.stage_search(spark, ["a"], lambda p, h: (401, ""), "k", entries, pipeline.Options())


def test_costs_are_confirmed(spark):
    with pytest.raises(SystemExit):
        pipeline.stage_search(spark, [f"q{i}" for i in range(60)], post, "key", spark.createDataFrame([], "domain string"), pipeline.Options(results=100))
    typed = spark.createDataFrame([(0, "a booking.com")], "qord long, query_text string")
    assert pipeline.sent(typed).first().query.count("-site:") == 5


def test_command_line(spark, tmp_path, capsys):
    pages = str(tmp_path / "pages")
    spark.createDataFrame(list(SITE.items()), "url string, html string").write.parquet(pages)
    out = tmp_path / "out.csv"
    assert cli.main(["companies", pages, str(out)], spark) == 0
    assert "cs@toko.example" in out.read_text(encoding="utf-8-sig")
    assert cli.main(["audit", str(out)], spark) == 0
    assert "'rows': 2" in capsys.readouterr().out
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"templates": ["{segment} {city}"], "segments": ["hotel"], "cities": ["Bali", "Solo"], "suffix": "email"}))
    assert cli.main(["expand", str(config)], spark) == 0
    assert capsys.readouterr().out.split("\n")[:2] == ["hotel Bali email", "hotel Solo email"]
    assert cli.main(["progress", str(tmp_path / "s")], spark) == 0


def test_run_from_queries_to_rows(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("SEARCH_API_KEY", "k")
    (tmp_path / "block").write_text("agg.example\n")
    (tmp_path / "queries").write_text("toko\n# no\nhotel\n")
    out, state = tmp_path / "out.csv", str(tmp_path / "state")
    common = ["--batch", "--blocklist", str(tmp_path / "block"), "--state", state, "--scrape-delay", "0", "-o", str(out)]
    args = ["run", str(tmp_path / "queries"), *common, "--save-urls", str(tmp_path / "urls.csv"), "--save-yield", str(tmp_path / "yield.csv")]
    assert cli.main(args, spark, post=post, transport=transport_of(dict(SITE))) == 0
    said = capsys.readouterr().out
    assert "https://toko.example/: emails=1 whatsapp=0 phone=0 (via /kontak)" in said and "https://c.example/: skipped (HTTPError: 404)" in said and "credits used: 2" in said
    assert publish.count_rows(out) == 3 and "cs@toko.example" in out.read_text(encoding="utf-8-sig") and not publish.partials(out)
    assert publish.count_rows(tmp_path / "urls.csv") == 3 and "toko,1,1,1" in (tmp_path / "yield.csv").read_text(encoding="utf-8-sig")
    assert cli.main(["run", str(tmp_path / "queries"), *common, "--dry-run"], spark, post=post, transport=transport_of({})) == 0
    assert capsys.readouterr().out.split()[-3:] == ["https://toko.example/", "https://b.example/", "https://c.example/"]
    assert cli.main(["run", str(tmp_path / "queries"), *common, "--skip-scraped", "--checkpoint-every", "0"], spark, post=post, transport=transport_of({})) == 0
    assert publish.count_rows(out) == 1  # only the page that failed is asked again
    assert cli.main(["run", str(tmp_path / "queries"), *common, "--continue", "--restart", "--dry-run"], spark, post=post, transport=transport_of({})) == 0
    (tmp_path / "list").write_text("https://b.example/\n")
    assert cli.main(["run", str(tmp_path / "list"), "--skip-search", "--scrape-delay", "0", "-o", str(tmp_path / "b.csv"), "--high-confidence-only"], spark, transport=transport_of(dict(SITE))) == 0
    assert "+6281200000001" in (tmp_path / "b.csv").read_text(encoding="utf-8-sig")
    with pytest.raises(SystemExit):
        cli.main(["run", "q", "--continue"], spark, post=post)
    with pytest.raises(SystemExit):
        cli.main(["run", "q", "--render"], spark, post=post)
