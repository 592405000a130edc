"""Contacts of pages: e-mails, WhatsApp links, numbers, contact blocks, links to contact pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dom, emails, fixed, names, phones, urls
from ..functions.text import any_of, collapse, contains_any, is_bot_check, text_or_empty


def _without_mailto(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)^mailto:", ""))


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def _first(values: Column) -> Column:
    return F.coalesce(F.get(_filled(values), F.lit(0)), F.lit(""))


def spread(pages: DataFrame) -> DataFrame:
    """pages in as many partitions as there are cores, if they came in fewer than half so many: a small input, since large ones
    are read in many. Parsing costs far more than to move them."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if 2 * pages.rdd.getNumPartitions() < cores else pages


def parsed(pages: DataFrame) -> DataFrame:
    """pages (ord, url, html, error) with the parser's facts: each page is parsed once, where it has a body."""
    has = F.col("error").isNull() if "error" in pages.columns else F.lit(True)
    return spread(pages).withColumn("f", dom.facts(F.when(has, F.col("html")), F.col("url"))).withColumn("ld", F.col("f.ld"))


def contacts(pages: DataFrame, *, drop_free_mail: bool = False) -> DataFrame:
    """pages with company, emails, whatsapp, phones, error, page_type and address: one chain of expressions over the facts."""
    p = parsed(pages if "error" in pages.columns else pages.withColumn("error", F.lit(None).cast("string")))
    html = text_or_empty(F.col("html"))
    bot = is_bot_check(F.col("f.text"))
    ld_emails = F.flatten(F.transform("ld", lambda n: F.array(n["email"], n["contact_email"])))
    ld_emails = F.transform(F.filter(ld_emails, lambda e: e.contains("@")), _without_mailto)
    ld_phones = F.flatten(F.transform("ld", lambda n: F.array(n["telephone"], n["phone"], n["fax"])))
    ld_phones = F.filter(F.transform(F.filter(ld_phones, lambda n: n.rlike("[0-9]")), phones.normalized), phones.is_mobile)
    empty = F.array().cast("array<string>")
    ok = F.col("error").isNull() & ~bot
    p = p.select(
        *pages.columns if "error" in pages.columns else [*pages.columns, "error"],
        "f",
        "ld",
        names.company(html, F.col("url")).alias("title_name"),
        F.when(ok, emails.cleaned(F.concat(emails.found(F.col("f.markup")), ld_emails), drop_free_mail=drop_free_mail)).otherwise(empty).alias("e"),
        F.when(ok, phones.in_links(html, fixed.WHATSAPP_LINK)).otherwise(empty).alias("w"),
        F.when(ok, F.array_union(F.array_union(phones.in_text(F.col("f.markup")), ld_phones), phones.in_links(html, fixed.TEL_LINK))).otherwise(empty).alias("p"),
        (F.col("error").isNull() & bot).alias("bot"),
    )
    p = with_block(p)
    structured = F.col("block").isNotNull() & F.col("error").isNull()
    of = lambda c: F.when(structured, F.col(f"block.{c}")).otherwise(F.lit(""))
    add = lambda c: _filled(F.array(of(c)))
    e = F.array_sort(F.array_union("e", emails.cleaned(add("email"), drop_free_mail=drop_free_mail)))
    w = F.array_sort(F.array_union("w", add("whatsapp")))
    ph = F.array_sort(F.array_except(F.array_union("p", add("phone")), w))
    return p.select(
        *[c for c in pages.columns if c not in ("error", "html")],
        "html",
        F.coalesce(F.nullif(of("name"), F.lit("")), F.when(F.col("bot"), "").otherwise(F.col("title_name"))).alias("company"),
        e.alias("emails"),
        w.alias("whatsapp"),
        ph.alias("phones"),
        F.coalesce("error", F.when(F.col("bot"), fixed.BOT_CHECK_ERROR)).alias("error"),
        F.when(structured, "structured").otherwise("flat").alias("page_type"),
        of("address").alias("address"),
        F.lit("static").alias("render_mode"),
        F.col("f.links").alias("links"),
        (F.col("f.empty_root") | F.exists("f.noscript", lambda t: contains_any(t, fixed.NOSCRIPT_MARKERS))).alias("looks_scripted"),
    )


def is_structured(ld: Column, facts: Column) -> Column:
    kinds = F.array(*map(F.lit, fixed.STRUCTURED_TYPES))
    return F.exists(ld, lambda n: F.arrays_overlap(n["types"], kinds)) | facts["has_address"] | facts["anchor_label"].isNotNull()


def with_block(p: DataFrame) -> DataFrame:
    """p and its labelled contact block, null where there is none: structured data first, then labelled lines near the anchor.

    p has title_name, which names a block without a name of its own."""
    kinds = F.array(*map(F.lit, fixed.STRUCTURED_TYPES))
    near = text_or_empty(F.col("f.scope_text"))
    p = p.withColumn("own", F.filter("ld", lambda n: F.arrays_overlap(n["types"], kinds)))
    p = p.withColumns({f"_{k}": collapse(F.regexp_extract(near, pattern, 1)) for k, pattern in (fixed.LABELLED_LINES | {"street": fixed.STREET_LINE}).items()})
    each = lambda f: F.transform("own", f)
    p = p.withColumns(
        {
            "_email": _first(F.concat(F.transform(F.filter(each(lambda n: n["email"]), lambda e: e.contains("@")), _without_mailto), F.array("_email"))),
            "_phone": _first(F.concat(F.transform(F.filter(each(lambda n: n["telephone"]), lambda t: t.rlike("[0-9]")), phones.normalized), F.array(phones.normalized(F.col("_phone"))))),
            "_address": _first(F.concat(each(lambda n: n["address"]), F.array("_address", "_street"))),
            "_whatsapp": phones.normalized(F.col("_whatsapp")),
            "_name": _first(F.concat(each(lambda n: collapse(n["name"])), F.array("title_name"))),
            "_label": F.when(F.size("own") > 0, "json-ld").otherwise(F.coalesce("f.anchor_label", F.lit(""))),
        }
    )
    fields = ("label", "name", "address", "phone", "email", "whatsapp")
    some = any_of(F.col(f"_{c}") != "" for c in fields[2:])
    block = F.struct(*(F.col(f"_{c}").alias(c) for c in fields))
    return p.withColumn("block", F.when(is_structured(F.col("ld"), F.col("f")) & some, block)).drop("own", "_street", *(f"_{c}" for c in fields))


def contact_links(found: DataFrame, *, limit: int = fixed.MAX_CONTACT_PAGES) -> DataFrame:
    """(url, target, rank): a page's links to contact pages of its own host, best word first, then the shortest, then the first."""
    own = urls.host(F.col("url"))
    here = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", "")
    x = found.select("url", F.explode("links").alias("l"), own.alias("host"), here.alias("here"))
    target, href = F.col("l.target"), F.col("l.href")
    skipped = (href == "") | any_of(href.startswith(s) for s in ("mailto:", "tel:", "javascript:", "#"))
    x = x.where(~skipped & (target != "") & (target != F.col("here")) & target.rlike("(?i)^https?://") & (urls.host(target) == F.col("host")))
    hay = F.lower(F.concat_ws(" ", href, "l.label"))
    word = F.coalesce(*(F.when(hay.contains(w), k) for k, w in enumerate(fixed.CONTACT_LINK_WORDS)))
    best = x.withColumn("word", word).where("word IS NOT NULL").groupBy("url", target.alias("target")).agg(F.min("word").alias("word"), F.min("l.pos").alias("pos"))
    w = Window.partitionBy("url").orderBy("word", F.length("target"), "pos")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("url", "target", "rank")


def with_followed(found: DataFrame, linked: DataFrame) -> DataFrame:
    """found pages and what their contact pages add, in rank order, up to the first that brings an e-mail.

    found: contacts() of pages; linked: contacts() of stored pages that links may lead to. Only pages without e-mails follow."""
    followers = found.where((F.size("emails") == 0) & F.col("error").isNull())
    there = linked.select(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", "").alias("target"), F.col("emails").alias("te"), F.col("whatsapp").alias("tw"), F.col("phones").alias("tp"), F.col("error").alias("terr"))
    hits = contact_links(followers).join(there.where("terr IS NULL").dropDuplicates(["target"]), "target")
    first = F.min(F.when(F.size("te") > 0, F.col("rank"))).over(Window.partitionBy("url"))
    hits = hits.withColumn("until", first).where("until IS NULL OR rank <= until")
    bag = hits.groupBy("url").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("te", "tw", "tp")), F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("followed"))
    none = F.array().cast("array<string>")
    out = found.join(bag, "url", "left")
    union = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, none)))
    out = out.withColumns({"emails": union("emails", "te"), "whatsapp": union("whatsapp", "tw"), "phones": union("phones", "tp"), "followed": F.coalesce("followed", none)})
    return out.withColumn("phones", F.array_except("phones", "whatsapp")).select(*found.columns, "followed")


def needs_render(found: DataFrame) -> Column:
    n = F.size("emails") + F.size("whatsapp") + F.size("phones")
    body = text_or_empty(F.col("html"))
    return (n == 0) & (body != "") & ((F.length(body) < fixed.RENDER_SIZE_HINT) | F.col("looks_scripted"))


def with_rendered(found: DataFrame, rendered: DataFrame) -> DataFrame:
    """found pages and what their rendered forms add; rendered: contacts() of bodies that a browser made, by url."""
    r = rendered.select("url", F.col("emails").alias("re"), F.col("whatsapp").alias("rw"), F.col("phones").alias("rp"), F.col("company").alias("rc"), F.col("error").alias("rerr"), F.lit(True).alias("tried"))
    out = found.withColumn("_need", needs_render(found)).join(r, "url", "left")
    none = F.array().cast("array<string>")
    use = F.col("_need") & F.coalesce("tried", F.lit(False)) & F.col("rerr").isNull()
    union = lambda a, b: F.array_sort(F.array_union(a, F.when(use, F.col(b)).otherwise(none)))
    before = F.size("emails") + F.size("whatsapp") + F.size("phones")
    out = out.withColumn("_before", before).withColumns({"emails": union("emails", "re"), "whatsapp": union("whatsapp", "rw"), "phones": union("phones", "rp")})
    grew = F.size("emails") + F.size("whatsapp") + F.size("phones") > F.col("_before")
    mode = F.when(F.col("_need") & F.col("tried"), F.when(grew, "rendered").otherwise("rendered_empty")).otherwise(F.col("render_mode"))
    company = F.when(use & (text_or_empty(F.col("company")) == ""), F.col("rc")).otherwise(F.col("company"))
    error = F.when(grew & (F.col("error") == fixed.BOT_CHECK_ERROR), F.lit(None)).otherwise(F.col("error"))
    return out.withColumns({"render_mode": mode, "company": company, "error": error}).select(*found.columns)


def outcome_line(found: DataFrame) -> Column:
    """What a run says of each page: why it was passed over, or how many contacts it and the pages it led to gave."""
    n = lambda c: F.size(c).cast("string")
    total = F.size("emails") + F.size("whatsapp") + F.size("phones")
    via = F.array_join(F.transform("followed", lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))), ", ") if "followed" in found.columns else F.lit("")
    counts = F.concat(F.lit("emails="), n("emails"), F.lit(" whatsapp="), n("whatsapp"), F.lit(" phone="), n("phones"), F.when(via != "", F.concat(F.lit(" (via "), via, F.lit(")"))).otherwise(""))
    return F.when(F.col("error").isNotNull(), F.concat(F.lit("skipped ("), "error", F.lit(")"))).when(total == 0, "no contacts found").otherwise(counts)
