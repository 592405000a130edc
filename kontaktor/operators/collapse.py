"""Scraped pages to one row per company: grouped by host, contacts united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails, fixed, urls
from ..functions.text import text_or_empty


def _first(value: str | Column, when: Column) -> Column:
    """The value of the first row, in input order, that meets a condition."""
    return F.min_by(value, F.when(when, F.col("ord")))


def _arrays(*columns: str) -> list[Column]:
    return [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in columns]


def united(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, columns): of each key, the distinct values of all rows' arrays, sorted. Values are made distinct before they are
    gathered, so a key with many rows gathers no more than it returns. Keys without any value have no row."""

    def numbered(k: int, column: str) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(k).alias("k"), v.alias("v")))

    each = F.explode(F.concat(*(numbered(k, c) for k, c in enumerate(columns))))
    values = rows.select(key, *_arrays(*columns)).select(key, each.alias("x")).select(key, "x.k", "x.v").distinct()
    return values.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("v")))).alias(c) for k, c in enumerate(columns)))


def companies(results: DataFrame, *, guess_email: bool = False, repeat_whatsapp: bool = False) -> DataFrame:
    """results: ord, url, company, emails, whatsapp, phones, error, page_type, address, render_mode, search_query.

    A host's pages may be many: the group-by first adds up each task's share, and only distinct values are gathered.
    A number that is a WhatsApp number is no phone, unless repeat_whatsapp asks for the pages' own lists."""
    r = results.withColumn("host", urls.host(F.col("url"))).where("host <> ''")
    error, filled = text_or_empty(F.col("error")), lambda c: text_or_empty(F.col(c)) != ""
    rank = F.when(F.col("render_mode") == "rendered", 2).when(F.col("render_mode") == "rendered_empty", 1).otherwise(0)
    g = r.groupBy("host").agg(
        _first("company", filled("company")).alias("company"),
        F.coalesce(_first("url", error == ""), F.min_by("url", "ord")).alias("website"),
        _first("address", filled("address")).alias("address"),
        F.coalesce(F.bool_or(F.col("page_type") == "structured"), F.lit(False)).alias("structured"),
        F.max(rank).alias("rendered"),
        _first("search_query", filled("search_query")).alias("search_query"),
        F.bool_or(error == "").alias("ok"),
        _first("error", error != "").alias("first_error"),
    )
    lists = united(r, "host", ("emails", "whatsapp", "phones")).toDF("host", "e", "w", "p")
    g = g.join(lists, "host", "left").select(*g.columns, *_arrays("e", "w", "p"))
    found = emails.primary(F.col("e"))
    guess = urls.guessed_email(F.col("website")) if guess_email else F.lit("")
    email = F.when(found != "", found).otherwise(guess)
    phones = F.col("p") if repeat_whatsapp else F.array_except("p", "w")
    return g.select(
        F.coalesce("company", "host").alias("company"),
        email.alias("email"),
        F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("whatsapp"),
        "website",
        F.when(found != "", "found").when(guess != "", "guessed").otherwise("").alias("email_source"),
        F.array_join(phones, "; ").alias("phone"),
        F.array_join(F.filter("e", lambda x: x != found), "; ").alias("other_emails"),
        F.array_join(F.slice("w", 2, 1 << 30), "; ").alias("other_whatsapp"),
        F.coalesce("address", F.lit("")).alias("address"),
        F.when(F.col("structured"), "structured").otherwise("flat").alias("page_type"),
        F.element_at(F.array(*map(F.lit, ("static", "rendered_empty", "rendered"))), F.col("rendered") + 1).alias("render_mode"),
        F.coalesce("search_query", F.lit("")).alias("search_query"),
        F.when(F.col("ok"), "ok").otherwise(F.coalesce("first_error", F.lit("ok"))).alias("status"),
        "host",
    )


def ordered(rows: DataFrame) -> DataFrame:
    """The thirteen output columns, by host."""
    return rows.orderBy("host").select(*fixed.COMPANY_COLUMNS)


def emails_only(rows: DataFrame) -> DataFrame:
    return rows.where("email_source = 'found'")


def high_confidence(rows: DataFrame) -> DataFrame:
    """Rows with a found address or a WhatsApp number; guesses are blanked."""
    kept = rows.where("email_source = 'found' OR whatsapp <> ''")
    guessed = F.col("email_source") == "guessed"
    return kept.withColumns({"email": F.when(guessed, "").otherwise(F.col("email")), "email_source": F.when(guessed, "").otherwise(F.col("email_source"))})


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        F.count("*").alias("n_rows"),
        n(F.col("email_source") == "found", "found"),
        n(F.col("email_source") == "guessed", "guessed"),
        n(F.col("whatsapp") != "", "with_whatsapp"),
        n(F.col("page_type") == "structured", "structured"),
        n(F.col("render_mode") == "rendered", "rendered"),
        n(F.col("render_mode") == "rendered_empty", "rendered_empty"),
        n(F.col("status") != "ok", "errors"),
    )
