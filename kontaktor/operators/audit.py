"""Quality of company rows: relevance, places, aggregators, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, phones, query_text
from ..functions.text import strip, text_or_empty
from ..sinks.tables import written
from . import blocklist as block

NUMBER_COLUMNS = ("whatsapp", "phone", "other_whatsapp")


def vocabulary(spark: SparkSession, cities: list[str] | None = None) -> list[str]:
    """The known places and the words, over two characters, of a configuration's cities."""
    import re

    return sorted({*fixed.LOCATIONS, *(w for c in cities or [] for w in re.findall("[a-z0-9]+", str(c).lower()) if len(w) > 2)})


def judged(rows: DataFrame, places: list[str]) -> DataFrame:
    """rows with asked_places, asked_topics, relevant, mismatched and has_contact."""
    words = F.split(F.lit("\n".join(places)), "\n")  # folded to one constant array
    r = rows.withColumns({"asked_places": query_text.places(F.col("search_query"), words), "asked_topics": query_text.topics(F.col("search_query"), words)})
    r = r.withColumn("_hay", F.lower(F.concat_ws(" ", text_or_empty(F.col("company")), text_or_empty(F.col("website")))))
    hay = F.col("_hay")
    r = r.withColumns(
        {
            "relevant": query_text.is_relevant(hay, F.col("asked_places"), F.col("asked_topics")),
            "mismatched": query_text.is_elsewhere(hay, F.col("asked_places"), words),
            "has_contact": (F.col("email_source") == "found") | (text_or_empty(F.col("whatsapp")) != ""),
        }
    )
    return r.drop("_hay")


def numbers(rows: DataFrame) -> DataFrame:
    """(column, number) of every number in a row, split at semicolons."""
    each = [_of(c) for c in NUMBER_COLUMNS]
    return rows.select(F.explode(F.concat(*each)).alias("x")).select("x.column", "x.number").where("number <> ''")


def _of(column: str):
    def pair(n):
        return F.struct(F.lit(column).alias("column"), strip(n).alias("number"))

    return F.transform(F.split(text_or_empty(F.col(column)), ";"), pair)


def audited(rows: DataFrame, blocklist: DataFrame, places: list[str]) -> DataFrame:
    """One row of counts, of rows and of the numbers in them, in one pass over rows that are stored first: they are dear to derive."""
    n = lambda c, name: F.count_if(c).alias(name)
    total = lambda c, name: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(name)
    status = F.lower(strip(text_or_empty(F.col("status"))))
    found = F.filter(F.concat(*(_of(c) for c in NUMBER_COLUMNS)), lambda x: x["number"] != "")
    r = judged(written(rows), places).withColumn("_numbers", F.transform(found, lambda x: x["number"]))
    r = block.tagged(r, blocklist, url="website").withColumns({"_mobile": F.filter("_numbers", phones.is_mobile), "_landline": F.filter("_numbers", phones.is_landline)})
    return r.agg(
        F.count("*").alias("rows"),
        n(F.col("relevant"), "relevant"),
        n(F.size("asked_places") > 0, "located"),
        n(F.col("mismatched"), "mismatched"),
        n(F.col("blocked_by").isNull(), "non_aggregator"),
        total("_numbers", "numbers"),
        (F.coalesce(F.sum(F.size("_mobile") + F.size("_landline")), F.lit(0))).cast("long").alias("valid_numbers"),
        total("_mobile", "mobiles"),
        total("_landline", "landlines"),
        F.count_distinct(F.when(text_or_empty(F.col("website")) != "", F.col("host"))).alias("unique_hosts"),
        n(F.col("has_contact"), "with_contact"),
        n(~status.isin("ok", ""), "errors"),
    )


def aggregator_hosts(rows: DataFrame, blocklist: DataFrame, limit: int = 10) -> DataFrame:
    """(host, n): the blocked hosts with most rows; ties by first occurrence. rows need ord."""
    tagged = block.tagged(rows, blocklist, url="website").where("blocked_by IS NOT NULL")
    return tagged.groupBy("host").agg(F.count("*").alias("n"), F.min("ord").alias("at")).orderBy(F.desc("n"), "at").limit(limit).select("host", "n")


def invalid_numbers(rows: DataFrame) -> DataFrame:
    """(column, number, n) of implausible numbers."""
    return numbers(rows).where(~phones.is_plausible(F.col("number"))).groupBy("column", "number").agg(F.count("*").alias("n"))


def first_invalid(rows: DataFrame, limit: int = 10) -> tuple[list, int]:
    """The most frequent implausible numbers, `limit` of them at most, and how many others there are."""
    found = invalid_numbers(rows)
    shown = found.orderBy(F.desc("n"), "column", "number").limit(limit).collect()
    return shown, found.count() - len(shown)


def percentages(audit: DataFrame) -> DataFrame:
    """Whole percents, rounded down; null without a denominator. rows_per_host over 2 means duplicates."""
    share = lambda a, b: F.when(F.col(b) > 0, F.floor(100 * F.col(a) / F.col(b))).alias(f"{a}_pct")
    per = F.when(F.col("unique_hosts") > 0, F.col("rows") / F.col("unique_hosts"))
    return audit.select(share("relevant", "rows"), share("non_aggregator", "rows"), share("valid_numbers", "numbers"), share("with_contact", "rows"), share("errors", "rows"), share("mismatched", "located"), per.alias("rows_per_host"), (per > 2.0).alias("duplicates"))
