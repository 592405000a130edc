"""Readers of text, JSON and CSV inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..functions import fixed
from ..functions.text import strip

FANOUT = "name string, templates array<string>, segments array<string>, cities array<string>, suffix string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): a list file's lines in order. Such files are configuration, read whole as one line of text each."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("ord", "value"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, query): stripped lines, without empty ones and those that then begin with #. A missing file is an error."""
    v = strip(F.col("value"))
    return _lines(spark, path).select("ord", v.alias("query")).where("query <> '' AND NOT startswith(query, '#')")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, url, search_query): here # counts only at the very start of a line, so an indented one is data."""
    v = strip(F.col("value"))
    return _lines(spark, path).where((v != "") & ~F.col("value").startswith("#")).select("ord", v.alias("url"), F.lit("").alias("search_query"))


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """(domain): what stands before a #, in lower case, distinct; nothing if there is no file."""
    try:
        lines = _lines(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], "domain string")
    return lines.select(F.lower(strip(F.substring_index("value", "#", 1))).alias("domain")).where("domain <> ''").distinct()


def fanout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FANOUT).json(path, multiLine=True)


def cities(spark: SparkSession, path: str) -> list[str]:
    """The cities of a fan-out configuration; none if it can't be read."""
    try:
        return [c for r in fanout(spark, path).select("cities").limit(1).collect() for c in r.cities or []]
    except AnalysisException:
        return []


def companies(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of company rows, all columns text. Columns that an older file lacks are empty."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in fixed.COMPANY_COLUMNS), *(c for c in rows.columns if c not in fixed.COMPANY_COLUMNS))


def table_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A stored table, or an empty one if it isn't there or can't be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
