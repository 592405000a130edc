"""Telephone numbers in one form, and which of them are plausible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import text_or_empty


def normalized(raw: Column) -> Column:
    """+ and digits. 62 and 0 lead to +62 without trunk zeros; so does a bare 8 with 9 to 12 digits. Empty without digits."""
    d = F.regexp_replace(text_or_empty(raw), "[^0-9]", "")
    return (
        F.when(d == "", "")
        .when(d.startswith("62"), F.concat(F.lit("+62"), F.regexp_replace(d.substr(F.lit(3), F.length(d)), "^0+", "")))
        .when(d.startswith("0"), F.concat(F.lit("+62"), F.regexp_replace(d, "^0+", "")))
        .when(d.startswith("8") & F.length(d).between(9, 12), F.concat(F.lit("+62"), d))
        .otherwise(F.concat(F.lit("+"), d))
    )


def _digits(number: Column) -> Column:
    return F.regexp_replace(text_or_empty(number), r"^\++", "")


def is_mobile(number: Column) -> Column:
    d = _digits(number)
    return d.startswith("628") & F.length(d).between(11, 14)


def is_landline(number: Column) -> Column:
    """62, an area code (three digits are tried before two), and 5 to 9 digits; mobile numbers apart."""
    d = _digits(number)
    rest = d.substr(F.lit(3), F.length(d))

    def with_code(n: int) -> Column:
        return F.substring(rest, 1, n).isin(*(c for c in fixed.AREA_CODES if len(c) == n)) & (F.length(rest) - n).between(5, 9)

    return d.startswith("62") & ~d.startswith("628") & (with_code(3) | with_code(2))


def is_plausible(number: Column) -> Column:
    return is_mobile(number) | is_landline(number)


def in_text(markup: Column) -> Column:
    """Distinct normalised mobile numbers that stand in a text."""
    raw = F.regexp_extract_all(markup, F.lit(f"({fixed.PHONE})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, normalized), is_mobile))


def in_links(html: Column, pattern: str) -> Column:
    """Distinct normalised numbers of links; fixed.WHATSAPP_LINK or fixed.TEL_LINK."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), normalized), lambda n: n != ""))
