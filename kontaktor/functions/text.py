"""Small string expressions. White space is Unicode's, as (?U) makes it in patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, words) -> Column:
    return any_of(c.contains(w) for w in words)


def title_case(c: Column) -> Column:
    """A letter after anything but a letter is upper case, every other letter lower case."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def is_bot_check(text: Column) -> Column:
    """A page with little text that holds an interstitial's phrase."""
    return F.coalesce((text != "") & (F.length(text) <= fixed.BOT_CHECK_MOST) & contains_any(F.lower(text), fixed.BOT_CHECK_MARKERS), F.lit(False))


def is_safe_to_click(label: Column) -> Column:
    low = F.lower(collapse(text_or_empty(label)))
    return (low != "") & (F.length(low) <= 60) & ~contains_any(low, fixed.FORBIDDEN_CLICK_WORDS) & contains_any(low, fixed.REVEAL_PHRASES)


def scrape_status(error: Column) -> Column:
    e = F.lower(text_or_empty(error))
    return F.when(e == "", "ok").when(e.contains("robots"), "robots_blocked").when(e.contains("blocked"), "blocked_domain").otherwise("error")
