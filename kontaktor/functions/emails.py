"""E-mail addresses in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_of


def found(markup: Column) -> Column:
    return F.regexp_extract_all(markup, F.lit(f"({fixed.EMAIL})"), F.lit(1))


def _kept(raw: Column) -> Column:
    low = F.transform(raw, lambda e: F.regexp_replace(F.lower(e), r"^\.+|\.+$", ""))
    return F.filter(low, lambda e: ~any_of(e.endswith(s) for s in fixed.ASSET_SUFFIXES) & ~e.isin(*fixed.PLACEHOLDER_EMAILS) & (e != ""))


def _is_free(e: Column) -> Column:
    return F.substring_index(e, "@", -1).isin(*fixed.FREE_MAIL_DOMAINS)


def cleaned(raw: Column, *, drop_free_mail: bool = False) -> Column:
    """Sorted distinct addresses in lower case, without assets and placeholders and, if asked, free mail."""
    kept = _kept(raw)
    return F.array_sort(F.array_distinct(F.filter(kept, lambda e: ~_is_free(e)) if drop_free_mail else kept))


def free_mail_dropped(raw: Column) -> Column:
    """How many occurrences the free-mail filter drops."""
    return F.size(F.filter(_kept(raw), _is_free))


def primary(emails: Column) -> Column:
    """The address to write to: role addresses first, then the shortest, then the first by its characters. Empty without any."""
    ranked = F.transform(emails, lambda e: F.struct((~F.substring_index(e, "@", 1).isin(*fixed.ROLE_LOCAL_PARTS)).alias("other"), F.length(e).alias("n"), e.alias("e")))
    return F.coalesce(F.array_min(ranked)["e"], F.lit(""))
