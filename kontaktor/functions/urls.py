"""Hosts and domains of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import text_or_empty


def host(url: Column) -> Column:
    """The network location in lower case, cut at its first colon, without one leading www. Empty without a scheme."""
    place = F.regexp_extract(text_or_empty(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.substring_index(F.lower(place), ":", 1), r"^www\.", "")


def registrable(url: Column) -> Column:
    """The last two labels of the host, or three below a second-level suffix."""
    h = host(url)
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) < 2, h).when((F.size(labels) >= 3) & last(2).isin(*fixed.SECOND_LEVEL_SUFFIXES), last(3)).otherwise(last(2))


def guessed_email(url: Column) -> Column:
    domain = registrable(url)
    return F.when(domain.contains("."), F.concat(F.lit(f"{fixed.GUESSED_LOCAL_PART}@"), domain)).otherwise(F.lit(""))


def host_suffixes(h: Column) -> Column:
    """The host and what follows each of its dots: what a blocklist entry must equal."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def unwrapped(url: Column) -> Column:
    """The target of a search engine's redirect link (u=a1 and URL-safe base64), or the link itself."""
    code = F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_%=-]+)", 1)
    plain = F.translate(F.regexp_replace(code, "%3[dD]|=", ""), "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    target = F.try_to_binary(padded, F.lit("base64"))
    text = F.when(F.is_valid_utf8(target.cast("string")), target.cast("string"))
    return F.when((code != "") & text.startswith("http"), text).otherwise(url)
