"""Company names from pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import collapse, strip, text_or_empty, title_case
from .urls import registrable

#: Entities that titles hold; numeric ones are decoded by rule.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&middot;", "·"), ("&raquo;", "»"), ("&laquo;", "«"), ("&reg;", "®"), ("&copy;", "©"), ("&trade;", "™"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&eacute;", "é"), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def telling(title: Column, separator: str = f"(?U){fixed.TITLE_SEPARATOR}", tidy: Callable[[Column], Column] = collapse, low: Callable[[Column], Column] = F.lower) -> Column:
    """The first part of a title that is more than a generic word; null if there is none."""
    parts = F.transform(F.split(title, separator), tidy)
    return F.get(F.filter(parts, lambda p: (F.length(p) > 2) & ~low(p).isin(*fixed.GENERIC_TITLES)), F.lit(0))


def company(html: Column, url: Column) -> Column:
    """The site's own name, else the first telling part of the title, else the domain in title case, else empty."""
    html = text_or_empty(html)
    site = F.coalesce(*(F.nullif(strip(unescaped(F.regexp_extract(html, p, 1))), F.lit("")) for p in fixed.OG_SITE_NAME))
    title = telling(unescaped(F.regexp_extract(html, fixed.TITLE, 1)))
    domain = registrable(url)
    name = title_case(F.replace(F.regexp_replace(domain, r"\.[^.]*$", ""), F.lit("-"), F.lit(" ")))
    return F.coalesce(site, title, F.when(domain != "", name), F.lit(""))
