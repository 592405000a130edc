"""Search queries as text: keys, operators, terms and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, collapse, text_or_empty


def key(query: Column, engine: Column) -> Column:
    """A query's identity: white space and cases don't count, the engine does."""
    return F.concat(F.lower(collapse(text_or_empty(query))), F.lit("|"), F.lower(text_or_empty(engine)))


def with_negative_operators(query: Column, domains: Column, most: int = fixed.MAX_NEGATIVE) -> Column:
    """query and -site: for the first `most` distinct domains that aren't part of the query's text."""
    if most <= 0:
        return query
    low = F.transform(domains, lambda d: F.lower(F.trim(d)))
    fresh = F.slice(F.array_distinct(F.filter(low, lambda d: (d != "") & ~F.contains(F.lower(query), d))), 1, most)
    added = F.array_join(F.transform(fresh, lambda d: F.concat(F.lit("-site:"), d)), " ")
    return F.when((F.coalesce(query, F.lit("")) != "") & (F.coalesce(added, F.lit("")) != ""), F.concat_ws(" ", query, added)).otherwise(query)


def without_negative_operators(query: Column) -> Column:
    parts = F.split(collapse(text_or_empty(query)), " ")
    return F.array_join(F.filter(parts, lambda w: ~F.lower(w).startswith("-site:")), " ")


def terms(query: Column) -> Column:
    """Topic words in lower case, repeats kept."""
    plain = F.regexp_replace(text_or_empty(query), r"(?iU)-?site:\S+", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*fixed.INTENT_WORDS) & (F.length(w) > 2))


def _tokens(query: Column) -> Column:
    plain = F.regexp_replace(text_or_empty(query), r"(?U)-?site:\S+", " ")
    words = F.regexp_extract_all(plain, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: ~F.lower(w).isin(*fixed.INTENT_WORDS) & (F.length(w) > 2))


def _is_place(w: Column, vocabulary: Column) -> Column:
    return F.array_contains(vocabulary, F.lower(w)) | (w.rlike("^[A-Z]") & (w != F.upper(w)))


def places(query: Column, vocabulary: Column) -> Column:
    """Sorted distinct words in lower case that the vocabulary holds, or that are capitalised without being all capitals."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(_tokens(query), lambda w: _is_place(w, vocabulary)), F.lower)))


def topics(query: Column, vocabulary: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(_tokens(query), lambda w: ~_is_place(w, vocabulary)), F.lower)))


def is_relevant(haystack: Column, asked_places: Column, asked_topics: Column) -> Column:
    """Some asked place, if any is asked, and some asked topic, if any, must be in the text; nothing asked is not relevant."""
    hit = lambda words: (F.size(words) == 0) | F.exists(words, lambda t: F.contains(haystack, t))
    return (F.size(asked_places) + F.size(asked_topics) > 0) & hit(asked_places) & hit(asked_topics)


def is_elsewhere(haystack: Column, asked_places: Column, vocabulary: Column) -> Column:
    """A place was asked for, none of those is in the text, and another one is."""
    in_text = lambda words: F.exists(words, lambda t: F.contains(haystack, t))
    return (F.size(asked_places) > 0) & ~in_text(asked_places) & in_text(F.array_except(vocabulary, asked_places))


def credits(n_queries: Column, n_results: Column) -> Column:
    return n_queries * F.when(n_results <= 10, 1).otherwise(2)


def request_size(query: Column, n: Column) -> Column:
    """1 to 100; queries with operators get 10 at most."""
    clamped = F.greatest(F.lit(1), F.least(F.lit(100), n))
    low = F.lower(query)
    return F.when((clamped > 10) & any_of([low.contains("site:"), low.contains(" or ")]), 10).otherwise(clamped)
