"""Pieces of SQL, for the second engine, that mean the same as the column expressions."""

from __future__ import annotations

from ..functions import fixed


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def host(url: str) -> str:
    return rf"regexp_replace(split_part(lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), ':', 1), '^www\.', '')"


def registrable(h: str) -> str:
    """Of a host column."""
    last = lambda n: f"array_to_string(string_split({h}, '.')[-{n}:], '.')"
    return f"CASE WHEN len(string_split({h}, '.')) < 2 THEN {h} WHEN len(string_split({h}, '.')) >= 3 AND {last(2)} IN {strings(fixed.SECOND_LEVEL_SUFFIXES)} THEN {last(3)} ELSE {last(2)} END"


def emails(text: str) -> str:
    """Sorted distinct cleaned addresses."""
    low = f"list_transform(regexp_extract_all({text}, '{fixed.EMAIL}'), lambda e: regexp_replace(regexp_replace(lower(e), '^\\.+', ''), '\\.+$', ''))"
    asset = " OR ".join(f"ends_with(e, '{s}')" for s in fixed.ASSET_SUFFIXES)
    return f"list_sort(list_distinct(list_filter({low}, lambda e: NOT ({asset}) AND e NOT IN {strings(fixed.PLACEHOLDER_EMAILS)})))"


def primary(emails_: str) -> str:
    ranked = f"list_sort(list_transform({emails_}, lambda e: {{'o': CAST(split_part(e, '@', 1) NOT IN {strings(fixed.ROLE_LOCAL_PARTS)} AS INTEGER), 'n': length(e), 'e': e}}))"
    return f"coalesce(({ranked})[1].e, '')"


def phone(raw: str) -> str:
    d = f"regexp_replace({raw}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN {d} = '' THEN '' WHEN starts_with({d}, '62') THEN '+62' || regexp_replace(substr({d}, 3), '^0+', '')"
        f" WHEN starts_with({d}, '0') THEN '+62' || regexp_replace({d}, '^0+', '')"
        f" WHEN starts_with({d}, '8') AND length({d}) BETWEEN 9 AND 12 THEN '+62' || {d} ELSE '+' || {d} END"
    )


def is_mobile(n: str) -> str:
    return f"(starts_with(ltrim({n}, '+'), '628') AND length(ltrim({n}, '+')) BETWEEN 11 AND 14)"


def is_landline(n: str) -> str:

    d = f"ltrim({n}, '+')"
    each = " OR ".join(f"(substr({d}, 3, {k}) IN {strings(c for c in fixed.AREA_CODES if len(c) == k)} AND length({d}) - 2 - {k} BETWEEN 5 AND 9)" for k in (3, 2))
    return f"(starts_with({d}, '62') AND NOT starts_with({d}, '628') AND ({each}))"


def _tokens(q: str) -> str:
    return f"list_filter(regexp_extract_all(regexp_replace(coalesce({q}, ''), '-?site:\\S+', ' ', 'g'), '[A-Za-z0-9]+'), lambda w: lower(w) NOT IN {strings(fixed.INTENT_WORDS)} AND length(w) > 2)"


def _is_place(w: str, vocabulary: str) -> str:
    return f"(list_contains({vocabulary}, lower({w})) OR (regexp_matches({w}, '^[A-Z]') AND {w} <> upper({w})))"


def places(q: str, vocabulary: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter({_tokens(q)}, lambda w: {_is_place('w', vocabulary)}), lambda w: lower(w))))"


def topics(q: str, vocabulary: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter({_tokens(q)}, lambda w: NOT {_is_place('w', vocabulary)}), lambda w: lower(w))))"


def hit(words: str, hay: str) -> str:
    return f"len(list_filter({words}, lambda t: contains({hay}, t))) > 0"


def without_negative(q: str) -> str:
    return f"array_to_string(list_filter(string_split(trim(regexp_replace({q}, '\\s+', ' ', 'g')), ' '), lambda w: NOT starts_with(lower(w), '-site:')), ' ')"


def with_negative(q: str, domains: str, most: int = fixed.MAX_NEGATIVE) -> str:
    fresh = f"list_filter(list_transform({domains}, lambda d: lower(trim(d))), lambda d: d <> '' AND NOT contains(lower({q}), d))"
    kept = f"list_filter({fresh}, lambda d, i: list_position({fresh}, d) = i)[1:{most}]"
    return f"CASE WHEN coalesce({q}, '') <> '' AND len({kept}) > 0 THEN {q} || ' ' || array_to_string(list_transform({kept}, lambda d: '-site:' || d), ' ') ELSE {q} END"
