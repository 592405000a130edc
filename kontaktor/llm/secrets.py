"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over the trigrams
that any match must hold. The postings of the trigrams that some query names are
gathered in blocks of neighbouring ids, queries intersect and unite them,
and only candidates are verified by the expression. A rule without mandatory
trigrams (runs of hexadecimal digits) scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK_BITS = 12  # a posting block spans 4096 ids: the bound of one posting list


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # in the syntax that Java, RE2 and Python share
    least: int = 0  # characters of group `group` at least, else the match is dropped
    group: int = 0
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")

#: Spans of one start are listed in the order of the rules.
RULES = (
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    # The runs of 32 or more that [0-9a-f]+ finds, without the many short ones.
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


# A query is True (no trigram is mandatory), a trigram, or ("and" | "or", its parts).


def _both(parts) -> object:
    parts = sorted({p for p in parts if p is not True}, key=str)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts) -> object:
    parts = sorted(set(parts), key=str)
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: frozenset[str]) -> object:
    return _any(_both(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)


def _exact(node) -> frozenset[str] | None:
    """The few strings, in lower case, that a node of the parsed expression can match; None if it isn't few."""
    op, arg = node
    if op is sre.LITERAL:
        return frozenset({chr(arg).lower()})
    if op is sre.IN:
        found = {chr(x[1]).lower() if x[0] is sre.LITERAL else None for x in arg}
        return frozenset(found) if None not in found and len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact_all(arg[3])
    if op is sre.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return frozenset().union(*parts) if None not in parts else None
    if op is sre.MAX_REPEAT and (arg[0], arg[1]) == (0, 1):
        inner = _exact_all(arg[2])
        return inner | {""} if inner is not None else None
    return None


def _exact_all(nodes) -> frozenset[str] | None:
    out = frozenset({""})
    for node in nodes:
        if (own := _exact(node)) is None or len(out) * len(own) > 64:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text with a match satisfies, over texts in lower case."""

    def walk(nodes) -> object:
        parts, run = [], frozenset({""})
        for node in nodes:
            own = _exact(node)
            if own is not None and "" in own:  # may be missing: what follows begins anew
                parts.append(_of_strings(run))
                run = frozenset({""})
                continue
            if own is not None and len(run) * len(own) <= 64:
                run = frozenset(a + b for a in run for b in own)
                continue
            parts.append(_of_strings(run))
            run = own if own is not None and len(own) <= 64 else frozenset({""})
            op, arg = node
            if own is not None:
                continue
            if op is sre.SUBPATTERN:
                parts.append(walk(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_any(walk(p) for p in arg[1]))
            elif op is sre.MAX_REPEAT and arg[0] > 0:
                parts.append(walk(arg[2]))
        return _both([*parts, _of_strings(run)])

    return walk(sre_parser.parse(pattern))


def _leaves(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_leaves, query[1]))


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (block, trigram, ids): which documents of a block hold a trigram, cases alike."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("low")
    found = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams)))
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", low).select("doc_id", F.explode(found).alias("trigram"))
    return rows.groupBy(F.shiftright("doc_id", BLOCK_BITS).alias("block"), "trigram").agg(F.collect_set("doc_id").alias("ids"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(doc_id, rules): for each document that satisfies a query, the kinds of those rules. Each block meets in one row."""
    of = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))

    def ids(query: object) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.try_element_at("lists", F.lit(query)), F.array().cast("array<bigint>"))
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, map(ids, query[1]))

    def hit(kind: str):
        return lambda x: F.struct(x.alias("doc_id"), F.lit(kind).alias("kind"))

    hits = [F.transform(ids(q), hit(kind)) for kind, q in queries.items()]
    rows = of.select(F.explode(F.concat(*hits)).alias("hit")).select("hit.doc_id", "hit.kind")
    return rows.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as an array of (start, order, end), in code points. Starts add up what splitting leaves and what matches took."""
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    judged = whole if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["judged"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(between.alias("gap"), whole.alias("match"), judged.alias("judged"))
    return F.aggregate(zipped, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def scanned(documents: DataFrame, *, rules: tuple[Rule, ...] = RULES, spans_as: str = "secret_spans") -> DataFrame:
    """documents and their spans: array<struct<start, order, end>> by start, then by the order of the rules.

    A null text has no spans. Rows are scanned one by one, repeated rows alike; a null doc_id, which the index can't
    name, is a candidate of every rule. A column of the name spans_as is replaced; other columns stay, whatever their names."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q is not True}
    base = documents.drop(spans_as)
    if indexed:
        index = postings(documents, sorted(set().union(*map(_leaves, indexed.values()))))
        found = candidates(index, indexed).withColumnsRenamed({"doc_id": "_found_id", "rules": "_found_rules"})
        base = base.join(found, F.col("doc_id") == F.col("_found_id"), "left")
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    parts = []
    for order, rule in enumerate(rules):
        text = F.coalesce("text", F.lit(""))
        gate = text.rlike(rule.pattern)
        if rule.kind in indexed:
            gate = (F.coalesce(F.array_contains("_found_rules", rule.kind), F.lit(False)) | F.col("doc_id").isNull()) & gate
        parts.append(F.when(gate, _spans(text, rule, order)).otherwise(empty))
    out = base.withColumn(spans_as, F.array_sort(F.concat(*parts)))
    return out.drop("_found_id", "_found_rules")


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["order"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(documents: DataFrame, *, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """documents, all rows and columns, with each stretch of secrets in text replaced by `mark`; n_chars, where it is, follows."""
    found = scanned(documents, rules=rules, spans_as="_spans")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.col("text").substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, rest)).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda order: F.size(F.filter("secret_spans", lambda x: x["order"] == order)).cast("long")
    base = F.filter("secret_spans", lambda x: x["order"] < sum(r.base for r in RULES))
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def _oracle() -> str:
    """The same spans in DuckDB SQL: every text is scanned, no index."""
    quoted = lambda s: s.replace("'", "''")
    columns, lists = [], []
    for order, r in enumerate(RULES):
        p = quoted(r.pattern)
        columns += [
            f"regexp_extract_all(t, '({p})', 1) AS m{order}",
            f"regexp_extract_all(t, '{p if r.group else f'({p})'}', {r.group or 1}) AS j{order}",
            f"string_split_regex(t, '{p}') AS g{order}",
        ]
        start = f"list_sum(list_transform(g{order}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{order}[1:i-1], lambda x: length(x))), 0)"
        lists.append(
            f"list_transform(list_filter(range(1, len(m{order}) + 1), lambda i: length(j{order}[i]) >= {r.least}),"
            f" lambda i: {{'s': CAST({start} AS BIGINT), 'o': {order}, 'e': CAST({start} + length(m{order}[i]) AS BIGINT)}})"
        )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda spans: f"array_to_string(list_transform({spans}, lambda x: {kinds}[x.o + 1] || ':' || x.s || ':' || x.e), ',')"
    n_base = sum(r.base for r in RULES)
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda x: x.o = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, {", ".join(columns)} FROM d),
s AS (SELECT doc_id, list_sort({" || ".join(lists)}) AS spans FROM found)
SELECT doc_id, {counts},
  sha256({text(f"list_filter(spans, lambda x: x.o < {n_base})")}) AS base_sha256,
  {text("spans")} AS spans
FROM s"""


QUERIES = {"op4_secrets": op4_secrets}
ORACLES = {"op4_secrets": _oracle()}
