"""Pages from a transport: bounded bodies, decoded text, robots rules.

The transport is injected, so that tests and offline runs replay stored answers.
Hosts are dealt to tasks, each of which takes a host's pages one after the other
with a pause between: a host is never asked twice at once, however many tasks there are.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls

_CHARSET = re.compile(rb"""charset=["']?([\w-]+)""", re.I)


@dataclass
class Answer:
    status: int = 200
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes | Iterable[bytes] = b""  # whole, or in chunks of which no more than the limit is read
    failure: str = ""  # what kept the transport from any answer; worth another attempt


Transport = Callable[[str], Answer]


def decode(body: bytes, content_type: str = "") -> str:
    """By the header's charset if it names one, else by one in the first 4096 bytes, else UTF-8; errors are replaced."""
    named = re.search(r"charset=[\"']?([\w-]+)", content_type, re.I)
    charset = named[1] if named else None
    if not charset and (m := _CHARSET.search(body[:4096])):
        charset = m[1].decode("ascii", "ignore")
    try:
        return body.decode(charset or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _decoded(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode(b, t or "") for b, t in zip(body, content_type, strict=True)])


def decoded(body: Column, content_type: Column) -> Column:
    return F.pandas_udf(_decoded, "string")(body, content_type)


def rejection(status: Column, content_type: Column, length: Column) -> Column:
    """Why an answer is no page, or null: an HTTP error, a type that is neither html nor text, a body over the limit."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(status >= 400, F.concat(F.lit("HTTPError: "), status.cast("string")))
        .when(~kind.contains("html") & ~kind.contains("text"), F.concat(F.lit("skipped non-HTML content ("), F.coalesce(content_type, F.lit("")), F.lit(")")))
        .when(length > fixed.MAX_BODY, F.lit("response too large"))
    )


def bounded(body: bytes | Iterable[bytes], most: int = fixed.MAX_BODY) -> bytes | None:
    """The whole body, or None as soon as it is seen to be larger than `most`."""
    if isinstance(body, bytes):
        return body if len(body) <= most else None
    held = bytearray()
    for chunk in body:
        held += chunk
        if len(held) > most:
            return None
    return bytes(held)


def page_of(answer: Answer) -> tuple[str | None, str | None]:
    kind = answer.headers.get("Content-Type", "")
    if answer.status >= 400:
        return None, f"HTTPError: {answer.status}"
    if "html" not in kind and "text" not in kind:
        return None, f"skipped non-HTML content ({kind})"
    declared = answer.headers.get("Content-Length", "")
    body = None if declared.isdigit() and int(declared) > fixed.MAX_BODY else bounded(answer.body)
    return (None, "response too large") if body is None else (decode(body, kind), None)


def fetched(url: str, transport: Transport, *, attempts: int = 3, pause: float = 2.0, sleep=time.sleep) -> tuple[str | None, str | None]:
    """(html, error). Only answers that never came are tried again, after 2 and 4 seconds."""
    for k in range(attempts):
        answer = transport(url)
        if not answer.failure:
            return page_of(answer)
        if k < attempts - 1:
            sleep(pause * 2**k)
    return None, answer.failure


def workers_of(asked: int, *, render: bool = False) -> int:
    """1 to MAX_WORKERS; a browser works alone."""
    return 1 if render else max(1, min(fixed.MAX_WORKERS, asked))


def pages(wanted: DataFrame, transport: Transport, *, tasks: int = fixed.MAX_WORKERS, delay: float = 2.0) -> DataFrame:
    """wanted (ord, url) with html and error. A host's pages lie in one of `tasks` partitions, in order."""
    dealt = wanted.select("ord", "url", urls.host(F.col("url")).alias("host")).repartition(tasks, "host").sortWithinPartitions("host", "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            out = []
            for ord_, url, host in b[["ord", "url", "host"]].itertuples(index=False):
                if host == last and delay:
                    time.sleep(delay)
                last = host
                out.append((ord_, url, *fetched(url, transport)))
            yield pd.DataFrame(out, columns=["ord", "url", "html", "error"])

    return dealt.mapInPandas(run, "ord long, url string, html string, error string")


def robots_rules(wanted: DataFrame, transport: Transport, *, tasks: int = fixed.MAX_WORKERS) -> DataFrame:
    """(base, body, status) of the robots.txt of each base of wanted (url), asked once each. No answer leaves the status null."""
    bases = wanted.select(base_of(F.col("url")).alias("base")).where("base <> ''").distinct().repartition(tasks, "base")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for base in b["base"]:
                answer = transport(f"{base}/robots.txt")
                body = None if answer.failure or answer.status != 200 else bounded(answer.body)
                out.append((base, None if body is None else decode(body, answer.headers.get("Content-Type", "")), None if answer.failure else answer.status))
            yield pd.DataFrame(out, columns=["base", "body", "status"]).astype({"status": "Int32"})

    return bases.mapInPandas(run, "base string, body string, status int")


def robots_allow(body: str | None, status: int | None, url: str, agent: str = fixed.USER_AGENT) -> bool:
    """Open where the rules can't be had: only an answer of 200 can forbid anything."""
    if status != 200 or body is None:
        return True
    try:
        rules = RobotFileParser()
        rules.parse(body.splitlines())
        return rules.can_fetch(agent, url)
    except Exception:
        return True


def _allowed(body: pd.Series, status: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([robots_allow(b, None if pd.isna(s) else int(s), u) for b, s, u in zip(body, status, url, strict=True)])


def base_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def with_robots(wanted: DataFrame, robots: DataFrame) -> DataFrame:
    """wanted with `allowed`; robots: base, body, status. A base that isn't there is open."""
    rules = robots.select(F.col("base").alias("_base"), F.col("body").alias("_body"), F.col("status").alias("_status"))
    joined = wanted.join(rules, base_of(F.col("url")) == F.col("_base"), "left")
    return joined.withColumn("allowed", F.when(F.col("_base").isNull(), True).otherwise(F.pandas_udf(_allowed, "boolean")("_body", "_status", "url"))).drop("_base", "_body", "_status")


def slots(wanted: DataFrame, delay: float = 2.0) -> DataFrame:
    """When each page's turn comes within its host, in seconds."""
    from pyspark.sql import Window

    at = (F.row_number().over(Window.partitionBy(urls.host(F.col("url"))).orderBy("ord")) - 1) * F.lit(delay)
    return wanted.withColumn("slot", at)


