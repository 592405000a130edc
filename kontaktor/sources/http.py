"""Transports over HTTP, from the standard library."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from ..functions import fixed
from .fetch import Answer
from .search_api import Post

TIMEOUT = 10.0


def _chunks(answer, size: int = 1 << 16) -> Iterator[bytes]:
    with answer:
        while chunk := answer.read(size):
            yield chunk


def get(url: str) -> Answer:
    """One GET; its body is read as far as it is wanted."""
    request = urllib.request.Request(url, headers={"User-Agent": fixed.USER_AGENT, "Accept-Language": "id,en"})
    try:
        answer = urllib.request.urlopen(request, timeout=TIMEOUT)
    except urllib.error.HTTPError as e:
        return Answer(e.code, dict(e.headers))
    except (OSError, ValueError) as e:
        return Answer(failure=type(e).__name__)
    return Answer(answer.status, dict(answer.headers), _chunks(answer))


def poster(endpoint: str) -> Post:
    """Calls of a search API at `endpoint`: (status, body); what never came raises OSError."""

    def post(payload: dict, headers: dict) -> tuple[int, str]:
        request = urllib.request.Request(endpoint, json.dumps(payload).encode(), headers | {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""

    return post
