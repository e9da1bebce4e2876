"""Paged API answers through an opener that callers inject: nothing here opens a connection of its own accord."""

from __future__ import annotations

import json
import time
import urllib.parse
from collections.abc import Callable, Iterable, Iterator

AGENT = "annolith/1.0"


class FetchError(Exception):
    """An answer that did not come, or came damaged, however often it was asked for."""


def fetch(url: str, opener: Callable, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of an answer; a failed try is followed by another after a wait that doubles."""
    for k in range(tries):
        try:
            with opener(url, {"User-Agent": AGENT}) as answer:
                return answer.read()
        except OSError as error:
            last = error
            if k + 1 < tries:
                sleep(wait * 2**k)
    raise FetchError(f"{url}: {last}")


def pages(base: str, params: dict[str, str], opener: Callable, most: int = 1000, **how) -> Iterator[dict]:
    """Answers of a query, each continued by what the one before says to continue with."""
    more: dict[str, str] = {}
    for _ in range(most):
        url = f"{base}?{urllib.parse.urlencode(sorted({**params, **more, 'format': 'json'}.items()))}"
        try:
            answer = json.loads(fetch(url, opener, **how))
        except ValueError as error:
            raise FetchError(f"{url}: {error}") from None
        yield answer
        more = answer.get("continue") or {}
        if not more:
            return


def batches(titles: Iterable[str], size: int = 25) -> Iterator[list[str]]:
    """Distinct titles, in their order, `size` to a call."""
    held: list[str] = []
    for title in dict.fromkeys(titles):
        held.append(title)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
