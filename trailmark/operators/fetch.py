"""Fetching for the crawl, as plain functions that run in the tasks: url -> (status, content_type, final_url, body)."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from http.client import HTTPException
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

# How much of a body is read, of which types, how long an answer may take, how long robots.txt is good
# for, and how long to wait between two requests to a site.
MAX_BYTES, TIMEOUT_S, ROBOTS_S, DELAY_S = 5 << 20, 15.0, 24 * 3600.0, 1.0
READABLE = ("text/html", "application/xhtml+xml")
AGENT = "trailmark-crawler/0.2 (one hop from pages that were read)"

Fetch = Callable[[str], tuple]


def _decoded(raw: bytes, charset: str | None) -> str:
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:  # a charset that nobody knows
        return raw.decode("utf-8", "replace")


def _answer(reply, url: str) -> tuple:
    kind = reply.headers.get("content-type") or ""
    media = kind.partition(";")[0].strip().lower()
    body = None
    if media in READABLE or media.startswith("text/") or url.endswith("/robots.txt"):
        body = _decoded(reply.read(MAX_BYTES), reply.headers.get_content_charset())
    return reply.status, kind, reply.geturl(), body


def fetch(url: str, timeout_s: float = TIMEOUT_S) -> tuple:
    """The reply to a GET, redirects followed. The body is read of HTML, text and robots.txt only, MAX_BYTES at most.
    Never raises: without any reply the status is 0."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        with urllib.request.urlopen(request, timeout=timeout_s) as reply:
            return _answer(reply, url)
    except urllib.error.HTTPError as reply:  # it is one, with a status
        with reply:
            return _answer(reply, url)
    except (OSError, HTTPException, ValueError):
        return 0, "", url, None


def origin_of(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


class Robots:
    """What robots.txt allows, asked once a day for each site. No answer, or a broken site's, denies and is not kept."""

    def __init__(self, fetch_: Fetch = fetch, agent: str = AGENT, kept_s: float = ROBOTS_S, clock: Callable[[], float] = time.time):
        self.fetch, self.agent, self.kept_s, self.clock = fetch_, agent, kept_s, clock
        self.known: dict[str, tuple[float, Callable[[str], bool]]] = {}

    def _rules(self, site: str) -> Callable[[str], bool] | None:
        status, _, _, body = self.fetch(f"{site}/robots.txt")
        if not status or status >= 500:
            return None
        if status >= 400:
            return lambda _: status not in (401, 403)
        rules = RobotFileParser()
        rules.parse((body or "").splitlines())
        return lambda url: rules.can_fetch(self.agent, url)

    def allowed(self, url: str) -> bool:
        site = origin_of(url)
        since, rules = self.known.get(site, (float("-inf"), None))
        if self.clock() - since >= self.kept_s:
            if (rules := self._rules(site)) is None:
                self.known.pop(site, None)
                return False
            self.known[site] = self.clock(), rules
        return rules(url)


def politely(urls: Iterator[str], fetch_: Fetch, delay_s: float = DELAY_S, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """(url, *reply) in order, with `delay_s` between the ends of a request and the next one to the same site."""
    free: dict[str, float] = {}
    for url in urls:
        site = origin_of(url)
        if (wait := free.get(site, 0.0) - clock()) > 0:
            sleep(wait)
        try:
            reply = fetch_(url)
        except Exception:  # noqa: BLE001  one bad page must not stop the rest
            reply = (0, "", url, None)
        free[site] = clock() + delay_s
        yield (url, *reply)
