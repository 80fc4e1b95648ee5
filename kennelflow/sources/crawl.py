"""Sources read page by page: strategies of paging, limits, politeness, robots rules, and many sources at once in Spark.

A source is read in order, since each page tells how to get on; different sources are read in parallel, one to a task. What
fetches a page is a function given by the caller (recorded pages in tests), so nothing here knows a network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kennelflow.sources import robots

Fetch = Callable[[str], str]
#: Hours that a host's robots rules are kept, as a fixed value.
ROBOTS_HOURS = 6


@dataclass
class Limits:
    """Pages and detail pages of one run at most; beyond them the run is incomplete and says so."""

    pages: int = 40
    details: int = 200


@dataclass
class Page:
    """What one page gives: items by id, the total the source reports, and the place of the next page (None: this is the last)."""

    items: list[tuple[str, dict]]
    next: str | None = None
    total: int | None = None
    complete: bool = True


@dataclass
class Crawl:
    items: dict[str, dict] = field(default_factory=dict)
    pages: int = 0
    total: int | None = None
    complete: bool = True
    attempts: int = 0
    failures: int = 0
    skipped: int = 0
    duplicates: int = 0
    warnings: list[str] = field(default_factory=list)
    trace: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Adapter:
    """How a kind of source is read.

    ``parse``: (text, url) -> Page. ``keep``: which items count (a species filter). ``last_wins``: of one id met twice the later item
    counts, at the place of the first. ``until_known``: stop at a page without new ids. ``short_is_incomplete``: fewer items than the
    reported total make the run incomplete. ``detail``: (item) -> url of its own page or None; ``merge``: (item, text) -> item.
    """

    parse: Callable[[str, str], Page]
    keep: Callable[[dict], bool] = lambda item: True
    last_wins: bool = False
    until_known: bool = False
    short_is_incomplete: bool = False
    detail: Callable[[dict], str | None] | None = None
    merge: Callable[[dict, str], dict] = lambda item, text: {**item, "detail": text}


def crawl(adapter: Adapter, url: str, fetch: Fetch, limits: Limits = Limits(), wants_detail: Callable[[str, dict], bool] = lambda key, item: True) -> Crawl:
    """Pages from ``url`` on until the last one, then the details that are wanted. A page that can't be read ends the run as incomplete."""
    c = Crawl()
    at: str | None = url
    seen: set[str] = set()
    while at is not None:
        if c.pages >= limits.pages:
            c.complete = False
            c.warnings.append(f"stopped after {c.pages} pages")
            break
        if at in seen:
            c.complete = False
            c.warnings.append("a page leads back to one read before")
            break
        seen.add(at)
        try:
            page = adapter.parse(fetch(at), at)
        except Exception as e:  # noqa: BLE001 - whatever a source does, its run ends in order
            c.complete = False
            c.warnings.append(f"page {c.pages + 1}: {type(e).__name__}")
            break
        c.pages += 1
        c.trace.append((at, len(page.items)))
        c.total = page.total if page.total is not None else c.total
        c.complete = c.complete and page.complete
        fresh = 0
        for key, item in page.items:
            if not adapter.keep(item):
                continue
            if key in c.items:
                c.duplicates += 1
                if adapter.last_wins:
                    c.items[key] = item
            else:
                fresh += 1
                c.items[key] = item
        at = None if adapter.until_known and not fresh else page.next
    if adapter.short_is_incomplete and c.total is not None and len(c.items) + c.duplicates < c.total:
        c.complete = False
        c.warnings.append(f"{len(c.items)} of {c.total} listings")
    if adapter.detail:
        _details(adapter, c, fetch, limits, wants_detail)
    return c


def _details(adapter: Adapter, c: Crawl, fetch: Fetch, limits: Limits, wants: Callable[[str, dict], bool]) -> None:
    for key, item in c.items.items():
        target = adapter.detail(item)
        if target is None or not wants(key, item):
            c.skipped += 1
        elif c.attempts >= limits.details:
            c.warnings.append(f"stopped after {c.attempts} details")
            break
        else:
            c.attempts += 1
            try:
                c.items[key] = adapter.merge(item, fetch(target))
            except Exception:  # noqa: BLE001 - a detail that fails leaves the card
                c.failures += 1


# strategies of paging


def json_feed(path: str, key: str, **how) -> Adapter:
    """One JSON document with its items under a dotted path."""
    return Adapter(lambda text, url: Page([(str(x[key]), x) for x in _under(json.loads(text), path)]), **how)


def json_pages(path: str, key: str, page: str, last: str, total: str | None = None, first: int = 1, **how) -> Adapter:
    """JSON pages that give their number and the last one; the address has ``page=<n>``."""

    def parse(text: str, url: str) -> Page:
        o = json.loads(text)
        n, end = int(_under(o, page)), int(_under(o, last))
        nxt = re.sub(r"(?<=[?&]page=)\d+", str(n + 1), url) if n < end else None
        return Page([(str(x[key]), x) for x in _under(o, path)], nxt, int(_under(o, total)) if total else None)

    return Adapter(parse, **how)


def json_offsets(path: str, key: str, size: int, **how) -> Adapter:
    """JSON pages by offset (``offset=<n>`` in the address) until one is not full."""

    def parse(text: str, url: str) -> Page:
        xs = _under(json.loads(text), path)
        nxt = re.sub(r"(?<=[?&]offset=)(\d+)", lambda m: str(int(m[1]) + size), url) if len(xs) >= size else None
        return Page([(str(x[key]), x) for x in xs], nxt)

    return Adapter(parse, **how)


COUNTS = re.compile(r"(\d+)\s*-\s*(\d+)\s+of\s+(\d+)")


def count_header(text: str) -> tuple[int, int, int] | None:
    """(first, last, total) of a heading such as 'Animals: 1 - 30 of 95'."""
    m = COUNTS.search(text)
    return tuple(map(int, m.groups())) if m else None


def counted_cards(cards: Callable[[str], list[tuple[str, dict]]], size: int, **how) -> Adapter:
    """HTML pages with a count heading; the address has ``index=<n>``. A page without one ends the run as incomplete."""

    def parse(text: str, url: str) -> Page:
        head = count_header(text)
        if not head:
            return Page(cards(text), None, None, False)
        nxt = re.sub(r"(?<=[?&]index=)(\d+)", lambda m: str(int(m[1]) + size), url) if head[1] < head[2] else None
        return Page(cards(text), nxt, head[2])

    return Adapter(parse, short_is_incomplete=True, **how)


def linked_cards(cards: Callable[[str], list[tuple[str, dict]]], next_link: str, **how) -> Adapter:
    """HTML pages with a link to the next one, found by the first group of ``next_link``."""

    def parse(text: str, url: str) -> Page:
        m = re.search(next_link, text)
        return Page(cards(text), m[1] if m else None)

    return Adapter(parse, **how)


def numbered_cards(cards: Callable[[str], list[tuple[str, dict]]], name: str = "tpage", **how) -> Adapter:
    """HTML pages by number until one has nothing new."""

    def parse(text: str, url: str) -> Page:
        return Page(cards(text), re.sub(rf"(?<=[?&]{name}=)(\d+)", lambda m: str(int(m[1]) + 1), url))

    return Adapter(parse, until_known=True, **how)


def literal_rows(rows: list[tuple[str, dict]]) -> Adapter:
    """Given rows, whatever the address."""
    return Adapter(lambda text, url: Page(rows))


def _under(o, path: str):
    for step in filter(None, path.split(".")):
        o = o[step]
    return o


# politeness


class PoliteFetch:
    """Calls of one host at least ``delay`` seconds apart, each tried ``1 + retries`` times."""

    def __init__(self, fetch: Fetch, delay: float = 1.5, retries: int = 2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.fetch, self.delay, self.retries, self.clock, self.sleep = fetch, delay, retries, clock, sleep
        self.free: dict[str, float] = {}

    def __call__(self, url: str) -> str:
        host = urlsplit(url).netloc
        for left in range(self.retries, -1, -1):
            wait = self.free.get(host, 0.0) - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.free[host] = self.clock() + self.delay
            try:
                return self.fetch(url)
            except Exception:  # noqa: BLE001 - the last failure is the caller's
                if not left:
                    raise
        raise AssertionError


class RobotsGate:
    """Whether an address may be read, by the rules of its host, kept for ``ROBOTS_HOURS``. A host without rules allows all."""

    def __init__(self, fetch: Fetch, clock: Callable[[], float] = time.time) -> None:
        self.fetch, self.clock = fetch, clock
        self.known: dict[str, tuple[float, list[tuple[str, str]]]] = {}

    def allows(self, url: str) -> bool:
        u = urlsplit(url)
        now = self.clock()
        at, rules = self.known.get(u.netloc, (-1e18, []))
        if now - at > ROBOTS_HOURS * 3600:
            try:
                rules = robots.parse(self.fetch(f"{u.scheme}://{u.netloc}/robots.txt"))
            except Exception:  # noqa: BLE001 - no rules
                rules = []
            self.known[u.netloc] = (now, rules)
        return robots.verdict(u.path + (f"?{u.query}" if u.query else ""), rules)[0]


# many sources


def ingest_all(sources: DataFrame, adapters: dict[str, Adapter], fetch: Fetch, limits: Limits = Limits()) -> DataFrame:
    """sources: id, adapter_type, listing_url, enabled -> source_id, kind ('item' or 'run'), seq, key, payload (JSON).

    A source to a task, whatever their number. A source without an address or an adapter of its type gives a run with a warning; disabled
    ones are left out. The run row has pages, total, complete, counts, warnings and the trace.
    """

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out: list[tuple] = []
            for sid, kind, url in zip(b.id, b.adapter_type, b.listing_url):
                a = adapters.get(kind)
                c = crawl(a, url, fetch, limits) if a and url else Crawl(complete=False, warnings=["no adapter" if url else "no address"])
                out += [(sid, "item", n, key, json.dumps(x)) for n, (key, x) in enumerate(c.items.items())]
                run = {"pages": c.pages, "total": c.total, "found": len(c.items), "complete": c.complete, "attempts": c.attempts, "failures": c.failures, "skipped": c.skipped, "duplicates": c.duplicates, "warnings": c.warnings, "trace": c.trace}
                out.append((sid, "run", -1, None, json.dumps(run)))
            yield pd.DataFrame(out, columns=["source_id", "kind", "seq", "key", "payload"])

    todo = sources.filter("enabled and id is not null").select(F.col("id").cast("string").alias("id"), "adapter_type", "listing_url")
    return todo.repartition(F.col("id")).mapInPandas(read, "source_id string, kind string, seq int, key string, payload string")


def wanted_details(cards: DataFrame, stored: DataFrame, key: Iterable[str]) -> DataFrame:
    """Cards whose own page is to be read: new ones, those whose fingerprint changed, and those never read in detail.

    ``cards``: key, card_fingerprint; ``stored``: key, card_fingerprint, detail_fetched_at. A card without a fingerprint is always read.
    """
    known = stored.filter("detail_fetched_at is not null and card_fingerprint is not null").select(*key, "card_fingerprint").distinct()
    return cards.join(known, [*key, "card_fingerprint"], "left_anti")


def absolute(url: Column, base: Column) -> Column:
    """An address relative to another as an absolute one; null where there is none."""
    root, folder = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1), F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]+(?:/[^?#]*/|/|(?=$)))", 1)
    scheme = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*:)", 1)
    made = F.when(url.rlike(r"^[a-z][a-z0-9+.-]*:"), url).when(F.startswith(url, F.lit("//")), F.concat(scheme, url)).when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(root, F.lit("/"))), url))
    return F.when((F.trim(url) != "") & (url.rlike(r"^[a-z][a-z0-9+.-]*:") | (root != "")), made)
