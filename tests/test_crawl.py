"""Paging strategies, limits and politeness over literal pages."""

import json

import pytest
from pyspark.sql import functions as F

from kennelflow.sources import crawl as C
from kennelflow.sources import robots


def site(pages):
    def fetch(url):
        if url not in pages:
            raise OSError(url)
        return pages[url] if isinstance(pages[url], str) else json.dumps(pages[url])

    return fetch


def cards(text):
    return [(x.split("=")[0], {"name": x.split("=")[1]}) for x in text.split("|")[1:] if "=" in x]


def dogs(*ids, species="Dog"):
    return [{"id": i, "species": species} for i in ids]


def test_one_feed_keeps_the_species_and_the_first():
    a = C.json_feed("data.response", "id", keep=lambda x: x["species"].lower() == "dog")
    c = C.crawl(a, "u", site({"u": {"data": {"response": [*dogs(1, 2), {"id": 1, "species": "DOG", "again": 1}, *dogs(3, species="Cat")]}}}))
    assert list(c.items) == ["1", "2"] and "again" not in c.items["1"] and c.complete and c.duplicates == 1


def test_numbered_json_pages_and_their_total():
    pages = {f"u?page={n}": {"page": n, "last": 3, "total": 5, "animals": dogs(*range(2 * n, 2 * n + 2))} for n in (1, 2, 3)}
    a = C.json_pages("animals", "id", "page", "last", "total")
    c = C.crawl(a, "u?page=1", site(pages))
    assert c.pages == 3 and c.total == 5 and len(c.items) == 6 and c.complete
    few = C.crawl(a, "u?page=1", site(pages), C.Limits(pages=2))
    assert few.pages == 2 and not few.complete and few.warnings
    broken = C.crawl(a, "u?page=1", site({k: v for k, v in pages.items() if k != "u?page=2"}))
    assert broken.pages == 1 and not broken.complete and len(broken.items) == 2


def test_offsets_until_a_page_is_not_full_and_the_last_wins():
    pages = {"u?offset=0": {"rows": dogs(1, 2)}, "u?offset=2": {"rows": [{"id": 2, "species": "Dog", "later": 1}]}}
    c = C.crawl(C.json_offsets("rows", "id", 2, last_wins=True), "u?offset=0", site(pages))
    assert list(c.items) == ["1", "2"] and c.items["2"]["later"] and c.complete


def test_counted_cards():
    pages = {"u?index=0": "Animals: 1 - 2 of 3 |a=Rex|b=Ada", "u?index=2": "Animals: 3 - 3 of 3 |c=Bo"}
    a = C.counted_cards(cards, 2)
    assert C.crawl(a, "u?index=0", site(pages)).complete and C.count_header("Animals: 31 - 60 of 95") == (31, 60, 95)
    short = C.crawl(a, "u?index=0", site(pages | {"u?index=2": "Animals: 3 - 3 of 3"}))
    assert not short.complete and len(short.items) == 2
    assert not C.crawl(a, "u?index=0", site({"u?index=0": "closed"})).complete


def test_links_numbers_and_loops():
    linked = C.linked_cards(cards, r"next<(\S+)>")
    c = C.crawl(linked, "u1", site({"u1": "next<u2> |a=Rex", "u2": "|b=Ada"}))
    assert list(c.items) == ["a", "b"] and c.complete
    assert not C.crawl(linked, "u1", site({"u1": "next<u1> |a=Rex"})).complete
    numbered = C.crawl(C.numbered_cards(cards), "u?tpage=1", site({"u?tpage=1": "|a=Rex", "u?tpage=2": "|a=Rex|b=Bo", "u?tpage=3": "|b=Bo"}))
    assert list(numbered.items) == ["a", "b"] and numbered.pages == 3 and numbered.complete


def test_details_are_bounded_skipped_and_may_fail():
    a = C.json_feed("", "id", detail=lambda x: f"d{x['id']}")
    pages = {"u": dogs(1, 2, 3, 4), "d1": "one", "d3": "three", "d4": "four"}
    c = C.crawl(a, "u", site(pages), C.Limits(details=3), wants_detail=lambda key, item: key != "3")
    assert (c.attempts, c.failures, c.skipped) == (3, 1, 1) and c.items["1"]["detail"] == "one" and "detail" not in c.items["2"] and c.complete
    assert "stopped after 1 details" in C.crawl(a, "u", site(pages), C.Limits(details=1)).warnings


def test_polite_calls_wait_and_retry():
    now, slept, calls = [0.0], [], []

    def sleep(t):
        slept.append(t)
        now[0] += t

    def fetch(url):
        calls.append(url)
        if len(calls) == 2:
            raise OSError
        return "ok"

    polite = C.PoliteFetch(fetch, 1.5, 1, lambda: now[0], sleep)
    assert [polite("https://a.example/1"), polite("https://a.example/2"), polite("https://b.example/1")] == ["ok"] * 3
    assert slept == [1.5, 1.5] and len(calls) == 4
    with pytest.raises(OSError):
        C.PoliteFetch(site({}), 0, 1)("https://a.example/1")


def test_robots_first_group_cache_and_matched_rule():
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: x\nDisallow: /tmp # c\nAllow: /tmp/open\nDisallow: /*.pdf$\n\nUser-agent: *\nDisallow: /second"
    rules = robots.parse(text)
    assert rules == [("disallow", "/tmp"), ("allow", "/tmp/open"), ("disallow", "/*.pdf$")]
    assert robots.verdict("/tmp/open/x", rules) == (True, ("allow", "/tmp/open")) and robots.verdict("/a.pdf", rules)[0] is False and robots.verdict("/second", rules) == (True, None)
    now, asked = [0.0], []

    def fetch(url):
        asked.append(url)
        return text

    gate = C.RobotsGate(fetch, lambda: now[0])
    assert not gate.allows("https://a.example/tmp/q") and gate.allows("https://a.example/x") and len(asked) == 1
    now[0] = 7 * 3600
    assert gate.allows("https://a.example/x") and len(asked) == 2 and C.RobotsGate(site({})).allows("https://b.example/tmp")


def test_many_sources_in_spark(spark):
    pages = {"u": dogs(1, 2), "v": dogs(3)}
    df = spark.createDataFrame([("s1", "feed", "u", True), ("s2", "feed", "v", True), ("s3", "feed", "w", True), ("s4", "none", "u", True), ("s5", "feed", "u", False), ("s6", "feed", None, True)], "id string, adapter_type string, listing_url string, enabled boolean")
    got = C.ingest_all(df, {"feed": C.json_feed("", "id")}, lambda url: json.dumps(pages[url])).collect()
    assert sorted((r.source_id, r.key) for r in got if r.kind == "item") == [("s1", "1"), ("s1", "2"), ("s2", "3")]
    runs = {r.source_id: json.loads(r.payload) for r in got if r.kind == "run"}
    assert {k: v["complete"] for k, v in runs.items()} == {"s1": True, "s2": True, "s3": False, "s4": False, "s6": False}


def test_wanted_details_and_addresses(spark):
    cards_ = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f3"), ("d", None)], "k string, card_fingerprint string")
    stored = spark.createDataFrame([("a", "f1", "t"), ("b", "old", "t"), ("c", "f3", None), ("d", None, "t")], "k string, card_fingerprint string, detail_fetched_at string")
    assert sorted(r.k for r in C.wanted_details(cards_, stored, ["k"]).collect()) == ["b", "c", "d"]
    cases = [("/x", "https://h.example/a/b", "https://h.example/x"), ("y", "https://h.example/a/b", "https://h.example/a/y"), ("z", "https://h.example", "https://h.example/z"), ("//k.example/q", "https://h.example/a", "https://k.example/q"), ("http://m.example", None, "http://m.example"), ("x", "nowhere", None), (None, "https://h.example", None), ("", "https://h.example", None)]
    df = spark.createDataFrame(cases, "u string, b string, want string")
    assert [r.got for r in df.select(C.absolute(F.col("u"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]
