"""Model plumbing with stubs: chunks, untrusted answers, fallbacks, the ledger."""

import json

import pytest

from kennelflow.operators import models as M

RANKED = "watch_id bigint, id string, rank int, block string"
REQ = "watch_id bigint, query string"


@pytest.fixture(scope="module")
def ranked(spark):
    return spark.createDataFrame([(w, f"{w}-{i}", i, "text") for w in (1, 2) for i in range(1, 13)], RANKED)


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(1, "calm dog"), (2, "fail")], REQ)


def test_chunks_are_judged_on_their_own(spark, ranked, requests):
    def model(query, xs):
        assert len(xs) <= 5
        if query == "fail" and xs[0]["id"] == "2-6":
            raise OSError
        return [{"id": xs[0]["id"], "score": 300, "reasons": ["a", 1], "caveats": None}, {"id": xs[0]["id"], "score": 1}, {"id": "other", "score": 50}, {"id": xs[1]["id"], "score": "high"}, {"id": xs[1]["id"], "score": -5}, "x"]

    fits = M.judged(ranked, requests, model, shortlist=12)
    got = {r.id: (r.fit, list(r.reasons)) for r in fits.collect()}
    assert got == {"1-1": (100.0, ["a"]), "1-2": (0.0, []), "1-6": (100.0, ["a"]), "1-7": (0.0, []), "1-11": (100.0, ["a"]), "1-12": (0.0, []), "2-1": (100.0, ["a"]), "2-2": (0.0, []), "2-11": (100.0, ["a"]), "2-12": (0.0, [])}
    order = [r.id for r in M.reranked(ranked, fits).filter("watch_id = 2").orderBy("place").collect()]
    assert order == ["2-1", "2-11", "2-2", "2-12", *[f"2-{i}" for i in (3, 4, 5, 6, 7, 8, 9, 10)]]
    assert {r.id for r in M.reranked(ranked, fits, M.FIT).collect()} == {"1-1", "1-6", "1-11", "2-1", "2-11"}
    assert M.reranked(ranked, fits.limit(0), M.FIT).count() == 24


def test_curation_and_its_fallback(spark, ranked, requests):
    def model(query, xs):
        if query == "fail":
            raise OSError
        return 'Here: {"alerts": [{"id": "1-3", "headline": " Hi "}, {"id": "9-9", "headline": "bad"}, {"id": "1-1", "blurb": "b"}, {"id": "1-2"}, {"id": "1-3", "blurb": "again"}]} bye'

    got = {w: [(r.id, r.headline, r.by_model) for r in M.curated(ranked, requests, model).filter(f"watch_id = {w}").orderBy("place").collect()] for w in (1, 2)}
    assert got[1] == [("1-3", "Hi", True), ("1-1", "New match", True)] and [x[0] for x in got[2]] == [f"2-{i}" for i in range(1, 6)]
    assert M.curated(ranked, requests, lambda q, xs: {"alerts": []}).count() == 0 and M.curated(ranked, requests, None).count() == 10


def test_overnight_tells_once(spark, ranked, requests):
    ledger = spark.createDataFrame([(1, "old")], "watch_id bigint, id string")
    alerts, after, summary = M.overnight(ranked, requests, ledger)
    assert alerts.count() == 10 and after.count() == 11 and {(r.watch_id, r.candidates, r.told) for r in summary.collect()} == {(1, 12, 5), (2, 12, 5)}
    rest = ranked.join(after, ["watch_id", "id"], "left_anti")
    assert {r.id for r in M.overnight(rest, requests, after)[0].collect()}.isdisjoint({r.id for r in alerts.collect()})


def test_requests_and_pictures(spark):
    req = spark.createDataFrame([(1, "small"), (2, "bad"), (3, None), (4, "list")], "id bigint, query string")

    def parse(q):
        if q == "bad":
            raise OSError
        return "[1]" if q == "list" else 'sure: {"sizes": ["small"]}'

    assert {r.id: json.loads(r.parsed) for r in M.parse_requests(req, parse).collect()} == {1: {"sizes": ["small"]}, 2: {}, 3: {}, 4: {}}
    work = spark.createDataFrame([("a", "u"), ("b", "bad"), ("c", None)], "id string, url string")
    got = {r.id: r for r in M.enriched(work, lambda u: {"tags": [" Fluffy ", "fluffy", 3], "confidence": 7, "size": "BIG", "description": " x "} if u == "u" else 1 / 0).collect()}
    assert got["a"].tags == ["fluffy"] and got["a"].confidence == 1.0 and got["a"]["size"] == "big" and got["a"].description == "x" and got["b"].outcome == "failed" and "c" not in got
    assert M.enriched(work, lambda u: {}, 1).count() == 1
    assert M.extract_json("no [ json {\"a\": 1} end") == {"a": 1} and M.extract_json(None) is None
