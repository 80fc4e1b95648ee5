"""Criteria against a plain reading of every pair; terms, ranking, new matches and merged scores."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kennelflow.operators import matching as Q
from kennelflow.operators import records
from kennelflow.operators.nearness import haversine

T0 = datetime(2026, 7, 1)
ROWS = (
    "id string, name string, breed_normalized string, breed_raw string, age_raw string, age_months_estimate int, weight_lbs_estimate double, size_raw string, color_raw string, sex string, status_normalized string, stale_status string, "
    "intake_date string, primary_photo_url string, first_seen_at timestamp, last_seen_at timestamp, description string, latitude double, longitude double"
)


def row(i, **k):
    base = dict.fromkeys(x.split()[0] for x in ROWS.split(", ")) | {"id": f"l{i}", "first_seen_at": T0, "last_seen_at": T0, "status_normalized": "available", "stale_status": "still_seen", "primary_photo_url": "https://h/a.jpg"} | k
    return tuple(base[x.split()[0]] for x in ROWS.split(", "))


def searched(spark, rows, watches, radius=None):
    w = spark.createDataFrame([(i, json.dumps(p), a, o) for i, p, a, o in watches], "id bigint, parsed string, latitude double, longitude double")
    return Q.match_all(Q.match_input(spark.createDataFrame(rows, ROWS)), Q.parse_criteria(w, radius))


def plain(r, p, here):
    """The verdicts of one pair as a dictionary, or None if one fails."""
    f = dict(zip([x.split()[0] for x in ROWS.split(", ")], r))
    out = {}
    text = " ".join(x for x in (f["breed_normalized"], f["breed_raw"]) if x).lower()
    if p.get("breedIncludes"):
        out["breed"] = "u" if not text else "r" if any(b.lower() in text for b in p["breedIncludes"]) else "f"
    if p.get("breedExcludes") and text and any(b.lower() in text for b in p["breedExcludes"]):
        return None
    m = f["age_months_estimate"]
    if p.get("excludePuppies"):
        pup = (m is not None and m < 12) or "pupp" in (f["age_raw"] or "").lower()
        out["no_puppy"] = "f" if pup else "u" if m is None and not f["age_raw"] else "r"
    bucket = None if m is None else "puppy" if m < 12 else "young" if m < 36 else "adult" if m < 96 else "senior"
    if p.get("ageBuckets"):
        out["age_bucket"] = "u" if bucket is None else "r" if bucket in p["ageBuckets"] else "f"
    if p.get("minAgeMonths") is not None or p.get("maxAgeMonths") is not None:
        out["age"] = "u" if m is None else "r" if (p.get("minAgeMonths") or 0) <= m <= (p.get("maxAgeMonths") or 1e9) else "f"
    lbs = f["weight_lbs_estimate"]
    if p.get("minWeightLbs") is not None:
        out["weight"] = "u" if lbs is None else "r" if lbs >= p["minWeightLbs"] else "f"
    if p.get("colors"):
        have = [c for c in (f["color_raw"] or "").lower().split("/") if c]
        out["color"] = "u" if not have else "r" if any(c.lower() in have for c in p["colors"]) else "f"
    if p.get("sexes"):
        out["sex"] = "u" if f["sex"] not in ("male", "female") else "r" if f["sex"] in p["sexes"] else "f"
    if p.get("statuses"):
        out["status"] = "r" if f["status_normalized"] in p["statuses"] else "f"
    if p.get("minDaysInShelter") is not None:
        days = (f["last_seen_at"] - datetime.fromisoformat(f["intake_date"])).days if f["intake_date"] else None
        out["stay"] = "u" if days is None else "r" if days >= p["minDaysInShelter"] else "f"
    if here[0] is not None and p.get("maxDistanceMiles") is not None:
        out["distance"] = "u" if f["latitude"] is None else "r" if haversine(*here, f["latitude"], f["longitude"]) <= p["maxDistanceMiles"] else "f"
    return None if "f" in out.values() else out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_a_reading_of_every_pair(spark, seed):
    rng = random.Random(seed)
    one = lambda *xs: rng.choice([None, *xs])
    rows = [
        row(i, breed_raw=one("Lab mix", "Poodle", "pit bull", "GSD"), breed_normalized=one("labrador retriever", "x"), age_raw=one("2 yrs", "puppy", "Puppies"), age_months_estimate=one(3, 24, 60, 120), weight_lbs_estimate=one(10.0, 40.0, 80.0), color_raw=one("black", "white/tan", "Red"),
            sex=one("male", "female", "unknown"), status_normalized=rng.choice(["available", "hold"]), intake_date=one("2026-06-01", "2026-06-28"), latitude=(lat := one(34.0, 34.2, 40.0)), longitude=lat and -118.0)
        for i in range(120)
    ]
    some = lambda xs: rng.choice([[], [], rng.sample(xs, 2)])
    watches = [
        (i, {"breedIncludes": some(["lab", "Poodle", "b", "zz"]), "breedExcludes": some(["pit", "gsd"]), "excludePuppies": rng.random() < 0.3, "ageBuckets": some(["young", "adult", "senior"]), "minAgeMonths": one(None, 12), "maxAgeMonths": one(None, 100), "minWeightLbs": one(None, 20),
             "colors": some(["Tan", "black", "red"]), "sexes": some(["male", "female"]), "statuses": some(["available", "hold"]), "minDaysInShelter": one(None, 10), "maxDistanceMiles": one(5, 20), "keywords": []}, *rng.choice([(34.0, -118.0), (None, None), (34.2, -118.0)]))
        for i in range(60)
    ]
    got = {(r.watch_id, r.id): (set(r.reasons), set(r.unknowns)) for r in searched(spark, rows, watches).collect()}
    want = {}
    for i, p, a, o in watches:
        for r in rows:
            v = plain(r, p, (a, o))
            if v is not None:
                want[i, r[0]] = ({k for k, x in v.items() if x == "r"}, {k for k, x in v.items() if x == "u"})
    assert got == want and len(want) > 500


def test_malformed_criteria_ask_for_nothing(spark):
    w = [(1, {"sizes": ["huge", "small"], "sexes": "male", "maxWeightLbs": "heavy", "breedIncludes": [None, " "], "excludePuppies": "yes"}, 0.0, 0.0), (2, None, None, None)]
    got = {(r.watch_id, r.id): list(r.reasons) for r in searched(spark, [row(1, size_raw="Small"), row(2, size_raw="Large")], w).collect()}
    assert got == {(1, "l1"): ["size"], (2, "l1"): [], (2, "l2"): []}
    assert searched(spark, [], w).count() == 0 and searched(spark, [row(1)], []).count() == 0


def test_ranking_prefers_the_nearer_and_the_default_radius_holds(spark):
    rows = [row(1, latitude=34.5, longitude=-118.0), row(2, latitude=34.1, longitude=-118.0), row(3), row(4, latitude=36.5, longitude=-118.0), row(5, description="likes squeaky toys")]
    m = searched(spark, rows, [(1, {"keywords": ["squeaky"]}, 34.0, -118.0)], 100.0)
    assert [r.id for r in m.orderBy(*Q.ranking()).collect()] == ["l2", "l1", "l5", "l3"]
    assert {r.id: r.score for r in m.collect()} == {"l1": 2.0, "l2": 2.0, "l3": 1.0, "l5": 2.0}


def test_traits_count_twice(spark):
    w = spark.createDataFrame([(1, '{"visualTraits": ["fluffy", "curly"]}', None, None)], "id bigint, parsed string, latitude double, longitude double")
    r = Q.match_input(spark.createDataFrame([row(1), row(2)], ROWS)).withColumn("look", F.when(F.col("id") == "l1", "Fluffy coat"))
    assert {r.id: (r.score, r.rich) for r in Q.match_all(r, Q.parse_criteria(w)).collect()} == {"l1": (3.0, 1), "l2": (1.0, 0)}


def test_terms_are_found_anywhere(spark):
    texts = spark.createDataFrame([("labrador retriever",), ("xy",), ("",), ("b",)], "text string")
    terms = spark.createDataFrame([("lab",), ("or r",), ("y",), ("retriever",), ("zz",), ("",), ("b",)], "term string")
    assert {tuple(r) for r in Q.term_hits(texts, terms).collect()} == {("labrador retriever", t) for t in ("lab", "or r", "retriever", "b")} | {("xy", "y"), ("b", "b")}


def test_new_matches(spark):
    m = spark.createDataFrame([(1, "a", 2.0, True, "available", "fresh", 1), (1, "b", 1.0, True, "hold", "fresh", 2), (1, "c", 1.0, False, "available", "fresh", 3), (1, "d", 1.0, True, "available", "missing", 4), (1, "e", 0.5, True, "available", "stale", 5)], "watch_id int, id string, score double, photo boolean, status string, freshness string, rank int")
    ledger = spark.createDataFrame([(1, "a"), (1, "a"), (9, "e")], "watch_id int, id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(Q.new_matches(m, ledger)) == ["e"] and ids(Q.new_matches(m, ledger, photo=False, available=False)) == ["b", "c", "e"] and ids(Q.new_matches(m, ledger.limit(0), 1.0)) == ["a"]


def test_far_listings_are_no_alerts(spark):
    m = searched(spark, [row(1, latitude=34.0, longitude=-118.0), row(2, latitude=51.0, longitude=0.1)], [(1, {"maxDistanceMiles": 3}, 34.0, -118.0), (2, {"maxDistanceMiles": 3}, 95.0, -118.0)])
    assert {(r.watch_id, r.id) for r in m.collect()} == {(1, "l1"), (2, "l1"), (2, "l2")} and all(r.first_seen_at - T0 == timedelta(0) for r in m.collect())


def listing(key, lat, lon, text=None):
    return row(0, id=key, name=key, breed_normalized="beagle", age_months_estimate=30, weight_lbs_estimate=20.0, stale_status=None, description=text, latitude=lat, longitude=lon)


def test_radius_rejects_what_is_far_and_ranks_what_is_near(spark):
    # a degree of latitude is 69.09 miles; "far" is the richest and would lead without the distance
    rows = [listing("near", 34.05, -118.0), listing("here", 34.0, -118.0), listing("far", 35.0, -118.0, "bio"), listing("nowhere", None, None, "bio"), listing("zero", 0.0, 0.0), listing("beyond", 91.0, 0.0)]
    watches = [(1, {"maxDistanceMiles": 4}, 34.0, -118.0), (2, {"maxDistanceMiles": 3.4}, 34.0, -118.0), (3, {"maxDistanceMiles": None}, 34.0, -118.0), (4, {"maxDistanceMiles": 4}, None, None), (5, {"maxDistanceMiles": 4}, 0.0, 0.0)]
    m = searched(spark, rows, watches)
    got = {(r.watch_id, r.id): (r.reasons, r.unknowns, r.score) for r in m.collect()}
    lost = {"nowhere", "zero", "beyond"}
    assert {k for w, k in got if w == 1} == {"near", "here"} | lost and {k for w, k in got if w == 2} == {"here"} | lost
    assert all(len([k for v, k in got if v == w]) == len(rows) for w in (3, 4, 5))
    assert got[1, "near"] == (["distance"], [], 1.5) and got[1, "zero"] == ([], ["distance"], 0.5)
    assert got[3, "far"] == ([], [], 0.5) and got[4, "near"] == ([], [], 0.5)
    best = records.top_per_group(m, ["watch_id"], Q.ranking(), 3).orderBy("watch_id", "rank").groupBy("watch_id").agg(F.collect_list("id").alias("ids"))
    ranked = {r.watch_id: r.ids for r in best.collect()}
    assert ranked[1] == ["here", "near", "nowhere"] and ranked[3] == ["here", "near", "far"]
