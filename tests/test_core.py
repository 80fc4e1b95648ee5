"""The general operators against brute force and literals."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kennelflow.functions import listing as X
from kennelflow.operators import drift, nearness, records, snapshots, units

T0 = datetime(2026, 7, 1, 8)
RUNS = "id bigint, source_id string, crawl_scope string, started_at timestamp, status string"
SNAPS = "run_id bigint, source_id string, listing_key string, a string, b string, extracted_at timestamp, n int"


def runs_and_rows(seed: int):
    rng = random.Random(seed)
    runs, rows = [], []
    for i in range(1, 13):
        runs.append((i, "s", "x" if i % 3 else None, T0 + timedelta(days=i), rng.choice(["success", "success_with_warnings", "partial"])))
        for k in "pqrs":
            for _ in range(rng.choice([0, 1, 1, 2])):
                rows.append((i, "s", k, rng.choice(["A", "a ", "b", None, ""]), rng.choice(["1", "2"]), T0 + timedelta(days=i, minutes=rng.randrange(5)), 0))
    return runs, rows


def key(x):
    return " ".join((x or "").split()).lower()


def complete_states(runs, rows):
    out = {}
    for scope in {r[2] for r in runs}:
        good = sorted((r for r in runs if r[2] == scope and r[4] != "partial"), key=lambda r: (r[3], r[0]))
        seq = []
        for r in good:
            best = {}
            for row in rows:
                if row[0] == r[0]:
                    v = (row[5], key(row[3]), key(row[4]))
                    best[row[2]] = max(best.get(row[2], v), v)
            seq.append((r[0], {k: v[1:] for k, v in best.items()}))
        out[scope] = seq
    return out


@pytest.mark.parametrize("seed", range(3))
def test_changes_and_history_equal_brute_force(spark, seed):
    runs, rows = runs_and_rows(seed)
    rdf, sdf = spark.createDataFrame(runs, RUNS), spark.createDataFrame(rows, SNAPS)
    want, versions = set(), set()
    for seq in complete_states(runs, rows).values():
        for (_, old), (rid, new) in zip(seq, seq[1:]):
            want |= {(rid, k, "added") for k in new.keys() - old.keys()} | {(rid, k, "removed") for k in old.keys() - new.keys()}
            want |= {(rid, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
        for k in {k for _, s in seq for k in s}:
            start = None
            for i, (rid, s) in enumerate(seq):
                if k in s and (start is None or s[k] != start[1]):
                    if start:
                        versions.add((k, start[0], rid))
                    start = (rid, s[k])
                elif k not in s and start:
                    versions.add((k, start[0], rid))
                    start = None
            if start:
                versions.add((k, start[0], 0))
    got = {(r.run_id, r.listing_key, r.change_kind) for r in snapshots.snapshot_changes(sdf, rdf, ["a", "b"]).collect()}
    assert got == want
    hist = snapshots.attribute_history(sdf, rdf, ["a", "b"]).collect()
    assert sorted((r.listing_key, r.from_run_id, r.to_run_id) for r in hist) == sorted(versions)


def test_snapshots_of_empty_tables(spark):
    rdf, sdf = spark.createDataFrame([], RUNS), spark.createDataFrame([], SNAPS)
    assert snapshots.snapshot_changes(sdf, rdf, ["a", "b"]).count() == 0
    assert snapshots.attribute_history(sdf, rdf, ["a", "b"]).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"chunk": 20, "query_chunk": 3, "least_pivots": 12, "flat": 4, "hot_rows": 30}])
def test_radius_join_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    pts = [(f"l{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(33, 36, 300), rng.uniform(-120, -117, 300)))]
    pts += [("east", 51.9, 179.99), ("west", 51.9, -179.99), ("null", None, 1.0), ("zero", 0.0, 0.0), ("far", 91.0, 0.0), ("pole", 90.0, 10.0)] + [(f"same{i}", 34.0, -118.0) for i in range(200)]
    qs = [(i, float(a), float(b), float(r)) for i, (a, b, r) in enumerate(zip(rng.uniform(33, 36, 40), rng.uniform(-120, -117, 40), rng.uniform(0, 60, 40)))]
    qs += [(100, 51.9, -179.999, 5.0), (101, 34.0, -118.0, 0.0), (102, 90.0, -50.0, 1.0), (103, 34.0, -118.0, None), (104, None, 1.0, 5.0), (105, 34.0, -118.0, -1.0)]
    got = {(r.qid, r.id) for r in nearness.within_radius(spark.createDataFrame(pts, "id string, lat double, lon double"), spark.createDataFrame(qs, "qid bigint, qlat double, qlon double, radius double"), **sizes).collect()}
    want = set()
    for q, a, b, r in qs:
        for i, x, y in pts:
            if None not in (a, b, r, x, y) and abs(x) <= 90 and (x, y) != (0, 0) and nearness.haversine(a, b, x, y) <= r:
                want.add((q, i))
    assert got == want
    empty = spark.createDataFrame([], "id string, lat double, lon double")
    assert nearness.within_radius(empty, spark.createDataFrame(qs, "qid bigint, qlat double, qlon double, radius double")).count() == 0


def test_positions_are_copied_only_where_a_cell_has_many_queries(spark):
    here, there = [(34 + i / 1000, -118.0) for i in range(60)], [(45 + i / 1000, -90.0) for i in range(60)]
    pts = spark.createDataFrame(here + there, "lat double, lon double")
    qs = spark.createDataFrame([(i, 34.0, -118.0, 10.0) for i in range(100)] + [(500, 45.0, -90.0, 10.0)], "qid bigint, qlat double, qlon double, radius double")
    t = nearness.cut_into_tasks(pts, qs, query_chunk=5, least_pivots=2).filter("is_point").groupBy("lat").count().collect()
    assert {r["count"] for r in t if r.lat < 40} == {20} and {r["count"] for r in t if r.lat > 40} == {1}


@pytest.mark.parametrize(
    "field,text,want",
    [
        ("weight", "54½ lb", 54.5),
        ("weight", "one hundred twenty-five lbs", 125),
        ("weight", "113 lb, 4 oz.", 113.25),
        ("weight", "12 to 18 pounds", 15),
        ("weight", "ca. 3,2 kg", 3.2 * 2.20462262185),
        ("weight", "78.5 Lb (scale 2)", 78.5),
        ("age", "5y 8m", 68),
        ("age", "nine and a half years", 114),
        ("age", "a year and a half", 18),
        ("age", "1 años 8 meses", 20),
        ("age", "11+ yrs", 132),
        ("age", "7-9 yrs", 96),
        ("age", "Under 2 yr", None),
        ("age", "puppy", None),
        ("weight", "", None),
        ("weight", None, None),
        ("weight", "x" * 100_000, None),
    ],
)
def test_amounts(field, text, want):
    factor = {u: k for u, f, k in units.FACTORS if f == field}
    parts = units.amounts(text, field)
    assert (sum(v * factor[u] for v, u in parts) if parts else None) == (pytest.approx(want) if want is not None else None)


def test_unit_of_bare_figures(spark):
    rows = [
        ("a", "20", None, "On our scale Rex comes to 20 kg.", None),
        ("b", "20", 20.0, None, "weight column exported in kilos"),
        ("c", "20", 20.0, None, "ages = months"),
        ("d", None, None, None, None),
        ("e", "10 kg", 22.0, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, w string, e double, text string, notes string").withColumn("at", F.lit(T0))
    got = {r.id: round(r.amount, 2) for r in units.to_common_units(units.parse_amounts(df, {"weight": ("w", "e")}, "id", "text", "notes", "at")).collect()}
    assert got == {"a": 44.09, "b": 44.09, "c": 20.0, "e": 22.05}
    wrong = units.wrong_estimates(units.to_common_units(units.parse_amounts(df, {"weight": ("w", "e")}, "id", "text", "notes", "at")))
    assert {r.id for r in wrong.collect()} == {"a", "b"}


def test_drift(spark):
    rng = random.Random(2)
    dogs = [{"id": 1000 + i, "name": f"n{i}", "state": rng.choice(["IN", "OUT", "HOLD"]), "size": {"kg": i}, "ok": True} for i in range(30)]
    files = {1: dogs}
    files[2] = [{**{k: v for k, v in x.items() if k != "state"}, "info": {"status": x["state"]}} for x in dogs]
    files[3] = [{**{k: v for k, v in x.items() if k != "ok"}, "size": {"kg": str(x["size"]["kg"])}, "views": 3, "note": None} for x in files[2]]
    rows = [("f", n, f"f{n}", i, json.dumps(x)) for n, xs in files.items() for i, x in enumerate(xs)]
    rows += [("f", 3, "f3", 0, rows[-1][4]), ("f", 3, "f3", 99, '{"id": 5, "na'), ("f", 3, "f3", 98, None), ("f", 2, "f2", 97, "[1]"), (None, 1, "x", 1, "{}")]
    df = spark.createDataFrame(rows, "feed string, file_no int, file_name string, record_no int, payload string")
    got = {tuple(r) for r in drift.drift_report(df).select("file_no", "change_kind", "old_path", "new_path").collect()}
    assert got == {(2, "renamed", "state", "info.status"), (3, "removed", "ok", ""), (3, "added", "", "views"), (3, "added", "", "note"), (3, "type_changed", "size.kg", "size.kg")}
    more = df.unionByName(spark.createDataFrame([("f", 3, "f3", 200, '{"id": 7, "size": {"kg": "heavy"}, "info": {"status": "IN"}}'), ("g", 1, "g1", 1, '{"ID": "x"}'), ("g", 1, "g1", None, '{"ID": "y"}'), ("g", 1, "g1", None, '{"ID": "y"}')], df.schema))
    t = drift.consistent_table(more)
    assert t.columns == ["feed", "file_no", "record_no", "g__ID", "f__id", "name", "ok", "size__kg", "state", "views"]
    got = t.collect()
    assert len(got) == 93 and len({(r.feed, r.file_no, r.record_no, r.g__ID) for r in got}) == 93
    assert sum(r.state is not None for r in got) == 91 and sum(r.size__kg is not None for r in got) == 90 and all(r.ok in (None, True) for r in got)
    assert dict(t.dtypes)["size__kg"] == "double" and [(r.record_no, r.field, r.text) for r in drift.failed_casts(more).collect()] == [(200, "size.kg", "heavy")]
    assert sorted((r.record_no, r.problem, r.n) for r in drift.unreadable(df).collect()) == [(97, "no object", 1), (98, "null", 1), (99, "cut", 1)]
    assert drift.consistent_table(df.limit(0)).count() == 0
    assert drift.drift_report(df.limit(0)).count() == 0


def test_missed_runs_equal_a_join(spark):
    rng = random.Random(3)
    seen = [(f"k{i}", "s", T0 + timedelta(hours=rng.randrange(100))) for i in range(30)]
    runs = [("s", T0 + timedelta(hours=rng.randrange(120))) for _ in range(20)]
    got = records.missed_runs(spark.createDataFrame(seen, "id string, scope string, last_seen_at timestamp"), spark.createDataFrame(runs, "scope string, ran_at timestamp"), ["scope"])
    for r in got.collect():
        after = sorted({t for _, t in runs if t > r.last_seen_at})
        assert r.missed == len(after) and r.missing_since == (after[0] if after else None)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in records.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_names_and_dates(spark):
    row = spark.createDataFrame([("*BISCUIT-BEAR* (A123456)", "Feb 31, 2026", "02/03/2026")], "n string, a string, b string").select(X.title_name(F.col("n")), X.loose_date(F.col("a")), X.loose_date(F.col("b"))).first()
    assert row[0] == "Biscuit-Bear" and str(row[1]) == "2026-03-03" and str(row[2]) == "2026-02-03"


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
