"""Listings of one dog against every pair, and breed tokens against literals."""

import random

import pytest
from pyspark.sql import functions as F

from kennelflow.functions import listing as X
from kennelflow.operators import entities, records

ROWS = "id string, source string, name string, placeholder boolean, sex string, tokens array<string>, age int, photo string"


def one_dog(a, b):
    if not a[2] or a[2] != b[2] or ({a[4], b[4]} == {"male", "female"}):
        return False
    shared = bool(set(a[5]) & set(b[5]))
    if a[1] == b[1]:
        return shared or not (a[5] or b[5])
    return not a[3] and (shared or not a[5] or not b[5]) and (a[6] is None or b[6] is None or abs(a[6] - b[6]) <= 24)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_every_pair(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(30)] + ["puppy", "", None]
    rows = []
    for i in range(400):
        name = rng.choice(names)
        photo = rng.choice([f"p{rng.randrange(600)}", " p1 ", f"no_photo{rng.randrange(40)}.jpg", None])
        rows.append((f"l{i:03}", rng.choice("stu"), name, name == "puppy", rng.choice(["male", "female", "unknown", None]), rng.choice([[], [], ["x"], ["y"], ["x", "z"], ["w"], ["v"], ["q"]]), rng.choice([None, *range(0, 400, 13), *range(0, 400, 13)]), photo))
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    users = {}
    for r in rows:
        if r[7] and "no_photo" not in r[7]:
            users.setdefault(r[7].strip(), []).append(r[0])
    pairs = [tuple(u) for u in users.values() if len(u) == 2]
    pairs += [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if one_dog(a, b)]
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, ROWS)
    got = {r.node: r.component for r in records.connected_components(entities.photo_edges(df).union(entities.name_edges(df))).collect()}
    assert {r[0]: got.get(r[0], r[0]) for r in rows} == {x: find(x) for x in parent}


def test_breed_tokens(spark):
    want = {"Lab Retriever / GSD mix": ["labrador retriever", "german shepherd"], "Mix": ["mixed breed"], "  ": [], "Beagle and Beagle, Yorkie": ["beagle", "yorkshire terrier"], "Pug cross Husky & Heeler": ["pug", "husky", "australian cattle dog"], "mixed breed dog": ["dog"]}
    got = spark.createDataFrame([(k,) for k in want], "b string").select("b", X.breed_tokens(F.col("b")).alias("t")).collect()
    assert {r.b: r.t for r in got} == want


def test_every_listing_has_a_component(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.001"
    ids = {r.id for r in spark.read.parquet(f"{d}/dog_listings.parquet").select("id").filter("id is not null").collect()}
    got = e.queries()["listing_components"](spark, d).collect()
    assert len(got) == len(ids) and {r.id for r in got} == ids
