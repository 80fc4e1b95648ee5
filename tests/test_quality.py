"""Run quality and global ranks against literals and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kennelflow.operators import quality as K
from kennelflow.operators import records as R

RUN = "status string, found int, paged boolean, mismatch boolean, done boolean, attempts int, failures int, weak int, photos int, urls int, warned int"


@pytest.mark.parametrize(
    "run,want",
    [
        (("success", 20, True, False, True, 0, 0, 0, 20, 20, 0), 1.0),
        (("failed", 20, True, False, True, 0, 0, 0, 20, 20, 0), 0.0),
        (("blocked", 0, True, False, True, 0, 0, 0, 0, 0, 0), 0.0),
        (("partial", 0, True, False, True, 0, 0, 0, 0, 0, 3), 0.1),
        (("partial", 20, False, False, True, 0, 0, 0, 20, 20, 0), 0.7),
        (("success", 20, None, True, False, 0, 0, 0, 20, 20, 0), 0.45),
        (("success", 20, True, False, True, 10, 2, 0, 20, 20, 0), 0.9),
        (("success", 20, True, False, True, 10, 9, 0, 20, 20, 0), 0.8),
        (("success", 20, True, False, True, 0, 0, 1, 20, 20, 0), 1.0),
        (("success", 20, True, False, True, 0, 0, 4, 20, 20, 0), 0.9),
        (("success", 20, True, False, True, 0, 0, 20, 15, 20, 0), 0.7),
        (("success", 20, True, False, True, 0, 0, 0, 20, 19, 9), 0.7),
        (("partial", 20, False, True, False, 10, 10, 20, 0, 0, 99), 0.0),
    ],
)
def test_confidence(spark, run, want):
    df = spark.createDataFrame([run], RUN)
    got = df.select(K.confidence(*[F.col(c) for c in ("status", "found", "paged", "mismatch", "done", "attempts", "failures", "weak", "photos", "urls", "warned")]).alias("c")).first().c
    assert got == pytest.approx(want, abs=1e-9)


def test_warnings_and_status(spark):
    cols = "k string, found int, paged boolean, reported int, prior int, attempts int, failures int, weak int, lost int, dup int, want array<string>, status string"
    rows = [
        ("plain", 20, True, 20, 20, 10, 2, 4, 6, 0, [], "success"),
        ("dup", 20, True, None, None, 0, 0, 0, 0, 1, ["duplicates"], "success_with_warnings"),
        ("weak", 20, True, 20, 20, 0, 0, 5, 0, 0, ["weak_keys"], "success_with_warnings"),
        ("empty", 0, True, 0, 9, 0, 0, 0, 0, 0, ["empty"], "partial"),
        ("pages", 20, False, 21, 20, 0, 0, 0, 0, 0, ["not_paged", "count"], "partial"),
        ("drop", 9, None, 9, 20, 0, 0, 0, 0, 0, ["not_paged", "drop"], "partial"),
        ("small", 4, True, 4, 9, 0, 0, 0, 3, 0, [], "success"),
        ("photos", 4, True, 4, 4, 0, 0, 0, 4, 0, ["photos"], "success_with_warnings"),
        ("details", 20, True, 20, 20, 10, 3, 0, 0, 0, ["details"], "partial"),
    ]
    w = K.run_warnings(*[F.col(c) for c in ("found", "paged", "reported", "prior", "attempts", "failures", "weak", "lost", "dup")])
    df = spark.createDataFrame(rows, cols).withColumn("got", w)
    for r in df.withColumn("judged", K.run_status(F.lit("success"), F.col("got"), F.lit(True))).collect():
        assert (r.got, r.judged) == (r.want, r.status), r.k
    kept = df.select(K.run_status(F.lit("blocked"), F.col("got"), F.lit(False)).alias("s")).distinct().collect()
    assert [r.s for r in kept] == ["blocked"]


def test_prior_good_run_skips_bad_ones(spark):
    rows = [(1, "a", 1, "success", 30), (2, "a", 2, "failed", 0), (3, "a", 3, "success", 10), (4, "a", 3, "partial", 5), (5, "b", 9, "success", 7)]
    got = K.last_good_before(spark.createDataFrame(rows, "id int, src string, t int, status string, n int"), "src", "t", "n")
    assert {r.id: r.prior for r in got.collect()} == {1: None, 2: 30, 3: 30, 4: 10, 5: None}


def test_richest_strength_and_verdict(spark):
    df = spark.createDataFrame([("k", 1, False, "long text"), ("k", 2, True, "a"), ("k", 3, True, "abc"), ("k", 4, True, "xyz"), ("j", 5, None, None)], "k string, seq int, d boolean, t string")
    assert {r.k: r.seq for r in K.richest(df, ["k"], F.coalesce("d", F.lit(False)), F.col("t"), [F.asc("seq")]).collect()} == {"k": 3, "j": 5}
    n = spark.createDataFrame([(0, 0, "empty"), (3, 3, "all"), (3, 0, "none"), (3, 1, "mixed")], "n int, own int, want string")
    assert all(r.got == r.want for r in n.select(K.key_strength(F.col("n"), F.col("own")).alias("got"), "want").collect())
    v = spark.createDataFrame([(True, True, "pass"), (False, True, "fail"), (True, False, "partial"), (None, None, "pass")], "a boolean, b boolean, want string")
    assert all(r.got == r.want for r in v.select(K.verdict_from({"a": F.col("a"), "b": F.col("b")}, ["a"]).alias("got"), "want").collect())


def test_global_rank_is_a_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(20), rng.choice([None, 1.5, 2.5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, a int, b double").repartition(5)
    got = {r.i: r.place for r in R.global_rank(df, [F.desc("a"), F.asc_nulls_last("b"), F.asc("i")], "place").collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 3001))
    assert R.global_rank(df.limit(0), [F.asc("i")], "place").count() == 0


def test_components_say_so_if_incomplete(spark):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(200)], "a string, b string")
    with pytest.raises(RuntimeError):
        R.connected_components(chain, rounds=1)
