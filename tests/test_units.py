"""Notations of amounts, as literals: text, field, amount in pounds or months (None: no amount)."""

import pytest

from kennelflow.operators import units as U

KG, G = 2.20462262185, 0.00220462262185
CASES = [
    ("45", "weight", 45), ("45.5", "weight", 45.5), ("45 lb", "weight", 45), ("45lbs", "weight", 45), ("45#", "weight", 45), ("#45", "weight", 45), ("Wt: 45 lb", "weight", 45),
    ("~45 LBS", "weight", 45), ("about 45 pounds", "weight", 45), ("approx. 45.5 pounds", "weight", 45.5), ("45½ lb", "weight", 45.5), ("45 1/2 lb", "weight", 45.5), ("41 to 43 pounds", "weight", 42),
    ("67-71 lbs", "weight", 69), ("57–67 lb", "weight", 62), ("10lbs 12oz", "weight", 10.75), ("47 lb 12 oz", "weight", 47.75), ("63 lb, 2 oz.", "weight", 63.125), ("135oz", "weight", 135 / 16),
    ("3180 g", "weight", 3180 * G), ("8300g", "weight", 8300 * G), ("2,780 grams", "weight", 2780 * G), ("10,480 grams", "weight", 10480 * G), ("2.780 g", "weight", 2780 * G), ("25 000 g", "weight", 25000 * G),
    ("1,120 oz", "weight", 70), ("21.3 kgs", "weight", 21.3 * KG), ("18,0 KG", "weight", 18 * KG), ("ca. 32,4 kg", "weight", 32.4 * KG), ("12,500 kg", "weight", 12.5 * KG), ("12.500 kg", "weight", 12.5 * KG), ("25.4kg", "weight", 25.4 * KG),
    ("23.2 kilos", "weight", 23.2 * KG), ("28.8 kilograms", "weight", 28.8 * KG), ("5 kilogramos", "weight", 5 * KG), ("3 st 4 lb", "weight", 46), ("3 stone", "weight", 42), ("4st", "weight", 56),
    ("forty-three pounds", "weight", 43), ("a hundred and five lb", "weight", 105), ("sixty one lb", "weight", 61), ("7 Lb (scale 2)", "weight", 7), ("about 45", "weight", 45), ("twenty", "weight", 20),
    ("1,000 - 1,200 g", "weight", 1100 * G), ("Medium", "weight", None), ("not weighed", "weight", None), ("TBD", "weight", None), ("n/a", "weight", None), ("under 20 lb", "weight", None), ("", "weight", None), (None, "weight", None),
    ("2", "age", 24), ("18 mo", "age", 18), ("25 weeks", "age", 25 * 7 / 30.44), ("14 yr, 11 mo", "age", 179), ("10mo old", "age", 10), ("1 años 8 meses", "age", 20), ("3y 5m", "age", 41), ("2Yrs 7Mths (approx)", "age", 31),
    ("est. 0.75 years", "age", 9), ("463 days old", "age", 463 / 30.44), ("1,200 days", "age", 1200 / 30.44), ("1.25 yrs", "age", 15), ("1 to 3 years", "age", 24), ("9-11 yrs", "age", 120), ("one year old", "age", 12),
    ("a year and a half", "age", 18), ("two and a half years", "age", 30), ("11+ yrs", "age", 132), ("12 años", "age", 144), ("6 y/o", "age", 72), ("3 ans", "age", 36), ("8 semaines", "age", 56 / 30.44), ("Under 1 yr", "age", None),
    ("young adult", "age", None), ("Senior", "age", None), ("half a year", "age", 6), ("1½ yrs", "age", 18), ("0,5 years", "age", 6), ("z" * 50_000, "age", None),
]


@pytest.mark.parametrize("text,field,want", CASES, ids=lambda x: str(x)[:24])
def test_notation(text, field, want):
    factor = {(f, u): k for u, f, k in U.FACTORS}
    parts = U.amounts(text, field)
    got = sum(v * factor[field, u or U.DEFAULT_UNIT[field]] for v, u in parts) if parts else None
    assert got == (None if want is None else pytest.approx(want, rel=1e-9))


def test_the_description_is_read_unless_a_unit_is_written(spark):
    raws = ["45", "about 45", "twenty", "45 approx", "45 lb", "3 años", "#12", "Medium", "", None, "45½", "forty-three pounds"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    assert [r.need for r in df.orderBy("i").select(U.needs_text(["raw"]).alias("need")).collect()] == [True, True, True, True, False, False, False, False, False, False, True, False]


def test_a_figure_in_words_takes_its_unit_from_the_description(spark):
    rows = [("a", "approx 12", None, "She weighs 12 kg today.", "T"), ("b", "approx 12", None, None, "T"), ("c", "approx 12", None, None, "weights in kilograms")]
    df = spark.createDataFrame(rows, "id string, weight_raw string, est double, description string, notes string").selectExpr("*", "timestamp'2026-01-01' as at")
    got = U.to_common_units(U.parse_amounts(df, {"weight": ("weight_raw", "est")}, "id", "description", "notes", "at"))
    assert {r.id: round(r.amount, 3) for r in got.collect()} == {"a": round(12 * KG, 3), "b": 12.0, "c": round(12 * KG, 3)}
