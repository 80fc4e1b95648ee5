"""Normalised fields against literals."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kennelflow.functions import feeds as P
from kennelflow.functions import listing as X

AT = datetime(2026, 7, 1)


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t, AT) for i, t in enumerate(texts)], "i int, t string, at timestamp")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t")).alias("v")).collect()]


CASES = {
    "names": (X.title_name, {"PATTIE GONIA* (A332073)": "Pattie Gonia", "PATTIE*GONIA (332073)": "Pattie Gonia", "*BUDDY": "Buddy", "  luna  ": "luna", "": None, "***": None, "MARY-ANN O'NEIL": "Mary-Ann O'Neil", "McGee": "McGee", "42": "42"}),
    "placeholder": (X.placeholder_name, {"A5786773": True, "230026": True, "Unknown": True, "Puppy": True, "pup": True, "pending": True, "K9": False, "B52": False, "x": True, "Biscuit": False}),
    "sex": (X.sex_of, {"Neutered Male": "male", "Spayed Female": "female", "F": "female", "M": "male", "female (young)": "female", "?": "unknown", "F/S spayed": "female", "Unknown": "unknown"}),
    "altered": (X.altered, {"Neutered Male": True, "young neutered male": True, "unaltered": True, "Intact female": False, "Male": None}),
    "weight": (X.weight_from_text, {"45 lbs": 45.0, "20 kg": 44.1, "45": 45.0, "12.34 pounds": 12.3, "heavy": None, "": None, "20kg (44 lb)": 44.1}),
    "status": (X.status_of, {"AVAILABLE FOR ADOPTION": "available", "Adoption Pending": "pending", "adopted": "adopted", "RESCUE-ONLY": "rescue_only", "Stray wait": "stray_hold", "Vet Hold": "medical_hold", "Other hold": "hold", "In Foster": "foster", "Unavailable": "not_available", "In Shelter": "available", "AV PEND SN": "pending", "zzz": "unknown", "": "unknown"}),
    "breeds": (X.breed_tokens, {"Lab Retriever / GSD mix": ["labrador retriever", "german shepherd"], "mixed": ["mixed breed"], "": [], "Poodle and poodle": ["poodle"], "Pug cross beagle": ["pug", "beagle"]}),
    "label": (X.breed_label, {"Lab Retriever mix": "labrador retriever mix", "Pug / Beagle": "pug / beagle", "mix": "mixed breed", "": None}),
    "colors": (X.split_colors, {"Blk & White/Tan": ["black", "white", "tan"], "grey - gray": ["gray"], "": [], "Blue Merle": ["blue merle"]}),
    "flags": (X.yes_no, {"Yes": True, "good with all": True, "No": False, "not yet": False, "maybe": None, "": None}),
    "fresh": (X.fresh, {"available": "fresh", "still_seen": "fresh", "missing_once": "stale", "missing_multiple_runs": "missing", "likely_unavailable": "missing", "x": "uncertain"}),
    "photo": (X.placeholder_photo, {"https://h/No_Photo.jpg": True, "https://h/coming-soon.png": True, "https://h/generic.svg": True, "https://h/a-1.jpg": False}),
    "html": (X.html_to_text, {"<p>A&nbsp;b</p>c<br>d": "A b\n\nc\nd", "it&#39;s &ldquo;x&rdquo; &mdash; y": "it's \"x\" — y", "<br> ": None}),
    "prose": (X.html_to_prose, {"a<br>\nb<br><br/>c": "a b\n\nc", "one\ntwo": "one two"}),
    "epoch": (P.epoch_date, {"1740148830": "2025-02-21", "0": None, "x": None, "": None}),
    "breed": (P.bare_breed, {"Mixed Breed (Medium)": "Mixed Breed", "Pug (X-Large) (toy)": "Pug (toy)", " ": None}),
    "permalink": (P.trailing_id, {"https://h/dogs/rex-12345/": "12345", "https://h/x": None}),
    "attribute": (P.attribute_text, {"&lt;b&gt; &quot;x&quot; &amp;amp;": '<b> "x" &amp;'}),
}


@pytest.mark.parametrize("name", CASES)
def test_literals(spark, name):
    f, cases = CASES[name]
    assert dict(zip(cases, values(spark, list(cases), f))) == cases


def test_nulls(spark):
    for name, (f, _) in CASES.items():
        got = values(spark, [None], f)[0]
        assert got == {"placeholder": True, "sex": "unknown", "status": "unknown", "breeds": [], "colors": [], "fresh": "uncertain", "photo": False}.get(name), name


AGES = {
    "2 years": (24, "young"), "2 years 3 months": (27, "young"), "13 weeks old": (3, "puppy"), "1Yrs 2Mths 1Wks (approx)": (14, "young"), "Est. age: 14 yrs": (168, "senior"), "I am about 11 years old.": (132, "senior"),
    "Senior": (None, "senior"), "puppy": (None, "puppy"), "0 years 0 months": (None, None), "gibberish": (None, None), "DOB 2025-07-01": (12, "young"), "born 7/1/2016": (120, "senior"), "1-3 yrs": (24, "young"), "Under 1 yr": (None, "puppy"),
    "Under 2 yr": (None, None), "7+ yrs": (84, "adult"), "Senior Dog: 7+ yrs.": (84, "senior"), "3": (36, "adult"), "123": (None, None), "": (None, None), "young adult": (None, "young"),
}


def test_ages(spark):
    got = values(spark, list(AGES), lambda c: X.age_from_text(c, F.col("at")))
    assert {t: (r["months"], r["bucket"]) for t, r in zip(AGES, got)} == AGES


def test_sizes_and_picture_sizes(spark):
    rows = [("X-Large", None, "xlarge"), ("Large", None, "large"), ("med", None, "medium"), ("sm", None, "small"), ("mini", None, "small"), ("PUPPY", 10.0, "small"), (None, 60.0, "medium"), (None, 60.5, "large"), (None, 100.0, "xlarge"), ("small-boned", None, "small"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, lbs double, want string")
    assert all(r.got == r.want for r in df.select(X.size_of(F.col("t"), F.col("lbs")).alias("got"), "want").collect())
    sizes = spark.createDataFrame([(160, 120, True), (160, 121, False), (None, 120, False)], "w int, h int, want boolean")
    assert all(r.got == r.want for r in sizes.select(X.placeholder_size(F.col("w"), F.col("h")).alias("got"), "want").collect())


def test_pictures_of_feeds(spark):
    one = lambda f, schema, *rows: [r[0] for r in spark.createDataFrame(list(rows), schema).select(f.alias("v")).collect()]
    assert one(P.picture_series(F.lit("https://h/"), F.col("i"), F.col("n")), "i string, n int", ("a", 2), ("b", 0), ("c", None), ("d", 99)) == [["https://h/a/1.jpg", "https://h/a/2.jpg"], [], ["https://h/c/1.jpg"], [f"https://h/d/{k}.jpg" for k in range(1, 13)]]
    photos = {"0": ("https://h/b.jpg", False, 2), "1": ("https://h/a.jpg", True, 9), "2": ("https://h/c.jpg", None, 1), "3": ("https://h/c.jpg", False, 3), "4": ("https://h/nopic.jpg", False, 0), "5": (None, True, 0)}
    schema = "p map<string,struct<url:string,isCover:boolean,order_column:int>>"
    assert one(P.ordered_pictures(F.col("p")), schema, (photos,), (None,)) == [["https://h/a.jpg", "https://h/c.jpg", "https://h/b.jpg"], []]
    assert one(P.best_variants(F.col("u")), "u array<string>", (["https://h/a-150x150.jpg", "https://h/a.jpg", "https://h/b_thumb.jpg", "https://h/b-300x200.jpg"],)) == [["https://h/a.jpg", "https://h/b-300x200.jpg"]]
    assert one(P.flag_of(F.col("t"), "done well with dogs", "only dog home"), "t string", ("Has done well with DOGS",), ("only dog home",), ("x",), (None,)) == [True, False, None, None]


def test_facts(spark):
    text = "Sex: Male\nWeight: 40 lbs\n3 years old\nGood with cats\nLoves naps"
    rules = {"sex": r"(?i)^sex:\s*(.+)$", "weight": r"(?i)^weight:\s*(.+)$", "age": r"(?i)^(.*years? old)$"}
    got = spark.createDataFrame([(text,), (None,)], "t string").select(P.facts(F.col("t"), rules).alias("f")).collect()
    assert got[0].f.asDict() == {"sex": "Male", "weight": "40 lbs", "age": "3 years old", "rest": ["Good with cats", "Loves naps"]} and got[1].f.asDict() == {"sex": None, "weight": None, "age": None, "rest": []}
