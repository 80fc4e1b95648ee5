"""What is found in a text does not depend on how many other texts are read, beyond what they teach."""

import random

from kennelflow.llm import personal

FIRSTS = "Anna Boris Clara Dmitri Elsa Farid Greta Hugo".split()
LASTS = [a + b for a in ("Ulm", "Sten", "Drain", "Quar", "Brin", "Kort", "Mez", "Pell", "Var", "Gor") for b in ("holt", "mar", "ko", "escu", "lund", "veld", "wright", "anza")]


def corpus(n: int, seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        f, la = rng.choice(FIRSTS), rng.choice(LASTS)
        mail = f" Mail {f.lower()}.{la.lower()}@mail.example for more." if i % 7 == 0 else ""
        out.append((i, rng.choice([f"Signed, {f} {la} at noon.", f"Landlord {f} {la} confirmed it.", f"We spoke with {f} {la} about walks.", f"The adopter, {f} {la}, asked for more."]) + f" Red Ball and Blue Chair {rng.random():.4f} are near Green Park.{mail}"))
    return out


def names(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return {(r.doc_id, r.start_pos) for r in personal.personal_information(df).filter("kind = 'name'").collect()}


def test_a_tenth_of_the_corpus_gives_nearly_the_same_names(spark):
    docs = corpus(1500, 3)
    want = {i for i, _ in docs}
    few, all_ = names(spark, docs[:150]), names(spark, docs)
    assert {i for i, _ in all_} == want and len(all_) == len(want)
    mine = {x for x in all_ if x[0] < 150}
    assert few <= mine and len(few) >= 0.9 * len(mine)


def test_labels_teach_phone_numbers_of_unknown_shape(spark):
    docs = [(i, f"Kennel no. {i}. Tel. (805) 555-0{100 + i}, or call home.") for i in range(40)] + [(100 + i, f"Kennel no. {i}. Tel. 555 {1000 + i} 7, or call home.") for i in range(12)] + [(200, "Lot 555 1000 7 was sold.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.start_pos) for r in personal.personal_information(df).filter("kind = 'phone'").collect()}
    text = dict(docs)
    assert got == {(i, t.index("805" if i < 100 else "555")) for i, t in docs if i != 200} and text[200]


def test_disjoint_spans_of_a_long_text():
    text = " ".join(f"Call 805-555-0{n % 900 + 100} now." for n in range(20_000))
    assert len(personal.spans(text)) == 20_000


def test_nulls_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Mail a.b@c.example", "x"), (1, "Mail a.b@c.example", "x"), (None, "Mail a.b@c.example", None), (2, None, None), (3, "", None)], "doc_id bigint, text string, kind string")
    assert [(r.doc_id, r.kind, r.start_pos) for r in personal.personal_information(df).collect()] == [(1, "email", 5)]
