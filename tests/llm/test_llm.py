"""The operators tagged llm against brute force and literals."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kennelflow.llm import mixing, packing, personal, survivors, vocabulary

T0 = datetime(2026, 7, 1)
MEMBERS = "gid bigint, id string, name string, text string, urls array<string>, seen_at timestamp"
GENERAL = "All dogs are vaccinated before they go home. Visit hours are posted on our page. Thank you for choosing us."


def test_survivors(spark):
    rng = random.Random(1)
    words = "runs jumps sleeps eats barks digs swims hides sings rolls naps walks".split()
    bio = lambda n: f"{n} {rng.choice(words)} near the {rng.choice(words)} tree {rng.random():.6f} every day. {n} {rng.choice(words)} with {rng.random():.6f} old friends at home."
    rows = [(g, f"x{g}", f"Dog{g}", GENERAL if g % 3 else "tbd", [f"https://h/{g}-1.jpg", "https://h/shared-1.jpg"], T0) for g in range(100, 160)]
    b1, b2 = bio("Rex"), bio("Rex")
    rows += [
        (1, "a", "Rex", b1 + "\n\n" + GENERAL, ["https://h/aa-1.jpg", "https://h/aa-1_thumb.jpg?w=3"], T0 + timedelta(1)),
        (1, "b", "REX", "<p>" + b1 + "</p>", ["https://h/aa-1.jpg", "https://k/aa-2.jpg"], T0),
        (1, "c", "Rex", GENERAL, None, T0 + timedelta(9)),
        (1, "d", "Rex", b1[:70], ["https://h/shared-1_small.jpg"], T0 + timedelta(9)),
        (1, "e", "Rex", "tbd", [], T0 + timedelta(9)),
        (2, "f", None, b2, None, None),
        (2, "g", None, None, [None, ""], T0),
        (3, "h", "Solo", b2, [], T0),
        (None, "i", "Lone", b2, [], T0),
    ]
    got = {r.gid: (r.text_id, r.urls_id, r.display_id) for r in survivors.survivors(spark.createDataFrame(rows, MEMBERS)).collect()}
    assert got == {1: ("a", "b", None), 2: ("f", None, None)}
    assert survivors.survivors(spark.createDataFrame([], MEMBERS)).count() == 0


def test_short_cut_copies_and_list_sizes_give_one_result(spark):
    full = "rex is a shy boy. he is ok. go see him. he naps by the old tree all day."
    rows = [(1, "a", "Rex", full, None, T0), (1, "b", "Rex", "rex is a shy boy. he is ok. go see him.", None, T0 + timedelta(9)), (2, "c", "Ada", "ada is a shy girl. she is ok. go see.", None, T0), (2, "d", None, None, None, T0)]
    rows += [(g, f"x{g}", f"Dog{g}", GENERAL, None, T0) for g in range(100, 140)]
    df = spark.createDataFrame(rows, MEMBERS)
    assert {r.gid: r.text_id for r in survivors.survivors(df).collect()} == {1: "a", 2: "c"}
    w = df.select("gid", "id", "name", "text")
    some, none = ({tuple(r) for r in survivors.text_worth(w, n).collect()} for n in (10_000, 0))
    assert some == none and {x[3] for x in some if x[1].startswith("x")} == {""}
    for head in (5, 30, 400):
        assert {r.id for r in survivors.cut_copies(survivors.text_worth(w), head).filter("complete").collect()} == {"a", "c"}


def test_golden_records(spark):
    schema = MEMBERS + ", priority int, sex string"
    rows = [(1, "a", "Rex", None, None, T0, 1, "male"), (1, "b", "REX", None, ["https://h/q-1.jpg"], T0 + timedelta(1), 3, " "), (1, "c", None, None, None, T0 + timedelta(2), None, "female"), (2, "d", "Solo", None, None, T0, 1, "male"), (None, "e", None, None, None, None, None, None)]
    got = [r.asDict() for r in survivors.golden_records(spark.createDataFrame(rows, schema), ["name", "sex"]).collect()]
    assert got == [{"gid": 1, "members": 3, "text": None, "text_id": None, "urls": ["https://h/q-1.jpg"], "urls_id": "b", "name": "REX", "name_id": "b", "sex": "male", "sex_id": "a"}]


NAMES = [(1, "Labrador Retriever", ["Lab"]), (2, "Golden Retriever", []), (3, "Pit Bull", []), (4, "Fox Terrier", []), (5, "Boston Terrier", ["Boston"]), (6, "Standard Poodle", []), (None, "Nothing", []), (7, None, ["Nobody"]), (8, " ", None)]
VALUES = {
    "Retriever, Golden mix": {2},
    "Labr. Retr. / Pit Bull": {1, 3},
    "g0ldén retreiver": {2},
    "Terrier, Fox / Boston": {4, 5},
    "Lab x ???": {1, 0},
    "Poodle (Standard) (Medium)": {6},
    "Purebred": {0},
    "": {0},
    "  ": {0},
    "Lurcher": {0},
    "labrador_retriever & lab": {1},
    "pit bull lab": {1, 3},
    "z" * 50_000: {0},
    "ab " * 5_000: {0},
}


def mapped(spark, rows, shard_names, refs=NAMES):
    df = spark.createDataFrame(rows, "id string, gid bigint, raw string, told string, field string")
    names = vocabulary.reference_names(spark.createDataFrame(refs, "ref_id bigint, name string, more array<string>"), "breed", "ref_id", "name", "more")
    found, learnt = vocabulary.map_values(df, {"breed": "raw"}, names, {"breed": "told"}, shard_names)
    return found.collect(), {(r.name, r.ref_id) for r in learnt.collect()}


@pytest.mark.parametrize("shard_names", [1000, 2])
def test_vocabulary(spark, shard_names):
    rows = [(f"v{i}", None, v, None, "x") for i, v in enumerate(VALUES)] + [("n", None, None, "Lab", "x"), (None, None, "Lab", None, "x")]
    found, learnt = mapped(spark, rows, shard_names)
    got = {}
    for r in found:
        got.setdefault(r.id, set()).add(r.ref_id)
    assert got == {f"v{i}": want for i, want in enumerate(VALUES.values())} and learnt == set()


def test_names_are_learnt_from_the_group_and_the_recorded_name(spark):
    rows = [(f"a{i}", i, "Goldie", None, "x") for i in range(4)] + [(f"b{i}", i, "golden retriever", None, "x") for i in range(4)]
    # one group with many rows is one vote; votes that differ teach nothing
    rows += [(f"c{i}", 50, "Lurcher", None, "x") for i in range(40)] + [("d", 50, "Lab", None, "x")]
    rows += [(f"e{i}", 60 + i, "Mystery", n, "x") for i, n in enumerate(["Lab", "Pit Bull", "Fox Terrier", "Lab"])]
    rows += [(f"f{i}", None, "Poody", "Standard  poodle", "x") for i in range(3)] + [("g", None, "Godlie / Pit Bull", None, "x")]
    found, learnt = mapped(spark, rows, 3)
    assert learnt == {("goldie", 2), ("poody", 6)}
    by = {}
    for r in found:
        by.setdefault(r.id, set()).add(r.ref_id)
    assert by["a0"] == {2} and by["f1"] == {6} and by["c7"] == {0} and by["e0"] == {0} and by["g"] == {2, 3}


def test_vocabulary_of_nothing(spark):
    assert mapped(spark, [], 10) == ([], set())
    assert [r.ref_id for r in mapped(spark, [("a", 1, "Lab", None, "x")], 10, [])[0]] == [0]


def test_recall_of_misspelt_names_is_whole_within_the_allowed_errors(spark):
    rng = random.Random(12)
    refs = [(i, "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(8, 12))), []) for i in range(1, 120)]
    rows, want = [], {}
    for i in range(400):
        ref_id, name, _ = rng.choice(refs)
        k = rng.randrange(1, len(name) - 2)
        bad = rng.choice([name[:k] + name[k + 1 :], name[:k] + rng.choice("nopq") + name[k:], name[:k] + name[k + 1] + name[k] + name[k + 2 :]])
        near = [n for _, n, _ in refs if vocabulary.damerau(bad, n) <= vocabulary.damerau(bad, name)]
        if near == [name]:
            want[f"r{i}"] = ref_id
            rows.append((f"r{i}", None, bad, None, "x"))
    found, _ = mapped(spark, rows, 30, refs)
    assert len(want) > 300 and {r.id: r.ref_id for r in found} == want


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distances(a, b):
    lev = int(vocabulary.levenshtein_many(a, *vocabulary.encode([b]))[0])
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert lev == d[-1][-1]
    assert vocabulary.damerau(a, b) <= lev <= 2 * vocabulary.damerau(a, b)


def test_tree_finds_all():
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(4, 12))) for _ in range(200)]
    queries = [n[:2] + rng.choice("abcdef") + n[3:] for n in names[:60]]
    got = set(vocabulary.BKTree(names).search(queries, np.full(len(queries), 3)))
    order = list(dict.fromkeys(names))
    want = {(q, k, int(vocabulary.levenshtein_many(w, *vocabulary.encode([queries[q]]))[0])) for q in range(len(queries)) for k, w in enumerate(order)}
    assert got == {x for x in want if x[2] <= 3}


def test_packing(spark):
    rng = random.Random(6)
    items = [(i, 0, rng.randrange(1, 100), rng.choice(["a", "b", None, "hot"]), rng.choice([1, 1, None, i])) for i in range(600)] + [(9999, 0, 100, "a", None), (9998, 0, 0, "a", None), (9997, 0, None, "a", None)]
    df = spark.createDataFrame(items, "doc_id bigint, part_no int, size int, source string, cluster bigint")
    got = packing.pack(df, 100, [("a", "b")], 2, shard_items=200).collect()
    by = {i[0]: i for i in items}
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, s, _, _ in items if s)
    bins = {}
    for r in got:
        bins.setdefault(r.container, []).append(by[r.doc_id])
    for members in bins.values():
        assert sum(m[2] for m in members) <= 100
        copies = [m[4] for m in members if m[4] is not None]
        assert len(copies) == len(set(copies)) and not {"a", "b"} <= {m[3] for m in members} and len({m[3] for m in members}) <= 2
    assert packing.pack(df.limit(0), 100).count() == 0


def test_copies_of_one_text_are_packed_in_time():
    items = [(i, 1 + i % 50, 0, 0) for i in range(20_000)]
    assert len(packing.best_fit(items, 100, {})) == 20_000


def test_split_long(spark):
    df = spark.createDataFrame([(1, 250), (2, 100), (3, 0)], "doc_id bigint, tokens bigint")
    assert sorted((r.doc_id, r.part_no, r.from_token, r["size"]) for r in packing.split_long(df, 100).collect()) == [(1, 0, 0, 100), (1, 1, 100, 100), (1, 2, 200, 50), (2, 0, 0, 100)]


def test_exponents():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    alpha = mixing.exponent_for_entropy(shares, 1.0)
    assert mixing.entropy(mixing.tempered(shares, alpha)) == pytest.approx(1.0, abs=1e-6)
    tokens, reps, nat, want = {"a": 700, "b": 300}, {"a": 1, "b": 2}, {"a": 0.7, "b": 0.3}, {"a": 0.2, "b": 0.8}
    x = mixing.exponent_for_total(nat, want, tokens, reps, 900)
    assert 0 < x < 1 and mixing.most_tokens(mixing.blended(nat, want, x), tokens, reps) == pytest.approx(900, rel=1e-3)


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, s, rng.randrange(5, 40)) for i, s in enumerate(["big"] * 900 + ["small"] * 60 + ["none"] * 10)] + [(5000, None, 9), (5001, "big", 0)]
    t = [("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 2), (None, 0.1, 1)]
    docs = mixing.countable(spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"))
    sel, rep = mixing.mix(docs, spark.createDataFrame(t, "source string, target_share double, max_repeats int"))
    rows, report = sel.collect(), {r.source: r for r in rep.collect()}
    assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"}
    assert report["small"].repeats == 3 and report["big"].actual_share == pytest.approx(0.5, abs=0.01) and report["absent"].selected == 0


def test_mixes_by_temperature_keep_limits_and_order(spark):
    rng = random.Random(9)
    docs = mixing.countable(spark.createDataFrame([(i, s, rng.randrange(5, 40)) for i, s in enumerate(["a"] * 2000 + ["b"] * 300 + ["c"] * 80)], "doc_id bigint, source string, tokens bigint"))
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.3, 3), ("c", 0.5, 4)], "source string, target_share double, max_repeats int")
    size = docs.groupBy().sum("tokens").first()[0]
    for how in ({}, {"target_entropy": 1.0}, {"total": float(size)}, {"total": 10.0 * size}):
        sel, rep = mixing.mix(docs, targets, block_records=100, **how)
        rows, report = sel.collect(), rep.collect()
        assert all(r.repeats <= r.max_repeats and abs(r.actual_share - r.weight) < 0.005 for r in report)
        assert len({r.exponent for r in report}) == 1 and (not how) == (report[0].exponent == 1.0)
        assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows)
        blocks = {}
        for r in rows:
            blocks.setdefault((r.source, r.pass_no, r.block), []).append(r.place)
        assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) < 300 for p in blocks.values()) and len(blocks) > 5
    assert abs(mixing.entropy({r.source: r.weight for r in mixing.mix(docs, targets, target_entropy=1.0)[1].collect()}) - 1.0) < 1e-6


def test_personal_information(spark):
    rng = random.Random(8)
    firsts, lasts = "Anna Boris Clara Dmitri Elsa Farid Greta Hugo".split(), "Ulmholt Stenmar Drainko Quarescu Brinlund Kortveld Mezwright Pellanza".split()
    docs, want = [], set()
    for i in range(160):
        f, la = rng.choice(firsts), rng.choice(lasts)
        text = f"Rex likes to swim near Maple Avenue. Landlord {f} {la} confirmed by email from {f.lower()}.{la.lower()}@example.net. Invoice 4861-7239 covers it."
        want |= {(i, "name", text.index(f"{f} {la}")), (i, "email", text.index(f"{f.lower()}."))}
        docs.append((i, text))
    docs += [(500, "Signed, Zara Ulmholt. Call (805) 555-0128 or +1 657 555 0192."), (501, None), (502, ""), (503, "Home check done at 3615A Pebblecross St, Tarnbend. Verified SSN 917-30-0771 at the desk."), (504, "x " * 60_000)]
    want |= {(500, "phone", docs[160][1].index("805")), (500, "phone", docs[160][1].index("1 657")), (500, "name", docs[160][1].index("Zara")), (503, "address", docs[163][1].index("3615A")), (503, "id_number", docs[163][1].index("917"))}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = personal.personal_information(df)
    assert {(r.doc_id, r.kind, r.start_pos) for r in found.collect()} == want
    red = {r.doc_id: r.text for r in personal.redact(df, found).collect()}
    assert red[503] == "Home check done at [ADDRESS], Tarnbend. Verified SSN [ID_NUMBER] at the desk." and red[504] == docs[164][1] and red[501] is None
    assert personal.personal_information(df.limit(0)).count() == 0


def test_pieces_join_to_the_text():
    from kennelflow.llm.tokens import pieces

    text = "word  " * 20_000 + "y" * 50_000
    assert "".join(pieces(text)) == text and "y" * 50_000 in pieces(text)[-1]


def test_pieces_keep_the_count(spark):
    from kennelflow.llm import tokens

    if not os.path.exists(tokens.TOKENIZER):
        pytest.skip("no tokenizer file")
    rng = random.Random(4)
    texts = ["".join(rng.choice(["Rex ", "runs\n", "  ", "x" * 30_000, "año", ". "]) for _ in range(300)) for _ in range(4)]
    whole = [len(tokens.encoder(tokens.TOKENIZER).encode(t, add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None), (10, "")], "i int, text string")
    assert [r.tokens for r in tokens.count_tokens(df, ["i"]).orderBy("i").collect()] == [*whole, 0, 0]


def test_plan_of_nothing():
    p = mixing.plan(pd.DataFrame({"source": [], "tokens": []}), pd.DataFrame({"source": ["a"], "target_share": [1.0], "max_repeats": [1]}))
    assert list(p.budget) == [0]
