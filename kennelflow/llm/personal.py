"""Personal information inside free text: found, typed and replaced by placeholders.

Bootstrapped contextual extraction. One reading of the texts gives candidates of every kind, each with the
features that stand for it in the pattern-instance graph:

* names: word pairs, titled and turned forms, with the words to the left and right, the first and the family name;
* identity numbers and phone numbers: digit groups with their label and their shape;
* addresses and emails: forms of a house number and capital words, or with an at-sign, with the words beside them.

Seeds are what has a form of its own: emails, phone numbers and addresses that a grammar reads, identity numbers of
a few well-known shapes, and names whose family name occurs in email addresses. Seeds induce patterns: in every round a
feature is as good as the candidates that have it, beyond what is usual in its kind, and a candidate as its features
together. Good features then discover values that no seed named, in any letter case, among them phone numbers,
addresses and emails that the grammar doesn't know.

A feature's share is drawn to the usual one by ``PRIOR`` candidates' worth, so that what is seen once says little in a
corpus of any size; there is no other threshold on counts. A candidate's own part is taken out of what its features
say. Copies of a name in the same words count once. All counts run over all documents; texts are read whole.
Positions are in code points of the text as stored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kennelflow.io import cut_lineage, release

ROUNDS = 6
#: Candidates of the usual share that each feature is taken to have besides its own.
PRIOR = 0.5
#: Greatest evidence (log odds) of one feature; that of a seed in all rounds but the last two.
MOST, SEED = 4.0, 0.9
#: Share of seeds that is taken to be usual at most: where nearly all candidates are seeds, the others are none for that.
MOST_USUAL = 0.3
#: Probability from which a candidate counts: of names and identity numbers, and of what only patterns name.
GOOD, SURE = 0.5, 0.9
#: Evidence of a feature that stands on its own, and of a family name that can't be one.
CLEAR, AGAINST = 1.0, -1.0
#: Slots of the map of family names that is sent to the workers. It only spares texts that surely hold none of them in
#: lower case; the names themselves, as many as there are, are joined.
SLOTS = 1 << 20
_BUCKET = 1 << 15  # bits in one bitmap of bitmap_construct_agg

_AT, _DOT = r"(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{at\}\s?)", r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)"
EMAIL = re.compile(
    rf"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*(?:(?:\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)[\w+%-]+)*(?:{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z][\w-]*)+|\sat\s[A-Za-z0-9][\w-]*(?:(?:\s?\(dot\)\s?|\s?\[dot\]\s?|\sdot\s)[A-Za-z][\w-]*)+)",
    re.I,
)
# Whatever has an address has one of these.
_EMAIL_SIGNS = ("@", "(at)", "[at]", "{at}", "dot")
_S = r"[\s. /‐–—-]{0,3}"
PHONE = re.compile(
    rf"(?<![\w/@#.-])(?:\+?1{_S})?\(?[2-9]\d\d\)?{_S}[2-9]\d\d{_S}\d{{4}}(?![\w@])(?![-./]\d)"
    r"|(?<![\w@#])(?:\+?1\s+)?\(?[2-9] \d \d\)?\s*[-–—/.]?\s*[2-9] \d \d\s*[-–—/.]?\s*\d \d \d \d(?!\w)"
    r"|(?<![\w@#./-])0[1-9]\d{2,3}[\s.-]?\d{3}[\s.-]?\d{3,4}(?!\w)"
    r"|(?<![\w@#])(?:\+|00)[1-9]\d{0,2}[\s. -]{0,2}(?:\(0\)[\s. -]?)?\d(?:[\s. ()/–-]{0,2}\d){6,11}(?!\w)"
)
_PHONE_PREFIXED = re.compile(rf"(?<=/ )(?:\+?1{_S})?\(?[2-9]\d\d\)?{_S}[2-9]\d\d{_S}\d{{4}}(?![\w@])")
# Kinds of street.
_STREET = "st street rd road ave avenue av ln lane blvd boulevard dr drive ct court pl place way cir circle ter terrace pkwy parkway hwy highway sq square row loop trl".split()
_NOT_STREET = "dogs? cats? miles? cups? minutes? hours? days? weeks? months? years? lbs? kg mg the a an of to in on at and or for with down up by from is was are times? more other good great long best".split()
ADDRESS = re.compile(
    rf"(?<![\w#/.,:-])(?<!\d )\d{{1,6}}(?:\s?-?\s?[A-Z](?![\w.]))?(?:\s1/2|\s?½)?\s+(?:[NSEW]\.?\s+|(?:north|south|east|west)\s+)?(?:(?!(?:{'|'.join(_NOT_STREET)})\b)(?:[A-Z][\w'’]*|\d+(?:st|nd|rd|th))\s+){{1,3}}(?:{'|'.join(_STREET)})\b"
    r"|(?<![\w/.-])\d{1,5}(?:\s?(?:bis|ter|quater)\b)?\s?,?\s+(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|all[ée]e|impasse|quai|route|cours)\s+(?:(?:de la|de l['’]|des|du|de|d['’]|la|le|les)\s*)?[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*){0,3}"
    r"|(?<!\w)(?:C/(?!o\b)|Calle|Camino|Avda\.?|Av\.|Avenida|Plaza|Paseo|Carretera|Ronda)\s*(?:(?:de las|de los|de la|del|de|la|el|los|las)\s+)?[A-Z][\w'’-]*(?:\s[A-Z][\w'’-]*){0,3},?\s+(?:n[.º°o]*\s*)?\d{1,4}\b"
    r"|(?<!\w)(?:P\.?\s?O\.?\s?Box|Apartado(?: de correos)?|B\.?P\.?)\s+\d{1,6}\b",
    re.I,
)
NUMBER = re.compile(r"(?<![\w/.+-])(?:[A-Z]{1,2}(?=\d)|[A-Z]{2} (?=\d\d \d\d \d\d))?\d(?:[ -]?\d){5,14}(?:[ -]?[A-Z])?(?![\w/])(?!-\d)")
# Shapes of well-known identity numbers (US, Spain, Britain).
SEED_SHAPES = ("999-99-9999", "99999999A", "A9999999A", "AA999999A")
_TITLE = re.compile(r"(?<!\w)(?:mr|mrs|ms|mx|miss|dr|sra?|srta|mme|mlle|prof|don|doña|señora?|monsieur|madame)\.?\s+$", re.I)
# Words that make a name that of an organisation.
_ORG = set("foundation group clinic services service supply county veterinary animal pet rescue society hospital shelter center centre inc llc ltd co company league haven association club department control humane fund trust store school church council partners".split())
_CAPITAL = re.compile(r"(?<!\w)[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|['’](?=[^\W\d_]))*(?:-[^\W\d_]+(?:['’][^\W\d_]+)?)*")
_TOKEN = re.compile(r"(?<!\w)[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*(?:-[^\W\d_]+(?:['’][^\W\d_]+)?)*")
_PARTICLE = set("de da do dos van von der den la le di del della el al bin ibn y st san".split())
_STOP = set("the a an and or of to in on at for with from by is was are be i we you he she it they this that these those my our your his her its no not but if then so as please ask call contact signed applicant adopter landlord name family el la los las un una y de del le les des du et".split())
_LOCAL_STOP = set("dogs info adopt adoption adoptions foster contact hello office mail rescue shelter help team admin test example".split())


_GAP = re.compile(r"(\.?)([^\S\n]{1,3})(?!\s)")
_COMMA = re.compile(r", ?(?!\s)")
_BREAK = re.compile(r"[\n/;,()<>.!?]")
_NEXT = re.compile(r"\s+([^\W\d_]+)")
_SMALL = re.compile(r"[a-zß-öø-ÿ]+")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_BEFORE = re.compile(_TOKEN.pattern.replace("(?<!\\w)", "(?<!\\w)(", 1) + r")\s+$")
# What may be an address or an email although the grammar doesn't know it.
_LOOSE_ADDRESS = re.compile(r"(?<![\w#/.,:-])\d{1,6}[A-Z]?[^\S\n](?:[A-Z][\w'’]*[^\S\n]){1,2}([A-Z][\w'’]+)")
_LOOSE_EMAIL = re.compile(r"(?<![\w.@])[A-Za-z0-9][\w.+-]*\s?@\s?[A-Za-z][\w-]*(?:\s?\.\s?[\w-]+)*")


class Taken:
    """Disjoint spans in order; ``free`` tells whether a span touches none of them."""

    def __init__(self, spans: list[tuple] = ()) -> None:
        self.spans: list[tuple[int, int]] = sorted((s[0], s[1]) for s in spans)

    def free(self, i: int, j: int) -> bool:
        if not self.spans:
            return True
        k = bisect_left(self.spans, (i, i))
        return (k == len(self.spans) or self.spans[k][0] >= j) and (k == 0 or self.spans[k - 1][1] <= i)

    def add(self, i: int, j: int) -> None:
        insort(self.spans, (i, j))


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of emails, phone numbers and addresses; of overlapping ones the first kind counts."""
    out: list[tuple[int, int, str]] = []
    taken = Taken()
    low = text.lower()
    rules = [("email", EMAIL)] if any(x in low for x in _EMAIL_SIGNS) else []
    digits = sum(map(text.count, "0123456789"))
    if digits:
        rules.append(("address", ADDRESS))
    if digits >= 7:
        rules += [("phone", PHONE), ("phone", _PHONE_PREFIXED)]
    for kind, rx in rules:
        for m in rx.finditer(text):
            i, j = m.span()
            while i < j and not text[i].isalnum():
                i += 1
            if taken.free(i, j):
                taken.add(i, j)
                out.append((i, j, kind))
    return out


def _words_before(text: str, i: int, n: int) -> str:
    """The last n words before i within its line, digits as 9; '^' where a line or text begins."""
    seg = re.split(r"[\n>]", text[max(0, i - 60) : i])[-1]
    w = re.findall(r"[^\W_]+|[.!?:,;(/]", seg)
    got = [re.sub(r"\d+", "9", x.lower()) for x in w[-n:]]
    if got and got[-1] in ".!?":
        got = ["^"]
    return " ".join(got) or "^"


def _words_after(text: str, j: int, n: int) -> str:
    seg = re.split(r"[\n<]", text[j : j + 60])[0]
    w = re.findall(r"[^\W_]+|[.!?:,;(/@]", seg)
    return " ".join(re.sub(r"\d+", "9", x.lower()) for x in w[:n]) or "$"


def label(text: str, i: int) -> str:
    """The words that label a number: the last two since a break, full stops after short words are none."""
    seg = re.split(r"[\n/;,()<>]|(?<=[a-z]{3})[.!?]\s", text[max(0, i - 60) : i])[-1]
    w = [x.lower() for x in re.findall(r"[^\W\d_]+", seg)]
    return " ".join(w[-2:]) or "^"


def shape(s: str) -> str:
    s = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", s))
    return re.sub(r"\s+", " ", s)


def numbers(text: str, taken: Taken) -> list[tuple[int, int, str, str]]:
    """(start, end, label, shape) of digit groups outside the spans found by grammar."""
    return [(m.start(), m.end(), label(text, m.start()), shape(m[0])) for m in NUMBER.finditer(text) if taken.free(*m.span())]


def _following(text: str, j: int, taken: Taken) -> tuple[str, re.Match] | None:
    """The word after one to three blanks on the line, perhaps after a full stop, with what lies between."""
    if g := _GAP.match(text, j):
        t = _TOKEN.match(text, g.end())
        if t and taken.free(*t.span()):
            return g[0], t
    return None


def _organisation(text: str, j: int) -> bool:
    m = _NEXT.match(text, j)
    return bool(m) and m[1][:1].isupper() and m[1].lower() in _ORG


def name_candidates(text: str, taken: Taken) -> list[tuple[int, int, str, str, str]]:
    """(start, end, form, first, family name) of capital words that could be a person's name.

    Forms: ``pair`` (first or initial, last), ``title`` (title, last) and ``turned`` (last, first). Words touching a span are no candidates.
    """
    out = []
    some = bool(taken.spans)
    for m in _CAPITAL.finditer(text):
        i, j = m.span()
        w = m[0]
        if some and not taken.free(i, j):
            continue
        if j - i > 2 and text[i - 1 : i].isspace() and _TITLE.search(text, max(0, i - 24), i) and not _organisation(text, j):
            out.append((i, j, "title", "", family(w)))
        if nxt := _following(text, j, taken):
            # first or initial; a middle initial and particles may stand before the last name
            gap, t = nxt
            if len(w) > 1 and gap.startswith("."):
                continue
            if len(w) > 1 and len(t[0]) == 1 and t[0].isupper() and (more := _following(text, t.end(), taken)):
                t = more[1]
            while t[0] in _PARTICLE and (more := _following(text, t.end(), taken)) and more[0] in (" ", "  "):
                t = more[1]
            last = t[0]
            capital = last[0].isupper() or ("-" in last and last.split("-")[-1][:1].isupper())
            fits = w.lower() not in _STOP if len(w) > 1 else gap.startswith(".")
            if capital and len(last) > 2 and fits and last.lower() not in _ORG and not _organisation(text, t.end()):
                out.append((i, t.end(), "pair", w.lower() if len(w) > 1 else "", family(last)))
        elif (c := _COMMA.match(text, j)) and len(w) > 2:
            t = _TOKEN.match(text, c.end())
            if t and len(t[0]) > 2 and t[0][0].isupper() and not {w.lower(), t[0].lower()} & _STOP and taken.free(*t.span()):
                out.append((i, t.end(), "turned", t[0].lower(), family(w)))
    return out


class FamilyNames(dict):
    """Whether a written word may end in a known family name in lower case, from the map of slots; kept by word."""

    def __init__(self, slots: bytes) -> None:
        self.slots = slots

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        bare = _EDGES.sub("", word)
        self[word] = known = len(bare) > 3 and bare.islower() and self.holds(family(bare))
        return known

    def holds(self, name: str) -> bool:
        k = crc32(name.encode()) % SLOTS
        return bool(self.slots[k >> 3] & 1 << (k & 7))


def lower_candidates(text: str, names: FamilyNames) -> list[tuple[int, int, str, str, str]]:
    """As ``name_candidates``: pairs of words in lower case of which the second may be a known family name."""
    out = []
    for w in {_EDGES.sub("", x) for x in text.split() if names[x]}:
        j = text.find(w)
        while j >= 0:
            m = _BEFORE.search(text, max(0, j - 60), j)
            if m and m[1].islower() and m[1] not in _STOP and not text[j + len(w) : j + len(w) + 1].isalnum():
                out.append((m.start(1), j + len(w), "lower", m[1], family(w)))
            j = text.find(w, j + len(w))
    return out


def family(word: str) -> str:
    """The part of a family name that is scored: the last of a double name, without a prefix (O', al-)."""
    return re.split(r"[-'’]", word)[-1].lower() or word.lower()


def cased(text: str) -> bool:
    """Written in both cases, so that capitals tell something."""
    return len(_SMALL.sub("", text)) < len(text) - len(text) // 2 or sum(map(str.islower, text)) > sum(map(str.isupper, text))


def email_words(address: str) -> set[str]:
    local = re.split(r"@|\(at\)|\[at\]|\sat\s", address, maxsplit=1)[0]
    return {w.lower() for w in re.findall(r"[^\W\d_]{4,}", re.sub(r"\(dot\)|\[dot\]|\sdot\s", ".", local)) if w.lower() not in _LOCAL_STOP}


def _features(text: str, i: int, j: int) -> tuple[str, str]:
    return _words_before(text, i, 2), _words_after(text, j, 2)


def candidates_of(text: str) -> list[tuple]:
    """(graph, form, start, end, learns, feature, feature, feature, feature) of one text; feature None is not there.

    ``learns`` is false for what is only judged: names turned round or in a text without small letters.
    """
    found = spans(text)
    taken = Taken(found)
    out: list[tuple] = []
    for i, j, kind in found:
        if kind == "phone":
            at = i
            while at and text[at - 1] in "(+":
                at -= 1
            out.append(("phone", "seed", i, j, True, label(text, at), shape(text[i:j]), None, None))
        else:
            out.append((kind, "seed", i, j, True, *_features(text, i, j), text[i:j].rsplit(None, 1)[-1].lower() if kind == "address" else None, None))
            if kind == "email":
                out += [("word", "", 0, 0, False, w, None, None, None) for w in email_words(text[i:j])]
    labelled = []
    for i, j, lab, sh in numbers(text, taken):
        labelled.append((i, set(lab.split())))
        out.append(("id_number", "seed" if sh in SEED_SHAPES else "", i, j, True, lab, sh, None, None))
        out.append(("phone", "", i, j, True, lab, sh, None, None))
    if "@" in text:
        out += [("email", "", *m.span(), True, *_features(text, *m.span()), None, None) for m in _LOOSE_EMAIL.finditer(text) if taken.free(*m.span())]
    mixed = cased(text)
    if mixed:
        out += [("address", "", *m.span(), True, *_features(text, *m.span()), m[1].lower(), None) for m in _LOOSE_ADDRESS.finditer(text) if taken.free(*m.span())]
    at = 0
    for i, j, form, first, last in name_candidates(text, taken):
        while at < len(labelled) and labelled[at][0] < j:
            at += 1
        # the label of a number is no name
        if at < len(labelled) and last in labelled[at][1] and not _BREAK.search(text[j : labelled[at][0]]):
            continue
        left, right = _features(text, i, j)
        out.append(("name", form if mixed else f"{form} caps", i, j, mixed and form != "turned", left, right, first or None, last))
    return out


_FEATURES = ("f0", "f1", "f2", "f3")
_CANDIDATE = ["doc_id", "graph", "form", "start_pos", "end_pos", "learns", *_FEATURES]


def _schema(docs: DataFrame):
    kinds = {"graph": "string", "form": "string", "start_pos": "bigint", "end_pos": "bigint", "learns": "boolean", **{f: "string" for f in _FEATURES}}
    return docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema


def candidates(docs: DataFrame) -> DataFrame:
    """One reading of doc_id, text: all candidates with their features, and the words of email addresses (graph ``word``)."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame([(doc, *c) for doc, text in zip(b.doc_id, b.text) for c in candidates_of(text)], columns=_CANDIDATE)

    return docs.mapInPandas(read, _schema(docs))


def _hashes(df: DataFrame) -> DataFrame:
    """Features as 64-bit numbers; two that fall together would only share what is known of them."""
    at = [F.when(F.col(f).isNotNull(), F.xxhash64("graph", F.lit(k), f)).alias(f"h{k}") for k, f in enumerate(_FEATURES)]
    return df.select("*", *at)


_NODES = tuple(f"h{k}" for k in range(len(_FEATURES)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judge(tuples: DataFrame, nodes: DataFrame, seed: float | None, least: float = -MOST) -> DataFrame:
    """Probability ``o`` of each tuple and the evidence ``e0`` .. ``e3`` of its features, given the node sums.

    ``nodes``: h, pos, graph, s (sum of probabilities), n. A tuple that learns is left out of its own nodes. Those
    marked ``seed`` have at least ``seed`` (None: what their features say). ``least`` bounds the evidence against: in the
    first round there is none, since what no seed has need not be wrong. The nodes of a feature that a large part
    of all tuples have are one row; the tuples' side of the join may be split.
    """
    usual = nodes.filter("pos = 0").groupBy("graph").agg((F.sum("s") / F.sum("n")).alias("pi"))
    # one row a kind
    t = tuples.join(F.broadcast(usual), "graph", "left").withColumn("pi", F.least(F.greatest(F.coalesce("pi", F.lit(0.0)), F.lit(1e-6)), F.lit(MOST_USUAL)))
    own_s, own_n = F.when(F.col("learns"), F.col("o")).otherwise(0.0), F.col("learns").cast("double")
    for k, h in enumerate(_NODES):
        one = nodes.filter(F.col("pos") == k).select(F.col("h").alias(h), F.col("s").alias("_s"), F.col("n").alias("_n"))
        p = (F.greatest(F.coalesce("_s", F.lit(0.0)) - own_s, F.lit(0.0)) + PRIOR * F.col("pi")) / (F.greatest(F.coalesce("_n", F.lit(0.0)) - own_n, F.lit(0.0)) + PRIOR)
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        e = F.least(F.greatest(_logit(p) - _logit(F.col("pi")), F.lit(least)), F.lit(MOST))
        t = t.join(one, h, "left").withColumn(f"e{k}", F.when(F.col(h).isNull(), 0.0).otherwise(e)).drop("_s", "_n")
    total = _logit(F.col("pi"))
    for k in range(len(_NODES)):
        total = total + F.col(f"e{k}")
    o = 1 / (1 + F.exp(-total))
    return t.withColumn("o", o if seed is None else F.when(F.col("seed"), F.greatest(o, F.lit(seed))).otherwise(o)).drop("pi")


def node_sums(tuples: DataFrame) -> DataFrame:
    """graph, pos, h, s, n over the tuples that learn, with partial sums before the exchange."""
    each = tuples.filter("learns").select("graph", "weight", "o", F.posexplode(F.array(*_NODES)).alias("pos", "h")).filter("h is not null")
    return each.groupBy("graph", "pos", "h").agg(F.sum(F.col("weight") * F.col("o")).alias("s"), F.sum("weight").alias("n"))


def bootstrap(tuples: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """tuples: graph, h0 .. h3, learns, weight, seed -> the same with o, e0 .. e3, and the node sums of the last round."""
    base = tuples.columns
    t = tuples.withColumn("o", F.when(F.col("seed"), SEED).otherwise(0.0))
    nodes = None
    for k in range(rounds):
        last = k == rounds - 1
        old, nodes = nodes, cut_lineage(node_sums(t))
        done = t
        t = cut_lineage(judge(t, nodes, SEED if k < rounds - 2 else None, -MOST if k else 0.0).select(*base, "o", *([f"e{i}" for i in range(len(_NODES))] if last else [])))
        if k:
            release(done, old)
    return t, nodes


def _slots(names: DataFrame) -> bytes:
    """The map of the slots of names (column ``name``): SLOTS bits, whatever their number."""
    slot = F.crc32(F.col("name").cast("binary")) % SLOTS
    rows = names.select(slot.alias("s")).groupBy(F.floor(F.col("s") / _BUCKET).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("s") % _BUCKET).alias("bits"))
    out = bytearray(SLOTS // 8)
    for r in rows.collect():  # SLOTS / _BUCKET rows at most
        out[r.b * _BUCKET // 8 : r.b * _BUCKET // 8 + len(r.bits)] = r.bits
    return bytes(out)


def _accepted() -> Column:
    """Which judged candidates count."""
    o, left, right, first, last = (F.col(c) for c in ("o", "e0", "e1", "e2", "e3"))
    form = F.col("form")
    clear = lambda c: c >= CLEAR
    known = clear(last) & ((first >= CLEAR / 2) | F.col("f2").isNull())
    name = (
        F.when(form.endswith(" caps"), known)
        .when(form == "turned", (first > AGAINST) & clear(last))
        .when((form == "pair") & F.col("f2").isNull(), (last >= CLEAR / 2) | ((last > -CLEAR / 4) & clear(left) & clear(right)))
        .when(form == "lower", clear(last) & (clear(first) | (clear(left) & clear(right))))
        .otherwise(last > AGAINST)
    )
    return (
        F.when(form == "seed", (F.col("graph") != "id_number") | (o >= GOOD) | ((left > AGAINST) & (right > AGAINST)))
        .when(F.col("graph") == "name", (o >= GOOD) & name)
        .when(F.col("graph") == "id_number", o >= GOOD)
        .when(F.col("graph") == "address", (o >= SURE) & clear(F.col("e2")) & (clear(left) | clear(right)))
        .otherwise((o >= SURE) & (left >= CLEAR))
    )


def _chosen(accepted: DataFrame) -> DataFrame:
    """doc_id, graph, start_pos, end_pos, f3: of overlapping values of a document the one of the better order, then the first, counts."""
    form = F.regexp_replace("form", " caps$", "")
    order = F.when(form == "seed", 0).when(F.col("graph") == "id_number", 1).when((form == "pair") & (F.col("e3") > -CLEAR / 4), 2).when(form == "lower", 3).when(form == "title", 4).when(form == "turned", 5).otherwise(6)
    # a document's values are bounded by its length
    per_doc = accepted.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(order.alias("order"), "start_pos", "end_pos", "graph", "f3"))).alias("found"))

    def choose(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for doc, found in zip(b.doc_id, b.found):
                taken = Taken()
                for x in found:
                    if taken.free(x["start_pos"], x["end_pos"]):
                        taken.add(x["start_pos"], x["end_pos"])
                        out.append((doc, x["graph"], x["start_pos"], x["end_pos"], x["f3"]))
            yield pd.DataFrame(out, columns=["doc_id", "graph", "start_pos", "end_pos", "f3"])

    return per_doc.mapInPandas(choose, accepted.select("doc_id", "graph", "start_pos", "end_pos", "f3").schema)


def personal_information(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, kind, start_pos, end_pos; one row per value, none inside another.

    Null and empty texts hold nothing. Repeated documents give their rows once per doc_id. Extra columns are
    ignored. An empty table gives no rows.
    """
    docs = docs.filter("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    cand = cut_lineage(_hashes(candidates(docs)))
    words = cand.filter("graph = 'word'").select(F.col("f0").alias("w")).distinct()
    key = ["graph", "learns", *_NODES]
    # a family name that occurs in email addresses, alone or after the initial, makes a seed; first names don't, dogs have them as well
    t = cand.filter("graph <> 'word'").groupBy(*key).agg(F.count("*").cast("double").alias("n"), F.max(F.col("form") == "seed").alias("formed"), F.first("f3").alias("f3"), F.first(F.concat(F.substring("f2", 1, 1), "f3")).alias("short"))
    t = t.join(words.select(F.col("w").alias("f3"), F.lit(True).alias("by_last")), "f3", "left")
    t = t.join(words.select(F.col("w").alias("short"), F.lit(True).alias("by_short")), "short", "left")
    named = (F.col("graph") == "name") & F.col("learns") & F.coalesce("by_last", "by_short", F.lit(False))
    # copies of a name in the same words count once
    t = cut_lineage(t.select(*key, F.when(F.col("graph") == "name", 1.0).otherwise(F.col("n")).alias("weight"), (named | F.col("formed")).alias("seed")))
    scored, nodes = bootstrap(t)
    on = [cand[c].eqNullSafe(scored[c]) for c in key]
    judged = cand.join(scored.select(*key, "o", *[f"e{k}" for k in range(len(_NODES))]), on).select(cand["*"], "o", *[f"e{k}" for k in range(len(_NODES))])

    # second reading, of texts with a known family name in lower case only
    accepted = cut_lineage(judged.filter(_accepted()).select("doc_id", "graph", "form", "start_pos", "end_pos", "f3", "e3"))
    known = _chosen(accepted).filter("graph = 'name'").select(F.col("f3").alias("name")).distinct()
    slots = _slots(known)

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = FamilyNames(slots)
        for b in it:
            out = []
            for doc, text in zip(b.doc_id, b.text):
                if any(map(names.__getitem__, text.split())) and (found := lower_candidates(text, names)):
                    taken = Taken(spans(text))
                    out += [(doc, "name", form, i, j, False, *_features(text, i, j), first, last) for i, j, form, first, last in found if taken.free(i, j)]
            yield pd.DataFrame(out, columns=_CANDIDATE)

    lower = _hashes(docs.mapInPandas(read, _schema(docs))).withColumns({"o": F.lit(0.0), "seed": F.lit(False)})
    more = judge(lower, nodes, None).filter(_accepted()).select(accepted.columns)
    return _chosen(accepted.unionByName(more)).select("doc_id", F.col("graph").alias("kind"), "start_pos", "end_pos")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text with each value replaced by its kind in square brackets; the rest is unchanged."""
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos", "kind"))).alias("found"))
    both = docs.filter("doc_id is not null").select("doc_id", "text").join(per_doc, "doc_id", "left")
    # pieces between the values; a document's values are bounded by its length
    n = F.size("found")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("found.end_pos"))
    ends = F.concat(F.col("found.start_pos"), F.array(F.length("text").cast("bigint")))
    tags = F.concat(F.transform("found", lambda x: F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))), F.array(F.lit("")))
    pieces = F.transform(F.sequence(F.lit(0), n), lambda k: F.concat(F.substr(F.col("text"), (F.get(starts, k) + 1).cast("int"), (F.get(ends, k) - F.get(starts, k)).cast("int")), F.get(tags, k)))
    return both.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))
