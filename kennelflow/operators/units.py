"""Amounts written in many units and notations, brought to one unit.

A multi-pattern automaton (Aho-Corasick) finds all unit aliases of a text in one pass. Of overlapping
hits the longest counts; an alias only counts beside a number and as a whole word. Short aliases are
ambiguous ("m", "g", "d"), so each field has its own alias table: the field is the context that decides.
The amounts leave Python as (value, unit) parts; the factors to the target unit come from a small literal
table, joined by broadcast (its size is that of ``FACTORS``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit aliases per field.
ALIASES = {
    "weight": {
        "lb": ("lb", "lbs", "pound", "pounds", "#", "libra", "libras", "livre", "livres"),
        "kg": ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes", "kilogramo", "kilogramos"),
        "oz": ("oz", "ounce", "ounces", "onza", "onzas"),
        "st": ("st", "stone", "stones"),
        "g": ("g", "gr", "gram", "grams", "gramo", "gramos", "gramme", "grammes"),
    },
    "age": {
        "year": ("y", "yr", "yrs", "year", "years", "y/o", "yo", "ano", "anos", "an", "ans"),
        "month": ("m", "mo", "mos", "mth", "mths", "month", "months", "mes", "meses", "mois"),
        "week": ("w", "wk", "wks", "week", "weeks", "semana", "semanas", "semaine", "semaines"),
        "day": ("d", "day", "days", "dia", "dias", "jour", "jours"),
    },
}
# Unit, field, factor to pounds or months (a month has 30.44 days, a year 12 months).
FACTORS = [
    ("lb", "weight", 1.0),
    ("st", "weight", 14.0),
    ("kg", "weight", 2.20462262185),
    ("oz", "weight", 1 / 16),
    ("g", "weight", 0.00220462262185),
    ("year", "age", 12.0),
    ("month", "age", 1.0),
    ("week", "age", 7 / 30.44),
    ("day", "age", 1 / 30.44),
]
DEFAULT_UNIT = {"weight": "lb", "age": "year"}
# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: i for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3}

_WORD = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + "|hundred"
_WORDS = re.compile(rf"(?<![a-z])(?:(?:a |one )?hundred|{_WORD})(?:(?:[ -]|\s+and\s+)(?:{_WORD}))*(?![a-z])")
_NUM = re.compile(r"(?<![\d.,])\d{1,3}(?:[ ,]\d{3})+(?:\.\d+)?(?![\d,])|\d+(?:[.,]\d+)?|\.\d+")
_ONE_GROUP = re.compile(r"\d{1,3}[.,]\d{3}")
#: Units so small that a figure in them may have thousands: "2,780 g" is no decimal fraction, "12,500 kg" is one.
_SMALL = {"g", "oz", "day", "week"}
_RANGE = re.compile(r"^\s*(?:-|–|—|to|a|à)\s*$")
_ISO = re.compile(r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)")
_US = re.compile(r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)")
_NAMED = re.compile(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})")


def _folded(s: str) -> str:
    s = "".join(c if c in FRACTIONS else unicodedata.normalize("NFKD", c) for c in s).lower()
    return "".join(c for c in s if not unicodedata.combining(c))


def _word_value(m: re.Match) -> str:
    total = part = 0
    for w in re.findall(r"[a-z]+", m.group(0)):
        if w == "hundred":
            part = max(part, 1) * 100
        elif w in NUMBER_WORDS:
            part += NUMBER_WORDS[w]
    return str(total + part)


def _digits(s: str) -> str:
    """Number words and written halves as digits."""
    s = re.sub(r"\ba (\w+) and a half\b", r"1.5 \1", s)
    s = _WORDS.sub(_word_value, s)
    s = re.sub(r"\b(\d+) and a half\b", r"\1.5", s)
    s = re.sub(r"(\d+)\s*([½¼¾⅓⅔])", lambda m: str(int(m[1]) + FRACTIONS[m[2]]), s)
    s = re.sub(r"[½¼¾⅓⅔]", lambda m: str(FRACTIONS[m[0]]), s)
    s = re.sub(r"(?<!\d)(\d+)\s+([1-3])/([2348])(?!\d)", lambda m: str(int(m[1]) + int(m[2]) / int(m[3])), s)
    return re.sub(r"\b(?:half a|a half)\s+(?=[a-z])", "0.5 ", s)


class Automaton:
    """Aliases of one field. ``units(text)``: longest whole-word hits as (start, end, unit)."""

    def __init__(self, field: str) -> None:
        import ahocorasick

        self.a = ahocorasick.Automaton()
        for unit, names in ALIASES[field].items():
            for n in names:
                self.a.add_word(n, (unit, len(n)))
        self.a.make_automaton()

    def units(self, s: str) -> list[tuple[int, int, str]]:
        hits = []
        for end, (unit, n) in self.a.iter(s):
            i, j = end - n + 1, end + 1
            if (i and s[i - 1].isalpha()) or (j < len(s) and s[j].isalpha() and s[i:j] != "#"):
                continue
            hits.append((i, j, unit))
        hits.sort(key=lambda h: (h[0], h[0] - h[1]))
        out: list[tuple[int, int, str]] = []
        for h in hits:
            if not out or h[0] >= out[-1][1]:
                out.append(h)
        return out


_made: dict[str, Automaton] = {}


def automaton(field: str) -> Automaton:
    if field not in _made:
        _made[field] = Automaton(field)
    return _made[field]


def _number(t: str, unit: str | None = None) -> float:
    """A written figure. Groups of thousands are told from decimal fractions by the unit where both can be meant."""
    if " " in t or t.count(",") > 1 or ("," in t and "." in t):
        return float(t.replace(" ", "").replace(",", ""))
    if _ONE_GROUP.fullmatch(t) and unit in _SMALL and not t.startswith("0") and ("," in t or unit == "g"):
        return float(t.replace(",", "").replace(".", ""))
    return float(t.replace(",", "."))


def birth_date(s: str) -> datetime | None:
    """ISO, month/day/year and month-name dates; impossible dates give none."""
    for rx, order in ((_ISO, (1, 2, 3)), (_US, (3, 1, 2)), (_NAMED, (3, 1, 2))):
        if m := rx.search(s):
            y, mo, d = (m[i] for i in order)
            try:
                return datetime(int(y), MONTHS.get(mo[:3]) or int(mo), int(d))
            except ValueError:
                return None
    return None


def amounts(text: str | None, field: str) -> list[tuple[float, str | None]]:
    """The amount a text states, as parts to be summed: (value, unit; None where no unit is written).

    A range gives its middle, "n+" n; "under n" and texts without a number state nothing. What stands in
    brackets is a remark unless nothing else is left. Very long texts are read whole.
    """
    if not text:
        return []
    s = _folded(text)
    outside = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", s)
    s = _digits(outside if re.search(r"\d|" + _WORD, outside) else s)
    if re.search(r"\b(?:under|below|less than|up to|menos de|moins de)\s*[\d.]", s):
        return []
    nums = [(m.start(), m.end(), m[0]) for m in _NUM.finditer(s)]
    if not nums:
        return []
    units = automaton(field).units(s)
    parts: list[list] = []
    for k, (i, j, v) in enumerate(nums):
        nxt = nums[k + 1][0] if k + 1 < len(nums) else len(s)
        unit = next((u for a, _, u in units if j <= a < nxt and re.fullmatch(r"[\s.+-]*", s[j:a])), None)
        if unit is None and field == "weight":  # "#12", "lb 12"
            unit = next((u for a, b, u in units if b <= i and s[b:i].strip() == "" and s[a:b] == "#" and not re.search(r"\d\s*$", s[:a])), None)
        parts.append([v, unit, i, j])
    # in a range the unit is written once, behind the second figure
    for k, p in enumerate(parts):
        p[0] = _number(p[0], p[1] or (parts[k + 1][1] if k + 1 < len(parts) else None))
    merged: list[list] = []
    for p in parts:
        if merged and _RANGE.match(re.sub("|".join(sorted((re.escape(a) for n in ALIASES[field].values() for a in n), key=len, reverse=True)), "", s[merged[-1][3] : p[2]]) if merged[-1][1] else s[merged[-1][3] : p[2]]) and (merged[-1][1] in (None, p[1])) and p[0] >= merged[-1][0]:
            merged[-1] = [(merged[-1][0] + p[0]) / 2, p[1], merged[-1][2], p[3]]
        else:
            merged.append(p)
    with_unit = [(v, u) for v, u, _, _ in merged if u]
    if with_unit:
        # one statement: units going down ("5 lb 3 oz"); a later statement with the same or a greater unit is another one
        rank = {u: r for r, u in enumerate(("kg", "st", "lb", "oz", "g") if field == "weight" else ("year", "month", "week", "day"))}
        out = [with_unit[0]]
        for v, u in with_unit[1:]:
            if rank[u] <= rank[out[-1][1]]:
                break
            out.append((v, u))
        return out
    return [(merged[0][0], None)] if len(merged) == 1 else []


_UNIT_WORDS = {f: "|".join(sorted((re.escape(a) for n in t.values() for a in n if len(a) > 1), key=len, reverse=True)) for f, t in ALIASES.items()}
_FIGURE = rf"[0-9½¼¾⅓⅔]|(?:^|[^a-z])(?:{_WORD})(?:[^a-z]|$)"
_ANY_UNIT = "#|(?:^|[^a-z])(?:" + "|".join(sorted((re.escape(a) for t in ALIASES.values() for n in t.values() for a in n if a != "#"), key=len, reverse=True)) + ")(?:[^a-z]|$)"
_NOTE = {
    "weight": (("kg", r"kilo|\bkgs?\b|metric"), ("lb", r"pound|\blbs?\b|imperial")),
    "age": (("month", r"month|\bmos?\b"), ("week", r"week"), ("year", r"year")),
}


def unit_in_text(text: str | None, field: str, value: float) -> str | None:
    """The unit that a description gives for a figure: that of the same figure, else of a statement on weight or age."""
    if not text:
        return None
    s = _folded(re.sub(r"<[^>]+>", " ", text))
    hits = []
    for a, b, u in automaton(field).units(s):
        m = re.search(r"(\d{1,3}(?:[ ,]\d{3})+|\d+(?:[.,]\d+)?)[\s-]*$", s[max(0, a - 16) : a])
        if m and (b - a > 1 or field == "weight") and s[a:b] != "st":
            before = s[max(0, a - 60) : a]
            about = re.search(r"weigh|scale|comes to|tips", before) if field == "weight" else re.search(r"\bage|\bold\b|born|turn|about|\bis\b", before + s[b : b + 6])
            hits.append((abs(_number(m[1], u) - value) < 1e-9, bool(about), u))
    hits = [h for h in hits if h[0] or h[1]]
    return max(hits, key=lambda h: (h[0], h[1]))[2] if hits else None


def unit_in_notes(notes: str | None, field: str) -> str | None:
    """The unit that a source's notes give to bare figures of a field."""
    if not notes:
        return None
    s = _folded(notes)
    word = r"weight|scale|mass" if field == "weight" else r"\bages?\b|age column"
    other = r"\bages?\b" if field == "weight" else r"weight"
    if not re.search(word, s) and (re.search(other, s) or not re.search(r"unit|export|feed", s)):
        return None
    return next((u for u, rx in _NOTE[field] if re.search(rx, s)), None)


def needs_text(raws: list[str]) -> Column:
    """Some raw text has a figure, in digits or words, and no unit, so that its unit may stand in the description."""
    out = F.lit(False)
    for raw in raws:
        plain = F.translate(F.lower(F.col(raw)), "áàâéèêíîóôúûñ", "aaaeeeiioouun")
        out = out | F.coalesce(plain.rlike(_FIGURE) & ~plain.rlike(_ANY_UNIT), F.lit(False))
    return out


def parse_amounts(rows: DataFrame, fields: dict[str, tuple[str, str]], id_col: str, text_col: str, notes_col: str, at_col: str) -> DataFrame:
    """One row per amount part: id, quantity, value, unit, recorded.

    ``fields``: quantity -> (raw column, column of the recorded estimate). Unit from the raw text, else from
    the description, else from the source's notes, else ``DEFAULT_UNIT``. A birth date gives the days to
    ``at_col``. Null or empty texts state nothing. Other columns are ignored.
    """
    names = list(fields)
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.col(notes_col).alias("_notes"), F.col(at_col).cast("timestamp").alias("_at")]
    cols[1] = F.when(needs_text([raw for raw, _ in fields.values()]), F.col(text_col)).alias("_text")
    for n, (raw, est) in fields.items():
        cols += [F.col(raw).alias(f"_{n}"), F.col(est).cast("double").alias(f"_e_{n}")]

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for b in it:
            out = []
            for n in names:
                for i, raw, est, text, notes, at in zip(b["id"], b[f"_{n}"], b[f"_e_{n}"], b["_text"], b["_notes"], b["_at"]):
                    if raw is None or raw != raw:
                        continue
                    if n == "age" and re.search(r"\d{4}", raw) and (born := birth_date(_folded(raw))):
                        if at is not None and at == at:
                            out.append((i, n, (at - born).total_seconds() / 86400, "day", est))
                        continue
                    if (k := (n, raw)) not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[k] = amounts(raw, n)
                    for v, u in seen[k]:
                        out.append((i, n, v, u or unit_in_text(text, n, v) or unit_in_notes(notes, n) or DEFAULT_UNIT[n], est))
            yield pd.DataFrame(out, columns=["id", "quantity", "value", "unit", "recorded"])

    return rows.select(*cols).mapInPandas(parse, "id string, quantity string, value double, unit string, recorded double")


def to_common_units(parts: DataFrame) -> DataFrame:
    """Sum the parts of each (id, quantity) in the target unit: id, quantity, amount, recorded.

    The factor table has one row a unit and is broadcast.
    """
    factors = parts.sparkSession.createDataFrame(FACTORS, "unit string, quantity string, factor double")
    conv = parts.join(F.broadcast(factors), ["unit", "quantity"])
    return conv.groupBy("id", "quantity").agg(F.sum(F.col("value") * F.col("factor")).alias("amount"), F.max("recorded").alias("recorded"))


def wrong_estimates(amounts_df: DataFrame) -> DataFrame:
    """Amounts whose recorded estimate is null or off by more than a tenth and by more than 1 (lb or month)."""
    off = F.abs(F.col("amount") - F.col("recorded"))
    return amounts_df.filter(F.col("recorded").isNull() | F.isnan("recorded") | ((off > 0.1 * F.col("amount")) & (off > 1)))
