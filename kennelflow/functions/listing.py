"""Scalar functions on listing fields as native column expressions: no Python runs per row.

All give null for null and for what they can't read, unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kennelflow.functions.text import clean_text, squish

# Mean radius of the earth in miles, days of a month, pounds of a kilogram.
EARTH_MI = 3958.7613
DAYS_A_MONTH = 30.44
LBS_A_KG = 2.20462

# shelters' short forms of breeds.
BREED_ALIASES = {
    "germ shepherd": "german shepherd",
    "german shepherd dog": "german shepherd",
    "gsd": "german shepherd",
    "belg malinois": "belgian malinois",
    "pit bull terrier": "pit bull",
    "pit bull ter": "pit bull",
    "am pit bull ter": "pit bull",
    "american pit bull terrier": "pit bull",
    "staffordshire bull terrier": "staffordshire terrier",
    "am staff": "staffordshire terrier",
    "amer staff": "staffordshire terrier",
    "chihuahua sh": "chihuahua",
    "chihuahua lh": "chihuahua",
    "chihuahua smooth coat": "chihuahua",
    "chihuahua long coat": "chihuahua",
    "dachshund smooth": "dachshund",
    "doxie": "dachshund",
    "lab retriever": "labrador retriever",
    "labrador": "labrador retriever",
    "labrador retr": "labrador retriever",
    "golden retr": "golden retriever",
    "aust shepherd": "australian shepherd",
    "aust cattle dog": "australian cattle dog",
    "queensland heeler": "australian cattle dog",
    "heeler": "australian cattle dog",
    "jack russ terrier": "jack russell terrier",
    "yorkshire terr": "yorkshire terrier",
    "yorkie": "yorkshire terrier",
    "poodle min": "miniature poodle",
    "poodle toy": "toy poodle",
    "poodle stnd": "standard poodle",
    "alask husky": "husky",
    "siberian husky": "husky",
    "catahoula leopard dog": "catahoula",
    "cane corso mastiff": "cane corso",
    "st bernard": "saint bernard",
}

# Short forms of colours.
COLOR_ALIASES = {
    "blk": "black",
    "bk": "black",
    "wht": "white",
    "wh": "white",
    "brn": "brown",
    "br": "brown",
    "choc": "chocolate",
    "gray": "gray",
    "grey": "gray",
    "gr": "gray",
    "slvr": "silver",
    "yel": "yellow",
    "gold": "golden",
    "bld": "blonde",
    "rd": "red",
    "org": "orange",
    "crm": "cream",
    "brdl": "brindle",
    "tri color": "tricolor",
    "tri": "tricolor",
}
# Names that stand for none.
PLACEHOLDER_NAMES = ["unknown", "no name", "noname", "unnamed", "puppy", "pup", "dog", "stray", "n/a", "pending"]
# Addresses and sizes of pictures that show no animal.
PLACEHOLDER_PHOTO = r"(?i)no[-_ ]?(image|pic|photo)|nopic|placeholder|default[-_.]|image[-_ ]?coming|(photo|image|coming)[-_ ]?soon|generic\.(svg|png|jpe?g)"
PLACEHOLDER_SIZES = [(160, 120), (232, 246), (515, 347)]
# Status words in the order in which they count, first match first.
STATUS_RULES = [
    ("rescue_only", r"rescue\s*only|rescue-only"),
    ("stray_hold", r"stray\s*(wait|hold)"),
    ("medical_hold", r"medical|med\s*hold|vet\s*hold"),
    ("adopted", r"adopt(ed|ion complete)"),
    ("pending", r"pend"),
    ("hold", r"\bhold\b|^id hold|other hold|behavior hold|evidence"),
    ("foster", r"foster"),
    ("not_available", r"not\s*(currently\s*)?available|unavailable|no longer"),
    ("available", r"^in shelter$"),
    ("available", r"rtgh|ready to go home|available|adoptable|^adopt$|^av\b|^avail"),
]
# Months of the age buckets, pounds of the size bands.
AGE_BUCKETS = [("puppy", 12), ("young", 36), ("adult", 96)]


def half_up(c: Column, k: float = 1) -> Column:
    """floor(x * k + 0.5) / k."""
    return F.floor(c * k + 0.5) / k


def first_case(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule that holds; nulls do not hold."""
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
    return out.otherwise(otherwise)


def age_bucket(months: Column) -> Column:
    return F.when(months.isNull(), None).when(months < AGE_BUCKETS[0][1], "puppy").when(months < AGE_BUCKETS[1][1], "young").when(months < AGE_BUCKETS[2][1], "adult").otherwise("senior")


def months_between_dates(since: Column, at: Column) -> Column:
    """Whole months of 30.44 days, at least 0; null for null."""
    m = half_up((F.unix_micros(at) - F.unix_micros(since)) / (DAYS_A_MONTH * 86400e6))
    return F.when(m < 0, 0).otherwise(m)


def loose_date(c: Column) -> Column:
    """y-m-d, m/d/y and 'Mon d, y' as a date; days beyond the month's end roll over; years 1990 to 2100."""
    months = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    t = F.regexp_replace(squish(c), r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4}).*$", "$3-$1-$2")
    t = F.regexp_replace(t, r"(?i)^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4}).*$", "$3-$1-$2")
    parts = F.split(F.regexp_extract(t, r"^\d{4}-(?:\d{1,2}|[A-Za-z]{3})-\d{1,2}", 0), "-")

    def date(y: Column, m: Column, d: Column) -> Column:
        ok = y.between(1990, 2100) & m.between(1, 12) & d.between(1, 31)
        return F.when(ok, F.date_add(F.make_date(F.when(ok, y), F.when(ok, m), F.lit(1)), d - 1))

    # each step is bound by a lambda, so that its code is made once
    number = lambda p, k: F.get(p, F.lit(k)).try_cast("int")
    ymd = F.transform(F.array(parts), lambda p: F.struct(number(p, 0).alias("y"), F.coalesce(number(p, 1), F.array_position(months, F.lower(F.get(p, F.lit(1)))).cast("int")).alias("m"), number(p, 2).alias("d")))
    return F.get(F.transform(ymd, lambda s: date(s["y"], s["m"], s["d"])), F.lit(0))


def first_number(t: Column, rx: str, group: int = 1) -> Column:
    """The captured figure of the first match as double; null without one."""
    return F.nullif(F.regexp_extract(t, rx, group), F.lit("")).try_cast("double")


_N = r"([0-9]+(?:\.[0-9]+)?)"


def age_from_text(c: Column, at: Column) -> Column:
    """struct<months int, bucket string> of an age in words and figures; each step counts only where those before say nothing.

    A birth date gives the age at ``at``; a range of years its middle; "under n" no months, but a puppy up to one year; "n+" n;
    else years, months, weeks and days are rounded one by one and summed (0 says nothing); a bare figure of one or two digits is
    years. A life stage in words decides the bucket whatever the figures say, but for birth dates and bare figures.
    """
    t = F.lower(squish(c))
    born = months_between_dates(loose_date(F.regexp_extract(t, r"(?:dob|born|date of birth)[:\s]*([0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4})", 1)).cast("timestamp"), at).cast("int")
    word = first_case((t.rlike(r"\bpupp(y|ies)\b"), "puppy"), (t.rlike(r"\bsenior\b"), "senior"), (t.rlike(r"\byoung\b"), "young"), (t.rlike(r"\badult\b"), "adult"))
    years = r"\s*(?:years?|yrs?)\b"
    rng = half_up((first_number(t, rf"{_N}\s*-\s*{_N}{years}", 1) + first_number(t, rf"{_N}\s*-\s*{_N}{years}", 2)) / 2 * 12).cast("int")
    under = first_number(t, rf"under\s+{_N}\s*(?:years?|yrs?|y)\b")
    plus = half_up(first_number(t, rf"{_N}\s*\+{years}") * 12).cast("int")
    parts = [
        half_up(first_number(t, rf"{_N}\s*(?:years?|yrs?|y)\b") * 12),
        half_up(first_number(t, rf"{_N}\s*(?:months?|mths?|mos?|m)\b")),
        half_up(first_number(t, rf"{_N}\s*(?:weeks?|wks?|w)\b") * 7 / DAYS_A_MONTH),
        half_up(first_number(t, rf"{_N}\s*(?:days?)\b") / DAYS_A_MONTH),
    ]
    stated = F.coalesce(*parts).isNotNull()
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts]).cast("int")
    bare = (first_number(t, r"^([0-9]{1,2})$") * 12).cast("int")

    def pair(months: Column, bucket: Column) -> Column:
        return F.struct(months.cast("int").alias("months"), bucket.alias("bucket"))

    none = F.lit(None).cast("int")
    return (
        F.when(t.isNull() | (t == ""), pair(none, F.lit(None).cast("string")))
        .when(born.isNotNull(), pair(born, age_bucket(born)))
        .when(rng.isNotNull(), pair(rng, F.coalesce(word, age_bucket(rng))))
        .when(under.isNotNull(), pair(none, F.coalesce(word, F.when(under <= 1, "puppy"))))
        .when(plus.isNotNull(), pair(plus, F.coalesce(word, age_bucket(plus))))
        .when(stated & (total <= 0), pair(none, word))
        .when(stated, pair(total, F.coalesce(word, age_bucket(total))))
        .when(bare.isNotNull(), pair(bare, age_bucket(bare)))
        .otherwise(pair(none, word))
    )


def weight_from_text(c: Column) -> Column:
    """Pounds to one decimal: kilograms before pounds before a bare figure. What else is written says nothing."""
    t = F.lower(squish(c))
    kg = first_number(t, rf"{_N}\s*(?:kg|kilos?|kilograms?)\b") * LBS_A_KG
    lb = first_number(t, rf"{_N}\s*(?:(?:lbs?|pounds?)\b|#\b)")
    return half_up(F.coalesce(kg, lb, first_number(t, rf"^{_N}$")), 10)


def sex_of(c: Column) -> Column:
    """'female', 'male' or 'unknown'; null is unknown."""
    t = F.coalesce(F.lower(squish(c)), F.lit(""))
    return first_case((t.rlike(r"female|^f\b") | (t.rlike(r"\bf\b") & t.contains("spayed")) | (F.startswith(t, F.lit("f")) & t.contains("spayed")), "female"), (t.rlike(r"\bmale\b|^m\b"), "male"), otherwise="unknown")


def altered(c: Column) -> Column:
    """Spayed or neutered: true, false (intact) or null where the text says neither."""
    t = F.coalesce(F.lower(squish(c)), F.lit(""))
    return first_case((t.rlike("(spayed|neutered|altered|desexed|fixed)"), True), (t.rlike(r"\bintact\b|unaltered"), False))


def size_of(raw: Column, lbs: Column) -> Column:
    """The size class that a text names, else that of the weight, else null."""
    t = F.coalesce(F.lower(squish(raw)), F.lit(""))
    named = first_case(
        (t.rlike(r"x[-\s]?large|extra[-\s]?large|\bxl\b|giant"), "xlarge"), (t.rlike(r"\blarge\b|\blg\b|\bl\b"), "large"), (t.rlike(r"\bmed(ium)?\b|\bm\b"), "medium"), (t.rlike(r"\bsmall\b|\bsm\b|\bs\b|\btoy\b|\bmini\b"), "small")
    )
    return F.coalesce(named, F.when(lbs < 26, "small").when(lbs <= 60, "medium").when(lbs <= 99, "large").when(lbs > 99, "xlarge"))


def title_name(c: Column) -> Column:
    """'*BISCUIT-BEAR* (A123456)' -> 'Biscuit-Bear'; only wholly upper-case names change case."""
    t = squish(F.regexp_replace(squish(c), r"\(([A-Za-z]?[0-9]{4,})\)\s*$", ""))
    t = clean_text(F.replace(F.regexp_replace(t, r"^\*+|\*+$", ""), F.lit("*"), F.lit(" ")))
    starts = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.when((i == 1) | F.substr(t, i - 1, F.lit(1)).rlike(r"[\s\-'/]"), F.upper(F.substr(t, i, F.lit(1)))).otherwise(F.lower(F.substr(t, i, F.lit(1)))))
    return F.when((t == F.upper(t)) & t.rlike("[A-Z]"), F.array_join(starts, "")).otherwise(t)


def placeholder_name(c: Column) -> Column:
    """True for null, a single character, an id of at least four digits and the words of ``PLACEHOLDER_NAMES``."""
    t = F.lower(F.trim(c))
    return c.isNull() | (F.length(t) < 2) | t.rlike(r"^[a-z]?[0-9]{4,}$") | t.isin(*PLACEHOLDER_NAMES)


def placeholder_photo(url: Column) -> Column:
    return F.coalesce(url.rlike(PLACEHOLDER_PHOTO), F.lit(False))


def placeholder_size(width: Column, height: Column) -> Column:
    return F.coalesce(reduce(lambda x, y: x | y, [(width == w) & (height == h) for w, h in PLACEHOLDER_SIZES]), F.lit(False))


def status_of(c: Column) -> Column:
    """One of ten states, by the first of ``STATUS_RULES`` that fits; 'unknown' for the rest and for null. A pending adoption is none yet."""
    t = F.lower(squish(c))
    rules = [(t.rlike(rx) & ~t.contains("pend") if name == "adopted" else t.rlike(rx), name) for name, rx in STATUS_RULES]
    return first_case(*rules, otherwise="unknown")


def split_colors(c: Column) -> Column:
    """'Blk & White/Tan' -> ['black', 'white', 'tan']; an empty list for null."""
    t = F.coalesce(F.lower(squish(c)), F.lit(""))
    t = F.regexp_replace(t, r"\s+and\s+|\s*&\s*|\s*-\s*", "/")
    short = F.create_map(*[F.lit(x) for pair in COLOR_ALIASES.items() for x in pair])
    parts = F.filter(F.transform(F.split(t, "[/,]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.coalesce(F.try_element_at(short, p), p)))


def breed_label(c: Column) -> Column:
    """The breeds of ``breed_tokens`` joined by ' / ', with ' mix' behind a single one that is called a mix; null for none."""
    t, names = F.lower(squish(c)), breed_tokens(c)
    mix = t.rlike(r"\bmix(ed)?\b|\bcross\b|\bx\b") & (F.size(names) == 1) & ~t.isin("unknown", "mixed", "mixed breed", "mix")
    return F.when(F.size(names) > 0, F.concat(F.array_join(names, " / "), F.when(mix, " mix").otherwise("")))


def fresh(stale: Column) -> Column:
    """'fresh' while a record is seen, 'stale' after one miss, 'missing' after more, 'uncertain' where nothing is recorded."""
    return F.when(stale.isin("available", "still_seen"), "fresh").when(stale == "missing_once", "stale").when(stale.isin("missing_multiple_runs", "likely_unavailable"), "missing").otherwise("uncertain")


def breed_tokens(c: Column) -> Column:
    """'Lab Retriever / GSD mix' -> ['labrador retriever', 'german shepherd']; what names no breed but a mix is 'mixed breed'."""
    t = F.coalesce(F.lower(squish(c)), F.lit(""))
    parts = F.regexp_replace(F.regexp_replace(t, r"\bmix(ed)?( breed)?\b", ""), r"\bcross\b|\s+and\s+|\s*&\s*", "/")
    short = F.create_map(*[F.lit(x) for pair in BREED_ALIASES.items() for x in pair])
    named = F.filter(F.transform(F.split(parts, "[/,]"), squish), lambda p: p != "")
    named = F.array_distinct(F.transform(named, lambda p: F.coalesce(F.try_element_at(short, p), p)))
    return F.when(t.isin("unknown", "mixed", "mixed breed", "mix"), F.array(F.lit("mixed breed"))).otherwise(named)


def yes_no(c: Column) -> Column:
    t = F.lower(squish(c))
    return first_case((t.rlike("^(y|yes|true|ok|good)"), True), (t.rlike("^(n|no|false|not)"), False))


def days_since(since: Column, at: Column) -> Column:
    d = F.floor((F.unix_micros(at) - F.unix_micros(since)) / 86400e6)
    return F.when(d >= 0, d)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MI * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def stable_hash(cols: list[str]) -> Column:
    """SHA-256 over the named columns as JSON with sorted names; nulls are kept apart from ''."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def set_hash(c: Column) -> Column:
    """One hash for the same set of strings in any order; null for none."""
    return F.when(F.size(c) > 0, F.sha2(F.array_join(F.array_sort(c), "\n"), 256))


def listing_key(animal_id: Column, url: Column) -> Column:
    return F.coalesce(clean_text(animal_id), F.concat(F.lit("url_"), F.substring(F.sha2(url, 256), 1, 16)))


# Entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#0?39;", "'"), ("&quot;", '"'), ("&rsquo;|&#8217;", "'"), ("&ldquo;|&rdquo;|&#822[01];", '"'), ("&ndash;|&#8211;", "–"), ("&mdash;|&#8212;", "—")]


def html_to_text(c: Column) -> Column:
    """Line breaks as new lines, paragraphs as blank lines, other tags dropped, entities decoded; null for what is empty."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n"), r"<[^>]+>", "")
    for rx, to in ENTITIES:
        t = F.regexp_replace(t, rx, to)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def html_to_prose(c: Column) -> Column:
    """As ``html_to_text``, but a single line break is a wrapped line and becomes a blank; two or more part paragraphs."""
    t = F.regexp_replace(c, r"\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)(<br\s*/?>\s*){2,}", "</p>"), r"(?i)<br\s*/?>", " ")
    return F.regexp_replace(html_to_text(t), " {2,}", " ")


def excerpt(c: Column, n: int) -> Column:
    t = squish(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def informative(c: Column, kind: str = "string") -> Column:
    """Neither null, nor 'unknown', nor an empty list."""
    return c.isNotNull() & (F.size(c) > 0 if kind.startswith("array") else ~F.lower(c.cast("string")).isin("unknown"))
