"""Listing fields normalised from their raw texts, with SQL twins that state the rules on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from kennelflow.functions import listing as X
from kennelflow.functions.text import squish
from kennelflow.plans.listings import LATEST, listings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _low(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_WS}', ' ', 'g')))"


def _num(rx: str, group: int = 1) -> str:
    return f"try_cast(nullif(regexp_extract(t, '{rx}', {group}), '') as double)"


_N = "([0-9]+(?:\\.[0-9]+)?)"
_Y = "\\s*(?:years?|yrs?)\\b"
_DAY = "try_cast(born as date)"
_AGE = f"""(with a as (select id, last_seen_at, {_low("age_raw")} as t from {LATEST}),
b as (select *, regexp_extract(t, '(?:dob|born|date of birth)[:\\s]*([0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}})', 1) as d,
  case when regexp_matches(t, '\\bpupp(y|ies)\\b') then 'puppy' when regexp_matches(t, '\\bsenior\\b') then 'senior' when regexp_matches(t, '\\byoung\\b') then 'young' when regexp_matches(t, '\\badult\\b') then 'adult' end as word,
  {_num(_N + "\\s*-\\s*" + _N + _Y)} as r1, {_num(_N + "\\s*-\\s*" + _N + _Y, 2)} as r2, {_num("under\\s+" + _N + "\\s*(?:years?|yrs?|y)\\b")} as u, {_num(_N + "\\s*\\+" + _Y)} as p,
  {_num(_N + "\\s*(?:years?|yrs?|y)\\b")} as y, {_num(_N + "\\s*(?:months?|mths?|mos?|m)\\b")} as m, {_num(_N + "\\s*(?:weeks?|wks?|w)\\b")} as w, {_num(_N + "\\s*(?:days?)\\b")} as dy, {_num("^([0-9]{1,2})$")} as bare from a),
c as (select *, case when regexp_matches(d, '^[0-9]{{4}}') then replace(d, '/', '-') when regexp_matches(d, '[0-9]{{4}}$') then regexp_replace(d, '^([0-9]+)[-/]([0-9]+)[-/]([0-9]+)$', '\\3-\\1-\\2') end as born from b),
e as (select *, case when {_DAY} is not null then greatest(0, floor(date_diff('microsecond', cast({_DAY} as timestamp), last_seen_at) / 2630016e6 + 0.5)) end as dob,
  floor(coalesce(y, 0) * 12 + 0.5) + floor(coalesce(m, 0) + 0.5) + floor(coalesce(w, 0) * 7 / 30.44 + 0.5) + floor(coalesce(dy, 0) / 30.44 + 0.5) as total, coalesce(y, m, w, dy) is not null as stated from c),
f as (select id, word, u, dob, r1, p, bare, stated, total, cast(case when dob is not null then dob when r1 is not null then floor((r1 + r2) / 2 * 12 + 0.5) when u is not null then null when p is not null then floor(p * 12 + 0.5)
  when stated then nullif(greatest(total, 0), 0) when bare is not null then bare * 12 end as integer) as months from e),
g as (select *, case when months < 12 then 'puppy' when months < 36 then 'young' when months < 96 then 'adult' when months >= 96 then 'senior' end as by_months from f)
select id, months, case when dob is not null then by_months when r1 is not null then coalesce(word, by_months) when u is not null then coalesce(word, case when u <= 1 then 'puppy' end)
  when p is not null or stated then coalesce(word, by_months) when bare is not null then by_months else word end as bucket from g)"""


@query("age_text", f"select * from {_AGE}")
def _(s, d):
    return listings(s, d, "age_raw", "last_seen_at").select("id", X.age_from_text(F.col("age_raw"), F.col("last_seen_at").cast("timestamp")).alias("a")).select("id", "a.months", "a.bucket")


_LBS = f"""(select id, floor(coalesce({_num(_N + "\\s*(?:kg|kilos?|kilograms?)\\b")} * 2.20462, {_num(_N + "\\s*(?:(?:lbs?|pounds?)\\b|#\\b)")}, {_num("^" + _N + "$")}) * 10 + 0.5) / 10 as lbs from (select id, {_low("weight_raw")} as t from {LATEST}))"""


@query("weight_text", f"select * from {_LBS}")
def _(s, d):
    return listings(s, d, "weight_raw").select("id", X.weight_from_text(F.col("weight_raw")).alias("lbs"))


_BARE = f"nullif(trim(regexp_replace(replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(name, '{_WS}', ' ', 'g')), '\\(([A-Za-z]?[0-9]{{4,}})\\)\\s*$', '')), '^\\*+|\\*+$', '', 'g'), '*', ' '), '{_WS}', ' ', 'g')), '')"
_NAME = f"""(select id, case when t = upper(t) and regexp_matches(t, '[A-Z]') then array_to_string(list_transform(range(1, length(t) + 1),
  lambda i: case when i = 1 or regexp_matches(substr(t, i - 1, 1), '[\\s\\-''/]') then upper(substr(t, i, 1)) else lower(substr(t, i, 1)) end), '') else t end as name from (select id, {_BARE} as t from {LATEST}))"""


@query("name_title", f"""select id, name, name is null or length(trim(name)) < 2 or regexp_matches(lower(trim(name)), '^[a-z]?[0-9]{{4,}}$')
  or lower(trim(name)) in ('unknown', 'no name', 'noname', 'unnamed', 'puppy', 'pup', 'dog', 'stray', 'n/a', 'pending') as placeholder from {_NAME}""")
def _(s, d):
    return listings(s, d, "name").select("id", X.title_name(F.col("name")).alias("name")).select("id", "name", X.placeholder_name(F.col("name")).alias("placeholder"))


_STATUS = f"""(select id, case when t is null then 'unknown' when regexp_matches(t, 'rescue\\s*only|rescue-only') then 'rescue_only' when regexp_matches(t, 'stray\\s*(wait|hold)') then 'stray_hold'
  when regexp_matches(t, 'medical|med\\s*hold|vet\\s*hold') then 'medical_hold' when regexp_matches(t, 'adopt(ed|ion complete)') and t not like '%pend%' then 'adopted' when t like '%pend%' then 'pending'
  when regexp_matches(t, '\\bhold\\b|^id hold|other hold|behavior hold|evidence') then 'hold' when t like '%foster%' then 'foster' when regexp_matches(t, 'not\\s*(currently\\s*)?available|unavailable|no longer') then 'not_available'
  when t = 'in shelter' then 'available' when regexp_matches(t, 'rtgh|ready to go home|available|adoptable|^adopt$|^av\\b|^avail') then 'available' else 'unknown' end as status from (select id, {_low("status_raw")} as t from {LATEST}))"""


@query("status_text", f"select * from {_STATUS}")
def _(s, d):
    return listings(s, d, "status_raw").select("id", X.status_of(F.col("status_raw")).alias("status"))


_SEX = f"""(select id, case when t like '%female%' or regexp_matches(t, '^f\\b') or ((regexp_matches(t, '\\bf\\b') or t like 'f%') and t like '%spayed%') then 'female' when regexp_matches(t, '\\bmale\\b|^m\\b') then 'male' else 'unknown' end as sex
  from (select id, coalesce({_low("sex")}, '') as t from {LATEST}))"""


@query("sex_text", f"select * from {_SEX}")
def _(s, d):
    return listings(s, d, "sex").select("id", X.sex_of(F.col("sex")).alias("sex"))


_SIZE = f"""(select id, case when regexp_matches(t, 'x[-\\s]?large|extra[-\\s]?large|\\bxl\\b|giant') then 'xlarge' when regexp_matches(t, '\\b(large|lg|l)\\b') then 'large' when regexp_matches(t, '\\b(med|medium|m)\\b') then 'medium'
  when regexp_matches(t, '\\b(small|sm|s|toy|mini)\\b') then 'small' when lbs < 26 then 'small' when lbs <= 60 then 'medium' when lbs <= 99 then 'large' when lbs > 99 then 'xlarge' end as size
  from (select l.id, coalesce({_low("size_raw")}, '') as t, lbs from {LATEST} l join {_LBS} w on w.id = l.id))"""


@query("size_bands", f"select * from {_SIZE}")
def _(s, d):
    return listings(s, d, "size_raw", "weight_raw").select("id", X.size_of(F.col("size_raw"), X.weight_from_text(F.col("weight_raw"))).alias("size"))


def _case(table: dict[str, str], x: str) -> str:
    return f"case {x} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + f" else {x} end"


def _distinct(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


_BREEDS = f"""(select id, t, case when t in ('unknown', 'mixed', 'mixed breed', 'mix') then ['mixed breed'] else {_distinct("p")} end as breeds from (select id, t,
  list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '\\bmix(ed)?( breed)?\\b', '', 'g'), '\\bcross\\b|\\s+and\\s+|\\s*&\\s*', '/', 'g'), '[/,]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''),
  lambda x: {_case(X.BREED_ALIASES, "x")}) as p from (select id, coalesce({_low("breed_raw")}, '') as t from {LATEST})))"""
_LABEL = "case when len(breeds) > 0 then array_to_string(breeds, ' / ') || case when len(breeds) = 1 and regexp_matches(t, '\\bmix(ed)?\\b|\\bcross\\b|\\bx\\b') and t not in ('unknown', 'mixed', 'mixed breed', 'mix') then ' mix' else '' end end"


@query("breed_tokens", f"select id, array_to_string(breeds, '|') as tokens, {_LABEL} as label from {_BREEDS}")
def _(s, d):
    c = F.col("breed_raw")
    return listings(s, d, "breed_raw").select("id", F.array_join(X.breed_tokens(c), "|").alias("tokens"), X.breed_label(c).alias("label"))


_COLORS = f"""(select id, {_distinct("p")} as colors from (select id, list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce({_low("color_raw")}, ''), '\\s+and\\s+|\\s*&\\s*|\\s*-\\s*', '/', 'g'), '[/,]'),
  lambda x: trim(x)), lambda x: x <> ''), lambda x: {_case(X.COLOR_ALIASES, "x")}) as p from {LATEST}))"""


@query("color_tokens", f"select id, array_to_string(colors, '|') as colors from {_COLORS}")
def _(s, d):
    return listings(s, d, "color_raw").select("id", F.array_join(X.split_colors(F.col("color_raw")), "|").alias("colors"))


@query("photo_flags", f"select id, coalesce(regexp_matches(primary_photo_url, '(?i)no[-_ ]?(image|pic|photo)|nopic|placeholder|default[-_.]|image[-_ ]?coming|(photo|image|coming)[-_ ]?soon|generic\\.(svg|png|jpe?g)'), false) as placeholder from {LATEST}")
def _(s, d):
    return listings(s, d, "primary_photo_url").select("id", X.placeholder_photo(F.col("primary_photo_url")).alias("placeholder"))


#: The silver row: every normalised field beside the key and a hash of the content.
_SILVER = f"""select l.id, coalesce(nullif(trim(regexp_replace(source_animal_id, '{_WS}', ' ', 'g')), ''), 'url_' || substr(sha256(original_url), 1, 16)) as listing_key,
  case when nullif(trim(source_animal_id), '') is null then 'original_url' else 'source_animal_id' end as dedupe_method, n.name, a.months, a.bucket, w.lbs, z.size, x.sex, s.status, array_to_string(b.breeds, '|') as breeds, array_to_string(c.colors, '|') as colors,
  case when len(photo_urls) > 0 then sha256(array_to_string(list_sort(list_distinct(list_filter(photo_urls, lambda u: u is not null))), chr(10))) end as photo_hash
  from {LATEST} l join {_NAME} n on n.id = l.id join {_AGE} a on a.id = l.id join {_LBS} w on w.id = l.id join {_SIZE} z on z.id = l.id join {_SEX} x on x.id = l.id join {_STATUS} s on s.id = l.id join {_BREEDS} b on b.id = l.id join {_COLORS} c on c.id = l.id"""


@query("silver_listings", _SILVER)
def _(s, d):
    t = listings(s, d, "source_animal_id", "original_url", "name", "age_raw", "last_seen_at", "weight_raw", "size_raw", "sex", "status_raw", "breed_raw", "color_raw", "photo_urls")
    age, lbs, own = X.age_from_text(F.col("age_raw"), F.col("last_seen_at").cast("timestamp")), X.weight_from_text(F.col("weight_raw")), F.nullif(squish(F.col("source_animal_id")), F.lit(""))
    t = t.withColumns({"a": age, "lbs": lbs})
    return t.select(
        "id", X.listing_key(F.col("source_animal_id"), F.col("original_url")).alias("listing_key"), F.when(own.isNull(), "original_url").otherwise("source_animal_id").alias("dedupe_method"), X.title_name(F.col("name")).alias("name"), "a.months", "a.bucket", "lbs",
        X.size_of(F.col("size_raw"), F.col("lbs")).alias("size"), X.sex_of(F.col("sex")).alias("sex"), X.status_of(F.col("status_raw")).alias("status"), F.array_join(X.breed_tokens(F.col("breed_raw")), "|").alias("breeds"), F.array_join(X.split_colors(F.col("color_raw")), "|").alias("colors"),
        F.when(F.size("photo_urls") > 0, X.set_hash(F.array_compact(F.array_distinct("photo_urls")))).alias("photo_hash"),
    )
