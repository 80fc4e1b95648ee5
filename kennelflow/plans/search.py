"""Standing searches against listings: matches with reasons, radius, ranking, new matches; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kennelflow.io import cut_lineage, table
from kennelflow.operators import matching as Q
from kennelflow.operators import models as O
from kennelflow.operators import records as R
from kennelflow.plans.listings import LATEST, listings

QUERIES: dict = {}
SQL: dict[str, str] = {}
SHORTLIST, ALERTS = 40, 12


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _matches(s: SparkSession, d: str) -> DataFrame:
    """Matches of the active watches, kept: the queries rank and join them."""
    w = Q.parse_criteria(table(s, d, "watches").filter("active").select("id", "parsed", "latitude", "longitude"))
    return cut_lineage(Q.match_all(Q.match_input(listings(s, d, *Q.INPUT)), w))


def _list(k: str) -> str:
    return f"coalesce(from_json(json_extract(parsed, '$.{k}'), '[\"VARCHAR\"]'), [])"


_SIZE = """case when regexp_matches(z, 'x[-\\s]?large|extra[-\\s]?large|\\bxl\\b|giant') then 'xlarge' when regexp_matches(z, '\\b(large|lg|l)\\b') then 'large' when regexp_matches(z, '\\b(med|medium|m)\\b') then 'medium' when regexp_matches(z, '\\b(small|sm|s|toy|mini)\\b') then 'small'
  when lbs < 26 then 'small' when lbs <= 60 then 'medium' when lbs <= 99 then 'large' when lbs > 99 then 'xlarge' end"""
_M = f"""w as (select id as watch_id, {_list("breedIncludes")} as breeds, {_list("sizes")} as sizes, {_list("keywords")} as keywords, coalesce(cast(json_extract(parsed, '$.excludePuppies') as boolean), false) as no_puppies,
  try_cast(json_extract_string(parsed, '$.maxWeightLbs') as double) as max_lbs, case when abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0) then latitude end as qlat, longitude as qlon,
  try_cast(json_extract_string(parsed, '$.maxDistanceMiles') as double) as radius from watches where active),
l0 as (select *, age_months_estimate as months, weight_lbs_estimate as lbs, coalesce(lower(trim(size_raw)), '') as z, case when abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0) then latitude end as lat, longitude as lon from {LATEST}),
l as (select *, trim(lower(concat_ws(' ', breed_normalized, breed_raw))) as breed, {_SIZE} as size, lower(concat_ws(' ', name, breed_normalized, breed_raw, description)) as hay from l0),
p as (select w.*, l.*, case when qlat is not null and radius is not null then true else false end as by_place, 2 * 3958.7613 * asin(sqrt(least(1, pow(sin(radians(lat - qlat) / 2), 2) + cos(radians(qlat)) * cos(radians(lat)) * pow(sin(radians(lon - qlon) / 2), 2)))) as miles from w, l),
t as (select *, case when len(breeds) > 0 then case when breed = '' then 'u' when len(list_filter(breeds, lambda b: contains(breed, lower(b)))) > 0 then 'r' else 'f' end end as t1,
  case when no_puppies then case when coalesce(months < 12, false) or coalesce(regexp_matches(lower(age_raw), '\\bpupp'), false) then 'f' when months is null and coalesce(age_raw, '') = '' then 'u' else 'r' end end as t2,
  case when len(sizes) > 0 then case when size is null then 'u' when list_contains(sizes, size) then 'r' else 'f' end end as t3,
  case when max_lbs is not null then case when lbs is null then 'u' when lbs <= max_lbs then 'r' else 'f' end end as t4,
  case when by_place then case when lat is null then 'u' when miles <= radius then 'r' else 'f' end end as t5 from p),
v as (select *, concat_ws('|', case when t1 = 'r' then 'breed' end, case when t2 = 'r' then 'no_puppy' end, case when t3 = 'r' then 'size' end, case when t4 = 'r' then 'weight' end, case when t5 = 'r' then 'distance' end) as reasons,
  concat_ws('|', case when t1 = 'u' then 'breed' end, case when t2 = 'u' then 'no_puppy' end, case when t3 = 'u' then 'size' end, case when t4 = 'u' then 'weight' end, case when t5 = 'u' then 'distance' end) as unknowns from t
  where not coalesce(t1 = 'f', false) and not coalesce(t2 = 'f', false) and not coalesce(t3 = 'f', false) and not coalesce(t4 = 'f', false) and not coalesce(t5 = 'f', false)),
m as (select watch_id, id, name, reasons, unknowns, miles, case when description is null then 0 else 1 end as rich, primary_photo_url, status_normalized as status, stale_status, first_seen_at,
  (case when reasons = '' then 0 else len(string_split(reasons, '|')) end) + len(list_filter(keywords, lambda k: contains(hay, lower(trim(k))))) + (case when stale_status in ('available', 'still_seen') then 0.5 else 0 end) + (case when status_normalized = 'available' then 0.5 else 0 end) as score from v)"""
_ORDER = "score desc, miles asc nulls last, rich desc, name asc nulls first, id"


@query("match_criteria", f"with {_M} select watch_id, id, reasons, unknowns, cast(score as double) as score from m")
def _(s, d):
    return _matches(s, d).select("watch_id", "id", F.array_join("reasons", "|").alias("reasons"), F.array_join("unknowns", "|").alias("unknowns"), "score")


@query("search_matches", f"with {_M} select watch_id, cast(count(*) as bigint) as matches, cast(count(case when unknowns = '' then 1 end) as bigint) as certain from m group by watch_id")
def _(s, d):
    return _matches(s, d).groupBy("watch_id").agg(F.count("*").alias("matches"), F.count_if(F.size("unknowns") == 0).alias("certain"))


@query("radius_filter", f"with {_M} select watch_id, id, floor(miles * 1000 + 0.5) / 1000 as miles from m where reasons like '%distance%'")
def _(s, d):
    m = _matches(s, d).filter(F.array_contains("reasons", "distance"))
    return m.select("watch_id", "id", (F.floor(F.col("miles") * 1000 + 0.5) / 1000).alias("miles"))


@query("ranked_search", f"with {_M} select watch_id, id, cast(row_number() over (partition by watch_id order by {_ORDER}) as integer) as rank from m qualify rank <= {SHORTLIST}")
def _(s, d):
    return R.top_per_group(_matches(s, d), ["watch_id"], Q.ranking(), SHORTLIST).select("watch_id", "id", "rank")


@query(
    "watch_topn",
    f"""with {_M} select m.watch_id, m.id, cast(row_number() over (partition by m.watch_id order by {_ORDER}) as integer) as rank from m join (select id as wid, label, last_notified_at from watches) w on w.wid = m.watch_id
  where (w.last_notified_at is null or m.first_seen_at > w.last_notified_at) and primary_photo_url is not null and status = 'available' and stale_status in ('available', 'still_seen', 'missing_once') qualify rank <= {ALERTS}""",
)
def _(s, d):
    """The best new matches of each watch: what it could have been told before is in the ledger."""
    m = _matches(s, d)
    told = table(s, d, "watches").select(F.col("id").alias("watch_id"), "last_notified_at")
    ledger = m.join(told, "watch_id").filter("first_seen_at <= last_notified_at").select("watch_id", "id")
    return R.top_per_group(Q.new_matches(m, ledger), ["watch_id"], Q.ranking(), ALERTS).select("watch_id", "id", "rank")


@query("saved_search_names", f"with {_M} select id, count(*) as searches, min(label) as first_label from m join (select id as wid, label, last_notified_at from watches) w on w.wid = m.watch_id where reasons <> '' group by m.id")
def _(s, d):
    """How many searches each listing strongly matches: nothing fails and something holds."""
    m = _matches(s, d).filter(F.size("reasons") > 0).join(table(s, d, "watches").select(F.col("id").alias("watch_id"), "label"), "watch_id")
    return m.groupBy("id").agg(F.count("*").alias("searches"), F.min("label").alias("first_label"))


@query(
    "criteria_chips",
    "select id as watch_id, concat_ws(', ', nullif(array_to_string(" + _list("breedIncludes") + ", '/'), ''), nullif(array_to_string(" + _list("sizes") + ", '/'), ''), case when cast(json_extract(parsed, '$.excludePuppies') as boolean) then 'no puppies' end, "
    "'to ' || cast(cast(try_cast(json_extract_string(parsed, '$.maxWeightLbs') as double) as bigint) as varchar) || ' lb') as chips from watches",
)
def _(s, d):
    w = Q.parse_criteria(table(s, d, "watches").select("id", "parsed", "latitude", "longitude"))
    text = lambda k: F.nullif(F.array_join(f"c.{k}", "/"), F.lit(""))
    pounds = F.concat(F.lit("to "), F.col("c.maxWeightLbs").cast("bigint").cast("string"), F.lit(" lb"))
    return w.select("watch_id", F.concat_ws(", ", text("breedIncludes"), text("sizes"), F.when(F.col("c.excludePuppies"), "no puppies"), pounds).alias("chips"))


def _stub(query: str, candidates: list[dict]) -> dict:
    """A stand-in for a model that chooses: every candidate of even place."""
    return {"alerts": [{"id": c["id"], "headline": c["block"]} for c in candidates[1::2]]}


_NEW = f"""new as (select m.watch_id, m.id, row_number() over (partition by m.watch_id order by {_ORDER}) as rank from m join (select id as wid, last_notified_at from watches) w on w.wid = m.watch_id
  where (w.last_notified_at is null or m.first_seen_at > w.last_notified_at) and primary_photo_url is not null and status = 'available' and stale_status in ('available', 'still_seen', 'missing_once') qualify rank <= {ALERTS})"""


def _overnight(s: SparkSession, d: str, model=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    new = QUERIES["watch_topn"](s, d).withColumn("block", F.col("id"))
    requests = table(s, d, "watches").select(F.col("id").alias("watch_id"), "query")
    return O.overnight(new, requests, new.select("watch_id", "id").limit(0), model)


@query("overnight_alerts", f"with {_M}, {_NEW} select watch_id, id, cast(rank as integer) as place from new where rank <= 5")
def _(s, d):
    return _overnight(s, d)[0].select("watch_id", "id", "place")


@query("overnight_summary", f"with {_M}, {_NEW} select watch_id, count(*) as candidates, least(count(*), 5) as told from new group by 1")
def _(s, d):
    return _overnight(s, d)[2]


@query("curated_alerts", f"with {_M}, {_NEW} select watch_id, id, cast(rank // 2 as integer) as place, id as headline from new where rank % 2 = 0")
def _(s, d):
    """As overnight_alerts, with a deterministic stand-in for the model that chooses."""
    return _overnight(s, d, _stub)[0].select("watch_id", "id", "place", "headline")


@query(
    "reranked_search",
    f"""with {_M}, r as (select watch_id, id, row_number() over (partition by watch_id order by {_ORDER}) as rank from m qualify rank <= {SHORTLIST}), f as (select *, case when (rank - 1) % 5 < 3 then length(id) end as fit from r)
select watch_id, id, cast(row_number() over (partition by watch_id order by fit is null, fit desc, rank) as integer) as place from f""",
)
def _(s, d):
    """The shortlist judged in chunks by a deterministic stand-in: the first three of each chunk fit by the length of their id."""
    ranked = R.top_per_group(_matches(s, d), ["watch_id"], Q.ranking(), SHORTLIST).select("watch_id", "id", "rank", F.col("id").alias("block"))
    ranked = cut_lineage(ranked)
    requests = table(s, d, "watches").select(F.col("id").alias("watch_id"), "query")
    fits = O.judged(ranked, requests, lambda query, xs: [{"id": x["id"], "score": len(x["id"])} for x in xs[:3]])
    return O.reranked(ranked, fits).select("watch_id", "id", "place")
