"""Queries on listings, runs, entities and standing searches, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kennelflow.functions import listing as X
from kennelflow.io import cut_lineage, latest_rows, table
from kennelflow.operators import entities as E
from kennelflow.operators import records as R

QUERIES: dict = {}
SQL: dict[str, str] = {}
LATEST = "(select * from dog_listings qualify row_number() over (partition by id order by updated_at desc) = 1)"
GOOD = ("success", "success_with_warnings")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def listings(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return latest_rows(table(spark, d, "dog_listings"), "id", "updated_at", list(cols))


# scans


@query("scan_filtered", "select id, source_id, crawl_scope from source_runs where status = 'success' and run_type in ('daily', 'backfill') and dogs_found > 10")
def _(s, d):
    return table(s, d, "source_runs").filter("status = 'success' and run_type in ('daily', 'backfill') and dogs_found > 10").select("id", "source_id", "crawl_scope")


@query("scan_projected_not_null", "select id, name, primary_photo_url, last_seen_at from dog_listings where primary_photo_url is not null")
def _(s, d):
    return table(s, d, "dog_listings").filter("primary_photo_url is not null").select("id", "name", "primary_photo_url", "last_seen_at")


@query("scan_like", "select distinct id, original_url from dog_listings where original_url like '%.example/dogs/1000%'")
def _(s, d):
    return table(s, d, "dog_listings").filter(F.col("original_url").like("%.example/dogs/1000%")).select("id", "original_url").distinct()


@query("point_lookup", "select id, name, adapter_type from adoption_sources where id = (select min(id) from adoption_sources)")
def _(s, d):
    t = table(s, d, "adoption_sources")
    return t.join(t.agg(F.min("id").alias("id")), "id").select("id", "name", "adapter_type")


@query("json_extract", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# scalar functions on whole columns

_AGE_SQL = "case when age_months_estimate is null then null when age_months_estimate < 12 then 'puppy' when age_months_estimate < 36 then 'young' when age_months_estimate < 96 then 'adult' else 'senior' end"


@query("age_buckets", f"select {_AGE_SQL} as bucket, count(*) as n from {LATEST} group by 1")
def _(s, d):
    return listings(s, d, "age_months_estimate").groupBy(X.age_bucket(F.col("age_months_estimate")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "intake_dates",
    f"""select id, coalesce(case when regexp_matches(intake_date, '^\\d{{4}}-\\d') then date_diff('day', date '1970-01-01', try_cast(intake_date as date))
  when regexp_matches(intake_date, '^\\d{{1,2}}/') then date_diff('day', date '1970-01-01', cast(try_strptime(intake_date, '%m/%d/%Y') as date))
  when regexp_matches(intake_date, '^[A-Za-z]') then date_diff('day', date '1970-01-01', cast(coalesce(try_strptime(intake_date, '%b %d, %Y'), try_strptime(intake_date, '%B %d, %Y')) as date)) end, -1) as day from {LATEST}""",
)
def _(s, d):
    return listings(s, d, "intake_date").select("id", F.coalesce(F.unix_date(X.loose_date(F.col("intake_date"))).cast("bigint"), F.lit(-1)).alias("day"))


@query("listing_keys", "select distinct id, coalesce(nullif(trim(source_animal_id), ''), 'url_' || substr(sha256(original_url), 1, 16)) as key from dog_listings where source_animal_id is not null or original_url is not null")
def _(s, d):
    t = table(s, d, "dog_listings").filter("source_animal_id is not null or original_url is not null")
    return t.select("id", X.listing_key(F.col("source_animal_id"), F.col("original_url")).alias("key")).distinct()


@query("photo_set_hash", f"select id, case when len(photo_urls) > 0 then sha256(array_to_string(list_sort(photo_urls), chr(10))) end as photo_hash from {LATEST}")
def _(s, d):
    return listings(s, d, "photo_urls").select("id", X.set_hash(F.col("photo_urls")).alias("photo_hash"))


@query("text_excerpt", f"select id, case when length(t) > 60 then substr(t, 1, 59) || '…' else t end as excerpt from (select id, trim(regexp_replace(description, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{A0}}]+', ' ', 'g')) as t from {LATEST})")
def _(s, d):
    return listings(s, d, "description").select("id", X.excerpt(F.col("description"), 60).alias("excerpt"))


@query("days_listed", f"select id, date_diff('microsecond', first_seen_at, last_seen_at) // 86400000000 as days from {LATEST}")
def _(s, d):
    return listings(s, d, "first_seen_at", "last_seen_at").select("id", X.days_since(F.col("first_seen_at").cast("timestamp"), F.col("last_seen_at").cast("timestamp")).alias("days"))


# joins


@query("listing_source_join", f"select l.id, l.source_id, s.name as source_name, coalesce(l.city, s.city) as place, l.city is not null as own_place from {LATEST} l join adoption_sources s on s.id = l.source_id")
def _(s, d):
    src = table(s, d, "adoption_sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("city").alias("source_city"))
    # small by its measured size, so Catalyst broadcasts it and the skew of source_id costs nothing
    return listings(s, d, "source_id", "city").join(src, "source_id").select("id", "source_id", "source_name", F.coalesce("city", "source_city").alias("place"), F.col("city").isNotNull().alias("own_place"))


@query(
    "latest_run_per_source",
    """select s.id as source_id, coalesce(r.id, 0) as run_id, r.status from adoption_sources s left join
  (select * from source_runs qualify row_number() over (partition by source_id order by started_at desc, id desc) = 1) r on r.source_id = s.id""",
)
def _(s, d):
    last = table(s, d, "source_runs").groupBy("source_id").agg(F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("r"))
    return table(s, d, "adoption_sources").select(F.col("id").alias("source_id")).join(last, "source_id", "left").select("source_id", F.coalesce("r.id", F.lit(0)).alias("run_id"), F.col("r.status").alias("status"))


@query("latest_good_run", "select source_id, id as run_id, dogs_found from source_runs where status in ('success', 'success_with_warnings') qualify row_number() over (partition by source_id order by started_at desc, id desc) = 1")
def _(s, d):
    good = table(s, d, "source_runs").filter(F.col("status").isin(*GOOD)).select("source_id", F.col("id").alias("run_id"), "dogs_found", "started_at")
    return R.pick_by(good, ["source_id"], [F.desc("started_at"), F.desc("run_id")]).drop("started_at")


@query("dogs_per_source", f"select s.id as source_id, count(l.id) as listings, count(case when l.status_normalized = 'available' then 1 end) as available from adoption_sources s left join {LATEST} l on l.source_id = s.id group by s.id having count(l.id) > 0")
def _(s, d):
    # partial sums per source before the join: a source with a third of all listings sends one row a task
    n = listings(s, d, "source_id", "status_normalized").groupBy("source_id").agg(F.count("*").alias("listings"), F.count_if(F.col("status_normalized") == "available").alias("available"))
    return table(s, d, "adoption_sources").select(F.col("id").alias("source_id")).join(n, "source_id")


@query("unlisted_documents", "select doc_id, listing_id from documents d where listing_id is not null and not exists (select 1 from dog_listings l where l.id = d.listing_id)")
def _(s, d):
    docs = table(s, d, "documents").filter("listing_id is not null").select("doc_id", "listing_id")
    return docs.join(table(s, d, "dog_listings").select(F.col("id").alias("listing_id")), "listing_id", "left_anti").select("doc_id", "listing_id")


@query("listed_documents", "select doc_id, listing_id from documents d where exists (select 1 from dog_listings l where l.id = d.listing_id)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "listing_id").join(table(s, d, "dog_listings").select(F.col("id").alias("listing_id")), "listing_id", "left_semi").select("doc_id", "listing_id")


@query("photo_pairs", f"""select u as url, min(id) as first_id, max(id) as other_id from (select distinct id, primary_photo_url as u from {LATEST} where primary_photo_url is not null) group by u having count(*) = 2""")
def _(s, d):
    return listings(s, d, "primary_photo_url").filter("primary_photo_url is not null").groupBy(F.col("primary_photo_url").alias("url")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("other_id")).filter("n = 2").drop("n")


# aggregations


@query("status_counts", f"select status_normalized as status, count(*) as n from {LATEST} group by 1")
def _(s, d):
    return listings(s, d, "status_normalized").groupBy(F.col("status_normalized").alias("status")).agg(F.count("*").alias("n"))


_FIELDS = ["name", "breed_raw", "age_raw", "weight_raw", "color_raw", "description", "primary_photo_url", "latitude"]


@query("completeness", " union all ".join(f"select '{c}' as field, count({c}) as filled, count(*) as total from {LATEST}" for c in _FIELDS))
def _(s, d):
    return R.completeness(listings(s, d, *_FIELDS), _FIELDS)


@query("bounding_box", f"select min(latitude) as south, max(latitude) as north, min(longitude) as west, max(longitude) as east from {LATEST} where abs(latitude) <= 90 and abs(longitude) <= 180")
def _(s, d):
    t = listings(s, d, "latitude", "longitude").filter("abs(latitude) <= 90 and abs(longitude) <= 180")
    return t.agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


@query("recently_first_seen", f"select id from {LATEST} where first_seen_at >= (select max(first_seen_at) - interval 3 hour from dog_listings)")
def _(s, d):
    t = listings(s, d, "first_seen_at")
    last = table(s, d, "dog_listings").agg(F.max("first_seen_at").alias("m"))
    # the other side is one row
    return t.join(F.broadcast(last), F.col("first_seen_at") >= F.col("m") - F.expr("interval 3 hours")).select("id")


@query("run_totals", "select source_id, count(*) as runs, cast(sum(new_dogs) as bigint) as new_dogs, cast(sum(missing_dogs) as bigint) as missing_dogs, count(case when status = 'failed' then 1 end) as failed from source_runs group by source_id")
def _(s, d):
    return table(s, d, "source_runs").groupBy("source_id").agg(F.count("*").alias("runs"), F.sum("new_dogs").alias("new_dogs"), F.sum("missing_dogs").alias("missing_dogs"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("longest_text_per_source", "select source, doc_id, len from (select source, doc_id, length(text) as len from documents) qualify row_number() over (partition by source order by len desc, doc_id) = 1")
def _(s, d):
    t = table(s, d, "documents").select("source", "doc_id", F.length("text").cast("bigint").alias("len"))
    return t.groupBy("source").agg(F.max_by(F.struct("doc_id", "len"), F.struct("len", -F.col("doc_id"))).alias("b")).select("source", "b.doc_id", "b.len")


@query(
    "duplicates_per_entity",
    f"select canonical_dog_id, id, n as members, place from (select canonical_dog_id, id, count(*) over (partition by canonical_dog_id) as n, row_number() over (partition by canonical_dog_id order by id) as place from {LATEST} where canonical_dog_id is not null) where n > 1",
)
def _(s, d):
    """A row per member with its place, and not a list per entity, since an entity may have any number of members."""
    t = listings(s, d, "canonical_dog_id").filter("canonical_dog_id is not null")
    g = t.groupBy("canonical_dog_id").agg(F.count("*").alias("members")).filter("members > 1")
    place = F.row_number().over(Window.partitionBy("canonical_dog_id").orderBy("id"))
    return t.join(g, "canonical_dog_id").select("canonical_dog_id", "id", "members", place.cast("bigint").alias("place"))


# windows and top-k


@query("representative", f"""select canonical_dog_id, id from {LATEST} where canonical_dog_id is not null qualify row_number() over (partition by canonical_dog_id
  order by (missed_run_count = 0) desc, (primary_photo_url is not null) desc, coalesce(length(description), 0) desc, last_seen_at desc, id) = 1""")
def _(s, d):
    t = listings(s, d, "canonical_dog_id", "missed_run_count", "primary_photo_url", "description", "last_seen_at").filter("canonical_dog_id is not null")
    # the text is reduced to its length before the exchange of the ranking
    t = t.select("canonical_dog_id", "id", (F.col("missed_run_count") == 0).alias("active"), F.col("primary_photo_url").isNotNull().alias("photo"), F.coalesce(F.length("description"), F.lit(0)).alias("len"), "last_seen_at")
    return R.pick_by(t, ["canonical_dog_id"], [F.desc("active"), F.desc("photo"), F.desc("len"), F.desc("last_seen_at"), F.asc("id")]).select("canonical_dog_id", "id")


@query("previous_event", "select event_id, user_id, lag(event_type) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts, event_id) as n from events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("before"), F.row_number().over(w).cast("bigint").alias("n"))


@query("top_parts_per_type", "select p_type, p_partkey, cast(row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as bigint) as rank from part qualify rank <= 3")
def _(s, d):
    return R.top_per_group(table(s, d, "part"), ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_type", "p_partkey", F.col("rank").cast("bigint").alias("rank"))


@query("revenue_by_nation", """select n_name, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def _(s, d):
    j = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("double").alias("revenue"))


# set operations


@query("url_sets", f"""select url from (select primary_photo_url as url from {LATEST} where primary_photo_url is not null union select unnest(photo_urls) from {LATEST}) where url is not null
  except select unnest(photo_urls) from {LATEST} where status_normalized = 'available'""")
def _(s, d):
    t = listings(s, d, "primary_photo_url", "photo_urls", "status_normalized")
    every = t.select(F.col("primary_photo_url").alias("url")).union(t.select(F.explode("photo_urls"))).filter("url is not null")
    return every.subtract(t.filter("status_normalized = 'available'").select(F.explode("photo_urls").alias("url")))


# mutations


@query("upsert_listings", """select id, coalesce(i.status, a.status) as status, coalesce(a.created_at, i.created_at) as created_at from
  (select id, status_normalized as status, created_at from dog_listings qualify row_number() over (partition by id order by updated_at) = 1) a full join
  (select id, status_normalized as status, created_at from dog_listings qualify row_number() over (partition by id order by updated_at desc) = 1) i using (id)""")
def _(s, d):
    t = table(s, d, "dog_listings").select("id", F.col("status_normalized").alias("status"), "created_at", "updated_at")
    old = R.pick_by(t, ["id"], [F.asc("updated_at")]).drop("updated_at")
    new = R.pick_by(t, ["id"], [F.desc("updated_at")]).drop("updated_at")
    return R.upsert(old, new, ["id"], keep=["created_at"])


_COMPARED = ["name", "breed_raw", "age_raw", "weight_raw", "status_raw"]


@query(
    "change_classes",
    f"""with r as (select id as run_id, row_number() over (partition by source_id, crawl_scope order by started_at desc, id desc) as back from source_runs where status in ('success', 'success_with_warnings')),
s as (select back, source_id, listing_key, {", ".join(_COMPARED)} from dog_listing_snapshots join r using (run_id) where back <= 2 qualify row_number() over (partition by run_id, source_id, listing_key order by extracted_at desc) = 1),
o as (select * from s where back = 2), n as (select * from s where back = 1)
select source_id, listing_key, case when o.back is null then 'inserted' when n.back is null then 'missing' when {" and ".join(f"o.{c} is not distinct from n.{c}" for c in _COMPARED)} then 'unchanged' else 'updated' end as outcome from o full join n using (source_id, listing_key)""",
)
def _(s, d):
    """The last two complete deliveries of every scope, compared as they are."""
    w = Window.partitionBy("source_id", "crawl_scope").orderBy(F.desc("started_at"), F.desc("id"))
    runs = table(s, d, "source_runs").filter(F.col("status").isin(*GOOD)).select(F.col("id").alias("run_id"), F.row_number().over(w).alias("back")).filter("back <= 2")
    rows = table(s, d, "dog_listing_snapshots").select("run_id", "source_id", "listing_key", "extracted_at", *_COMPARED).join(runs, "run_id")
    key = ["run_id", "back", "source_id", "listing_key"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*_COMPARED), "extracted_at").alias("r")).select(*key, "r.*")
    last = cut_lineage(last)
    return R.classify_changes(last.filter("back = 2"), last.filter("back = 1"), ["source_id", "listing_key"], _COMPARED)


@query("cascade_delete", "select e.event_id from events e where exists (select 1 from customer c where c.c_custkey = e.user_id and c.c_mktsegment <> 'BUILDING')")
def _(s, d):
    gone = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    left = R.delete_keys(table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), gone, ["user_id"])
    return table(s, d, "events").select("event_id", "user_id").join(left, "user_id", "left_semi").select("event_id")


# lifecycle, quality, entities


@query(
    "missed_runs",
    f"""with runs as (select distinct source_id, crawl_scope, started_at as ran_at from source_runs where status in ('success', 'success_with_warnings'))
select l.id, cast(count(r.ran_at) as integer) as missed, min(r.ran_at) as missing_since,
  case when count(r.ran_at) >= 4 then 'likely_unavailable' when count(r.ran_at) >= 2 then 'missing_multiple_runs' when count(r.ran_at) = 1 then 'missing_once' else 'still_seen' end as stale
from {LATEST} l left join runs r on r.source_id = l.source_id and r.crawl_scope = l.crawl_scope and r.ran_at > l.last_seen_at group by l.id""",
)
def _(s, d):
    seen = listings(s, d, "source_id", "crawl_scope", "last_seen_at")
    runs = table(s, d, "source_runs").filter(F.col("status").isin(*GOOD)).select("source_id", "crawl_scope", F.col("started_at").alias("ran_at"))
    m = R.missed_runs(seen, runs, ["source_id", "crawl_scope"])
    return m.select("id", "missed", "missing_since", R.stale_status(F.col("missed"), F.lit(False)).alias("stale"))


@query("photo_components", f"""with recursive p as (select distinct id, u from (select id, unnest(photo_urls) as u from {LATEST}) where u is not null),
rare as (select u from p group by u having count(*) = 2), e as (select min(id) as a, max(id) as b from p join rare using (u) group by u),
both_ways as (select a, b from e union select b, a from e),
reach as (select a as node, a as other from both_ways union select node, b from reach join both_ways on a = other)
select node, min(other) as component from reach group by node""")
def _(s, d):
    p = listings(s, d, "photo_urls").select("id", F.explode("photo_urls").alias("u")).filter("u is not null").distinct()
    e = p.groupBy("u").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n = 2")
    return R.connected_components(e.select("a", "b"))


@query("listing_components")
def _(s, d):
    """Every listing with the least listing of its dog: shared photos and the rules for equal names."""
    t = listings(s, d, "source_id", "name", "sex", "breed_raw", "breed_normalized", "age_months_estimate", "primary_photo_url")
    name = X.title_name(F.col("name"))
    placeholder = X.placeholder_name(name)
    rows = t.select(
        "id", F.col("source_id").alias("source"), F.lower(name).alias("name"), placeholder.alias("placeholder"), F.lower(F.trim("sex")).alias("sex"),
        X.breed_tokens(F.coalesce("breed_raw", "breed_normalized")).alias("tokens"), F.col("age_months_estimate").alias("age"), F.col("primary_photo_url").alias("photo"),
    )
    rows = cut_lineage(rows)
    c = R.connected_components(E.photo_edges(rows).union(E.name_edges(rows)))
    return rows.select("id").join(c.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("source_registry", "select id, name, adapter_type, enabled from adoption_sources order by id")
def _(s, d):
    return table(s, d, "adoption_sources").select("id", "name", "adapter_type", "enabled")


@query(
    "geojson",
    f"""select id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || cast(cast(floor(longitude * 1e5 + 0.5) as bigint) as varchar) || ',' || cast(cast(floor(latitude * 1e5 + 0.5) as bigint) as varchar) || ']}},"properties":{{"id":' || to_json(id) || ',"name":' || coalesce(to_json(name), 'null') || '}}}}' as feature
  from {LATEST} where latitude is not null and longitude is not null""",
)
def _(s, d):
    """A point feature per listing with a place; coordinates in units of 1e-5 degrees, so that every engine writes them alike."""
    t = listings(s, d, "latitude", "longitude", "name").filter("latitude is not null and longitude is not null")
    units = lambda c: F.floor(F.col(c) * 1e5 + 0.5)
    point = F.struct(F.lit("Point").alias("type"), F.array(units("longitude"), units("latitude")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("id", "name").alias("properties"))
    return t.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))
