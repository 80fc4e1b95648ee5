"""Browsing, dashboards, batch updates and small set operations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from kennelflow.functions import listing as X
from kennelflow.io import table
from kennelflow.operators import records as R
from kennelflow.plans.listings import LATEST, listings

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Records in one batch of an update.
BATCH = 200
PRIORITIES = ["critical", "high", "medium", "low"]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_HAY = "lower(concat_ws(' ', l.name, l.breed_raw, l.breed_normalized, coalesce(l.city, s.city), l.shelter_name, l.description))"


@query(
    "browse_filter",
    f"""select l.id from {LATEST} l join adoption_sources s on s.id = l.source_id where contains({_HAY}, 'terrier') and l.sex in ('male', 'female') and coalesce(l.age_months_estimate >= 12, false)
  and (l.weight_lbs_estimate is null or l.weight_lbs_estimate <= 60) and l.primary_photo_url is not null and coalesce(l.good_with_dogs, true)""",
)
def _(s, d):
    """A conjunction of optional predicates with a substring search over the joined texts of a listing."""
    t = listings(s, d, "source_id", "name", "breed_raw", "breed_normalized", "city", "shelter_name", "description", "sex", "age_months_estimate", "weight_lbs_estimate", "primary_photo_url", "good_with_dogs")
    src = table(s, d, "adoption_sources").select(F.col("id").alias("source_id"), F.col("city").alias("_city"))
    # what the columns decide is decided before the join
    t = t.filter("sex in ('male', 'female') and age_months_estimate >= 12 and (weight_lbs_estimate is null or weight_lbs_estimate <= 60) and primary_photo_url is not null and coalesce(good_with_dogs, true)")
    hay = F.lower(F.concat_ws(" ", "name", "breed_raw", "breed_normalized", F.coalesce("city", "_city"), "shelter_name", "description"))
    return t.join(src, "source_id").filter(F.contains(hay, F.lit("terrier"))).select("id")


_BAD = "(select photo as url from (select primary_photo_url as photo, count(distinct id) as n from dog_listings where primary_photo_url is not null group by 1) where n > 2 or regexp_matches(photo, '(?i)no[-_ ]?(image|pic|photo)|nopic|placeholder|default[-_.]|image[-_ ]?coming|(photo|image|coming)[-_ ]?soon|generic\\.(svg|png|jpe?g)'))"


def _bad_photos(s, d):
    """Pictures that show no one dog: stand-ins by their address, and those of more than two listings."""
    p = table(s, d, "dog_listings").filter("primary_photo_url is not null").select(F.col("primary_photo_url").alias("url"), "id").distinct()
    n = p.groupBy("url").agg(F.count("*").alias("n"))
    return n.filter((F.col("n") > 2) | X.placeholder_photo(F.col("url"))).select("url")


@query("displayable", f"select id from {LATEST} l where primary_photo_url is not null and not exists (select 1 from {_BAD} b where b.url = l.primary_photo_url)")
def _(s, d):
    return listings(s, d, "primary_photo_url").filter("primary_photo_url is not null").join(_bad_photos(s, d), F.col("primary_photo_url") == F.col("url"), "left_anti").select("id")


@query("photo_prune", f"select id, case when b.url is null then primary_photo_url end as primary_photo_url, b.url is not null as pruned from {LATEST} l left join {_BAD} b on b.url = l.primary_photo_url")
def _(s, d):
    """The table after an update that takes away bad pictures, whatever their number: one join instead of batches of keys."""
    j = listings(s, d, "primary_photo_url").join(_bad_photos(s, d), F.col("primary_photo_url") == F.col("url"), "left")
    return j.select("id", F.when(F.col("url").isNull(), F.col("primary_photo_url")).alias("primary_photo_url"), F.col("url").isNotNull().alias("pruned"))


@query("update_batches", f"select url, cast((row_number() over (order by url) - 1) // {BATCH} as bigint) as batch from {_BAD}")
def _(s, d):
    """Keys cut into batches of a fixed size in their order."""
    return R.global_rank(_bad_photos(s, d), [F.asc("url")], "n").select("url", F.floor((F.col("n") - 1) / BATCH).cast("bigint").alias("batch"))


@query("url_rewrite", f"select id, case when regexp_matches(original_url, '^https?://[^/]+/.+$') then regexp_replace(original_url, '^https?://([^/]+)/(.+)$', 'https://listings.example/\\1?path=\\2') else original_url end as url from {LATEST}")
def _(s, d):
    c = F.col("original_url")
    return listings(s, d, "original_url").select("id", F.when(c.rlike("^https?://[^/]+/.+$"), F.regexp_replace(c, "^https?://([^/]+)/(.+)$", r"https://listings.example/$1?path=$2")).otherwise(c).alias("url"))


@query("toggle_flags", "select id, not coalesce(enabled, false) as enabled from adoption_sources where priority = 'low' union all select id, enabled from adoption_sources where priority is distinct from 'low'")
def _(s, d):
    return table(s, d, "adoption_sources").select("id", F.when(F.coalesce(F.col("priority") == "low", F.lit(False)), ~F.coalesce("enabled", F.lit(False))).otherwise(F.col("enabled")).alias("enabled"))


@query("insert_ignore", "select id, v from (select id, updated_at as v, row_number() over (partition by id order by updated_at) as n from dog_listings) where n = 1")
def _(s, d):
    """Versions written in their order, of which the first stays: oldest versions stored, all versions coming in."""
    t = table(s, d, "dog_listings").filter("id is not null").select("id", F.col("updated_at").alias("v"))
    oldest = t.groupBy("id").agg(F.min("v").alias("v"))
    return R.insert_ignore(oldest, t, ["id"])


@query(
    "merged_details",
    f"""select n.id, coalesce(n.description, o.description) as description, coalesce(nullif(n.breed_normalized, 'unknown'), o.breed_normalized, n.breed_normalized) as breed, coalesce(n.weight_lbs_estimate, o.weight_lbs_estimate) as lbs
  from {LATEST} n join (select * from dog_listings qualify row_number() over (partition by id order by updated_at) = 1) o using (id)""",
)
def _(s, d):
    """What was known stays where the newer version says nothing."""
    t = table(s, d, "dog_listings").filter("id is not null")
    cols = ["description", "breed_normalized", "weight_lbs_estimate"]
    g = t.groupBy("id").agg(F.max_by(F.struct(*cols), "updated_at").alias("new"), F.min_by(F.struct(*cols), "updated_at").alias("old"))
    old, new = ({c: F.col(f"{side}.{c}") for c in cols} for side in ("old", "new"))
    m = R.merge_details(old, new, F.lit(True), X.informative)
    return g.select("id", m["description"].alias("description"), m["breed_normalized"].alias("breed"), m["weight_lbs_estimate"].alias("lbs"))


@query("content_hash", f"select id, sha256(concat_ws(chr(31), coalesce(age_raw, chr(30)), coalesce(breed_raw, chr(30)), coalesce(color_raw, chr(30)), coalesce(name, chr(30)), coalesce(status_raw, chr(30)), coalesce(weight_raw, chr(30)))) as hash from {LATEST}")
def _(s, d):
    """One hash over the content fields in the order of their names; null is told from ''."""
    cols = sorted(["name", "breed_raw", "age_raw", "weight_raw", "color_raw", "status_raw"])
    return listings(s, d, *cols).select("id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x1e")) for c in cols]), 256).alias("hash"))


@query("source_order", f"select id, cast(row_number() over (order by coalesce(enabled, false) desc, case priority when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 9 end, name, id) as bigint) as place from adoption_sources")
def _(s, d):
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0)), F.lit(10))
    t = table(s, d, "adoption_sources").select("id", F.coalesce("enabled", F.lit(False)).alias("on"), rank.alias("rank"), "name")
    return R.global_rank(t, [F.desc("on"), F.asc("rank"), F.asc_nulls_last("name"), F.asc("id")], "place").select("id", "place")


@query("sources_by_listings", f"select source_id, n, cast(row_number() over (order by n desc, source_id) as bigint) as place from (select source_id, count(*) as n from {LATEST} group by 1)")
def _(s, d):
    return R.global_rank(listings(s, d, "source_id").groupBy("source_id").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("source_id")], "place")


@query(
    "source_stats",
    """select count(*) as sources, count(case when enabled then 1 end) as enabled, count(case when initialized_for_daily_monitoring then 1 end) as ready, count(case when r.status in ('success', 'success_with_warnings') then 1 end) as good, count(case when r.status is null then 1 end) as never_read,
  count(case when s.priority in ('critical', 'high') then 1 end) as urgent from adoption_sources s left join (select source_id, status from source_runs qualify row_number() over (partition by source_id order by started_at desc, id desc) = 1) r on r.source_id = s.id""",
)
def _(s, d):
    last = table(s, d, "source_runs").groupBy("source_id").agg(F.max_by("status", F.struct("started_at", "id")).alias("status"))
    j = table(s, d, "adoption_sources").select(F.col("id").alias("source_id"), "enabled", "initialized_for_daily_monitoring", "priority").join(last, "source_id", "left")
    return j.agg(
        F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"), F.count_if("initialized_for_daily_monitoring").alias("ready"), F.count_if(F.col("status").isin("success", "success_with_warnings")).alias("good"),
        F.count_if(F.col("status").isNull()).alias("never_read"), F.count_if(F.col("priority").isin("critical", "high")).alias("urgent"),
    )


@query("uncertain_sources", "select s.id, not coalesce(s.initialized_for_daily_monitoring, false) or r.status is null or r.status not in ('success', 'success_with_warnings') as uncertain from adoption_sources s left join (select source_id, status from source_runs qualify row_number() over (partition by source_id order by started_at desc, id desc) = 1) r on r.source_id = s.id")
def _(s, d):
    last = table(s, d, "source_runs").groupBy("source_id").agg(F.max_by("status", F.struct("started_at", "id")).alias("status"))
    j = table(s, d, "adoption_sources").select("id", "initialized_for_daily_monitoring").join(last, F.col("id") == F.col("source_id"), "left")
    return j.select("id", (~F.coalesce("initialized_for_daily_monitoring", F.lit(False)) | ~F.coalesce(F.col("status").isin("success", "success_with_warnings"), F.lit(False))).alias("uncertain"))


@query("newest_watches", "select id, cast(row_number() over (order by created_at desc, id desc) as bigint) as place, active and row_number() over (partition by active order by created_at desc, id desc) = 1 as newest_active from watches")
def _(s, d):
    t = table(s, d, "watches").select("id", "created_at", "active")
    top = t.filter("active").orderBy(F.desc("created_at"), F.desc("id")).limit(1).select(F.col("id").alias("top"))
    # one row
    j = t.join(F.broadcast(top), F.col("id") == F.col("top"), "left").withColumn("newest_active", F.col("top").isNotNull())
    return R.global_rank(j.drop("top"), [F.desc("created_at"), F.desc("id")], "place").select("id", "place", "newest_active")


@query("last_wins", "select source_id, listing_key, arg_max(name, run_id) as name, min(run_id) as first_run from (select * from dog_listing_snapshots qualify row_number() over (partition by source_id, listing_key, run_id order by extracted_at desc) = 1) group by 1, 2")
def _(s, d):
    """Of every listing the value that was delivered last, at the place of its first delivery."""
    t = table(s, d, "dog_listing_snapshots").filter("source_id is not null and listing_key is not null and run_id is not null")
    last = F.struct("run_id", "extracted_at")
    # a value of null counts as one; a struct keeps it
    return t.groupBy("source_id", "listing_key").agg(F.max_by(F.struct("name"), last).alias("v"), F.min("run_id").alias("first_run")).select("source_id", "listing_key", F.col("v.name").alias("name"), "first_run")


@query(
    "view_rows",
    f"select l.id, '{{\"id\":' || to_json(l.id) || ',\"name\":' || coalesce(to_json(l.name), 'null') || ',\"city\":' || coalesce(to_json(coalesce(l.city, s.city)), 'null') || ',\"months\":' || coalesce(cast(l.age_months_estimate as varchar), 'null') || '}}' as body from {LATEST} l join adoption_sources s on s.id = l.source_id",
)
def _(s, d):
    """Listings as JSON bodies, with nulls, in a fixed order of fields."""
    src = table(s, d, "adoption_sources").select(F.col("id").alias("source_id"), F.col("city").alias("_city"))
    t = listings(s, d, "source_id", "name", "city", "age_months_estimate").join(src, "source_id")
    return t.select("id", F.to_json(F.struct("id", "name", F.coalesce("city", "_city").alias("city"), F.col("age_months_estimate").alias("months")), {"ignoreNullFields": "false"}).alias("body"))
