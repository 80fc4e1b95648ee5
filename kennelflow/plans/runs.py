"""Runs, batches, entities and views, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kennelflow.functions import listing as X
from kennelflow.io import cut_lineage, table
from kennelflow.operators import quality as K
from kennelflow.operators import records as R
from kennelflow.plans.listings import LATEST, QUERIES as LISTINGS, listings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_PRIOR = "last_value(case when status in ('success', 'success_with_warnings') then dogs_found end ignore nulls) over (partition by source_id order by started_at, id rows between unbounded preceding and 1 preceding)"
_WARNED = f"""w as (select *, coalesce(duplicates_detected > 0, false) as w1, dogs_found = 0 as w2, not coalesce(pagination_completed, false) as w3, coalesce(total_listings_reported_by_source <> dogs_found, false) as w4,
  coalesce(prior >= 10 and dogs_found < 0.5 * prior, false) as w5 from (select *, {_PRIOR} as prior from source_runs))"""
_N = "(w1::int + coalesce(w2, false)::int + w3::int + w4::int + w5::int)"


@query(
    "run_guards",
    f"""with {_WARNED} select id, case when status = 'failed' then 'failed' when dogs_found = 0 then 'empty' when w5 then 'sharp_drop'
  when w4 then 'count_mismatch' else 'ok' end as verdict from w""",
)
def _(s, d):
    t = K.last_good_before(table(s, d, "source_runs"), "source_id", "started_at", "dogs_found")
    n, told = F.col("dogs_found"), F.col("total_listings_reported_by_source")
    return t.select("id", X.first_case((F.col("status") == "failed", "failed"), (n == 0, "empty"), (K.dropped(n, F.col("prior")), "sharp_drop"), (told != n, "count_mismatch"), otherwise="ok").alias("verdict"))


@query(
    "run_quality",
    f"""with {_WARNED}, c as (select *, case when status in ('failed', 'blocked') then status when coalesce(w2, false) or w3 or w5 then 'partial' when {_N} > 0 then 'success_with_warnings' else 'success' end as judged from w)
select id, judged as status, cast({_N} as integer) as warnings, cast(case when status in ('failed', 'blocked') then 0 when dogs_found = 0 then 0.1
  else floor(greatest(0, 1 - case when w3 then 0.3 else 0 end - case when w4 then 0.15 else 0 end - least(0.1, {_N} * 0.02)) * 100 + 0.5 + 1e-9) / 100 end as double) as confidence from c""",
)
def _(s, d):
    t = K.last_good_before(table(s, d, "source_runs"), "source_id", "started_at", "dogs_found")
    zero, n, paged, told = F.lit(0), F.col("dogs_found"), F.col("pagination_completed"), F.col("total_listings_reported_by_source")
    t = t.withColumn("warned", K.run_warnings(n, paged, told, F.col("prior"), zero, zero, zero, zero, F.col("duplicates_detected")))
    t = t.withColumn("judged", K.run_status(F.col("status"), F.col("warned"), F.lit(True)))
    score = K.confidence(F.col("status"), n, paged, told != n, F.lit(True), zero, zero, zero, n, n, F.size("warned"))
    return t.select("id", F.col("judged").alias("status"), F.size("warned").alias("warnings"), score.cast("double").alias("confidence"))


_BATCH = "(select run_id, count(*) as delivered, count(distinct listing_key) as listings, count(distinct case when listing_key like 'url\\_%' escape '\\' then listing_key end) as weak from dog_listing_snapshots where listing_key is not null group by run_id)"


@query("batch_quality", f"select run_id, delivered, listings, delivered - listings as duplicates, weak, weak > 0.2 * listings as weak_warning from {_BATCH}")
def _(s, d):
    # each listing of a run once before the counts of runs: two aggregations with partial sums, whatever the skew
    one = table(s, d, "dog_listing_snapshots").filter("listing_key is not null").groupBy("run_id", "listing_key").agg(F.count("*").alias("n"))
    g = one.groupBy("run_id").agg(F.sum("n").alias("delivered"), F.count("*").alias("listings"), F.count_if(F.startswith("listing_key", F.lit("url_"))).alias("weak"))
    return g.select("run_id", "delivered", "listings", (F.col("delivered") - F.col("listings")).alias("duplicates"), "weak", (F.col("weak") > K.WEAK_SHARE * F.col("listings")).alias("weak_warning"))


@query("key_strength", f"select source_id, case when n = own then 'all' when own = 0 then 'none' else 'mixed' end as strength from (select source_id, count(*) as n, count(nullif(trim(source_animal_id), '')) as own from {LATEST} group by 1)")
def _(s, d):
    own = F.nullif(F.trim("source_animal_id"), F.lit(""))
    g = listings(s, d, "source_id", "source_animal_id").groupBy("source_id").agg(F.count("*").alias("n"), F.count(own).alias("own"))
    return g.select("source_id", K.key_strength(F.col("n"), F.col("own")).alias("strength"))


@query(
    "source_verdicts",
    f"""select source_id, case when named < n or keyed < n then 'fail' when 2 * pictured < n or 2 * described < n then 'partial' else 'pass' end as verdict
  from (select source_id, count(*) as n, count(name) as named, count(listing_key) as keyed, count(primary_photo_url) as pictured, count(description) as described from {LATEST} group by 1)""",
)
def _(s, d):
    g = listings(s, d, "source_id", "name", "listing_key", "primary_photo_url", "description").groupBy("source_id")
    g = g.agg(F.count("*").alias("n"), F.count("name").alias("named"), F.count("listing_key").alias("keyed"), F.count("primary_photo_url").alias("pictured"), F.count("description").alias("described"))
    n = F.col("n")
    checks = {"names": F.col("named") >= n, "keys": F.col("keyed") >= n, "photos": 2 * F.col("pictured") >= n, "texts": 2 * F.col("described") >= n}
    return g.select("source_id", K.verdict_from(checks, ["names", "keys"]).alias("verdict"))


@query("richest_version", "select id, updated_at from dog_listings qualify row_number() over (partition by id order by (primary_photo_url is not null)::int desc, coalesce(length(description), 0) desc, updated_at) = 1")
def _(s, d):
    t = table(s, d, "dog_listings").select("id", "updated_at", F.col("primary_photo_url").isNotNull().alias("pictured"), "description").filter("id is not null")
    return K.richest(t, ["id"], F.col("pictured"), F.col("description"), [F.asc("updated_at")]).select("id", "updated_at")


_OLD = "(select * from dog_listings qualify row_number() over (partition by id order by updated_at) = 1)"


def _hash(p: str) -> str:
    return f"case when len({p}.photo_urls) > 0 then sha256(array_to_string(list_sort({p}.photo_urls), chr(10))) end"


@query("photo_work", f"select l.id, case when len(l.photo_urls) is null or len(l.photo_urls) = 0 then 'no_photo' when {_hash('l')} = {_hash('o')} then 'cached' else 'todo' end as work from {LATEST} l join {_OLD} o using (id)")
def _(s, d):
    """What a reader of pictures has to do: nothing without pictures or with the set that was read before, by the first version."""
    t = table(s, d, "dog_listings").filter("id is not null").groupBy("id").agg(F.max_by("photo_urls", "updated_at").alias("now"), F.min_by("photo_urls", "updated_at").alias("before"))
    return t.select("id", X.first_case((F.coalesce(F.size("now"), F.lit(0)) <= 0, "no_photo"), (X.set_hash(F.col("now")) == X.set_hash(F.col("before")), "cached"), otherwise="todo").alias("work"))


# entities and views

_RULES = f"""n as (select id, source_id, lower(name) as nm, name is null or length(trim(name)) < 2 or regexp_matches(lower(trim(name)), '^[a-z]?[0-9]{{4,}}$') or lower(trim(name)) in ('unknown', 'no name', 'noname', 'unnamed', 'puppy', 'pup', 'dog', 'stray', 'n/a', 'pending') as ph,
  lower(trim(sex)) as sex, breeds, age_months_estimate as age, trim(primary_photo_url) as photo from e0),
pe as (select min(id) as a, max(id) as b from n where photo <> '' and not regexp_matches(photo, '(?i)no[-_ ]?(image|pic|photo)|placeholder|default[-_.]|generic\\.(svg|png|jpg)') group by photo having count(*) = 2),
ne as (select x.id as a, y.id as b from n x join n y on x.nm = y.nm and x.nm <> '' and x.id < y.id where (x.sex = y.sex or coalesce(x.sex, '') not in ('male', 'female') or coalesce(y.sex, '') not in ('male', 'female'))
  and case when x.source_id = y.source_id then list_has_any(x.breeds, y.breeds) or (len(x.breeds) = 0 and len(y.breeds) = 0)
  else not x.ph and not y.ph and (list_has_any(x.breeds, y.breeds) or len(x.breeds) = 0 or len(y.breeds) = 0) and coalesce(abs(x.age - y.age) <= 24, true) end),
ed as (select a, b from pe union select a, b from ne), both_ways as (select a, b from ed union select b, a from ed),
reach as (select id as node, id as other from n union select r.node, w.b from reach r join both_ways w on w.a = r.other),
comp as (select node as id, min(other) as component from reach group by node)"""


def _entity_sql() -> str:
    from kennelflow.plans.normalised import _BREEDS, _NAME

    both = _BREEDS.replace("coalesce(lower(trim(regexp_replace(breed_raw,", "coalesce(lower(trim(regexp_replace(coalesce(breed_raw, breed_normalized),")
    return f"with recursive e0 as (select l.* replace (t.name as name), b.breeds from {LATEST} l join {_NAME} t on t.id = l.id join {both} b on b.id = l.id), {_RULES}"


@query("components", _entity_sql() + " select id, component from comp")
def _(s, d):
    return LISTINGS["listing_components"](s, d)


SQL["listing_components"] = SQL["components"]


def _members(s, d):
    c = cut_lineage(LISTINGS["listing_components"](s, d))
    t = listings(s, d, "name", "source_id", "sex", "breed_raw", "breed_normalized", "stale_status", "primary_photo_url", "description", "last_seen_at")
    active = F.coalesce(F.col("stale_status").isin("available", "still_seen", "missing_once"), F.lit(False))
    first = F.get(X.breed_tokens(F.coalesce("breed_raw", "breed_normalized")), F.lit(0))
    t = t.select("id", "source_id", X.title_name(F.col("name")).alias("name"), F.lower(F.trim("sex")).alias("sex"), first.alias("breed"), active.alias("active"), F.col("primary_photo_url").isNotNull().alias("pictured"), F.coalesce(F.length("description"), F.lit(0)).alias("size"), "last_seen_at", F.trim("primary_photo_url").alias("photo"))
    return t.join(c, "id")


_GROUPS = """g as (select c.component, e.*, row_number() over (partition by c.component order by coalesce(e.stale_status in ('available', 'still_seen', 'missing_once'), false) desc, (e.primary_photo_url is not null) desc, coalesce(length(e.description), 0) desc, e.last_seen_at desc nulls last, e.id) as pos,
  count(*) over (partition by c.component) as listings from comp c join e0 e on e.id = c.id)"""
_KEY = "coalesce(nullif(lower(trim(name)), ''), 'unnamed') || '|' || coalesce(nullif(lower(trim(sex)), ''), '?') || '|' || coalesce(breeds[1], '?')"


@query("canonical_groups", _entity_sql() + f", {_GROUPS} select component, id as display_id, {_KEY} as merge_key, listings from g where pos = 1")
def _(s, d):
    """The listing shown for each entity: active, then pictured, then the longer text, then the last seen; and the key of the entity."""
    m = _members(s, d)
    best = F.struct("active", "pictured", "size", "last_seen_at")
    # a maximum per entity, ties by the least id, so an entity of any size is combined before the exchange
    order = R.pick_by(m, ["component"], [F.desc("active"), F.desc("pictured"), F.desc("size"), F.desc_nulls_last("last_seen_at"), F.asc("id")])
    n = m.groupBy("component").agg(F.count("*").alias("listings"), F.max(best).alias("_"))
    text = lambda c, none: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit(none))
    return order.join(n, "component").select("component", F.col("id").alias("display_id"), F.concat_ws("|", text("name", "unnamed"), text("sex", "?"), F.coalesce("breed", F.lit("?"))).alias("merge_key"), "listings")


@query(
    "duplicate_confidence",
    _entity_sql() + f", {_GROUPS} select m.id, case when trim(m.primary_photo_url) = trim(x.primary_photo_url) then 0.95 when m.source_id = x.source_id then 0.85 else 0.6 end::double as confidence from g m join g x on x.component = m.component and x.pos = 1 where m.pos > 1",
)
def _(s, d):
    """How surely each further listing is the entity shown: the same picture, the same source, or by its rules only."""
    m = cut_lineage(_members(s, d))
    shown = R.pick_by(m, ["component"], [F.desc("active"), F.desc("pictured"), F.desc("size"), F.desc_nulls_last("last_seen_at"), F.asc("id")]).select("component", F.col("id").alias("shown"), F.col("photo").alias("shown_photo"), F.col("source_id").alias("shown_source"))
    j = m.join(shown, "component").filter("id <> shown")
    return j.select("id", F.when(F.col("photo") == F.col("shown_photo"), 0.95).when(F.col("source_id") == F.col("shown_source"), 0.85).otherwise(0.6).alias("confidence"))


@query(
    "views",
    f"""with l as (select *, coalesce('c' || canonical_dog_id, 'solo:' || id) as gid from {LATEST}),
p as (select *, count(*) over (partition by gid) as listings, row_number() over (partition by gid order by coalesce(stale_status in ('available', 'still_seen'), false) desc, coalesce(len(photo_urls) > 0, false) desc, last_seen_at desc nulls last, id) as pos from l),
v as (select p.id, s.name as source_name, coalesce(p.city, s.city) as place, case when stale_status in ('available', 'still_seen') then 'fresh' when stale_status = 'missing_once' then 'stale' when stale_status in ('missing_multiple_runs', 'likely_unavailable') then 'missing' else 'uncertain' end as freshness,
  listings, coalesce(first_seen_at >= (select max(first_seen_at) from l) - interval 3 hour, false) as new_arrival, dedupe_method <> 'source_animal_id' as weak_key, first_seen_at from p join adoption_sources s on s.id = p.source_id where pos = 1 and p.primary_photo_url is not null)
select * exclude (first_seen_at), cast(row_number() over (order by (freshness = 'fresh') desc, first_seen_at desc nulls last, id) as bigint) as rank from v""",
)
def _(s, d):
    """One listing per dog that has a picture, with its source: seen before missed, pictured before not, last seen first; fresh and new ones in front."""
    t = listings(s, d, "canonical_dog_id", "source_id", "stale_status", "photo_urls", "primary_photo_url", "city", "first_seen_at", "last_seen_at", "dedupe_method")
    t = t.select(
        F.coalesce(F.concat(F.lit("c"), F.col("canonical_dog_id")), F.concat(F.lit("solo:"), F.col("id"))).alias("gid"), "id", "source_id", F.coalesce(F.col("stale_status").isin("available", "still_seen"), F.lit(False)).alias("seen"),
        (F.coalesce(F.size("photo_urls"), F.lit(0)) > 0).alias("pictured"), "primary_photo_url", "city", "first_seen_at", "last_seen_at", "dedupe_method", X.fresh(F.col("stale_status")).alias("freshness"),
    )
    t = cut_lineage(t)
    shown = R.pick_by(t, ["gid"], [F.desc("seen"), F.desc("pictured"), F.desc_nulls_last("last_seen_at"), F.asc("id")]).filter("primary_photo_url is not null")
    sources = table(s, d, "adoption_sources").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("city").alias("source_city"))
    newest = t.agg(F.max("first_seen_at").alias("newest"))
    # the newest date is one row
    v = shown.join(t.groupBy("gid").agg(F.count("*").alias("listings")), "gid").join(sources, "source_id").join(F.broadcast(newest))
    v = v.select("id", "source_name", F.coalesce("city", "source_city").alias("place"), "freshness", "listings", F.coalesce(F.col("first_seen_at") >= F.col("newest") - F.expr("interval 3 hours"), F.lit(False)).alias("new_arrival"), (F.col("dedupe_method") != "source_animal_id").alias("weak_key"), "first_seen_at")
    return R.global_rank(v, [F.desc(F.col("freshness") == "fresh"), F.desc_nulls_last("first_seen_at"), F.asc("id")], "rank").drop("first_seen_at")


_PLACES = """c as (select lower(trim(city)) as k, avg(latitude) as lat, avg(longitude) as lon from adoption_sources where city is not null and latitude is not null and longitude is not null group by 1),
o as (select regexp_replace(lower(trim(county)), '\\s+county$', '') as k, avg(latitude) as lat, avg(longitude) as lon from adoption_sources where county is not null and latitude is not null and longitude is not null group by 1)"""


@query(
    "location_ladder",
    f"""with {_PLACES}, j as (select l.id, l.latitude, l.longitude, l.geocode_precision, s.latitude as slat, s.longitude as slon, s.geocode_precision as sprec, c1.lat as a1, c1.lon as b1, c2.lat as a2, c2.lon as b2, o1.lat as a3, o1.lon as b3, o2.lat as a4, o2.lon as b4
  from {LATEST} l left join adoption_sources s on s.id = l.source_id left join c c1 on c1.k = lower(trim(l.city)) left join c c2 on c2.k = lower(trim(s.city)) left join o o1 on o1.k = regexp_replace(lower(trim(l.county)), '\\s+county$', '') left join o o2 on o2.k = regexp_replace(lower(trim(s.county)), '\\s+county$', '')),
q as (select id, case when latitude is not null and longitude is not null then [latitude, longitude] when slat is not null and slon is not null then [slat, slon] when a1 is not null then [a1, b1] when a2 is not null then [a2, b2] when a3 is not null then [a3, b3] when a4 is not null then [a4, b4] end as pt,
  case when latitude is not null and longitude is not null then coalesce(geocode_precision, 'campus') when slat is not null and slon is not null then coalesce(nullif(sprec, 'unknown'), 'campus') when a1 is not null or a2 is not null then 'city' when a3 is not null or a4 is not null then 'county' else 'unknown' end as precision from j)
select id, floor(pt[1] * 10000 + 0.5) / 10000 as lat, floor(pt[2] * 10000 + 0.5) / 10000 as lon, precision from q""",
)
def _(s, d):
    """The best known place of each listing: its own, its source's, the centre of its city, of the source's city, of the counties."""
    src = table(s, d, "adoption_sources")
    known = src.filter("latitude is not null and longitude is not null")
    city = lambda c: F.lower(F.trim(F.col(c)))
    county = lambda c: F.regexp_replace(F.lower(F.trim(F.col(c))), r"\s+county$", "")
    # two lookup tables by name, as long as the list of sources
    centre = {k: known.filter(F.col(k).isNotNull()).groupBy(f(k).alias("k")).agg(F.struct(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")).alias("at")) for k, f in (("city", city), ("county", county))}
    j = listings(s, d, "source_id", "latitude", "longitude", "geocode_precision", "city", "county").join(src.select(F.col("id").alias("source_id"), F.col("latitude").alias("slat"), F.col("longitude").alias("slon"), F.col("geocode_precision").alias("sprec"), F.col("city").alias("scity"), F.col("county").alias("scounty")), "source_id", "left")
    for name, col, kind, f in (("a1", "city", "city", city), ("a2", "scity", "city", city), ("a3", "county", "county", county), ("a4", "scounty", "county", county)):
        j = j.withColumn("_k", f(col)).join(centre[kind].withColumnsRenamed({"k": "_k", "at": name}), "_k", "left").drop("_k")
    own, of = F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.col("slat").isNotNull() & F.col("slon").isNotNull()
    at = F.when(own, F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).when(of, F.struct(F.col("slat").alias("lat"), F.col("slon").alias("lon"))).otherwise(F.coalesce("a1", "a2", "a3", "a4"))
    known_as = F.when(own, F.coalesce("geocode_precision", F.lit("campus"))).when(of, F.coalesce(F.nullif("sprec", F.lit("unknown")), F.lit("campus"))).when(F.coalesce("a1", "a2").isNotNull(), "city").when(F.coalesce("a3", "a4").isNotNull(), "county").otherwise("unknown")
    return j.select("id", at.alias("at"), known_as.alias("precision")).select("id", X.half_up(F.col("at.lat"), 10000).alias("lat"), X.half_up(F.col("at.lon"), 10000).alias("lon"), "precision")


# feeds

#: Per kind of feed: path of each field in the payload as first delivered.
FEED_PATHS = {
    "available": {"key": "$.nid", "name": "$.name", "species": "$.species", "breed": "$.breed", "breed_2": "$.secondary_breed", "sex": "$.sex", "status": "$.age_group.name"},
    "search_trimmed": {"key": "$.AnimalId", "name": "$.Name", "species": "$.AnimalType", "breed": "$.Breed.Primary", "breed_2": "$.Breed.Secondary", "sex": "$.Sex", "status": "$.Status"},
    "pet_sample": {"key": "$.organization_pet.code", "name": "$.organization_pet.name", "species": None, "breed": "$.organization_pet.breed_primary_name", "breed_2": "$.organization_pet.breed_secondary_name", "sex": "$.organization_pet.sex_key", "status": "$.organization_pet.status_key"},
}


def _feed_sql() -> str:
    pick = lambda f: "case " + " ".join(f"when feed like '{k}%' then json_extract_string(payload, '{p[f]}')" for k, p in FEED_PATHS.items() if p[f]) + " end"
    fields = ", ".join(f"{pick(f)} as {f}" for f in FEED_PATHS["available"])
    return f"""with r as (select distinct feed, file_no, record_no, {fields} from feed_records where json_valid(payload))
select feed, file_no, record_no, key, name, nullif(concat_ws(' / ', breed, breed_2), '') as breed, lower(sex) as sex, status from r where key is not null and (species is null or lower(species) = 'dog')"""


@query("feed_listings", _feed_sql())
def _(s, d):
    """Dogs of all feeds as one kind of record, by the paths of the first delivery; cut payloads and repeats are left out."""
    t = table(s, d, "feed_records").filter(F.get_json_object("payload", "$").isNotNull())
    pick = lambda f: F.coalesce(*[F.when(F.startswith("feed", F.lit(k)), F.get_json_object("payload", p[f])) for k, p in FEED_PATHS.items() if p[f]])
    r = t.select("feed", "file_no", "record_no", *[pick(f).alias(f) for f in FEED_PATHS["available"]]).distinct()
    r = r.filter(F.col("key").isNotNull() & (F.col("species").isNull() | (F.lower("species") == "dog")))
    return r.select("feed", "file_no", "record_no", "key", "name", F.nullif(F.concat_ws(" / ", "breed", "breed_2"), F.lit("")).alias("breed"), F.lower("sex").alias("sex"), "status")


@query("feed_first_wins", _feed_sql().replace("select feed, file_no, record_no, key, name,", "select feed, key, first_file, name from (select feed, key, file_no as first_file, name, row_number() over (partition by feed, key order by file_no, record_no, name nulls first) as n from (select feed, file_no, record_no, key, name,") + ")) where n = 1")
def _(s, d):
    """The first delivery of every dog of a feed."""
    return R.pick_by(QUERIES["feed_listings"](s, d), ["feed", "key"], [F.asc("file_no"), F.asc("record_no"), F.asc_nulls_first("name")]).select("feed", "key", F.col("file_no").alias("first_file"), "name")
