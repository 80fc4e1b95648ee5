"""Queries of the general problems: nearness, snapshots, units, drift, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kennelflow.io import latest_rows, table
from kennelflow.operators import drift as D
from kennelflow.operators import nearness as N
from kennelflow.operators import snapshots as S
from kennelflow.operators import units as U

COMPARED = ("name", "breed_raw", "age_raw", "weight_raw", "status_raw", "status_normalized")
TRACKED = ("status_raw", "status_normalized", "weight_raw")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshot_changes(table(spark, d, "dog_listing_snapshots"), table(spark, d, "source_runs"), COMPARED)


def p3_new_dogs(spark: SparkSession, d: str) -> DataFrame:
    """Per complete run with a complete one before it: the true counts beside the recorded new_dogs."""
    c = p3_found(spark, d).groupBy("run_id").agg(*[F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "changed")])
    runs = table(spark, d, "source_runs")
    known = S.complete_runs(runs).filter("prev_run_id is not null").select("run_id")
    return (
        known.join(c, "run_id", "left")
        .join(runs.groupBy(F.col("id").alias("run_id")).agg(F.max("new_dogs").alias("new_dogs_recorded")), "run_id")
        .select("run_id", *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in ("added", "removed", "changed")], "new_dogs_recorded")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    h = S.attribute_history(table(spark, d, "dog_listing_snapshots"), table(spark, d, "source_runs"), TRACKED)
    return h.select("source_id", "listing_key", "from_run_id", "to_run_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    listings = latest_rows(table(spark, d, "dog_listings"), "id", "updated_at", ["latitude", "longitude"]).toDF("id", "lat", "lon")
    w = table(spark, d, "watches").select(
        F.col("id").alias("qid"), F.col("latitude").alias("qlat"), F.col("longitude").alias("qlon"), F.get_json_object("parsed", "$.maxDistanceMiles").try_cast("double").alias("radius")
    )
    return N.within_radius(listings, w).select(F.col("qid").alias("watch_id"), F.col("id").alias("listing_id"))


def p4_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Pounds and months of every listing that states them: id, quantity, amount, recorded."""
    raws = ["weight_raw", "age_raw"]
    listings = table(spark, d, "dog_listings").withColumn("description", F.when(U.needs_text(raws), F.col("description")))
    cols = ["source_id", *raws, "weight_lbs_estimate", "age_months_estimate", "last_seen_at", "description"]
    # the sources are few and small enough for Catalyst to broadcast by their measured size
    notes = table(spark, d, "adoption_sources").groupBy(F.col("id").alias("source_id")).agg(F.max("notes").alias("notes"))
    rows = latest_rows(listings, "id", "updated_at", cols).join(notes, "source_id", "left")
    fields = {"weight": ("weight_raw", "weight_lbs_estimate"), "age": ("age_raw", "age_months_estimate")}
    return U.to_common_units(U.parse_amounts(rows, fields, "id", "description", "notes", "last_seen_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return U.wrong_estimates(p4_amounts(spark, d)).select(F.col("id").alias("listing_id"), "quantity")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return D.drift_report(table(spark, d, "feed_records"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return D.consistent_table(table(spark, d, "feed_records"))


def p5_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    return D.failed_casts(table(spark, d, "feed_records"))


def p5_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return D.unreadable(table(spark, d, "feed_records"))


QUERIES = {"p5_found": p5_found, "p5_table": p5_table, "p5_failed_casts": p5_failed_casts, "p5_unreadable": p5_unreadable, "p2_found": p2_found, "p4_found": p4_found, "p4_amounts": p4_amounts, "p3_found": p3_found, "p3_new_dogs": p3_new_dogs, "p7_found": p7_found}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _key(c: str) -> str:
    return f"coalesce(lower(trim(regexp_replace({c}, '{_WS}', ' ', 'g'))), '')"


_RUNS = """runs as (
  select id as run_id, source_id, crawl_scope, row_number() over w as seq, lag(id) over w as prev_id, lead(id) over w as next_id
  from source_runs where status in ('success', 'success_with_warnings')
  window w as (partition by source_id, crawl_scope order by started_at, id))"""
_P3 = f"""with {_RUNS}, s as (
  select run_id, source_id, listing_key, {", ".join(f"{_key(c)} as {c}" for c in COMPARED)} from dog_listing_snapshots
  qualify row_number() over (partition by run_id, source_id, listing_key order by extracted_at desc) = 1),
n as (select s.* from s join runs using (run_id) where prev_id is not null),
o as (select s.* replace (next_id as run_id) from s join runs using (run_id) where next_id is not null),
p3 as (select coalesce(n.run_id, o.run_id) as run_id, coalesce(n.source_id, o.source_id) as source_id, coalesce(n.listing_key, o.listing_key) as listing_key,
  case when o.run_id is null then 'added' when n.run_id is null then 'removed' else 'changed' end as change_kind
  from n full join o on n.run_id = o.run_id and n.source_id = o.source_id and n.listing_key = o.listing_key
  where o.run_id is null or n.run_id is null or {" or ".join(f"n.{c} <> o.{c}" for c in COMPARED)})"""

SQL = {
    "p5_unreadable": """select feed, file_no, coalesce(record_no, -1) as record_no, case when payload is null then 'null' when not json_valid(payload) then 'cut' else 'no object' end as problem, count(*) as n
from feed_records where feed is not null and file_no is not null and not coalesce(json_valid(payload) and json_type(case when json_valid(payload) then payload end) = 'OBJECT', false) group by all""",
    "p2_found": """with l as (select id, latitude, longitude from dog_listings qualify row_number() over (partition by id order by updated_at desc) = 1),
w as (select id, latitude, longitude, try_cast(json_extract_string(parsed, '$.maxDistanceMiles') as double) as radius from watches)
select w.id as watch_id, l.id as listing_id from w join l on
  abs(l.latitude) <= 90 and abs(l.longitude) <= 180 and not (l.latitude = 0 and l.longitude = 0)
  and abs(w.latitude) <= 90 and abs(w.longitude) <= 180 and not (w.latitude = 0 and w.longitude = 0)
  and 2 * 3958.7613 * asin(sqrt(least(1, pow(sin(radians(l.latitude - w.latitude) / 2), 2)
    + cos(radians(w.latitude)) * cos(radians(l.latitude)) * pow(sin(radians(l.longitude - w.longitude) / 2), 2)))) <= radius""",
    "p3_found": _P3 + " select * from p3",
    "p3_new_dogs": _P3
    + """ select r.run_id, count(case when change_kind = 'added' then 1 end) as added, count(case when change_kind = 'removed' then 1 end) as removed,
  count(case when change_kind = 'changed' then 1 end) as changed, max(s.new_dogs) as new_dogs_recorded
  from runs r join source_runs s on s.id = r.run_id left join p3 on p3.run_id = r.run_id where r.prev_id is not null group by r.run_id""",
    "p7_found": f"""with {_RUNS}, s as (
  select run_id, source_id, listing_key, {", ".join(f"{_key(c)} as {c}" for c in TRACKED)} from dog_listing_snapshots
  qualify row_number() over (partition by run_id, source_id, listing_key order by extracted_at desc) = 1),
q as (select s.*, r.crawl_scope, r.seq, r.next_id,
  lag(r.seq) over k = r.seq - 1 and {" and ".join(f"lag(s.{c}) over k = s.{c}" for c in TRACKED)} as goes_on
  from s join runs r using (run_id) window k as (partition by s.source_id, r.crawl_scope, listing_key order by r.seq)),
g as (select *, sum(case when goes_on then 0 else 1 end) over (partition by source_id, crawl_scope, listing_key order by seq) as version from q)
select source_id, listing_key, arg_min(run_id, seq) as from_run_id, coalesce(max_by(struct_pack(x := next_id), seq).x, 0) as to_run_id
from g group by source_id, crawl_scope, listing_key, version""",
}
