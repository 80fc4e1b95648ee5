"""Criteria matched against rows with three-valued results, and ranked search.

Each criterion gives a reason, a failure or an unknown, or nothing where it is not asked for. A row matches if nothing
fails; what is unknown never rejects. Candidates come by the most selective criterion of each search:

* a search with a place and a radius meets the rows within it (the complete radius join of ``nearness``) and the rows
  without a usable place;
* of the rows still to be met, a search for breeds meets those whose breed text holds one of its terms, found over the
  distinct texts and terms by their n-grams, and those without a breed;
* what asks for neither meets all rows, in blocks of searches.

Then the criteria themselves are native column arithmetic over the candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kennelflow.functions import listing as X
from kennelflow.operators.nearness import usable, within_radius

INPUT = ("name", "breed_normalized", "breed_raw", "age_raw", "age_months_estimate", "weight_lbs_estimate", "size_raw", "color_raw", "sex", "status_normalized", "stale_status", "intake_date", "primary_photo_url", "first_seen_at", "last_seen_at", "description", "latitude", "longitude")
LISTS = ("breedIncludes", "breedExcludes", "sizes", "ageBuckets", "colors", "sexes", "statuses", "visualTraits", "keywords")
NUMBERS = ("minWeightLbs", "maxWeightLbs", "minAgeMonths", "maxAgeMonths", "minDaysInShelter", "maxDaysInShelter", "maxDistanceMiles")
# What the lists of fixed choice may hold, and the radius where a place is given without one.
CHOICES = {"sizes": ["small", "medium", "large", "xlarge"], "ageBuckets": ["puppy", "young", "adult", "senior"], "sexes": ["male", "female"]}
DEFAULT_RADIUS = 100.0
#: Searches in one block that meets all rows; searches up to which the criteria are sent to every worker.
BLOCK, BROADCAST_CRITERIA = 500, 10_000


def parse_criteria(watches: DataFrame, default_radius: float | None = None) -> DataFrame:
    """id, parsed (JSON), latitude, longitude -> watch_id, c (struct of lists and numbers), from_lat, from_lon.

    What has a wrong type or is no choice of its list is dropped; a null or cut text asks for nothing. Searches without a usable
    position ask for no radius; those with one but no radius get ``default_radius`` (None: no radius either).
    """
    text = F.from_json("parsed", "struct<" + ",".join(f"{k}:string" for k in (*LISTS, *NUMBERS, "excludePuppies")) + ">")

    def strings(k: str) -> Column:
        xs = F.coalesce(F.from_json(F.col(f"_p.{k}"), "array<string>"), F.array().cast("array<string>"))
        allowed = CHOICES.get(k)
        return F.filter(xs, lambda x: x.isNotNull() & (x.isin(*allowed) if allowed else F.trim(x) != ""))

    here = usable(F.col("latitude"), F.col("longitude"))
    radius = F.coalesce(F.col("_p.maxDistanceMiles").try_cast("double"), F.lit(default_radius).cast("double"))
    numbers = [F.when(here, radius).alias(k) if k == "maxDistanceMiles" else F.col(f"_p.{k}").try_cast("double").alias(k) for k in NUMBERS]
    c = F.struct(*[strings(k).alias(k) for k in LISTS], *numbers, F.coalesce(F.col("_p.excludePuppies") == "true", F.lit(False)).alias("excludePuppies"))
    return watches.withColumn("_p", text).select(F.col("id").alias("watch_id"), c.alias("c"), F.when(here, F.col("latitude")).alias("from_lat"), F.when(here, F.col("longitude")).alias("from_lon"))


def match_input(rows: DataFrame) -> DataFrame:
    """What the criteria read of each listing; the stay counts from the intake date to the last time it was seen."""
    here = usable(F.col("latitude"), F.col("longitude"))
    stay = X.days_since(X.loose_date(F.col("intake_date")).cast("timestamp"), F.col("last_seen_at").cast("timestamp"))
    return rows.select(
        "id", "name", F.trim(F.lower(F.concat_ws(" ", "breed_normalized", "breed_raw"))).alias("breed"), F.lower("age_raw").alias("age"), F.col("age_months_estimate").cast("double").alias("months"), F.col("weight_lbs_estimate").alias("lbs"),
        X.size_of(F.col("size_raw"), F.col("weight_lbs_estimate")).alias("size"), X.split_colors(F.col("color_raw")).alias("colors"), "sex", F.col("status_normalized").alias("status"), X.fresh(F.col("stale_status")).alias("freshness"), stay.cast("double").alias("stay"),
        F.col("primary_photo_url").isNotNull().alias("photo"), "first_seen_at", F.lower(F.concat_ws(" ", "name", "breed_normalized", "breed_raw", "description")).alias("hay"), F.col("description").isNotNull().alias("bio"),
        F.when(here, F.col("latitude")).alias("lat"), F.when(here, F.col("longitude")).alias("lon"),
    )


def verdict(asked: Column, known: Column, holds: Column) -> Column:
    """'r', 'f' or 'u'; null where the criterion is not asked for."""
    return F.when(asked, F.when(~F.coalesce(known, F.lit(False)), "u").when(F.coalesce(holds, F.lit(False)), "r").otherwise("f"))


def tests() -> dict[str, Column]:
    """The criteria by name, over the columns of ``match_input`` and ``parse_criteria``."""
    asks = lambda f: F.size(F.col(f"c.{f}")) > 0
    within = lambda x, lo, hi: (F.col(f"c.{lo}").isNull() | (x >= F.col(f"c.{lo}"))) & (F.col(f"c.{hi}").isNull() | (x <= F.col(f"c.{hi}")))
    bounded = lambda lo, hi: F.col(f"c.{lo}").isNotNull() | F.col(f"c.{hi}").isNotNull()
    breed, months, bucket = F.col("breed"), F.col("months"), X.age_bucket(F.col("months"))
    held = lambda f: F.exists(f"c.{f}", lambda b: F.contains(breed, F.lower(b)))
    pup = F.coalesce(bucket == "puppy", F.lit(False)) | F.coalesce(F.col("age").rlike(r"\bpupp"), F.lit(False))
    sex = F.col("sex").isin("male", "female")
    return {
        "breed": verdict(asks("breedIncludes"), breed != "", held("breedIncludes")),
        "no_breed": F.when(asks("breedExcludes") & (breed != "") & held("breedExcludes"), "f"),
        "no_puppy": F.when(F.col("c.excludePuppies"), F.when(pup, "f").when(months.isNull() & F.coalesce(F.col("age") == "", F.lit(True)), "u").otherwise("r")),
        "age": verdict(bounded("minAgeMonths", "maxAgeMonths"), months.isNotNull(), within(months, "minAgeMonths", "maxAgeMonths")),
        "age_bucket": verdict(asks("ageBuckets"), bucket.isNotNull(), F.array_contains("c.ageBuckets", bucket)),
        "size": verdict(asks("sizes"), F.col("size").isNotNull(), F.array_contains("c.sizes", F.col("size"))),
        "weight": verdict(bounded("minWeightLbs", "maxWeightLbs"), F.col("lbs").isNotNull(), within(F.col("lbs"), "minWeightLbs", "maxWeightLbs")),
        "color": verdict(asks("colors"), F.size("colors") > 0, F.exists("c.colors", lambda x: F.array_contains("colors", F.lower(x)))),
        "status": verdict(asks("statuses"), F.lit(True), F.array_contains("c.statuses", F.col("status"))),
        "sex": verdict(asks("sexes"), sex, F.array_contains("c.sexes", F.col("sex"))),
        "stay": verdict(bounded("minDaysInShelter", "maxDaysInShelter"), F.col("stay").isNotNull(), within(F.col("stay"), "minDaysInShelter", "maxDaysInShelter")),
        "distance": verdict(F.col("c.maxDistanceMiles").isNotNull(), F.col("lat").isNotNull(), X.haversine_miles(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")) <= F.col("c.maxDistanceMiles")),
    }


def term_hits(texts: DataFrame, terms: DataFrame, gram: int = 3) -> DataFrame:
    """texts: text; terms: term (both distinct) -> text, term of every text that holds the term anywhere. Met by n-gram, not all with all.

    A term is looked up by its first ``gram`` letters (fewer if it is shorter), a text under all its grams up to that length.
    """
    long = terms.filter("term <> ''").withColumn("g", F.substring("term", 1, gram))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.array(*[F.substr(F.col("text"), i, F.lit(n)) for n in range(1, gram + 1)]))
    grams = texts.filter("text <> ''").select("text", F.explode(F.array_distinct(F.flatten(starts))).alias("g"))
    return grams.join(long, "g").filter(F.contains("text", F.col("term"))).select("text", "term").distinct()


def _blocks(searches: DataFrame, rows: DataFrame) -> DataFrame:
    """Every search with every row, ``BLOCK`` searches at a time: a stated set of queries against all rows."""
    n = searches.count()
    if not n:
        return rows.withColumn("watch_id", F.lit(None).cast("bigint")).limit(0)
    block = searches.select("watch_id", F.pmod(F.xxhash64("watch_id"), F.lit(-(-n // BLOCK))).alias("_b")).groupBy("_b").agg(F.collect_list("watch_id").alias("_w"))
    return rows.join(F.broadcast(block)).withColumn("watch_id", F.explode("_w")).drop("_b", "_w")


def candidates(rows: DataFrame, criteria: DataFrame) -> DataFrame:
    """The columns of ``rows`` with watch_id, for every pair that no radius and no breed list rejects."""
    far = criteria.filter(F.col("c.maxDistanceMiles").isNotNull())
    near = within_radius(rows.select("id", "lat", "lon"), far.select(F.col("watch_id").alias("qid"), F.col("from_lat").alias("qlat"), F.col("from_lon").alias("qlon"), F.col("c.maxDistanceMiles").alias("radius")))
    parts = [rows.join(near.select("id", F.col("qid").alias("watch_id")), "id")]
    for some, left in ((far, rows.filter("lat is null")), (criteria.filter(F.col("c.maxDistanceMiles").isNull()), rows)):
        by_breed = some.filter(F.size("c.breedIncludes") > 0)
        wanted = by_breed.select("watch_id", F.explode(F.transform("c.breedIncludes", F.lower)).alias("term"))
        texts = left.select(F.col("breed").alias("text")).distinct()
        hit = term_hits(texts, wanted.select("term").distinct()).join(wanted, "term").select(F.col("text").alias("breed"), "watch_id").distinct()
        parts += [left.join(hit, "breed"), _blocks(by_breed, left.filter("breed = ''")), _blocks(some.filter(F.size("c.breedIncludes") == 0), left)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def match_all(rows: DataFrame, criteria: DataFrame) -> DataFrame:
    """Every matching (watch, row) with reasons, unknowns, hits of keywords, a score and the miles between them.

    One for each reason, two for each visual trait that the row's column ``look`` holds (if it has one), one for each keyword in its
    texts, and half for fresh and for available rows.
    """
    n = criteria.limit(BROADCAST_CRITERIA + 1).count()
    small = F.broadcast(criteria) if n <= BROADCAST_CRITERIA else criteria
    j = candidates(rows, criteria).join(small, "watch_id")
    found = tests()
    # as one array, so that each criterion is computed once for the filter and the lists
    j = j.withColumn("_t", F.array(*[F.coalesce(t, F.lit("-")) for t in found.values()])).filter(~F.array_contains("_t", "f"))
    names = list(found)

    def pick(v: str) -> Column:
        return F.filter(F.transform("_t", lambda t, i: F.when(t == v, F.element_at(F.array(*map(F.lit, names)), i + 1))), lambda x: x.isNotNull())

    j = j.withColumns({"reasons": pick("r"), "unknowns": pick("u"), "miles": X.haversine_miles(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon"))})
    hits = F.size(F.filter("c.keywords", lambda k: F.contains(F.col("hay"), F.lower(F.trim(k)))))
    look = F.size(F.filter("c.visualTraits", lambda k: F.contains(F.lower("look"), F.lower(F.trim(k))))) if "look" in rows.columns else F.lit(0)
    score = F.size("reasons") + 2 * look + hits + F.when(F.col("freshness") == "fresh", 0.5).otherwise(0.0) + F.when(F.col("status") == "available", 0.5).otherwise(0.0)
    rich = F.col("bio").cast("int") + (F.col("look").isNotNull().cast("int") if "look" in rows.columns else F.lit(0))
    return j.withColumns({"score": score.cast("double"), "rich": rich}).select("watch_id", "id", "name", "reasons", "unknowns", "score", "miles", "rich", "photo", "status", "freshness", "first_seen_at")


def ranking() -> list[Column]:
    """Score, then nearness (unknown last), richness, name, ending in the id, so that no two rows tie."""
    return [F.desc("score"), F.asc_nulls_last("miles"), F.desc("rich"), F.asc_nulls_first("name"), F.asc("id")]


def new_matches(matches: DataFrame, ledger: DataFrame, least_score: float = 0.0, photo: bool = True, available: bool = True) -> DataFrame:
    """Matches that the ledger (watch_id, id) does not hold yet, of rows that are there to be had."""
    m = matches.join(ledger.select("watch_id", "id").distinct(), ["watch_id", "id"], "left_anti").filter((F.col("score") >= least_score) & (F.col("freshness") != "missing"))
    m = m.filter("photo") if photo else m
    return m.filter("status = 'available'") if available else m
