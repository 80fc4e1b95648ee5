"""Listings of one dog: shared photos and equal names as edges, whose components are the dogs.

Edges stand for all pairs that the rules connect, but are only as many as keep the components the same: stars
and chains instead of every pair. So a name held by a large part of all listings costs no square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Addresses of pictures that link no listings, and months that the ages of one dog's listings may lie apart.
PLACEHOLDER_PHOTO = r"(?i)no[-_ ]?(image|pic|photo)|placeholder|default[-_.]|generic\.(svg|png|jpg)"
AGE_GAP = 24


def photo_edges(rows: DataFrame) -> DataFrame:
    """id, photo -> a, b: the two listings of a primary photo used exactly twice that is no stand-in picture."""
    p = rows.select("id", F.trim("photo").alias("photo")).filter((F.col("photo") != "") & ~F.col("photo").rlike(PLACEHOLDER_PHOTO))
    return p.groupBy("photo").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n = 2").select("a", "b")


def name_edges(rows: DataFrame) -> DataFrame:
    """id, source, name, placeholder, sex, tokens, age -> a, b.

    Two listings of a name and of compatible sex (equal or unknown) are one dog if, in one source, a breed
    token is shared or neither has any; in two sources, for names that are no placeholders, if a token is
    shared or one has none and the ages, where known, lie within ``AGE_GAP``.

    Those that may be male and those that may be female form two sides; on a side all sexes are compatible.
    Listings of a side that share a token are also one dog if they share the source whatever their ages, so the
    test of ages needs no regard to the source; sorted by age they form a chain, and an unknown age joins all.
    """
    sides = F.when(F.col("sex").isin("male", "female"), F.array("sex")).otherwise(F.array(F.lit("male"), F.lit("female")))
    t = rows.filter("name <> ''").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).withColumn("side", F.explode(sides))
    each = t.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    free = each.filter(~F.col("placeholder"))

    def star(df: DataFrame, key: list[str]) -> DataFrame:
        least = df.groupBy(*key).agg(F.min("id").alias("_least"))
        on = [df[k].eqNullSafe(least[k]) for k in key]
        return df.join(least, on).filter("id <> _least").select(F.col("id").alias("a"), F.col("_least").alias("b"))

    group = ["name", "token", "side"]
    ages = free.groupBy(*group, "age").agg(F.min("id").alias("a"))
    w = Window.partitionBy(*group)
    # one row for each age of a name and token
    chain = ages.withColumns({"unknown": F.max(F.when(F.col("age").isNull(), F.col("a"))).over(w), "before": F.lag("a").over(w.orderBy("age")), "gap": F.col("age") - F.lag("age").over(w.orderBy("age"))})
    chain = chain.select("a", F.when(F.col("unknown").isNotNull(), F.col("unknown")).when(F.col("gap") <= AGE_GAP, F.col("before")).alias("b")).filter("b is not null and a <> b")
    return star(each, [*group, "source"]).union(star(free, [*group, "age"])).union(chain).union(breedless_edges(t)).distinct()


def breedless_edges(t: DataFrame) -> DataFrame:
    """Edges between listings with and without breed tokens, of one name and side in two sources.

    Listings without tokens of one name, side and age are connected already, so two of them, from different
    sources if there are any, stand for all: one at least is not from the other listing's source. So are those
    within the gap on the same side of an age; of each such stretch one is enough.
    """
    t = t.filter(~F.col("placeholder"))
    own = F.struct("source", "id")
    bare = t.filter(F.size("tokens") == 0).groupBy("name", "side", "age").agg(F.min(own).alias("p"), F.max(own).alias("q"))
    bare = bare.select("name", "side", F.explode(F.array_distinct(F.array(*[F.struct("age", F.col(f"{x}.source").alias("source"), F.col(f"{x}.id").alias("id")) for x in "pq"]))).alias("x"))
    lists = bare.groupBy("name", "side").agg(F.collect_list("x").alias("bare"))
    j = t.filter(F.size("tokens") > 0).select("id", "source", "age", "name", "side").join(lists, ["name", "side"])
    j = j.withColumn("bare", F.filter("bare", lambda x: ~x["source"].eqNullSafe(F.col("source"))))

    def one(test) -> Column:
        return F.slice(F.filter("bare", test), 1, 1)

    age = F.col("age")
    picked = F.concat(one(lambda x: x["age"].isNull()), one(lambda x: x["age"].between(age - AGE_GAP, age)), one(lambda x: x["age"].between(age, age + AGE_GAP)))
    return j.select(F.col("id").alias("a"), F.explode(F.when(age.isNull(), F.col("bare")).otherwise(picked)).alias("x")).select("a", F.col("x.id").alias("b"))
