"""Operators on keyed records: de-duplication, upserts, change detection, lifecycle, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Spark turns the rank filter into a grouped limit before the exchange."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in the whole order (no two rows may tie), without one task that sorts all rows.

    A range partitioning puts the rows in order; the rows before each partition are added to the place inside it. Kept once, since
    the partitions are read twice.
    """
    from kennelflow.io import cut_lineage

    kept = cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    # a row a partition
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before")
    return kept.join(F.broadcast(before), "_p").withColumn(name, place.cast("bigint")).drop("_p", "_before")


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The stored table after the incoming rows: incoming ones win, but columns in ``keep`` stay as stored."""
    a, b = stored.alias("a"), incoming.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    there, new = F.col("_there").isNotNull(), F.col("_new").isNotNull()
    j = a.withColumn("_there", F.lit(True)).alias("a").join(b.withColumn("_new", F.lit(True)).alias("b"), on, "full_outer")
    cols = [F.when(new & ~(there & F.lit(c in keep)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in stored.columns]
    return j.select(*cols)


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows and the incoming ones whose key is not stored yet: the first write counts."""
    return stored.unionByName(incoming.join(stored.select(*key), list(key), "left_anti").dropDuplicates(list(key)))


def delete_keys(stored: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return stored.join(keys.select(*key), list(key), "left_anti")


def classify_changes(stored: DataFrame, incoming: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """key, outcome: inserted, updated, unchanged or missing, by comparing the content of both sides."""
    whole = F.struct(*content)
    a = stored.select(*key, whole.alias("_h"), F.lit(True).alias("_a"))
    b = incoming.select(*key, whole.alias("_g"), F.lit(True).alias("_b"))
    j = a.join(b, list(key), "full_outer")
    outcome = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "missing").when(F.col("_h").eqNullSafe(F.col("_g")), "unchanged").otherwise("updated")
    return j.select(*key, outcome.alias("outcome"))


def merge_details(old: dict[str, Column], new: dict[str, Column], card_only: Column, informative) -> dict[str, Column]:
    """Field by field: a card-only row that says nothing keeps what is known."""
    return {c: F.when(card_only & ~informative(new[c]) & informative(old[c]), old[c]).otherwise(new[c]) for c in new}


def missed_runs(seen: DataFrame, runs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """seen: scope, key, last_seen_at; runs: scope, ran_at (conclusive) -> missed and missing_since.

    The runs of a scope become one sorted list, as long as there are days of history, so each record meets
    one row; records are neither ordered nor gathered by scope, which may hold a third of them.
    """
    lists = runs.filter("ran_at is not null").groupBy(*scope).agg(F.sort_array(F.collect_set("ran_at")).alias("_ran"))
    j = seen.join(lists, list(scope), "left")
    j = j.withColumn("_after", F.filter("_ran", lambda r: r > F.col("last_seen_at")))
    missed = F.when(F.col("_after").isNull(), 0).otherwise(F.size("_after"))
    return j.select(*[F.col(c) for c in seen.columns], missed.cast("int").alias("missed"), F.get("_after", F.lit(0)).alias("missing_since"))


# Missed runs from which a record counts as likely gone, missing for several runs and missing once.
def stale_status(missed: Column, first_time: Column) -> Column:
    return F.when(missed >= 4, "likely_unavailable").when(missed >= 2, "missing_multiple_runs").when(missed == 1, "missing_once").when(first_time, "available").otherwise("still_seen")


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, filled, total: how many rows hold a value, for each column, in one pass."""
    row = df.agg(F.count("*").alias("_total"), *[F.count(c).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled"), F.col("_total").alias("total")) for c in columns])).alias("f")).select("f.*")


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges: a, b -> node, component (the least node). Large-star and small-star rounds until nothing changes.

    Each round rewires every node to the least neighbour known, so the number of rounds grows with the
    logarithm of a component's diameter; if ``rounds`` do not do, that is an error. A node with a third of all edges is aggregated with partial minima
    and joined back by an exchange that AQE may split.
    """
    from kennelflow.io import cut_lineage, release

    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut_lineage(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    first = e
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        nxt = cut_lineage(small)
        same = nxt.count() == e.count() and nxt.exceptAll(e).isEmpty()
        if e is not first:
            release(e)
        e = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components not complete after {rounds} rounds")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("component")), nodes.node == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
