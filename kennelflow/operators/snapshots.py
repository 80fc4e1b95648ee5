"""Full snapshots of keyed records: changes between them, and the history of attributes.

Rows of a delivery are reduced to one per key before anything else, by an aggregation with map-side
combine, so a key that is repeated in a third of all rows costs one row after the first exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kennelflow.functions.text import same_text_key
from kennelflow.io import cut_lineage

COMPLETE = ("success", "success_with_warnings")


def complete_runs(runs: DataFrame, ok: Sequence[str] = COMPLETE) -> DataFrame:
    """Complete runs with their neighbours: run_id, source_id, crawl_scope, seq, prev_run_id, next_run_id.

    Runs of one (source_id, crawl_scope) are ordered by started_at, then id. Repeated rows of an id
    count once (the earliest start), rows without id or start not at all; null scopes form a scope.
    """
    one = (
        runs.filter(F.col("status").isin(*ok) & F.col("id").isNotNull() & F.col("started_at").isNotNull())
        .groupBy(F.col("id").alias("run_id"))
        .agg(F.min(F.struct("started_at", "source_id", "crawl_scope")).alias("r"))
        .select("run_id", "r.*")
    )
    w = Window.partitionBy("source_id", "crawl_scope").orderBy("started_at", "run_id")
    return one.select(
        "run_id",
        F.col("source_id").alias("run_source_id"),
        "crawl_scope",
        F.row_number().over(w).alias("seq"),
        F.lag("run_id").over(w).alias("prev_run_id"),
        F.lead("run_id").over(w).alias("next_run_id"),
    )


def latest_in_run(snapshots: DataFrame, fields: dict[str, Column], key: Sequence[str] = ("run_id", "source_id", "listing_key"), version: str = "extracted_at") -> DataFrame:
    """One row per key: the one with the latest ``version`` (null is oldest); ties go to the greater fields.

    ``fields`` maps result names to expressions. Rows with a null in the key are no records and are left out.
    """
    keyed = snapshots.filter(F.expr(" and ".join(f"`{k}` is not null" for k in key)))
    rows = keyed.select(*key, F.col(version).alias("_version"), *[c.alias(n) for n, c in fields.items()])
    return rows.groupBy(*key).agg(F.max(F.struct("_version", *fields)).alias("_r")).select(*key, *[F.col(f"_r.{n}").alias(n) for n in fields])


def except_all_both_ways(new: DataFrame, old: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``new EXCEPT ALL old`` and ``old EXCEPT ALL new`` in one exchange.

    Both differences are the positive and the negative part of the same signed multiset count, so one
    aggregation over the whole row gives both; ``n`` tells how many copies remain (below 0: of old).
    """
    both = new.select(*cols, F.lit(1).alias("_sign")).unionAll(old.select(*cols, F.lit(-1).alias("_sign")))
    return both.groupBy(*cols).agg(F.sum("_sign").alias("n")).filter("n <> 0")


def snapshot_changes(snapshots: DataFrame, runs: DataFrame, compared: Sequence[str], ok: Sequence[str] = COMPLETE) -> DataFrame:
    """Records added, removed or changed from each complete run to the next one of its scope.

    Identical rows (up to letter case and white space, null = '') cancel in ``except_all_both_ways``;
    what is left is full-joined by key: only new = ``added``, only old = ``removed``, both = ``changed``.
    The first complete run of a scope has no cases. A complete run without rows removes all records
    before it. Returns run_id, source_id, listing_key, change_kind, crawl_scope. Empty tables give no rows.
    """
    known = complete_runs(runs, ok)
    rows = latest_in_run(snapshots, {c: same_text_key(F.col(c)) for c in compared}).join(known.drop("seq"), "run_id")
    cols = ["pair", "source_id", "listing_key", *compared]
    new = rows.filter("prev_run_id is not null").withColumn("pair", F.col("run_id"))
    old = rows.filter("next_run_id is not null").withColumn("pair", F.col("next_run_id"))
    key = ["pair", "source_id", "listing_key"]
    # kept once without the contents, since both sides of the join read it
    rest = cut_lineage(except_all_both_ways(new, old, cols).select(*key, (F.col("n") > 0).alias("is_new")))
    a = rest.filter("is_new").select(*key, F.lit(True).alias("in_new"))
    b = rest.filter("not is_new").select(*key, F.lit(True).alias("in_old"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").select(F.col("pair").alias("run_id"), "source_id", "listing_key", kind.alias("change_kind"))


def attribute_log(rows: DataFrame, key: Sequence[str], attributes: Sequence[str], seq: str = "seq") -> DataFrame:
    """The change log of each attribute on its own: key, attribute, from_seq, to_seq (exclusive), value.

    ``rows`` holds one row per key and ``seq``. An interval of an attribute is a longest stretch of
    consecutive ``seq`` with one value; it ends where the value changes or the record is absent.
    """
    w = Window.partitionBy(*key).orderBy(seq)
    there, gone = F.coalesce(F.lag(seq).over(w) == F.col(seq) - 1, F.lit(False)), F.coalesce(F.lead(seq).over(w) == F.col(seq) + 1, F.lit(False))
    marked = rows.select(
        *key,
        F.col(seq).alias("_seq"),
        *[F.col(a).alias(f"_v{i}") for i, a in enumerate(attributes)],
        *[(~there | ~F.lag(a).over(w).eqNullSafe(F.col(a))).alias(f"_open{i}") for i, a in enumerate(attributes)],
        *[(~gone | ~F.lead(a).over(w).eqNullSafe(F.col(a))).alias(f"_close{i}") for i, a in enumerate(attributes)],
    )
    # an event is written only where an attribute's interval opens or closes; the rest of the rows ends here
    events = F.flatten(
        F.array(
            *[
                F.filter(
                    F.array(
                        F.when(F.col(f"_open{i}"), F.struct(F.lit(i).alias("attribute"), F.lit(0).alias("closes"), F.col("_seq").alias("at"), F.col(f"_v{i}").alias("value"))),
                        F.when(F.col(f"_close{i}"), F.struct(F.lit(i).alias("attribute"), F.lit(1).alias("closes"), (F.col("_seq") + 1).alias("at"), F.col(f"_v{i}").alias("value"))),
                    ),
                    lambda x: x.isNotNull(),
                )
                for i in range(len(attributes))
            ]
        )
    )
    log = marked.select(*key, F.explode(events).alias("e")).select(*key, "e.*")
    # opens and closes alternate within an attribute, a close before an open at the same place
    v = Window.partitionBy(*key).orderBy("attribute", "at", F.desc("closes"))
    return log.withColumn("to_seq", F.lead("at").over(v)).filter("closes = 0").select(*key, "attribute", F.col("at").alias("from_seq"), "to_seq", "value")


def combine_logs(log: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Versions of whole records out of the logs of ``n`` attributes.

    All intervals of a key are split at the union of their boundaries; in each piece every attribute has
    at most one value, carried on from the boundary where it opened. Neighbouring pieces with the same
    values are put together again. Returns key, from_seq, to_seq (exclusive), v0 .. v(n-1).
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("from_seq").alias("at"), F.struct(F.lit(True).alias("on"), F.col("value").alias("value")).alias("s")),
            F.struct(F.col("to_seq").alias("at"), F.struct(F.lit(False).alias("on"), F.lit(None).cast("string").alias("value")).alias("s")),
        )
    )
    marks = log.select(*key, "attribute", ends.alias("b")).select(*key, "attribute", "b.at", "b.s")
    # of a close and an open at one boundary the open counts (on = true is the greater)
    at = marks.groupBy(*key, "at").agg(*[F.max(F.when(F.col("attribute") == i, F.col("s"))).alias(f"s{i}") for i in range(n)])
    w = Window.partitionBy(*key).orderBy("at")
    pieces = at.select(*key, "at", F.lead("at").over(w).alias("upto"), *[F.last(f"s{i}", ignorenulls=True).over(w).alias(f"s{i}") for i in range(n)])
    alive = pieces.filter(" and ".join(f"s{i}.on" for i in range(n))).select(*key, "at", "upto", *[F.col(f"s{i}.value").alias(f"v{i}") for i in range(n)])
    same = F.coalesce(F.lag("upto").over(w) == F.col("at"), F.lit(False))
    for i in range(n):
        same = same & F.lag(f"v{i}").over(w).eqNullSafe(F.col(f"v{i}"))
    grouped = alive.withColumn("_new", (~same).cast("int")).withColumn("_g", F.sum("_new").over(w))
    return grouped.groupBy(*key, "_g").agg(F.min("at").alias("from_seq"), F.max("upto").alias("to_seq"), *[F.first(f"v{i}").alias(f"v{i}") for i in range(n)]).drop("_g")


def attribute_history(snapshots: DataFrame, runs: DataFrame, attributes: Sequence[str], ok: Sequence[str] = COMPLETE) -> DataFrame:
    """Every version of every record of each scope with the complete runs between which it held.

    Returns source_id, crawl_scope, listing_key, from_run_id, to_run_id (first complete run in which the
    version no longer holds, 0 if there is none) and the attributes as compared. Values differing only in
    letter case or white space are one, null = ''. Incomplete runs neither end nor extend a version.
    """
    known = complete_runs(runs, ok)
    rows = latest_in_run(snapshots, {a: same_text_key(F.col(a)) for a in attributes}).join(known.select("run_id", "crawl_scope", "seq"), "run_id")
    key = ["source_id", "crawl_scope", "listing_key"]
    versions = combine_logs(attribute_log(rows, key, attributes), key, len(attributes))
    first = known.select(F.col("run_source_id").alias("source_id"), "crawl_scope", F.col("seq").alias("from_seq"), F.col("run_id").alias("from_run_id"))
    until = known.select(F.col("run_source_id").alias("source_id"), "crawl_scope", F.col("seq").alias("to_seq"), F.col("run_id").alias("to_run_id"))

    def at(left: DataFrame, right: DataFrame, seq: str, how: str) -> DataFrame:
        r = right.withColumnsRenamed({"source_id": "_s", "crawl_scope": "_c", seq: "_q"})
        return left.join(r, F.col("source_id").eqNullSafe(F.col("_s")) & F.col("crawl_scope").eqNullSafe(F.col("_c")) & (F.col(seq) == F.col("_q")), how).drop("_s", "_c", "_q")

    out = at(at(versions, first, "from_seq", "inner"), until, "to_seq", "left")
    return out.select(*key, "from_run_id", F.coalesce("to_run_id", F.lit(0).cast("bigint")).alias("to_run_id"), *[F.col(f"v{i}").alias(a) for i, a in enumerate(attributes)])
