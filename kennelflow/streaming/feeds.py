"""Structured Streaming around the batch operators: snapshot upserts, event windows, alerts sent once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kennelflow.io import delete_path
from kennelflow.operators.records import insert_ignore, pick_by, upsert


def windowed_counts(events: DataFrame, at: str, width: str, late: str, key: Sequence[str]) -> DataFrame:
    """Counts per key and tumbling window; what comes later than ``late`` behind the newest event is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, gap: str, late: str, key: Sequence[str]) -> DataFrame:
    """Activity periods of each key: a pause longer than ``gap`` ends one."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), *key).agg(F.count("*").alias("n"))


def once(events: DataFrame, at: str, late: str, key: Sequence[str]) -> DataFrame:
    """Each key the first time within the watermark; the state is as large as the watermark is long."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def upsert_stream(incoming: DataFrame, path: str, key: Sequence[str], version: str, keep: Sequence[str] = ()) -> DataStreamWriter:
    """Every micro-batch is reduced to the latest version of each key and merged into the table at ``path``.

    Batches are written as numbered snapshots beside each other, so a batch that is repeated after a
    failure writes the same snapshot again, from the same one before it. Older ones are removed.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = pick_by(batch, list(key), [F.desc_nulls_last(version), F.desc(F.xxhash64(*batch.columns))])
        merged = upsert(spark.read.parquet(f"{path}/{n - 1}"), new, key, keep) if n else new
        merged.write.mode("overwrite").parquet(f"{path}/{n}")
        # a repeated batch needs the snapshot before its own only
        delete_path(spark, f"{path}/{n - 2}")

    return incoming.writeStream.foreachBatch(merge)


def alert_stream(matches: DataFrame, path: str, key: Sequence[str], send: Callable[[DataFrame], None]) -> DataStreamWriter:
    """Sends what the ledger at ``path`` doesn't hold yet, then adds it: a pair is reported once.

    The ledger is written after the sending, as numbered snapshots: a failure in between sends a batch again.
    """

    def report(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        pairs = batch.select(*key).distinct()
        ledger = spark.read.parquet(f"{path}/{n - 1}") if n else pairs.limit(0)
        send(batch.join(ledger, list(key), "left_anti"))
        insert_ignore(ledger, pairs, key).write.mode("overwrite").parquet(f"{path}/{n}")
        delete_path(spark, f"{path}/{n - 2}")

    return matches.writeStream.foreachBatch(report)
