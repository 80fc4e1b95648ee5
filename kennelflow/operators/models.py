"""Batch plumbing around a model that the caller gives as a function: chunks, validation of ids, merging, fallbacks.

A model is any callable on plain Python values, a deterministic stub in tests. It runs on the executors, one group of few rows at a
time; what it returns is untrusted: ids that were not asked for are dropped, numbers are clamped, and a call that fails leaves
the order that was there before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Candidates that are judged, in chunks of so many; fit from which a judged one counts; alerts of a watch.
SHORTLIST, CHUNK, FIT, NEW, ALERTS = 40, 5, 55.0, 12, 5


def extract_json(text: str | None):
    """The first JSON object or array in a text, whatever stands around it; None without one."""
    decoder = json.JSONDecoder()
    for i, ch in enumerate(text or ""):
        if ch in "{[":
            try:
                return decoder.raw_decode(text, i)[0]
            except ValueError:
                continue
    return None


def _texts(xs) -> list[str]:
    return [x for x in xs if isinstance(x, str)] if isinstance(xs, list) else []


def parse_requests(requests: DataFrame, model: Callable[[str], str | dict]) -> DataFrame:
    """id, query -> id, parsed (JSON of an object; '{}' where the model fails or gives none)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for q in b["query"]:
                try:
                    got = model(q) if q else {}
                    got = extract_json(got) if isinstance(got, str) else got
                except Exception:  # noqa: BLE001 - a failed call asks for nothing
                    got = {}
                out.append(json.dumps(got if isinstance(got, dict) else {}))
            yield pd.DataFrame({"id": b["id"], "parsed": out})

    return requests.select("id", "query").mapInPandas(run, requests.select("id", F.lit("").alias("parsed")).schema)


def judged(ranked: DataFrame, requests: DataFrame, model: Callable[[str, list[dict]], list[dict]], chunk: int = CHUNK, shortlist: int = SHORTLIST) -> DataFrame:
    """ranked: watch_id, id, rank, block (text of a candidate); requests: watch_id, query -> watch_id, id, fit, reasons, caveats.

    The first ``shortlist`` of each watch go to the model in chunks of ``chunk``, each chunk on its own: if a call fails, only its chunk
    has no fit. Fits are clamped to 0..100; candidates that were not in the chunk, and repeats but the first, are dropped.
    """
    top = ranked.filter(F.col("rank") <= shortlist).withColumn("chunk", F.floor((F.col("rank") - 1) / chunk).cast("int")).join(requests.select("watch_id", "query"), "watch_id")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        out = {}
        try:
            for r in model(g["query"].iloc[0], g[["id", "block"]].to_dict("records")):
                if isinstance(r, dict) and r.get("id") in set(g.id) and r["id"] not in out and isinstance(r.get("score"), (int, float)):
                    out[r["id"]] = (key[0], r["id"], float(min(100, max(0, r["score"]))), _texts(r.get("reasons")), _texts(r.get("caveats")))
        except Exception:  # noqa: BLE001 - its chunk keeps the order it had
            out = {}
        return pd.DataFrame(list(out.values()), columns=["watch_id", "id", "fit", "reasons", "caveats"])

    schema = top.select("watch_id", "id", F.lit(0.0).alias("fit"), F.array(F.lit("")).alias("reasons"), F.array(F.lit("")).alias("caveats")).schema
    return top.groupBy("watch_id", "chunk").applyInPandas(run, schema)


def reranked(ranked: DataFrame, fits: DataFrame, gate: float | None = None) -> DataFrame:
    """``ranked`` with fit and place: judged ones first by their fit, the others after them in their order.

    ``gate``: only candidates with at least this fit stay, once anything is judged for their watch.
    """
    best = fits.groupBy("watch_id", "id").agg(F.max("fit").alias("fit"))
    j = ranked.join(best, ["watch_id", "id"], "left")
    if gate is not None:
        some = fits.select("watch_id").distinct().withColumn("_any", F.lit(True))
        j = j.join(some, "watch_id", "left").filter(F.col("_any").isNull() | (F.col("fit") >= gate)).drop("_any")
    w = Window.partitionBy("watch_id").orderBy(F.col("fit").isNull(), F.desc("fit"), "rank")
    return j.withColumn("place", F.row_number().over(w))


def curated(new: DataFrame, requests: DataFrame, model: Callable[[str, list[dict]], dict | str | None] | None, alerts: int = ALERTS) -> DataFrame:
    """new: watch_id, id, rank, block (few a watch) -> watch_id, id, place, headline, blurb, by_model.

    The model chooses and words the alerts in its order; ids it was not given and empty ones are dropped. Without a model, where it
    fails or where it gives no list of alerts, the first ``alerts`` of the watch are taken as they are. An empty list is a choice.
    """
    j = new.join(requests.select("watch_id", "query"), "watch_id")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        plain = [(key[0], i, n + 1, None, None, False) for n, i in enumerate(g.id.head(alerts))]
        out = plain
        if model:
            try:
                got = model(g["query"].iloc[0], g[["id", "block"]].to_dict("records"))
                got = extract_json(got) if isinstance(got, str) else got
                if isinstance(got, dict) and isinstance(got.get("alerts"), list):
                    chosen = {}
                    for a in got["alerts"]:
                        head, blurb = (str(a.get(k) or "").strip() for k in ("headline", "blurb"))
                        if a.get("id") in set(g.id) and (head or blurb):
                            chosen.setdefault(a["id"], (head or "New match", blurb))
                    out = [(key[0], i, n + 1, h, t, True) for n, (i, (h, t)) in enumerate(chosen.items())]
            except Exception:  # noqa: BLE001 - as without a model
                out = plain
        return pd.DataFrame(out, columns=["watch_id", "id", "place", "headline", "blurb", "by_model"])

    schema = j.select("watch_id", "id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("headline"), F.lit(None).cast("string").alias("blurb"), F.lit(False).alias("by_model")).schema
    return j.groupBy("watch_id").applyInPandas(run, schema)


def enriched(work: DataFrame, model: Callable[[str], dict], limit: int | None = None) -> DataFrame:
    """work: id, url -> id, outcome ('done' or 'failed'), tags, texture, length, size, description, confidence.

    Words are trimmed and in lower case, repeats dropped; confidence is clamped to 0..1. ``limit``: the first so many by id, if a batch is to
    be bounded.
    """
    todo = work.select("id", "url").filter("id is not null and url is not null")
    todo = todo.orderBy("id").limit(limit) if limit is not None else todo

    def word(x) -> str | None:
        return (x.strip().lower() or None) if isinstance(x, str) else None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for i, url in zip(b["id"], b["url"]):
                try:
                    r = model(url)
                    tags = list(dict.fromkeys(w for w in map(word, r.get("tags") or []) if w))
                    sure = r.get("confidence")
                    out.append((i, "done", tags, word(r.get("texture")), word(r.get("length")), word(r.get("size")), (r.get("description") or "").strip() or None, None if not isinstance(sure, (int, float)) else min(1.0, max(0.0, float(sure)))))
                except Exception:  # noqa: BLE001 - counted and tried again another time
                    out.append((i, "failed", [], None, None, None, None, None))
            yield pd.DataFrame(out, columns=["id", "outcome", "tags", "texture", "length", "size", "description", "confidence"])

    return todo.mapInPandas(run, "id string, outcome string, tags array<string>, texture string, length string, size string, description string, confidence double")


def overnight(new: DataFrame, requests: DataFrame, ledger: DataFrame, model=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alerts, ledger after them, summary): the first ``NEW`` of each watch, chosen by ``curated``, told once.

    ``new``: watch_id, id, rank, block of matches that the ledger (watch_id, id) does not hold. summary: watch_id, candidates, told.
    """
    few = new.filter(F.col("rank") <= NEW)
    alerts = curated(few, requests, model)
    after = ledger.select("watch_id", "id").unionByName(alerts.select("watch_id", "id")).distinct()
    told = alerts.groupBy("watch_id").agg(F.count("*").alias("told"))
    summary = few.groupBy("watch_id").agg(F.count("*").alias("candidates")).join(told, "watch_id", "left").select("watch_id", "candidates", F.coalesce("told", F.lit(0)).alias("told"))
    return alerts, after, summary
