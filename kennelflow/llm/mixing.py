"""Records of several sources mixed to target shares of the total size.

Temperature mixing: weights are source shares raised to an exponent and normalised. The exponent is bisected: so that
the entropy of the tempered natural shares meets a target, or, between natural and wanted shares, so that no source is
repeated beyond its limit at a wanted total. Weights become budgets of tokens, realised by block permutations: each
pass over a source orders its records by a seeded hash, cut into blocks; whole passes and whole blocks are taken as
they are, and only the block in which a budget ends is cut inside. No task orders a whole source.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kennelflow.io import cut_lineage

#: Records in one block, about; a source has one block for each so many of its records.
BLOCK_RECORDS = 10_000
STEPS = 80


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def tempered(shares: dict[str, float], alpha: float) -> dict[str, float]:
    """Shares to the power alpha, normalised: 1 keeps them, 0 makes them equal."""
    p = {s: x**alpha for s, x in shares.items() if x > 0}
    total = sum(p.values())
    return {s: x / total for s, x in p.items()}


def exponent_for_entropy(shares: dict[str, float], target: float) -> float:
    """The exponent in [0, 16] whose weights have the target entropy; the nearer end if none has."""
    lo, hi = 0.0, 16.0
    if entropy(tempered(shares, lo)) <= target:
        return lo
    if entropy(tempered(shares, hi)) >= target:
        return hi
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(tempered(shares, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def blended(natural: dict[str, float], wanted: dict[str, float], alpha: float) -> dict[str, float]:
    """Natural shares times (wanted / natural) to the power alpha, normalised: 1 gives the wanted shares."""
    p = {s: natural[s] * (wanted[s] / natural[s]) ** alpha for s in wanted if wanted[s] > 0 and natural.get(s, 0) > 0}
    total = sum(p.values())
    return {s: x / total for s, x in p.items()}


def most_tokens(weights: dict[str, float], tokens: dict[str, int], repeats: dict[str, int]) -> float:
    """The greatest total at which no source of these weights is repeated beyond its limit."""
    return min((tokens[s] * repeats[s] / w for s, w in weights.items() if w > 0), default=0.0)


def exponent_for_total(natural: dict[str, float], wanted: dict[str, float], tokens: dict[str, int], repeats: dict[str, int], total: float) -> float:
    """The greatest exponent in [0, 1] whose weights allow the total under all repetition limits (0 if none does)."""
    if most_tokens(blended(natural, wanted, 1.0), tokens, repeats) >= total:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if most_tokens(blended(natural, wanted, mid), tokens, repeats) >= total else (lo, mid)
    return lo


def exponent_of(natural: dict[str, float], wanted: dict[str, float], tokens: dict[str, int], repeats: dict[str, int], total: float | None, target_entropy: float | None) -> tuple[dict[str, float], float]:
    """The weights and the bisected exponent: for a target entropy those of tempered natural shares, else those between natural and wanted shares."""
    if target_entropy is not None:
        alpha = exponent_for_entropy(natural, target_entropy)
        return tempered(natural, alpha), alpha
    alpha = exponent_for_total(natural, wanted, tokens, repeats, total if total is not None else most_tokens(wanted, tokens, repeats))
    return blended(natural, wanted, alpha), alpha


def plan(sizes: pd.DataFrame, targets: pd.DataFrame, total: float | None = None, target_entropy: float | None = None) -> pd.DataFrame:
    """sizes: source, tokens; targets: source, target_share, max_repeats -> a row per target with its budget.

    The exponent is bisected: with ``target_entropy`` natural shares are tempered until their entropy is that (in nats); else
    it is the greatest at which the repetition limits allow ``total`` (without one the greatest total that the wanted
    shares allow, so that they are met). A total beyond the limits is cut to them. Sources without tokens or share get
    weight 0, and the shares of the others are scaled up.
    """
    tokens = {s: int(t) for s, t in zip(sizes.source, sizes.tokens)}
    t = targets.dropna(subset=["source"]).drop_duplicates("source").fillna({"target_share": 0.0, "max_repeats": 1})
    use = {s: float(x) for s, x, r in zip(t.source, t.target_share, t.max_repeats) if x > 0 and r > 0 and tokens.get(s, 0) > 0}
    repeats = {s: int(r) for s, r in zip(t.source, t.max_repeats)}
    scale = sum(use.values())
    wanted = {s: x / scale for s, x in use.items()} if use else {}
    have = sum(tokens[s] for s in wanted)
    natural = {s: tokens[s] / have for s in wanted}
    w, alpha = exponent_of(natural, wanted, tokens, repeats, total, target_entropy) if wanted else ({}, 1.0)
    whole = most_tokens(w, tokens, repeats) if total is None else min(total, most_tokens(w, tokens, repeats))
    rows = [(s, float(x), int(r), tokens.get(s, 0), natural.get(s, 0.0), w.get(s, 0.0), int(w.get(s, 0.0) * whole + 1e-6), alpha) for s, x, r in zip(t.source, t.target_share, t.max_repeats)]
    out = pd.DataFrame(rows, columns=["source", "target_share", "max_repeats", "tokens", "natural_share", "weight", "budget", "exponent"])
    out["full_passes"] = [b // n if n else 0 for b, n in zip(out.budget, out.tokens)]
    out["rest"] = [b - f * n for b, f, n in zip(out.budget, out.full_passes, out.tokens)]
    return out


def source_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))


def countable(docs: DataFrame) -> DataFrame:
    """The records that may be selected, kept: those with tokens, id and source."""
    return cut_lineage(docs.filter("tokens > 0 and doc_id is not null and source is not null").select("doc_id", "source", "tokens"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total: float | None = None, target_entropy: float | None = None, block_records: int = BLOCK_RECORDS) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, source, tokens (as of ``countable``); targets: source, target_share, max_repeats -> (selection, report).

    selection: doc_id, source, pass_no, block, place, tokens; a pass is a permutation of its source, cut into blocks, and takes
    a record at most once. In the block in which the last, partial pass ends every record is taken, in order, that still
    fits the budget. report: one row per target with weight, exponent, budget, selected tokens, actual share and repeats.
    Sources are as many as the targets name, whose rows go to the driver; of the documents only sums per source do.
    Sources without a target are not selected.
    """
    spark = docs.sparkSession
    named = targets.select("source", "target_share", "max_repeats").filter("source is not null")
    sizes = source_sizes(docs).join(named.select("source").distinct(), "source").toPandas()
    p = plan(sizes, named.toPandas(), total, target_entropy)
    p["blocks"] = [max(1, -(-int(n) // block_records)) for n in p.source.map(dict(zip(sizes.source, sizes.records))).fillna(0)]
    budgets = spark.createDataFrame(p[["source", "full_passes", "rest", "blocks"]].astype({"full_passes": "int64", "rest": "int64", "blocks": "int64"}), "source string, full_passes bigint, rest bigint, blocks bigint")
    # one row per target: as small as the list of targets; the last pass is the one that may end before its source does
    d = docs.join(F.broadcast(budgets), "source").filter("full_passes > 0 or rest > 0")
    passes = F.explode(F.sequence(F.lit(1), (F.col("full_passes") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int")))
    d = d.withColumn("pass_no", passes).withColumn("_o", F.xxhash64("doc_id", "source", F.lit(seed), F.col("pass_no").cast("bigint")))
    # the block is the high part of the order, so blocks follow each other in the permutation
    d = d.withColumn("block", F.floor((F.col("_o") / F.lit(2.0**64) + 0.5) * F.col("blocks")).cast("bigint"))
    d = cut_lineage(d.select("doc_id", "source", "tokens", "rest", "pass_no", F.col("pass_no").cast("bigint") > F.col("full_passes"), "_o", "block").toDF("doc_id", "source", "tokens", "rest", "pass_no", "last", "_o", "block"))
    by_block = d.filter("last").groupBy("source", "block", "rest").agg(F.sum("tokens").alias("t"))
    cum = by_block.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("block")))
    taken = cum.select("source", "block", F.when(F.col("upto") <= F.col("rest"), F.lit(None).cast("bigint")).otherwise(F.col("rest") - (F.col("upto") - F.col("t"))).alias("room")).filter("room is null or room > 0")
    cut = d.filter("last").join(taken, ["source", "block"])

    def fill(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        # the one block in which a source's budget ends: in the permuted order, whatever still fits
        room, keep = int(g.room.iloc[0]), []
        g = g.sort_values(["_o", "doc_id"])
        for t in g.tokens:
            keep.append(t <= room)
            room -= t if t <= room else 0
        return g[keep][["doc_id", "source", "tokens", "pass_no", "_o", "block"]]

    cols = ["doc_id", "source", "tokens", "pass_no", "_o", "block"]
    inside = cut.filter("room is not null").groupBy("source", "block").applyInPandas(fill, d.select(*cols).schema)
    chosen = d.filter(~F.col("last")).select(*cols).unionByName(cut.filter("room is null").select(*cols)).unionByName(inside)
    # a block has about ``block_records`` records
    place = F.row_number().over(Window.partitionBy("source", "pass_no", "block").orderBy("_o", "doc_id"))
    selection = chosen.withColumn("place", place).select("doc_id", "source", "pass_no", "block", "place", "tokens")
    got = chosen.groupBy("source").agg(F.sum("tokens").alias("selected"))
    rep = spark.createDataFrame(p[["source", "target_share", "max_repeats", "tokens", "natural_share", "weight", "budget", "exponent"]], "source string, target_share double, max_repeats int, tokens bigint, natural_share double, weight double, budget bigint, exponent double")
    rep = rep.join(got, "source", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    everything = F.sum("selected").over(Window.partitionBy(F.lit(1)))
    report = rep.withColumns({"actual_share": F.when(everything > 0, F.col("selected") / everything).otherwise(0.0), "repeats": F.when(F.col("tokens") > 0, F.col("selected") / F.col("tokens")).otherwise(0.0)})
    return selection, report
