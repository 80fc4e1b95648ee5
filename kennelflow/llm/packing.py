"""Items of varying length packed whole into containers of fixed capacity.

Conflict-constrained best fit: the open bins of a shard are ordered by what is left in them; each bin
carries a bitmap of its sources and one of its duplicate clusters. For an item, longest first, the search
starts at the tightest bin that it fits and goes on through the successors until one is compatible: no
copy of the item's cluster is in it, no source that must not share a container with the item's, and not already as
many sources as a container may have.

Shards are hashes of the item, sized by counts, so that a source or cluster with a third of all items is
spread evenly. The bins that a round leaves loosely filled are opened again and their items packed anew
in fewer shards, for ``ROUNDS`` rounds or until one shard holds them all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kennelflow.io import cut_lineage

CAPACITY = 2048
#: Items packed by one task.
SHARD_ITEMS = 20_000
#: A bin filled to this share is closed for good; the rest are packed again, at most ROUNDS times.
GOOD_FILL, ROUNDS = 0.98, 3


def best_fit(items: Iterable[tuple[int, int, int, int]], capacity: int, apart: dict[int, int], most_sources: int | None = None) -> list[tuple[int, list[int]]]:
    """items: (item, size, source bit number, cluster bit number or -1) -> (free room, items) of each bin.

    ``apart``: source bit number -> bitmap of sources that must not share its bin. ``most_sources``: different sources in a
    bin at most. A cluster all of whose bins are in the way opens a new bin without a search.
    """
    left: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    holding: dict[int, list[int]] = {}  # cluster -> free room of the bins that hold it, in order
    within: list[set[int]] = []  # clusters in each bin
    for item, size, src, cl in sorted(items, key=lambda x: (-x[1], x[0])):
        bad, bit, copy = apart.get(src, 0), 1 << src, 1 << cl if cl >= 0 else 0
        at = bisect_left(left, (size, -1))
        if copy and (own := holding.get(cl)) and len(own) - bisect_left(own, size) == len(left) - at:
            at = len(left)
        while at < len(left):
            b = left[at][1]
            if not (clusters[b] & copy or sources[b] & bad) and (most_sources is None or sources[b] & bit or sources[b].bit_count() < most_sources):
                break
            at += 1
        if at < len(left):
            room, b = left.pop(at)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
            sources.append(0)
            clusters.append(0)
            within.append(set())
        for c in within[b]:
            own = holding[c]
            own.pop(bisect_left(own, room))
            insort(own, room - size)
        if copy:
            within[b].add(cl)
            insort(holding.setdefault(cl, []), room - size)
        sources[b] |= bit
        clusters[b] |= copy
        insort(left, (room - size, b))
    return [(room, bins[b]) for room, b in left]


def split_long(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, tokens, ... -> item rows: part_no, from_token, size. Only what exceeds the capacity is split."""
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1))
    rows = docs.filter("tokens > 0").withColumn("part_no", F.explode(parts))
    return rows.withColumn("from_token", (F.col("part_no") * capacity).cast("bigint")).withColumn("size", F.least(F.lit(capacity), F.col("tokens") - F.col("from_token")).cast("int"))


def pack(items: DataFrame, capacity: int = CAPACITY, keep_apart: Iterable[tuple[str, str]] = (), most_sources: int | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """items: doc_id, part_no, size, source, cluster (null: no copies) -> doc_id, part_no, size, container.

    Every item comes out once; no container exceeds ``capacity``, holds two items of one cluster, two
    sources of a pair in ``keep_apart`` or more than ``most_sources`` sources. Items of size 0 or null are not packed; null sources are a source
    of their own. Equal sizes are taken in the order of their ids, so the result is the same in every run.
    """
    pairs = [tuple(p) for p in keep_apart]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rnd, shard = key
        names = {s: i for i, s in enumerate(sorted({x for p in pairs for x in p} | set(g.source.fillna(""))))}
        apart: dict[int, int] = {}
        for a, b in pairs:
            apart[names[a]] = apart.get(names[a], 0) | 1 << names[b]
            apart[names[b]] = apart.get(names[b], 0) | 1 << names[a]
        counts = g.cluster.value_counts()
        bits = {c: i for i, c in enumerate(sorted(counts[counts > 1].index))}
        g = g.sort_values(["doc_id", "part_no"]).reset_index(drop=True)
        its = ((i, int(s), names[x], bits.get(c, -1)) for i, (s, x, c) in enumerate(zip(g["size"], g.source.fillna(""), g.cluster)))
        label, room = [""] * len(g), [0] * len(g)
        for n, (free, members) in enumerate(sorted(best_fit(its, capacity, apart, most_sources), key=lambda b: b[1][0])):
            for m in members:
                label[m], room[m] = f"{rnd}-{shard}-{n}", free
        return g.assign(container=label, free=room)[["doc_id", "part_no", "size", "source", "cluster", "container", "free"]]

    schema = "doc_id bigint, part_no int, size int, source string, cluster string, container string, free int"
    rest = items.filter("size > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("part_no").cast("int").alias("part_no"), F.col("size").cast("int").alias("size"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    # what fills a container alone needs no bin
    full = rest.filter(F.col("size") >= capacity).select("doc_id", "part_no", "size", F.concat_ws("-", F.lit("full"), "doc_id", "part_no").alias("container"))
    rest = rest.filter(F.col("size") < capacity)
    done = [full]
    for rnd in range(ROUNDS):
        shards = max(1, -(-rest.count() // shard_items))
        key = F.pmod(F.xxhash64("doc_id", "part_no", F.lit(rnd)), F.lit(shards)).cast("int")
        packed = cut_lineage(rest.withColumns({"round": F.lit(rnd), "shard": key}).groupBy("round", "shard").applyInPandas(run, schema))
        last = shards == 1 or rnd == ROUNDS - 1
        good = F.lit(True) if last else F.col("free") <= (1 - GOOD_FILL) * capacity
        done.append(packed.filter(good).select("doc_id", "part_no", "size", "container"))
        if last:
            break
        rest = packed.filter(~good).select("doc_id", "part_no", "size", "source", "cluster")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def text_cluster(text):
    """One number for texts that differ only in letter case and white space, as copies do."""
    from kennelflow.functions.text import same_text_key

    return F.xxhash64(same_text_key(text))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill (share of the room used), loosest (least tokens in one)."""
    c = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return c.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.max("used").alias("fullest"), F.min("used").alias("loosest"))
