"""Complete radius joins of points on a sphere.

Plan: the distinct positions of the points are split into the Voronoi cells of pivots, as many as there are chunks of
positions; above ``FLAT`` pivots in two levels, so that a position is compared with few of them. Each query is copied to
every cell that the triangle inequality cannot rule out (distance to the pivot at most its radius and the cell's reach).
A cell with many positions or many queries is cut into parts by its own counts, so positions are copied only where a
cell has more queries than one task takes. Within a part a vantage-point tree under the great-circle metric is searched
for all queries at once. Hits are pairs of positions, which are joined back to the rows; a position that very many rows
share is searched once and its rows are joined in salted parts.

Pivots come from a random sample of ``PER_PIVOT`` positions a pivot. They only decide how the work is split; every row is
assigned, and which pairs come out doesn't depend on them. What the driver holds is a row a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kennelflow.io import cut_lineage

EARTH_MI = 3958.7613
#: Positions in one task's tree, queries in one task: their product bounds the pairs that a task returns.
CHUNK, QUERY_CHUNK = 10_000, 1_000
#: Pivots at most and at least, those compared at once, and positions sampled for each.
MOST_PIVOTS, LEAST_PIVOTS, FLAT, PER_PIVOT = 16_384, 64, 256, 16
#: Rows of one position that are joined as one.
HOT_ROWS = 100_000
LEAF = 32


def usable(lat: Column, lon: Column) -> Column:
    """Neither null nor NaN, in range and not (0, 0)."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def great_circle(a: np.ndarray, b: np.ndarray, radius: float = EARTH_MI) -> np.ndarray:
    """Distances between unit vectors, broadcast over leading axes; exact at small and at large angles."""
    return radius * 2 * np.arctan2(np.linalg.norm(a - b, axis=-1), np.linalg.norm(a + b, axis=-1))


def spread_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-point choice of up to n pivots out of the given unit vectors."""
    if not len(points):
        return unit(np.array([0.0]), np.array([0.0]))
    chosen, far = [0], great_circle(points, points[0])
    while len(chosen) < n and far.max() > 1e-9:
        k = int(far.argmax())
        chosen.append(k)
        far = np.minimum(far, great_circle(points, points[k]))
    return points[chosen]


class VPTree:
    """Vantage-point tree over unit vectors. Equal distances may fall on either side of a node's median,
    so both bounds are inclusive."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray) -> int:
        # halves by rank, so that the depth is log2(n) even where all points are equal
        if len(ids) <= LEAF:
            self.nodes.append((None, ids))
            return len(self.nodes) - 1
        v, rest = ids[0], ids[1:]
        d = great_circle(self.points[rest], self.points[v])
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        near, far = order[:half], order[half:]
        a, b = self._build(rest[near]), self._build(rest[far])
        self.nodes.append((v, d[near[0]], d[near[-1]], a, d[far[0]], d[far[-1]], b))
        return len(self.nodes) - 1

    def within(self, qs: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) at most r[query] apart, and some more in the leaves: the exact test is the caller's.

        All queries that reach a node are compared with its vantage point in one pass.
        """
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(self.root, np.arange(len(qs)))]
        while stack:
            at, ids = stack.pop()
            node = self.nodes[at]
            if node[0] is None:
                hits.append((np.repeat(ids, len(node[1])), np.tile(node[1], len(ids))))
                continue
            v, n0, n1, a, f0, f1, b = node
            d = great_circle(qs[ids], self.points[v])
            hits.append((ids, np.full(len(ids), v)))
            for lo, hi, child in ((n0, n1, a), (f0, f1, b)):
                some = ids[(lo - r[ids] <= d) & (d <= hi + r[ids])]
                if len(some):
                    stack.append((child, some))
        return np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])


class Pivots:
    """Pivots in one or two levels: ``cell`` gives each unit vector the nearest pivot of the nearest group."""

    def __init__(self, sample: np.ndarray, n: int, flat: int = FLAT) -> None:
        if n <= flat or len(sample) <= flat:
            self.top = spread_pivots(sample, n)
            self.sub = [self.top[[k]] for k in range(len(self.top))]
        else:
            self.top = spread_pivots(sample, int(np.ceil(np.sqrt(n))))
            group = (sample @ self.top.T).argmax(axis=1)
            self.sub = [spread_pivots(sample[group == k], max(1, round(n * (group == k).mean()))) for k in range(len(self.top))]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in self.sub])])
        self.centers = np.concatenate(self.sub)

    def cell(self, u: np.ndarray) -> np.ndarray:
        group = (u @ self.top.T).argmax(axis=1)
        out = self.start[group].copy()
        for k in np.unique(group):
            if len(self.sub[k]) > 1:
                at = group == k
                out[at] += (u[at] @ self.sub[k].T).argmax(axis=1)
        return out


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_MI) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def cut_into_tasks(points: DataFrame, queries: DataFrame, chunk: int = CHUNK, query_chunk: int = QUERY_CHUNK, least_pivots: int = LEAST_PIVOTS, flat: int = FLAT) -> DataFrame:
    """Positions and queries with the task (cell, part, qpart) in which they meet: every pair that may be near meets in one."""
    spark = points.sparkSession
    total = points.count()
    n = int(min(MOST_PIVOTS, max(least_pivots, -(-total // chunk))))
    share = min(1.0, 1.2 * n * PER_PIVOT / max(1, total))
    sample = points.select("lat", "lon").sample(share, seed=1).limit(2 * n * PER_PIVOT).toPandas()
    pivots = Pivots(unit(sample.lat.to_numpy(), sample.lon.to_numpy()), n, flat)

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                u = unit(b.lat.to_numpy(), b.lon.to_numpy())
                cell = pivots.cell(u)
                yield b.assign(cell=cell.astype("int32"), away=great_circle(u, pivots.centers[cell]))

    placed = cut_lineage(points.select("lat", "lon").mapInPandas(assign, "lat double, lon double, cell int, away double"))
    # one row a pivot comes to the driver
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("reach")).toPandas().sort_values("cell")
    cells, reach = stats.cell.to_numpy(), stats.reach.to_numpy()
    centers = pivots.centers[cells] if len(cells) else np.empty((0, 3))

    def replicate(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if not len(b) or not len(cells):
                continue
            u = unit(b.qlat.to_numpy(), b.qlon.to_numpy())
            for k, c in enumerate(cells):
                # triangle inequality: a point of the cell within r of q has its pivot within r + reach
                near = b[great_circle(u, centers[k]) <= b.radius.to_numpy() + reach[k] + 1e-6]
                if len(near):
                    yield near.assign(cell=np.int32(c))

    q = cut_lineage(queries.select("qid", "qlat", "qlon", "radius").mapInPandas(replicate, "qid bigint, qlat double, qlon double, radius double, cell int"))
    asked = q.groupBy("cell").count().toPandas()
    sizes = stats.merge(asked.rename(columns={"count": "q"}), on="cell")
    sizes = sizes.assign(parts=-(-sizes.n // chunk), qparts=-(-sizes.q // query_chunk))[["cell", "parts", "qparts"]].astype("int32")
    # a row a pivot
    cuts = F.broadcast(spark.createDataFrame(sizes, "cell int, parts int, qparts int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = placed.join(cuts, "cell").withColumn("part", F.pmod(F.xxhash64("lat", "lon"), F.col("parts")).cast("int")).withColumn("qpart", every("qparts"))
    p = p.select("cell", "part", "qpart", F.lit(True).alias("is_point"), F.lit(None).cast("bigint").alias("qid"), "lat", "lon", F.lit(None).cast("double").alias("radius"))
    q = q.join(cuts, "cell").withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts")).cast("int")).withColumn("part", every("parts"))
    q = q.select("cell", "part", "qpart", F.lit(False).alias("is_point"), "qid", F.col("qlat").alias("lat"), F.col("qlon").alias("lon"), "radius")

    return p.unionByName(q)


def radius_pairs(points: DataFrame, queries: DataFrame, **sizes: int) -> DataFrame:
    """All pairs of a query and a position within the query's radius.

    ``points``: lat, lon (distinct, usable). ``queries``: qid, qlat, qlon, radius (usable; radius in miles,
    not null; below 0 matches nothing). Returns qid, lat, lon. Empty inputs give no rows. ``sizes`` as of ``cut_into_tasks``.
    """

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        pts, qs = group[group.is_point], group[~group.is_point]
        if not len(pts) or not len(qs):
            return pd.DataFrame({"qid": np.empty(0, "int64"), "lat": np.empty(0), "lon": np.empty(0)})
        lat, lon = pts.lat.to_numpy(), pts.lon.to_numpy()
        tree = VPTree(unit(lat, lon))
        qlat, qlon, r, qid = qs.lat.to_numpy(), qs.lon.to_numpy(), qs.radius.to_numpy(), qs.qid.to_numpy().astype("int64")
        u = unit(qlat, qlon)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(qs), 100):
            k, ids = tree.within(u[at : at + 100], r[at : at + 100] + 1e-6)
            k = k + at
            good = haversine(qlat[k], qlon[k], lat[ids], lon[ids]) <= r[k]
            out.append((k[good], ids[good]))
        k, ids = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        return pd.DataFrame({"qid": qid[k], "lat": lat[ids], "lon": lon[ids]})

    return cut_into_tasks(points, queries, **sizes).groupBy("cell", "part", "qpart").applyInPandas(search, "qid bigint, lat double, lon double")


def within_radius(rows: DataFrame, queries: DataFrame, hot_rows: int = HOT_ROWS, **sizes: int) -> DataFrame:
    """Every (qid, id) with the row's position within the query's radius on the great circle.

    ``rows``: id, lat, lon; ``queries``: qid bigint, qlat, qlon, radius. Rows or queries with a null id,
    position or radius, at (0, 0) or out of range have no pairs. Repeated rows of an id give one pair each
    distinct position; extra columns are ignored.
    """
    r = rows.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    # -0.0 and 0.0 are one position
    r = r.filter(F.col("id").isNotNull() & usable(F.col("lat"), F.col("lon"))).withColumns({"lat": F.col("lat") + 0.0, "lon": F.col("lon") + 0.0})
    q = queries.select(F.col("qid").cast("bigint").alias("qid"), *[F.col(c).cast("double").alias(c) for c in ("qlat", "qlon", "radius")])
    q = q.filter(F.col("qid").isNotNull() & usable(F.col("qlat"), F.col("qlon")) & F.col("radius").isNotNull() & ~F.isnan("radius"))
    r = cut_lineage(r)
    seen = cut_lineage(r.groupBy("lat", "lon").agg(F.count("*").alias("n")))
    hits = radius_pairs(seen.select("lat", "lon"), q, **sizes)
    # positions of very many rows: at most rows / hot_rows of them
    hot = seen.filter(F.col("n") > hot_rows).select("lat", "lon", F.ceil(F.col("n") / hot_rows).cast("int").alias("_salts"))
    if hot.isEmpty():
        return hits.join(r, ["lat", "lon"]).select("qid", "id")
    hot = F.broadcast(hot)
    salted = r.join(hot, ["lat", "lon"], "left").withColumn("_salt", F.pmod(F.xxhash64("id"), F.coalesce("_salts", F.lit(1))).cast("int"))
    spread = hits.join(hot, ["lat", "lon"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return spread.join(salted, ["lat", "lon", "_salt"]).select("qid", "id")
