"""Quality of runs and batches: ordered downgrades, guards, a confidence score, key strength and verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A drop against the last good run, failures among details, weak keys and lost pictures that count.
DROP_LEAST, DROP_SHARE, DETAIL_SHARE, WEAK_SHARE, PHOTO_LEAST, PHOTO_SHARE = 10, 0.5, 0.2, 0.2, 3, 0.3
GOOD = ("success", "success_with_warnings")


def last_good_before(runs: DataFrame, key: str, at: str, value: str, ok: Sequence[str] = GOOD) -> DataFrame:
    """``runs`` with ``prior``: the ``value`` of the last run of the key that went well before each run (null: there is none)."""
    w = Window.partitionBy(key).orderBy(at, "id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("prior", F.last(F.when(F.col("status").isin(*ok), F.col(value)), ignorenulls=True).over(w))


def dropped(found: Column, prior: Column) -> Column:
    return F.coalesce((prior >= DROP_LEAST) & (found < DROP_SHARE * prior), F.lit(False))


def run_warnings(found: Column, paged: Column, reported: Column, prior: Column, attempts: Column, failures: Column, weak: Column, lost_photos: Column, duplicates: Column) -> Column:
    """The kinds of warning a run gives, in order."""
    rules = [
        ("duplicates", duplicates > 0), ("weak_keys", (found > 0) & (weak > WEAK_SHARE * found)), ("empty", found == 0), ("not_paged", ~F.coalesce(paged, F.lit(False))), ("details", (attempts > 0) & (failures > DETAIL_SHARE * attempts)),
        ("count", reported != found), ("drop", dropped(found, prior)), ("photos", lost_photos > F.greatest(F.lit(float(PHOTO_LEAST)), PHOTO_SHARE * found)),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in rules]), lambda x: x.isNotNull())


def run_status(recorded: Column, warnings: Column, details_done: Column) -> Column:
    """failed and blocked stay; what lowers a run makes it partial; other warnings leave it a success with warnings."""
    lowers = reduce(lambda a, b: a | b, [F.array_contains(warnings, k) for k in ("empty", "not_paged", "details", "drop")])
    return F.when(recorded.isin("failed", "blocked"), recorded).when(lowers | ~details_done, "partial").when(F.size(warnings) > 0, "success_with_warnings").otherwise("success")


def confidence(status: Column, found: Column, paged: Column, mismatch: Column, details_done: Column, attempts: Column, failures: Column, weak: Column, photos: Column, urls: Column, warnings: Column) -> Column:
    """0 to 1 in hundredths: deductions from 1, each with its cap; nothing for a failed run, a tenth for an empty one."""
    n = found.cast("double")
    off = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    score = (
        1.0
        - off(~F.coalesce(paged, F.lit(False)), F.lit(0.3))
        - off(mismatch, F.lit(0.15))
        - off(~F.coalesce(details_done, F.lit(False)), F.lit(0.1))
        - off(attempts > 0, F.least(F.lit(0.2), failures / attempts * 0.5))
        - off(weak / n > 0.05, F.least(F.lit(0.25), weak / n * 0.5))
        - off(photos / n < 0.8, F.lit(0.05))
        - off(urls / n < 1, F.lit(0.2))
        - F.least(F.lit(0.1), F.coalesce(warnings, F.lit(0)) * 0.02)
    )
    return F.when(status.isin("failed", "blocked"), 0.0).when(found == 0, 0.1).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100 + 0.5 + 1e-9) / 100)


def richest(batch: DataFrame, key: Sequence[str], detailed: Column, text: Column, seq: Sequence[Column]) -> DataFrame:
    """One row per key: with details before without, then the longer text, then the earlier one."""
    w = Window.partitionBy(*key).orderBy(F.desc(detailed.cast("int")), F.desc(F.coalesce(F.length(text), F.lit(0))), *seq)
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def key_strength(total: Column, own: Column) -> Column:
    """'all', 'none' or 'mixed' by how many records have an id of the source; 'empty' without records."""
    return F.when(total == 0, "empty").when(own == total, "all").when(own == 0, "none").otherwise("mixed")


def verdict_from(checks: dict[str, Column], hard: Sequence[str]) -> Column:
    """'fail' if a hard check doesn't hold, 'partial' if another one doesn't, else 'pass'; unknown checks count as held."""
    bad = lambda names: reduce(lambda a, b: a | b, [~F.coalesce(checks[k], F.lit(True)) for k in names], F.lit(False))
    return F.when(bad(hard), "fail").when(bad([k for k in checks if k not in hard]), "partial").otherwise("pass")
