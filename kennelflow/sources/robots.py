"""Robots rules as data: parsed lines, and the verdict for many paths at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(text: str | None) -> list[tuple[str, str]]:
    """(allow or disallow, path pattern) of the first group for all agents. Null and empty texts have no rules."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    open_ = False
    for line in (text or "").splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value)
            open_ = True
        elif name in ("allow", "disallow") and groups:
            open_ = False
            if value:
                groups[-1][1].append((name, value))
    return next((rules for agents, rules in groups if "*" in agents), [])


def verdict(path: str, rules: list[tuple[str, str]]) -> tuple[bool, tuple[str, str] | None]:
    """Whether a path is allowed and the rule that says so: the longest that fits, of equal ones the allowing."""
    fits = [(len(p), kind == "allow", (kind, p)) for kind, p in rules if re.search(pattern(p), path)]
    return (max(fits)[1], max(fits)[2]) if fits else (True, None)


def pattern(path: str) -> str:
    """A rule's path as an anchored regular expression: * is anything, a final $ is the end."""
    end = path.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in path.removesuffix("$").split("*")) + ("$" if end else "")


def allowed(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """paths: path -> path, allowed. The longest rule that fits decides, of equal ones the allowing."""
    best = F.lit(None).cast("struct<len:int,allow:boolean>")
    fits = [F.when(F.col("path").rlike(pattern(p)), F.struct(F.lit(len(p)).alias("len"), F.lit(kind == "allow").alias("allow"))) for kind, p in rules]
    best = F.array_max(F.array(*fits)) if fits else best
    return paths.withColumn("allowed", F.coalesce(best["allow"], F.lit(True)))
