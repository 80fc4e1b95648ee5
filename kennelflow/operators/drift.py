"""Schemas that drift between the numbered files of a feed.

Each record is read once as a map of leaf path -> (raw type, value as text) and kept in the shared folder.
Statistics of paths and types by file tell what was added, removed or changed type; a removed and an added
path are one renamed field where the values of the same records go on. Records of two files are linked by
whatever unchanged field identifies them best, found from exact value counts. Everything per record is
hashed over feed, file and value, so a feed that holds a third of all records is spread like the rest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kennelflow.io import cut_lineage

#: A rename needs at least this share of linked records with the same value, and as much beyond chance.
SAME, BEYOND_CHANCE = 0.5, 0.4
#: Linked records below this number decide nothing; then the sets of values are compared.
LINKED = 5


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, str | None, str | None]]:
    """(dotted path, type, text) of the leaf fields; objects are no leaves, arrays are, nulls have no type."""
    stack = [(prefix, value)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is None:
                yield path, None, None
            elif isinstance(v, bool):
                yield path, "boolean", "true" if v else "false"
            elif isinstance(v, (int, float)):
                yield path, "number", repr(v)
            elif isinstance(v, list):
                yield path, "array", json.dumps(v, sort_keys=True, ensure_ascii=False)
            else:
                yield path, "string", v


def read_records(records: DataFrame) -> DataFrame:
    """Every record as feed, file_no, record_no, captured_at, problem, vals: map<path, struct<type, value>>.

    ``problem`` is null for a readable record; else ``null`` (no payload), ``cut`` (no JSON) or ``no object``, and vals is null. Records
    without feed or file number are left out; a null record number is -1. Of a key twice in an object the last counts. Nesting of any
    depth is read without recursion of ours; what the JSON parser itself refuses is cut. Extra columns are ignored.
    """

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for *key, payload in zip(b.feed, b.file_no, b.record_no, b.captured_at, b.payload):
                o, problem = None, None
                try:
                    o = json.loads(payload) if payload is not None else None
                    problem = "null" if payload is None else None if isinstance(o, dict) else "no object"
                except (ValueError, TypeError, RecursionError):
                    problem = "cut"
                found = [] if problem else list({p: (p, t, v) for p, t, v in leaves(o)}.values())
                out.append((*key, problem, *([x[k] for x in found] for k in range(3))))
            yield pd.DataFrame(out, columns=["feed", "file_no", "record_no", "captured_at", "problem", "paths", "types", "texts"])

    at = F.col("captured_at").cast("timestamp") if "captured_at" in records.columns else F.lit(None).cast("timestamp")
    src = records.filter("feed is not null and file_no is not null")
    src = src.select("feed", F.col("file_no").cast("int").alias("file_no"), F.coalesce(F.col("record_no").cast("int"), F.lit(-1)).alias("record_no"), at.alias("captured_at"), "payload")
    rows = src.mapInPandas(parse, "feed string, file_no int, record_no int, captured_at timestamp, problem string, paths array<string>, types array<string>, texts array<string>")
    entries = F.arrays_zip(F.col("types").alias("type"), F.col("texts").alias("value"))
    return rows.select("feed", "file_no", "record_no", "captured_at", "problem", F.when(F.col("problem").isNull(), F.map_from_arrays("paths", entries)).alias("vals"))


def path_values(records: DataFrame) -> DataFrame:
    """The readable records: feed, file_no, record_no, captured_at, vals."""
    return read_records(records).filter("problem is null").drop("problem")


def unreadable(records: DataFrame) -> DataFrame:
    """feed, file_no, record_no, problem, n: the records that give no row, with the number of times they were delivered so."""
    return read_records(records).filter("problem is not null").groupBy("feed", "file_no", "record_no", "problem").agg(F.count("*").alias("n"))


def path_types(rows: DataFrame) -> DataFrame:
    """feed, file_no, path, types (sorted set), n (records with a typed value)."""
    each = rows.select("feed", "file_no", F.explode("vals").alias("path", "v"))
    stats = each.groupBy("feed", "file_no", "path").agg(F.sort_array(F.collect_set("v.type")).alias("types"), F.count("v.type").alias("n"))
    # a null where other records have an object is no leaf
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    objects = stats.filter(F.size(parts) > 1).select("feed", F.explode(prefixes).alias("path")).distinct()
    return stats.join(objects.withColumn("_object", F.lit(True)), ["feed", "path"], "left").filter("_object is null or n > 0").select("feed", "file_no", "path", "types", "n")


def file_pairs(stats: DataFrame) -> DataFrame:
    """feed, file_no, prev_no: each file of a feed with the file before it."""
    w = Window.partitionBy("feed").orderBy("file_no")
    return stats.select("feed", "file_no").distinct().withColumn("prev_no", F.lag("file_no").over(w)).filter("prev_no is not null")


def path_changes(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """feed, file_no, prev_no, path, change_kind: added, removed or type_changed."""
    cur = stats.join(pairs, ["feed", "file_no"]).select("feed", "file_no", "prev_no", "path", F.col("types").alias("cur"))
    old = stats.withColumnRenamed("file_no", "prev_no").join(pairs, ["feed", "prev_no"]).select("feed", "file_no", "prev_no", "path", F.col("types").alias("old"))
    both = cur.join(old, ["feed", "file_no", "prev_no", "path"], "full_outer")
    kind = (
        F.when(F.col("old").isNull(), "added").when(F.col("cur").isNull(), "removed").when((F.size("cur") > 0) & (F.size("old") > 0) & (F.col("cur") != F.col("old")), "type_changed")
    )
    return both.withColumn("change_kind", kind).filter("change_kind is not null").select("feed", "file_no", "prev_no", "path", "change_kind")


def renames(rows: DataFrame, changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """feed, file_no, old_path, new_path of fields whose values go on under another path."""
    pair = ["feed", "file_no", "prev_no"]
    lists = changes.groupBy(*pair).agg(F.collect_set(F.when(F.col("change_kind") == "removed", F.col("path"))).alias("removed"), F.collect_set(F.when(F.col("change_kind") == "added", F.col("path"))).alias("added"))
    lists = cut_lineage(lists.filter("size(removed) > 0 and size(added) > 0"))

    # which files hold a value under a path: one row a distinct value, repeats are combined before the exchange
    typed = rows.select("feed", "file_no", F.explode("vals").alias("path", "v")).filter("v.value is not null").select("feed", "file_no", "path", "v.type", F.xxhash64("v.value").alias("h"))
    wanted = typed.join(lists.select("feed").distinct(), "feed", "left_semi")
    held = cut_lineage(wanted.groupBy("feed", "path", "h", "file_no").agg(F.count("*").alias("n"), F.max("type").alias("type")))

    # the identifying field of a pair of files: nearly all values differ, and most were there before
    by_file = held.join(lists.select(*pair), ["feed", "file_no"])
    old = held.select("feed", "path", "h", F.col("file_no").alias("prev_no"), F.lit(True).alias("was"))
    by_file = by_file.join(old, ["feed", "path", "h", "prev_no"], "left")
    key = by_file.groupBy(*pair, "path").agg(F.sum("n").alias("n"), F.count("*").alias("different"), F.count("was").alias("before"), F.max("type").alias("type"))
    key = key.filter("type in ('string', 'number') and before >= 3 and different * 2 >= n and before * 4 >= different")
    best = F.max(F.struct((F.col("before") / F.col("different")).alias("share"), "different", "path"))
    keys = key.groupBy(*pair).agg(best.alias("b")).select(*pair, F.col("b.path").alias("key_path"))
    todo = lists.join(keys, pair, "left")

    def side(file: str, paths: str, name: str) -> DataFrame:
        t = todo.filter("key_path is not null").withColumn("_file", F.col(file))
        r = rows.withColumnRenamed("file_no", "_file").join(t, ["feed", "_file"])
        r = r.select(*pair, F.xxhash64(F.col("vals")[F.col("key_path")]["value"]).alias("k"), (F.col("vals")[F.col("key_path")]["value"]).isNotNull().alias("ok"), F.explode(paths).alias(name), "vals")
        r = r.filter("ok").select(*pair, "k", name, F.xxhash64(F.col("vals")[F.col(name)]["value"]).alias("h"), F.col("vals")[F.col(name)]["value"].isNotNull().alias("there")).filter("there")
        return r.groupBy(*pair, "k", name).agg(F.max("h").alias(f"h_{name}"))

    linked = side("prev_no", "removed", "old_path").join(side("file_no", "added", "new_path"), [*pair, "k"])
    at = [*pair, "old_path", "new_path"]
    hist = cut_lineage(linked.groupBy(*at, "h_old_path", "h_new_path").agg(F.count("*").alias("n")))
    a = hist.groupBy(*at, F.col("h_old_path").alias("h")).agg(F.sum("n").alias("na"))
    b = hist.groupBy(*at, F.col("h_new_path").alias("h")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, [*at, "h"]).groupBy(*at).agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    total = hist.groupBy(*at).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("h_old_path") == F.col("h_new_path"), F.col("n")).otherwise(0)).alias("same"))
    score = total.join(chance, at, "left").select(*at, "n", (F.col("same") / F.col("n")).alias("share"), (F.coalesce("cross", F.lit(0)) / (F.col("n") * F.col("n"))).alias("chance"))
    score = score.withColumn("beyond", F.when(F.col("chance") > 0.95, F.when(F.col("share") >= 0.95, 1.0).otherwise(0.0)).otherwise((F.col("share") - F.col("chance")) / (1 - F.col("chance"))))

    # where too few records are linked the distinct values decide
    cand = todo.select(*pair, F.explode("removed").alias("old_path"), "added").select(*pair, "old_path", F.explode("added").alias("new_path"))
    o = held.select("feed", F.col("file_no").alias("prev_no"), F.col("path").alias("old_path"), "h")
    n = held.select("feed", "file_no", F.col("path").alias("new_path"), "h")
    no = o.groupBy("feed", "prev_no", "old_path").agg(F.count("*").alias("n_old"))
    nn = n.groupBy("feed", "file_no", "new_path").agg(F.count("*").alias("n_new"))
    common = cand.join(o, ["feed", "prev_no", "old_path"]).join(n, ["feed", "file_no", "new_path", "h"]).groupBy(*at).agg(F.count("*").alias("common"))
    sets = cand.join(no, ["feed", "prev_no", "old_path"]).join(nn, ["feed", "file_no", "new_path"]).join(common, at, "left")
    sets = sets.select(*at, (F.coalesce("common", F.lit(0)) / F.least("n_old", "n_new")).alias("overlap"))
    judged = sets.join(score, at, "left")
    by_records = F.coalesce(F.col("n") >= LINKED, F.lit(False))
    good = judged.filter(F.when(by_records, (F.col("share") >= SAME) & (F.col("beyond") >= BEYOND_CHANCE)).otherwise(F.col("overlap") >= 0.6))
    rank = [F.desc(F.when(by_records, F.col("beyond")).otherwise(F.col("overlap"))), F.desc("overlap"), "old_path", "new_path"]
    w_old, w_new = Window.partitionBy(*pair, "old_path").orderBy(*rank), Window.partitionBy(*pair, "new_path").orderBy(*rank)
    return good.withColumn("_a", F.row_number().over(w_old)).withColumn("_b", F.row_number().over(w_new)).filter("_a = 1 and _b = 1").select("feed", "file_no", "old_path", "new_path")


def drift_report(records: DataFrame) -> DataFrame:
    """feed, file_no, change_kind, old_path, new_path for each file against the one before it.

    Repeated records and files delivered twice count once for paths and types. Empty input gives no rows.
    """
    rows = cut_lineage(path_values(records))
    return report_of(rows)


def report_of(rows: DataFrame) -> DataFrame:
    stats = cut_lineage(path_types(rows))
    pairs = file_pairs(stats)
    changes = cut_lineage(path_changes(stats, pairs))
    ren = cut_lineage(renames(rows, changes, pairs))
    gone = ren.select("feed", "file_no", F.col("old_path").alias("path"), F.lit("removed").alias("change_kind"))
    come = ren.select("feed", "file_no", F.col("new_path").alias("path"), F.lit("added").alias("change_kind"))
    rest = changes.join(gone.unionAll(come), ["feed", "file_no", "path", "change_kind"], "left_anti")
    old = F.when(F.col("change_kind") == "added", "").otherwise(F.col("path"))
    new = F.when(F.col("change_kind") == "removed", "").otherwise(F.col("path"))
    plain = rest.select("feed", "file_no", "change_kind", old.alias("old_path"), new.alias("new_path"))
    return plain.unionByName(ren.select("feed", "file_no", F.lit("renamed").alias("change_kind"), "old_path", "new_path"))


def field_names(ren: DataFrame) -> DataFrame:
    """feed, path, since, known: from which file on a path stands for the field that was first called ``known``."""

    def chains(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        # one feed's renames in file order: few rows, one for each renamed field and file
        first: dict[str, str] = {}
        out = []
        for no, old, new in g.sort_values(["file_no", "old_path"])[["file_no", "old_path", "new_path"]].itertuples(index=False):
            first[new] = first.get(old, old)
            out.append((key[0], no, new, first[new]))
        return pd.DataFrame(out, columns=["feed", "since", "path", "field"])

    names = ren.groupBy("feed").applyInPandas(chains, "feed string, since int, path string, field string")
    return names.groupBy("feed", "path").agg(F.min(F.struct("since", "field")).alias("m")).select("feed", "path", "m.since", F.col("m.field").alias("known"))


def one_version(rows: DataFrame) -> DataFrame:
    """Repeats of a record (files delivered twice as well) as one row: the last captured, of equal ones the greater content."""
    text = F.to_json("vals")
    last = rows.groupBy("feed", "file_no", "record_no", F.when(F.col("record_no") < 0, F.xxhash64(text)).alias("_one")).agg(F.max_by("vals", F.struct("captured_at", text)).alias("vals"))
    return last.select("feed", "file_no", "record_no", "vals")


def typed_values(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feed, file_no, record_no, field, raw, text; feed, field, type): values under their first names, and each field's type.

    A field's type is that of most of its values over all files (ties: the first by name).
    """
    vals = rows.select("feed", "file_no", "record_no", F.explode("vals").alias("path", "v")).filter("v.type is not null")
    named = vals.join(names, ["feed", "path"], "left").select("feed", "file_no", "record_no", F.when(F.col("file_no") >= F.col("since"), F.col("known")).otherwise(F.col("path")).alias("field"), F.col("v.type").alias("raw"), F.col("v.value").alias("text"))
    counts = named.groupBy("feed", "field", "raw").agg(F.count("*").alias("n"))
    return named, counts.groupBy("feed", "field").agg(F.min_by("raw", F.struct(-F.col("n"), "raw")).alias("type"))


def _cast(text: Column, kind: str) -> Column:
    return {"number": text.try_cast("double"), "boolean": F.lower(text).try_cast("boolean")}.get(kind, text)


def _failed(raw: Column, text: Column, kind: Column) -> Column:
    number, flag = _cast(text, "number").isNull(), _cast(text, "boolean").isNull()
    return ((kind == "number") & number) | ((kind == "boolean") & flag) | ((kind == "array") & (raw != "array"))


def failed_casts(records: DataFrame) -> DataFrame:
    """feed, file_no, record_no, field, type, raw, text: values that ``consistent_table`` can't give in their field's type."""
    kept = cut_lineage(path_values(records))
    named, types = typed_values(one_version(kept), field_names(report_of(kept).filter("change_kind = 'renamed'")))
    t = named.join(types, ["feed", "field"])
    return t.filter(_failed(F.col("raw"), F.col("text"), F.col("type"))).select("feed", "file_no", "record_no", "field", "type", "raw", "text")


#: Fields that ``consistent_table`` makes columns of; more raise an error.
FIELDS_MOST = 5_000


def consistent_table(records: DataFrame) -> DataFrame:
    """One row a readable record, with a typed column for every field of all feeds under its first name.

    Columns: feed, file_no, record_no, then the fields in order of name; dots become ``__``. Numbers are double, flags boolean, strings and
    arrays (as JSON) string. A path that feeds type differently has a column a feed (``<feed>__<path>``), as has one that differs
    from another only in case. What can't be cast is null and in ``failed_casts``. Only names and types go to the driver.
    """
    kept = cut_lineage(path_values(records))
    names = cut_lineage(field_names(report_of(kept).filter("change_kind = 'renamed'")))
    rows = one_version(kept)
    fields = typed_values(rows, names)[1].limit(FIELDS_MOST + 1).collect()
    if len(fields) > FIELDS_MOST:
        raise ValueError(f"more than {FIELDS_MOST} fields")
    renamed: dict[tuple[str, str], list[tuple[str, int]]] = {}
    since: dict[tuple[str, str], int] = {}
    for r in names.collect():
        renamed.setdefault((r.feed, r.known), []).append((r.path, r.since))
        since[r.feed, r.path] = r.since
    kinds: dict[str, set[tuple[str, str]]] = {}
    for f in fields:
        kinds.setdefault(f.field.lower(), set()).add((f.field, f.type))
    columns: dict[str, Column] = {}
    no = F.col("file_no")
    for f in sorted(fields, key=lambda f: (f.field, f.feed)):
        own = F.col("vals")[f.field]["value"]
        of = F.when(no < since[f.feed, f.field], own) if (f.feed, f.field) in since else own
        texts = [of, *[F.when(no >= n, F.col("vals")[p]["value"]) for p, n in sorted(renamed.get((f.feed, f.field), []))]]
        value = F.when(F.col("feed") == f.feed, _cast(F.coalesce(*texts), f.type))
        name = f.field.replace(".", "__") if len(kinds[f.field.lower()]) == 1 else f"{f.feed}__{f.field}".replace(".", "__")
        columns[name] = F.coalesce(columns[name], value) if name in columns else value
    return rows.select("feed", "file_no", "record_no", *[c.alias(n) for n, c in columns.items()])
