"""The best representative of each duplicate group, field by field.

All fields of a group are decided in one aggregation: for each field the maximum of the struct
(value is there, source priority, further measure, timestamp, value, row id). What a value is worth is measured before
that, from statistics over all rows, with no fixed list of filler phrases or stand-in pictures:

* a text that stands alone on many entities is filler;
* two sentences that follow each other on many entities are general text wherever they occur;
* a text that is the beginning of a longer text of its group, or breaks off, is a cut copy;
* a picture seen on several entities tells nothing about one of them.

A group may hold a third of all rows: nothing is collected per group, and maxima are combined before
the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kennelflow.functions.text import WS, squish
from kennelflow.io import cut_lineage

#: Share of all entities that a sentence pair or a whole text surely has (n entities less SURELY * sqrt(n)) if it is general.
GENERAL_SHARE, SURELY = 0.002, 2.0
#: General grams up to which their list goes to every row; more are joined.
LIST_MOST = 20_000
#: Length from which bodies of a group are compared by their beginnings of this length.
HEAD = 40
#: Entities from which a picture is one used for other dogs.
SHARED_PICTURE = 2


def plain_text(c: Column) -> Column:
    """Mark-up, entities and spacing removed."""
    c = F.regexp_replace(c, r"(?s)<[^<>]{0,300}>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return squish(c)


def bare_name(c: Column) -> Column:
    """A display name without decoration: '*OTIS* (A123)' -> 'OTIS'."""
    return squish(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"[*!_~]+", " "))


def sentences(text: Column) -> Column:
    return F.split(F.lower(text), r"(?<=[.!?])" + WS + "+")


def masked(s: Column, name: Column) -> Column:
    """Each sentence with the record's own name put as '@', so that texts written for many names agree."""
    n = F.lower(bare_name(name))
    return F.when(F.length(n) >= 2, F.transform(s, lambda x: F.replace(x, n, F.lit("@")))).otherwise(s)


def _grams(s: str, gap: int) -> Column:
    """Hashes of the sentences i and i + gap; empty where the text is shorter."""
    n = F.size(s) - gap
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.col(s)[i], F.col(s)[i + gap], F.lit(gap)))).otherwise(F.array().cast("array<bigint>"))


def _general_hits(t: DataFrame, general: DataFrame, list_most: int) -> DataFrame:
    """gid, id, own, w, h1, h2: which grams of each text are general. A list of checked length goes to every row, a longer one is joined."""
    if general.count() <= list_most:
        m = t.join(F.broadcast(general.agg(F.collect_set("g").alias("general"))))
    else:
        found = t.select("id", F.explode(F.array_distinct(F.concat("g0", "g1", "g2"))).alias("g")).join(general, "g").groupBy("id").agg(F.collect_set("g").alias("general"))
        m = t.join(found, "id", "left").withColumn("general", F.coalesce("general", F.array().cast("array<bigint>")))
    hit = lambda g: F.transform(g, lambda x: F.array_contains("general", x))
    return m.select("gid", "id", "own", hit("g0")[0].alias("w"), hit("g1").alias("h1"), hit("g2").alias("h2"))


def text_worth(rows: DataFrame, list_most: int = LIST_MOST) -> DataFrame:
    """rows: gid, id, name, text -> gid, id, whole, stem: the text's own part, lower case, '' if there is none.

    ``stem`` is what remains after the general sentences; a wholly general text has none. A sentence is
    general if it follows or precedes another one on many entities, or stands between two such (a
    sentence with a name that the record doesn't give). ``whole`` tells that a biography remains that
    doesn't break off.
    """
    t = rows.filter("text is not null").select("gid", "id", plain_text(F.col("text")).alias("plain"), "name").filter("plain <> ''")
    t = t.select("gid", "id", "name", sentences(F.col("plain")).alias("own")).withColumn("s", masked(F.col("own"), F.col("name"))).drop("name")
    whole = F.array(F.xxhash64(F.array_join("s", " ")))
    t = cut_lineage(t.select("gid", "id", "own", whole.alias("g0"), _grams("s", 1).alias("g1"), _grams("s", 2).alias("g2")))
    total = t.agg(F.count_distinct("gid").alias("all"))
    # each entity counts once; what many records share is combined before the exchange
    grams = t.select("gid", F.explode(F.array_distinct(F.concat("g0", "g1", "g2"))).alias("g"))
    counts = grams.distinct().groupBy("g").agg(F.count("*").alias("entities"))
    surely = F.col("entities") - SURELY * F.sqrt("entities")
    general = cut_lineage(counts.join(F.broadcast(total)).filter(surely > GENERAL_SHARE * F.col("all")).select("g"))
    m = _general_hits(t, general, list_most)

    def at(h: str, i: Column) -> Column:
        return F.coalesce(F.get(h, i), F.lit(False))

    kept = F.filter("own", lambda x, i: ~(at("h1", i) | at("h1", i - 1) | at("h2", i) | at("h2", i - 1) | at("h2", i - 2)))
    body = F.when(F.col("w"), F.lit("")).otherwise(F.trim(F.array_join(kept, " ")))
    out = m.select("gid", "id", body.alias("body"))
    stub = r"(?:\.\.\.|…|\[more\]|read more\W*|see more\W*|continue reading\W*)$"
    cut = F.col("body").rlike(stub) | ~F.col("body").rlike(r"[.!?][\"')\]*_]*$")
    whole = (F.col("body") != "") & ~cut & (F.size(F.split("body", " ")) >= 8)
    return out.select("gid", "id", whole.alias("whole"), F.trim(F.regexp_replace("body", stub, "")).alias("stem"))


def cut_copies(worth: DataFrame, head: int = HEAD) -> DataFrame:
    """worth -> id, complete. A body that is a proper beginning of another body of its group is a cut copy.

    In the order of their texts a beginning stands directly before a text that goes on from it, so each distinct body of at
    least ``head`` characters is compared with the next one that begins like it. A shorter one is looked up among the
    beginnings of the others of its group.
    """
    d = worth.filter("stem <> ''").select("gid", "stem").distinct().withColumn("head", F.substring("stem", 1, head))
    following = F.lead("stem").over(Window.partitionBy("gid", "head").orderBy("stem"))
    cut = d.filter(F.length("head") == head).withColumn("next", following).filter(F.startswith("next", "stem")).select("gid", "stem")
    # short bodies that could stand for a biography are rare, and only their groups are searched
    short = worth.filter("whole").select("gid", "stem").filter(F.length("stem") < head).distinct()
    sizes = short.groupBy("gid").agg(F.collect_set(F.length("stem")).alias("sizes"))
    heads = d.select("gid", "head").distinct().join(sizes, "gid").select("gid", "head", F.explode("sizes").alias("n"))
    starts = heads.filter(F.length("head") > F.col("n")).select("gid", F.expr("substring(head, 1, n)").alias("stem")).distinct()
    cut = cut.unionByName(short.join(starts, ["gid", "stem"], "left_semi"))
    w = worth.join(cut.withColumn("_short", F.lit(True)), ["gid", "stem"], "left")
    return w.select("id", (F.col("whole") & F.col("_short").isNull()).alias("complete"))


def picture_key(url: Column) -> Column:
    """One key for all sizes and repeats of a picture: host, query, size marks and file type do not count."""
    k = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    k = F.regexp_replace(k, r"^[a-z]+://[^/]*/", "")
    k = F.regexp_replace(k, r"^(?:t_[a-z]+|thumbs?|small|medium|large|\d+x\d+)/", "")
    k = F.regexp_replace(k, r"\.[a-z]{3,4}$", "")
    return F.regexp_replace(k, r"(?:[-_](?:thumb(?:nail)?|small|medium|large|\d{2,4}x\d{2,4}|\d{3,4}w))+$", "")


def picture_worth(rows: DataFrame) -> DataFrame:
    """rows: gid, id, urls -> id, pictures: how many different genuine pictures of its own entity a record has."""
    p = rows.select("gid", "id", F.explode("urls").alias("url")).filter("url is not null and trim(url) <> ''")
    p = p.select("gid", "id", picture_key(F.col("url")).alias("key"))
    p = cut_lineage(p.groupBy("gid", "id", "key").agg(F.lit(1).alias("_")).drop("_"))
    # a popular picture is combined map-side twice: by (picture, entity), then by picture
    shared = p.groupBy("key", "gid").count().groupBy("key").agg(F.count("*").alias("entities")).filter(F.col("entities") >= SHARED_PICTURE).select("key")
    return p.join(shared, "key", "left_anti").groupBy("id").agg(F.count("*").alias("pictures"))


def _worth(rows: DataFrame) -> DataFrame:
    """rows with gid as text (lone rows are entities of their own), grouped, complete and pictures."""
    r = rows.withColumn("gid", F.coalesce(F.col("gid").cast("string"), F.concat(F.lit("lone "), F.col("id"))))
    r = cut_lineage(r.withColumn("grouped", ~F.startswith("gid", F.lit("lone "))))
    complete = cut_copies(cut_lineage(text_worth(r.select("gid", "id", "name", "text"))))
    pictures = picture_worth(r.select("gid", "id", "urls"))
    return r.filter("grouped").drop("text", "urls").join(complete, "id", "left").join(pictures, "id", "left")


def _best(there: Column, *measures: str) -> Column:
    """The greatest struct of priority and measures among the rows where the value is there."""
    return F.max(F.when(there, F.struct("priority", *measures)))


def survivors(rows: DataFrame) -> DataFrame:
    """rows: gid, id, name, text, urls, seen_at (one row per id) -> one row per group of two or more ids.

    gid, members, text_id, urls_id, display_id; a field is null where no member
    qualifies. Rows with a null gid are entities of their own: they count in the statistics and form no
    group. All sources have the same priority here, unless ``rows`` has a column priority. Ties of timestamp go to the
    greater id. Null names, texts and lists are allowed anywhere.
    """
    cols = ["gid", "id", "name", "text", "urls", "seen_at", F.col("priority") if "priority" in rows.columns else F.lit(0).alias("priority")]
    w = _worth(rows.select(*cols))
    ok_t, ok_p = F.coalesce("complete", F.lit(False)), F.coalesce("pictures", F.lit(0)) > 0
    # a text or a list is read again by its id, so that no long value is shuffled for the maximum
    g = w.groupBy("gid").agg(F.count("*").alias("members"), _best(ok_t, "seen_at", "id").alias("t"), _best(ok_p, "pictures", "seen_at", "id").alias("p")).filter("members >= 2")
    return g.select(F.col("gid").cast("bigint").alias("gid"), "members", F.col("t.id").alias("text_id"), F.col("p.id").alias("urls_id"), F.when(F.col("t.id") == F.col("p.id"), F.col("t.id")).alias("display_id"))


def golden_records(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The surviving record of each group of two or more, with the origin of each value.

    ``rows``: gid, id, name, text, urls, seen_at, priority (of the source; greater is better, null least) and ``fields`` (short
    values). Returns gid, members, text, text_id, urls, urls_id and per field its value and ``<field>_id``. A field takes the
    greatest (priority, seen_at, value, id) among the members that have a value other than blank; all in one aggregation.
    """
    w = _worth(rows.select("gid", "id", "name", "text", "urls", "seen_at", "priority", *[F.col(f).alias(f"_{f}") for f in fields]))
    ok_t, ok_p = F.coalesce("complete", F.lit(False)), F.coalesce("pictures", F.lit(0)) > 0
    plain = [_best(F.trim(F.col(f"_{f}").cast("string")) != "", "seen_at", f"_{f}", "id").alias(f"b_{f}") for f in fields]
    g = w.groupBy("gid").agg(F.count("*").alias("members"), _best(ok_t, "seen_at", "id").alias("t"), _best(ok_p, "pictures", "seen_at", "id").alias("p"), *plain).filter("members >= 2")
    s = g.select(F.col("gid").cast("bigint").alias("gid"), "members", F.col("t.id").alias("text_id"), F.col("p.id").alias("urls_id"), *[x for f in fields for x in (F.col(f"b_{f}._{f}").alias(f), F.col(f"b_{f}.id").alias(f"{f}_id"))])
    texts, urls = rows.select(F.col("id").alias("text_id"), "text"), rows.select(F.col("id").alias("urls_id"), "urls")
    return s.join(texts, "text_id", "left").join(urls, "urls_id", "left").select("gid", "members", "text", "text_id", "urls", "urls_id", *[x for f in fields for x in (f, f"{f}_id")])
