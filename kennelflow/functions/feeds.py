"""Column builders for the raw fields of feeds and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kennelflow.functions.listing import placeholder_photo
from kennelflow.functions.text import clean_text

#: Pictures of a series at most, as a fixed value.
SERIES = 12
_SIZE_MARK = r"[-_](?:thumb|small|medium|large|(\d{2,4})x\d{2,4})(?=\.[a-z]{3,4}$)"


def epoch_date(c: Column) -> Column:
    """Seconds since 1970 in a text as yyyy-mm-dd; null for 0, below and what is no number."""
    n = c.try_cast("double")
    return F.when(n > 0, F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd"))


def bare_breed(c: Column) -> Column:
    """'Mixed Breed (Medium)' -> 'Mixed Breed': the first size in brackets is dropped."""
    rx = r"(?i)^(.*?)\s*\((?:x-?small|small|medium|large|x-?large|giant|toy)\)(.*)$"
    return clean_text(F.when(c.rlike(rx), F.concat(F.regexp_extract(c, rx, 1), F.regexp_extract(c, rx, 2))).otherwise(c))


def trailing_id(url: Column) -> Column:
    """The number at the end of an address."""
    return F.nullif(F.regexp_extract(url, r"(\d+)/?$", 1), F.lit(""))


def attribute_text(c: Column) -> Column:
    """The text of an attribute: entities decoded once, the ampersand last."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")], c)


def embedded_json(html: Column, name: str, path: str) -> Column:
    """A field of the JSON that the attribute ``name`` of a page holds."""
    return F.get_json_object(attribute_text(F.regexp_extract(html, rf'{name}="([^"]*)"', 1)), path)


def picture_series(base: Column, key: Column, n: Column) -> Column:
    """Addresses of the pictures 1 to n of an id; one where n is not known, none for 0."""
    count = F.least(F.coalesce(n, F.lit(1)), F.lit(SERIES))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(base, key, F.lit("/"), i.cast("string"), F.lit(".jpg")))).otherwise(F.array().cast("array<string>"))


def ordered_pictures(photos: Column) -> Column:
    """map<string, struct<url, isCover, order_column>> -> addresses: covers first, then by order; repeats and stand-ins dropped."""
    rows = F.filter(F.map_values(F.coalesce(photos, F.create_map().cast("map<string,struct<url:string,isCover:boolean,order_column:int>>"))), lambda p: p["url"].isNotNull() & (p["url"] != ""))
    keyed = F.array_sort(F.transform(rows, lambda p: F.struct((~F.coalesce(p["isCover"], F.lit(False))).alias("a"), F.coalesce(p["order_column"], F.lit(0)).alias("b"), p["url"].alias("url"))))
    return F.filter(F.array_distinct(F.transform(keyed, lambda p: p["url"])), lambda u: ~placeholder_photo(u))


def best_variants(urls: Column) -> Column:
    """Of the sizes of one picture the whole one, else the widest, in the order of the pictures."""
    key = lambda u: F.regexp_replace(u, _SIZE_MARK, "")
    width = lambda u: F.when(key(u) == u, 1 << 30).otherwise(F.coalesce(F.nullif(F.regexp_extract(u, _SIZE_MARK, 1), F.lit("")).try_cast("int"), F.lit(0)))
    groups = F.array_distinct(F.transform(urls, key))
    return F.transform(groups, lambda g: F.array_max(F.transform(F.filter(urls, lambda u: key(u) == g), lambda u: F.struct(width(u).alias("w"), u.alias("u"))))["u"])


def flag_of(c: Column, yes: str, no: str | None = None) -> Column:
    """True or false by what a text asserts, null where it asserts neither."""
    t = F.lower(c)
    out = F.when(t.rlike(yes), True)
    return out.when(t.rlike(no), False) if no else out


def facts(c: Column, rules: dict[str, str]) -> Column:
    """A block of lines as struct: the first line that fits each rule gives its first group; ``rest`` are the lines that fit none."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), F.trim), lambda x: x != "")
    first = lambda rx: F.get(F.transform(F.filter(lines, lambda x: x.rlike(rx)), lambda x: F.regexp_extract(x, rx, 1)), F.lit(0))
    rest = F.filter(lines, lambda x: ~reduce(lambda a, b: a | b, [x.rlike(rx) for rx in rules.values()]))
    return F.struct(*[first(rx).alias(k) for k, rx in rules.items()], rest.alias("rest"))
