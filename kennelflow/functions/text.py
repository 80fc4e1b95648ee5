"""Column builders for text clean-up. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character with the Unicode White_Space property, and the information separators.
WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squish(c: Column) -> Column:
    """White space runs as one blank, ends cut; '' stays ''."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def clean_text(c: Column) -> Column:
    """As ``squish``, with '' as null."""
    return F.nullif(squish(c), F.lit(""))


def same_text_key(c: Column) -> Column:
    """Texts that differ only in letter case or white space get one key; null counts as ''."""
    return F.coalesce(F.lower(squish(c)), F.lit(""))
