"""Token counts of whole texts under a public tokenizer, read from a path that the caller gives."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("KENNELFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
_loaded: dict[str, object] = {}
#: Characters encoded at a time. Pieces end at white space, so that very long texts need no memory beyond it.
PIECE = 20_000


def encoder(path: str):
    """The tokenizer of a file; loaded once a worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _loaded[path] = t
    return _loaded[path]


_SPACE = re.compile(r"[ \n]")


def pieces(text: str) -> list[str]:
    """The text cut before white space about every ``PIECE`` characters; joined they are the text. What has no white space is one piece."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at + 1, at + PIECE), text.rfind("\n", at + 1, at + PIECE))
        if cut <= at:
            m = _SPACE.search(text, at + PIECE)
            cut = m.start() if m else len(text)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) else out


def count_tokens(docs: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and tokens (bigint) of the column text. Null and empty texts have 0 tokens."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in it:
            parts = [pieces(t) if t else [] for t in b["_text"]]
            got = iter(enc.encode_batch_fast([p for x in parts for p in x], add_special_tokens=False))
            b["tokens"] = [sum(len(next(got).ids) for _ in x) for x in parts]
            yield b.drop(columns="_text")

    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("tokens")).schema
    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(count, schema)
