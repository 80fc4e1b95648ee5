"""Recorded pages and feeds as a Spark data source, one partition a file, and extraction of cards from HTML."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FilePart(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.items = options["path"], options.get("items", "")

    def partitions(self) -> list[FilePart]:
        return [FilePart(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, part: FilePart) -> Iterator[tuple[str, int, str]]:
        data = json.loads(Path(part.path).read_text())
        for step in filter(None, self.items.split(".")):
            data = data[step]
        for n, item in enumerate(data if isinstance(data, list) else [data]):
            yield Path(part.path).name, n, json.dumps(item)


class RecordedFeed(DataSource):
    """``spark.read.format("recorded_feed").option("path", ...).option("items", "response").load()``:
    file_name, record_no, payload of each item under a dotted path in recorded JSON files."""

    @classmethod
    def name(cls) -> str:
        return "recorded_feed"

    def schema(self) -> str:
        return "file_name string, record_no int, payload string"

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options)


class _Cards(HTMLParser):
    """Texts of the elements that have a class, inside elements of the card class."""

    VOID = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, card: str) -> None:
        super().__init__()
        self.card, self.depth, self.open = card, 0, []
        self.cards: list[dict[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = (dict(attrs).get("class") or "").split()
        if not self.depth and self.card in classes:
            self.cards.append({})
            self.depth = 1
        elif self.depth and tag not in self.VOID:
            self.depth += 1
        if self.depth and tag not in self.VOID:
            self.open.append(classes)
            for k, v in attrs:
                if k.startswith("data-") or k in ("href", "src"):
                    self.cards[-1].setdefault(k, v or "")
        elif self.depth and tag == "img":
            self.cards[-1].setdefault("src", dict(attrs).get("src") or "")

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag not in self.VOID:
            self.depth -= 1
            self.open.pop()

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if self.depth and text:
            for name in self.open[-1] if self.open else []:
                old = self.cards[-1].get(name)
                self.cards[-1][name] = f"{old} {text}" if old else text


def cards(pages: DataFrame, html: str, key: str, card_class: str) -> DataFrame:
    """key, card_no, fields (map of class or attribute to text) of every card in each page.

    Null pages and pages without cards give no rows; unclosed elements end with the page.
    """

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for k, page in zip(b["key"], b["html"]):
                if page:
                    p = _Cards(card_class)
                    p.feed(page)
                    out += [(k, n, json.dumps(c)) for n, c in enumerate(p.cards)]
            yield pd.DataFrame(out, columns=["key", "card_no", "fields"])

    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(read, "key string, card_no int, fields string")
    return rows.select("key", "card_no", F.from_json("fields", "map<string,string>").alias("fields"))
