"""Sources and streams."""

import json
import time
from datetime import datetime, timedelta

from kennelflow.sources import pages, robots
from kennelflow.streaming import feeds


def test_robots(spark):
    rules = robots.parse("User-agent: x\nDisallow: /\n\nUser-agent: *\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow: /same\nAllow: /same\n")
    paths = ["/", "/private/a", "/private/open/b", "/a.pdf", "/a.pdf?x", "/same"]
    got = {r.path: r.allowed for r in robots.allowed(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert got == {"/": True, "/private/a": False, "/private/open/b": True, "/a.pdf": False, "/a.pdf?x": True, "/same": True}
    assert robots.parse(None) == [] and robots.allowed(spark.createDataFrame([("/",)], "path string"), []).first().allowed


def test_recorded_feed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"response": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"response": []}))
    spark.dataSource.register(pages.RecordedFeed)
    got = spark.read.format("recorded_feed").option("path", str(tmp_path)).option("items", "response").load().collect()
    assert sorted((r.file_name, r.record_no, json.loads(r.payload)["id"]) for r in got) == [("a.json", 0, 1), ("a.json", 1, 2)]


def test_cards(spark):
    html = '<ul><li class="card" data-id="7"><b class="name">Rex</b><br><img src="r.jpg"><i class="age">2 <u>yr</u></i></li><li class="card"><b class="name">Zoe</b>'
    got = pages.cards(spark.createDataFrame([("p", html), ("q", None), ("r", "")], "k string, h string"), "h", "k", "card").collect()
    assert [(r.key, r.card_no, r.fields.get("name")) for r in got] == [("p", 0, "Rex"), ("p", 1, "Zoe")]
    assert got[0].fields["data-id"] == "7" and got[0].fields["src"] == "r.jpg"


def test_upsert_stream_and_windows(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    t = datetime(2026, 7, 1)
    spark.createDataFrame([("a", 1, t), ("a", 2, t + timedelta(minutes=1)), ("b", 1, t)], "id string, v int, at timestamp").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id string, v int, at timestamp").parquet(str(src))
    q = feeds.upsert_stream(stream, str(out), ["id"], "at").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.id, r.v) for r in spark.read.parquet(str(out / "0")).collect()} == {("a", 2), ("b", 1)}
    batch = spark.read.parquet(str(src))
    assert {(r.id, r.n) for r in feeds.windowed_counts(batch, "at", "10 minutes", "1 hour", ["id"]).collect()} == {("a", 2), ("b", 1)}
    assert feeds.sessions(batch, "at", "30 seconds", "1 hour", ["id"]).count() == 3
    sent = []
    q = feeds.alert_stream(stream, str(tmp_path / "ledger"), ["id"], lambda df: sent.extend(r.id for r in df.select("id").distinct().collect()))
    q.option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination(60)
    time.sleep(0)
    assert sorted(sent) == ["a", "b"]
