"""Landed payload readers (FIXTURES.md 4) and streaming."""

import json
import os

import pytest

from pyspark.sql import functions as F

from sift.sources import collect as SC
from sift.sources import files as SF


def test_forum_listing(spark, tmpdir_path):
    listing = {"data": {"children": [
        {"data": {"title": "A title here", "selftext": "with a body", "permalink": "/r/x/1"}},
        {"data": {"title": "Short", "selftext": "", "permalink": ""}},
        {"data": {"title": "Only a long title!", "selftext": "", "permalink": None}}]}}
    p = os.path.join(tmpdir_path, "l.json")
    with open(p, "w") as f:
        f.write(json.dumps(listing))
    rows = SC.forum_listing(spark, p, "https://base", "https://list").collect()
    assert [r["text"] for r in rows] == ["A title here. with a body", "Only a long title!"]
    assert rows[0]["url"] == "https://base/r/x/1" and rows[1]["url"] == "https://list"


def test_rss_items(spark, tmpdir_path):
    xml = ("<rss><channel><item><title>Headline number one</title><summary>&lt;b&gt;bold&lt;/b&gt; text</summary>"
           "<link>http://x/1</link></item><item><title>tiny</title></item></channel></rss>")
    p = os.path.join(tmpdir_path, "f.xml")
    with open(p, "w") as f:
        f.write(xml)
    rows = SC.rss_items(spark, p, "feed", "http://feed").collect()
    assert len(rows) == 1 and rows[0]["text"] == "Headline number one. bold text"
    assert rows[0]["source"] == "RSS: feed"


def test_fallback_and_union(spark):
    p = spark.createDataFrame([("t1", "p")], "target string, text string")
    s = spark.createDataFrame([("t1", "s"), ("t2", "s")], "target string, text string")
    got = sorted((r["target"], r["text"]) for r in SC.fallback(p, s, "target").collect())
    assert got == [("t1", "p"), ("t2", "s")]
    a = spark.createDataFrame([("x", "src")], "text string, source string")
    b = spark.createDataFrame([("  ",), ("y",)], "text string")
    u = SC.union_clean([a, b]).collect()
    assert [(r["text"], r["source"], r["url"]) for r in u] == [("x", "src", ""), ("y", "OSINT", "")]


def test_uploaded_txt(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "u.txt")
    with open(p, "w") as f:
        f.write("one\n\n  two  \n")
    assert [r["text"] for r in SC.uploaded_texts(spark, p).collect()] == ["one", "two"]


def test_media_manifest(spark, tmpdir_path):
    for n in ("a.WAV", "b.mp3", "c.txt"):
        with open(os.path.join(tmpdir_path, n), "wb") as f:
            f.write(b"x")
    inv = SF.media_inventory(spark, tmpdir_path)
    assert sorted(r["name"] for r in inv.collect()) == ["a.WAV", "b.mp3"]
    mp = os.path.join(tmpdir_path, "m.json")
    with open(mp, "w") as f:
        f.write(json.dumps({"a.WAV": "hello there", "missing.wav": "x"}))
    man = SF.read_manifest(spark, mp)
    j = man.join(inv.select("name"), "name").collect()
    assert [r["name"] for r in j] == ["a.WAV"]


def test_stream_triage_first_write(spark, tmpdir_path):
    from sift.streaming.triage_stream import run_incremental_triage
    land = os.path.join(tmpdir_path, "land")
    os.makedirs(land)
    with open(os.path.join(land, "1.json"), "w") as f:
        for i, t in enumerate(["ayo kita bergerak! malam ini", "biasa saja hari ini", "ayo kita bergerak! malam ini"]):
            f.write(json.dumps({"post_id": str(i), "text": t, "source": "s", "url": ""}) + "\n")
    logs, ck = os.path.join(tmpdir_path, "logs"), os.path.join(tmpdir_path, "ck")
    run_incremental_triage(spark, land, logs, ck)
    with open(os.path.join(land, "2.json"), "w") as f:
        f.write(json.dumps({"post_id": "9", "text": "biasa saja hari ini", "source": "s", "url": ""}) + "\n")
    run_incremental_triage(spark, land, logs, ck)
    stored = spark.read.parquet(logs)
    assert stored.count() == 2 and stored.select("id").distinct().count() == 2


def test_stream_trend_matches_batch(spark, tmpdir_path):
    import datetime as dt
    from sift.schemas import ANALYSIS_LOG
    from sift.streaming.trend_stream import trend_stream
    rows = [(f"i{k}", dt.datetime(2024, 1, 1 + k % 3, 5), 0.0, "x", None, ["AMAN", "TINGGI"][k % 2], 0,
             "LOW", 0.1, False, "SWEEP") for k in range(12)]
    src = os.path.join(tmpdir_path, "logs")
    spark.createDataFrame(rows, ANALYSIS_LOG).write.parquet(src)
    q = (trend_stream(spark, src).writeStream.outputMode("complete").format("memory")
         .queryName("trend_check").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((str(r["dt"]), r["predicted_label"], r["n"]) for r in spark.table("trend_check").collect())
    batch = (spark.read.parquet(src).groupBy(F.to_date("timestamp").alias("dt"), "predicted_label")
             .agg(F.count("*").alias("n")).collect())
    assert got == sorted((str(r["dt"]), r["predicted_label"], r["n"]) for r in batch)


def test_streams_share_a_log_without_losing_rows(spark, tmpdir_path):
    """A second stream, and a new checkpoint of the first, start at batch 0 again."""
    from sift.streaming.triage_stream import run_incremental_triage
    logs = os.path.join(tmpdir_path, "logs")
    for name, text in (("a", "teks pertama"), ("b", "teks kedua")):
        os.makedirs(os.path.join(tmpdir_path, name))
        with open(os.path.join(tmpdir_path, name, "1.json"), "w") as f:
            f.write(json.dumps({"post_id": name, "text": text, "source": "s", "url": ""}) + "\n")
        run_incremental_triage(spark, os.path.join(tmpdir_path, name), logs, os.path.join(tmpdir_path, f"ck-{name}"))
    run_incremental_triage(spark, os.path.join(tmpdir_path, "a"), logs, os.path.join(tmpdir_path, "ck-new"))
    stored = spark.read.parquet(logs)
    assert sorted(r["input_text"] for r in stored.collect()) == ["teks kedua", "teks pertama"]


def test_unreadable_store_raises(spark, tmpdir_path):
    from sift.operators.store import append_first_write
    logs = os.path.join(tmpdir_path, "logs")
    os.makedirs(os.path.join(logs, "batch_id=0"))
    with open(os.path.join(logs, "batch_id=0", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    batch = spark.createDataFrame([("x", 1)], "id string, arrival int")
    with pytest.raises(Exception):
        append_first_write(spark, batch, logs, "1")
    assert not os.path.exists(os.path.join(logs, "batch_id=1", "_SUCCESS"))
