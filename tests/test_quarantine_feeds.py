"""Quarantine, array replies, feeds, model selection."""

import json

from pyspark.sql import functions as F

from sift.operators import curation as C
from sift.operators import quarantine as QU
from sift.sources import collect as CO

GOOD = {"label": "AMAN", "probabilities": {"AMAN": 0.7, "WASPADA": 0.2, "TINGGI": 0.1}, "risk_score": 5, "recommendation": "ARCHIVE",
        "ambiguity_notes": "a long enough note"}


def test_split_counts_equal_the_rows_written(spark, tmpdir_path):
    replies = [json.dumps(GOOD), "```json\n" + json.dumps(GOOD) + "\n```", json.dumps(GOOD | {"ambiguity_notes": "  short  "}), "{broken", None, "",
               json.dumps(GOOD | {"probabilities": {"AMAN": 0.9, "TINGGI": 0.9}, "risk_score": 101}), json.dumps(GOOD | {"recommendation": "PANIC"})]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, reply string").repartition(3)
    path = f"{tmpdir_path}/q"
    valid, bad, seen = QU.split_write(QU.check_replies(df), path)
    assert sorted(r["id"] for r in valid.collect()) == [0, 1]
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {2: ["ambiguity_notes"], 3: ["parse"], 4: ["parse"], 5: ["parse"],
                                                              6: ["probability_sum", "risk_score"], 7: ["recommendation"]}
    assert bad.filter("id = 3").first()["reply"] == "{broken"  # the input stays with the reasons
    assert (seen["rows"], seen["valid"], seen["bad"], seen["parse"], seen["probability_sum"], seen["label"]) == (8, 2, 6, 3, 1, 0)
    valid, bad, seen = QU.split_write(QU.check_replies(df.limit(0)), f"{tmpdir_path}/e")
    assert seen["rows"] == seen["bad"] == 0


def test_array_replies(spark):
    cases = {'["a", "b"]': ["a", "b"], '```json\n["a"]\n```': ["a"], '```["x"]```': ["x"], " [] ": [], '["a", 1]': None, '["a", null]': None,
             '{"a": 1}': None, '"a"': None, "[1, 2]": None, "not json": None, "": None, '[["a"]]': None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "r string")
    got = {r["r"]: r["a"] for r in df.select("r", QU.string_array("r").alias("a")).collect()}
    assert got == cases | {None: None}


def test_dropped_rows_are_counted(spark):
    rows = [("SKIP", "long enough text"), ("AMAN", "short"), ("AMAN", "long enough text"), (None, "no label, long text"), ("TINGGI", None), ("SKIP", "x")]
    kept, seen = C.usable(spark.createDataFrame(rows, "label string, text string"))
    assert kept.count() == 1 and seen.get == {"rows": 6, "kept": 1, "skipped": 3, "too_short": 2}


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed</title><link>f</link>
<item><title>First title</title><link>http://a/1</link><description>&lt;p&gt;Body &amp;amp; more of it&lt;/p&gt;</description></item>
<item><title>Second one</title><description><![CDATA[<b>cdata body text</b>]]></description><content:encoded><![CDATA[<i>full content here</i>]]></content:encoded></item>
<item><title>Tiny</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link rel="self" href="me"/>
<entry><title type="html">Atom title</title><link rel="edit" href="no"/><link rel="alternate" href="http://b/1"/><summary>sum of the entry</summary>
<content type="html">&lt;p&gt;content of the entry&lt;/p&gt;</content></entry><entry><title>Plain and long enough</title><link href="http://b/2"/></entry></feed>"""


def test_feeds_of_both_kinds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("bad", "<rss><channel><item>"), ("none", None), ("empty", "")], "feed string, payload string")
    items = {(r["feed"], r["ord"]): r for r in CO.feed_items(df).collect()}
    assert set(items) == {("r", 0), ("r", 1), ("r", 2), ("a", 0), ("a", 1)}
    assert items["a", 0]["link"] == "http://b/1" and items["a", 1]["link"] == "http://b/2" and items["r", 1]["content"] == "<i>full content here</i>"
    rss = {(r["feed"], r["ord"]): (r["text"], r["url"]) for r in CO.rss_posts(CO.feed_items(df), "n", "home").collect()}
    assert rss["r", 0] == ("First title. Body &amp; more of it", "http://a/1") and rss["r", 1] == ("Second one. cdata body text", "home")
    assert rss["a", 0] == ("Atom title. sum of the entry", "http://b/1") and ("r", 2) not in rss
    forum = {(r["feed"], r["ord"]): r["text"] for r in CO.forum_posts(CO.feed_items(df), "s", "home", 20).collect()}
    assert forum["r", 0] == "First title. Body &a" and forum["r", 1] == "Second one. full con"  # the description is kept
    assert forum["a", 0] == "Atom title. content "


def test_feed_files(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.xml", "w") as f:
        f.write(RSS)
    with open(f"{tmpdir_path}/b.xml", "w") as f:
        f.write(ATOM)
    assert CO.rss_items(spark, tmpdir_path, "n", "home").count() == 4
    assert CO.forum_rss(spark, tmpdir_path, "s", "home").columns == ["text", "source", "url"]


def test_model_selection_is_repeatable(spark):
    from sift.operators import ml as ML
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    rows = [(f"t{i}", ("bom serang " if i % 5 == 0 else "kopi pagi ") + f"w{i % 17}", "TINGGI" if i % 5 == 0 else "AMAN") for i in range(200)]
    df = spark.createDataFrame(rows, "text_id string, text string, label string")
    (model, tried), (_, again) = (ML.select_model(df, "text_id", regs=(0.01, 10.0), max_iter=10, num_features=512) for _ in range(2))
    assert tried == again and [t[2] for t in tried].count(True) == 1
    best = next(t for t in tried if t[2])
    assert best[1] == max(t[1] for t in tried) == 1.0
    assert ML.predictions(model, df).filter("correct").count() == 200
    feedback = spark.createDataFrame([(f"t{i}", "TINGGI") for i in range(60)], "text_hash string, corrected_label string")
    assert ML.retrain_from_feedback(df, feedback.limit(3), "text_id") is None
    retrained = ML.retrain_from_feedback(df, feedback, "text_id", 50, max_iter=5, num_features=512)
    assert ML.score(retrained, df).count() == 200
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before  # nothing is left cached
