"""Normalisation and signals on fixture texts (FIXTURES.md 7)."""

from pyspark.sql import functions as F

from sift.operators.normalize import normalize
from sift.operators.signals import extract_signals
from sift.functions import text as X


def _norm(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r["id"]: r for r in normalize(df, "text").collect()}


def test_urls_mentions_hashtags(spark):
    r = _norm(spark, ["see https://a.b/c and www.x.org/y end", "@bob hi #tag!", "https://q.r"])
    assert r[0]["normalized_text"] == "see and end"
    assert list(r[0]["stripped_urls"]) == ["https://a.b/c", "www.x.org/y"]
    assert r[1]["normalized_text"] == "hi tag!"
    assert r[2]["normalized_text"] == "" and r[2]["token_count"] == 0


def test_slang_rules(spark):
    r = _norm(spark, ["GW pergi", "kyk, gitu", "wkwk ok", "kyk kayak"])
    assert r[0]["normalized_text"] == "saya pergi"          # upper case matches
    assert r[1]["normalized_text"] == "kyk, gitu"           # attached comma: no match
    assert r[2]["normalized_text"] == "ok"                  # empty replacement deletes
    assert r[3]["normalized_text"] == "kayak seperti"       # single pass, no chaining


def test_emoji_and_whitespace(spark):
    r = _norm(spark, ["api 🔥 ⚠️ x", "a  b\t c "])
    assert r[0]["has_emoji"] is True
    assert r[0]["normalized_text"] == "api [api] [peringatan] x"
    assert r[1]["normalized_text"] == "a b c" and r[1]["token_count"] == 3
    assert r[1]["has_emoji"] is False


def test_script_mix_runs(spark):
    r = _norm(spark, ["مرحبا", "", "abc def"])
    assert r[0]["lang_mix"]["ar"] == 0.5 and r[0]["lang_mix"]["id"] == 0.0
    assert r[1]["lang_mix"]["other"] == 1.0
    assert r[2]["lang_mix"]["id"] == round(2 / 3, 3)


def test_text_hash_strip_lower(spark):
    df = spark.createDataFrame([(" Hello ",), ("hello",)], "t string")
    h = [r[0] for r in df.select(X.text_hash("t")).collect()]
    assert h[0] == h[1]


def test_signals_windows_and_dedup(spark):
    text = "🔥 kita harus bergerak! segera, malam ini juga. segera"
    df = spark.createDataFrame([(1, text), (2, "tidak ada apa-apa")], "id int, text string")
    out = {r["id"]: r for r in extract_signals(df, "text").collect()}
    sig = out[1]["signals"]
    types = [s["signal_type"] for s in sig]
    assert types.count("EUPHEMISM") == 2  # segera, malam ini
    acts = [s for s in sig if s["signal_type"] == "CALL_TO_ACTION"]
    # window is taken on the original text; offsets count code points (emoji first)
    assert acts[0]["extracted_text"].startswith("🔥 kita harus")
    temporal = [s["extracted_text"] for s in sig if s["signal_type"] == "TEMPORAL"]
    assert temporal == ["malam ini", "segera"]
    assert out[2]["signal_count"] == 0


def test_lexicon_inside_word(spark):
    df = spark.createDataFrame([(1, "membakar")], "id int, text string")
    sig = extract_signals(df, "text").collect()[0]["signals"]
    assert [s["extracted_text"] for s in sig] == ["bakar"]
    assert sig[0]["significance"] == "MEDIUM"


def test_slang_meaning_is_the_same_at_any_size(spark):
    """Null replacements, repeated tokens and null texts around the inline bound."""
    from sift.operators.normalize import normalize
    texts = spark.createDataFrame([(0, "Saya pergi ZZ ke x"), (1, "zz  zz"), (2, None), (3, ""), (4, "dup t5 #tag @me"), (1, "zz  zz")],
                                  "id int, text string")
    out = []
    for size in (999, 1000, 1001):
        rows = [(f"t{i}", f"r{i}", i) for i in range(size - 2)] + [("zz", None, 1), ("Dup", "last", 9), ("dup", "first", 1)]
        slang = spark.createDataFrame(rows, "token string, replacement string, ord int")
        n = normalize(texts, "text", slang=slang)
        out.append(sorted(map(repr, n.select("id", "text", "normalized_text", "token_count", "content_hash", "has_emoji", "stripped_urls", "lang_mix").collect())))
    assert out[0] == out[1] == out[2]
    assert "normalized_text='saya pergi ke x'" in out[2][0].lower() and "last r5" in out[2][-1]


def test_python_whitespace_in_patterns(spark):
    from sift.operators.signals import urgency_signals
    df = spark.createDataFrame([("malam\x1cini",)], "text string")
    assert len(df.select(urgency_signals(F.col("text"), [r"malam\s+ini"]).alias("s")).first()["s"]) == 1
