"""Dictionaries of any size: the index equals the in-row form."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F
from sift.operators import dicts
from sift.operators import matching as M
from sift.operators import signals as SG
from sift.operators.normalize import normalize

TERMS = ["bakar", "Gebuk", "é", "ß", "日本", "a", "malam ini", "x" * 40, "🔥🔥", " besok", "bakar gedung", ""]
PATTERNS = [r"ayo\s+(kita\s+)?", r"\d+", r"segera", r"(?i)SEGERA", r"ma(lam|tahari)\s+ini", r"[a-c]+d", r"x{2,}y", r"(ab)+c", r"bes?ok\b", r"^ayo", "ß", r"(foo|bar)baz(qu)?x"]


def texts(rnd, n=150):
    words = ["ayo", "kita", "bakar", "GEBUK", "gedung", "malam", "ini", "éa", "straße", "日本語", "🔥🔥", "12", "besok", "segera", "abababc", "xxy", "foobazx", "zz", "x" * 45]
    rows = [" ".join(rnd.choices(words, k=rnd.randint(0, 25))) for _ in range(n)]
    return rows + ["", None, "ayo"] + ["same text bakar 7"] * 40


def test_required_literals_are_held_by_every_match():
    cases = {r"ayo\s+(kita\s+)?": "ayo", r"(abc|abd)efg": "efg", r"\d+": "", r"a?bc+d": "b", r"x(?:yz){2,3}w": "yz", r"(?i)abc": "",
             r"(": "", r"ab(?=cde)f": "abf", r"(kita)+ bergerak": " bergerak", "": "", r"\bsekarang\b": "sekarang", r"a.bcd": "bcd"}
    assert {p: M.required_literal(p) for p in cases} == cases
    rnd = random.Random(4)
    for p in PATTERNS:
        lit = M.required_literal(p)
        for t in texts(rnd, 300):
            assert t is None or not re.search(p, t) or lit in t


def test_required_forms_are_held_by_every_match():
    cases = {r"the\s+(cat|la)[,.]": ["the cat,", "the cat.", "the la,", "the la."], r"ayo\s+(kita\s+)?": ["ayo ", "ayo kita "], r"\d+": [""],
             r"a ?b\sc": ["a b c", "ab c"], r"(ab|c\d)ef": ["ef"], r" +a\n b": [" a b"], r"(?i)abc": [""], "(": [""], r"x{2,}y": ["x"]}
    assert {p: M.required_forms(p) for p in cases} == cases
    rnd = random.Random(4)
    parts = ["a", "b", " ", r"\s", r"\s+", "[ab]", "(a|b )", r"(ab|\sb|)", "b?", r"\s*", r"(a\s)+", r"[a\s]", "a{2}", ".", r"\b", r"(?:a|b\s+a)?", "^", "[^a]"]
    for p in ["".join(rnd.choices(parts, k=rnd.randint(1, 5))) for _ in range(1000)]:
        for t in ["".join(rnd.choices("ab \n\t", k=rnd.randint(0, 12))) for _ in range(10)]:
            assert not re.search(p, t) or any(f in re.sub(r"\s+", " ", t) for f in M.required_forms(p)), (p, t)


def test_patterns_of_a_common_word_are_no_candidates_of_every_text(spark):
    rows = [f"the cat{i}, the\n dog{i}." for i in range(40)]
    pats = spark.createDataFrame([(i, rf"the\s+(cat{i}x?|dog{i})[,.]") for i in range(40)], "ord int, pattern string")
    df = spark.createDataFrame(list(enumerate(rows)), "id int, low string")
    needles = pats.selectExpr("cast(ord AS long) AS ord", "pattern").mapInArrow(SG._pattern_needles, "ord long, pattern string, java string, literal string")
    spaced = df.withColumn("spaced", F.regexp_replace("low", r"\s+", " "))
    found = {r.id: [c.ord for c in r.c] for r in M.with_candidates(spaced, "spaced", needles, "c").collect()}
    assert found == {i: [i] for i in range(40)}  # two forms of a pattern are one candidate


def lexicon(spark, rows):
    return spark.createDataFrame(rows, "ord int, term string, meaning string, threat_level string, note string")


def signal_rows(spark, rows, lex, pats, emoji=None, slang=None):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").repartition(4)
    out = SG.extract_signals(df, "text", lexicon=lex, action_patterns=pats, urgency_patterns=pats)
    out = normalize(out, "text", slang=slang, emoji=emoji)
    return sorted(map(str, out.select("id", "signals", "normalized_text", "has_emoji", "token_count").collect()))


def test_index_equals_in_row_form(spark, monkeypatch):
    rows = texts(random.Random(1))
    lex = lexicon(spark, [(i % 9, t, "m", ["HIGH", "MEDIUM", "ODD", None][i % 4], None if i == 3 else "n") for i, t in enumerate(TERMS)]
                  + [(None, "zz", None, "LOW", "n"), (3, None, "m", "HIGH", "n"), (2, "bakar", "again", "HIGH", "n")])
    pats = spark.createDataFrame([(i % 8, p) for i, p in enumerate(PATTERNS)] + [(1, None)], "ord int, pattern string")
    # tags that later keys match, keys inside keys, an empty tag
    emoji = spark.createDataFrame([(1, "🔥", "[api]"), (2, "api", "[x]"), (3, "é", None), (4, "] [", "join"), (5, "日本", "JP"), (6, None, "z")], "ord int, emoji string, tag string")
    slang = spark.createDataFrame([("ayo", "mari\t kita"), ("12", None), ("[api]", "fire"), ("gebuk", "pukul")], "token string, replacement string")
    inline = signal_rows(spark, rows, lex, pats, emoji, slang)
    monkeypatch.setattr(dicts, "MAX_INLINE_ROWS", -1)
    for name, value in [("FILTER_BITS", M.FILTER_BITS), ("FILTER_BITS", 1 << 6), ("STEP_BYTES", 100)]:  # useless bit table, small steps
        monkeypatch.setattr(M, name, value)
        assert signal_rows(spark, rows, lex, pats, emoji, slang) == inline


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_one_meaning_around_the_bound(spark, n):
    rnd = random.Random(n)
    rows = texts(rnd, 60)
    terms = [(i, "".join(rnd.choice("abkargemlini ") for _ in range(rnd.randint(1, 6))), "m", "HIGH", "n") for i in range(n)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows) if t is not None], "id int, text string").withColumn("low", F.lower("text"))
    got = SG.with_lexicon_signals(df, "low", lexicon(spark, terms), "s").select("id", F.transform("s", lambda e: e["extracted_text"]).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {i: [x[1] for x in terms if x[1].lower() in t.lower()] for i, t in enumerate(rows) if t is not None}


def test_no_nested_loop_and_no_hot_gram(spark, monkeypatch):
    monkeypatch.setattr(dicts, "MAX_INLINE_ROWS", 0)
    df = spark.createDataFrame([(i, f"common words everywhere number {i}") for i in range(500)], "id int, text string").withColumn("low", F.lower("text"))
    lex = lexicon(spark, [(i, f"words everywhere number {i}", "m", "HIGH", "n") for i in range(400, 450)])
    out = SG.with_lexicon_signals(df, "low", lex, "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # terms are filed under their numbers, not under the words that all texts hold
    terms = lex.select(F.lower("term").alias("literal"))
    n = M.candidates(df.select(F.col("id").cast("long").alias("key"), "low"), terms).count()
    assert n < 50 * 20 and out.filter("size(s) = 1").count() == 50


def test_grams_of_short_literals():
    data = np.frombuffer("aß日🔥".encode(), np.uint8).astype(np.int64)
    sizes = [set(M._grams(data, n).tolist()) for n in range(1, 5)]
    assert not (sizes[0] & sizes[1]) and not (sizes[2] & sizes[3]) and [len(s) for s in sizes] == [8, 9, 8, 7]  # bytes repeat


def test_empty_dictionaries_and_tables(spark, monkeypatch):
    monkeypatch.setattr(dicts, "MAX_INLINE_ROWS", -1)
    pats, emoji = spark.createDataFrame([], "ord int, pattern string"), spark.createDataFrame([], "ord int, emoji string, tag string")
    lex, slang = lexicon(spark, []), spark.createDataFrame([], "token string, replacement string")
    assert len(signal_rows(spark, ["some text", None, ""], lex, pats, emoji, slang)) == 3
    full = lexicon(spark, [(1, "a", "m", "HIGH", "n")])
    empty = spark.createDataFrame([], "id int, text string, low string")
    assert SG.with_lexicon_signals(empty, "low", full, "s").count() == 0


def test_hits_are_not_shuffled(spark, monkeypatch):
    """Texts that hold very many needles: what is exchanged is rows and a block's needles, not pairs of both."""
    monkeypatch.setattr(dicts, "MAX_INLINE_ROWS", 0)
    words = [f"w{i:03}" for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(100)], "id int, text string").withColumn("low", F.lower("text"))
    lex = lexicon(spark, [(i, w, "m", "HIGH", "n") for i, w in enumerate(words)] + [(900, "w000 " + " ".join(words[1:9]), "m", "LOW", "n"), (901, "w000 w001 w002 w003 w004 wrong", "m", "LOW", "n")])
    out = SG.with_lexicon_signals(df, "low", lex, "s")
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("size(s) = 301").count() == 100
    slang = spark.createDataFrame([(w, w[::-1]) for w in words], "token string, replacement string")
    n = normalize(df.select("id", "text"), "text", slang=slang)
    assert "collect_list" not in n._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in n.select("normalized_text").collect()} == {" ".join(w[::-1] for w in words)}


def test_each_block_has_its_own_task(spark, monkeypatch):
    """Blocks went to tasks by their hash: a third of the tasks had none, others several."""
    monkeypatch.setattr("sift.operators.blocks.BLOCK_BYTES", 100)
    df = spark.createDataFrame([(i, f"text {i:05d}") for i in range(640)], "id int, low string")
    needles = spark.createDataFrame([(i, f"{i:05d}") for i in range(640)], "ord int, literal string")
    out = M.with_candidates(df, "low", needles, "c").select("id", "c.ord", F.spark_partition_id().alias("task")).collect()
    assert {r.id: r.ord for r in out} == {i: [i] for i in range(640)}
    assert len({r.task for r in out}) == 64


def test_literals_of_any_length_at_any_place(spark):
    rnd = random.Random(8)
    unit = "".join(rnd.choices("abé", k=150))
    terms = sorted({unit[:n] for n in range(1, 140)} | {unit[:n] + "!" for n in (1, 7, 8, 9, 15, 16, 17, 23, 24, 40, 99)})
    rows = [unit[:50] + "?" + unit, unit[:17] + unit[:16] + "!", unit[:99] + "!", "!" + unit[:8], unit[:7] + "!", "", None]
    rows += ["".join(rnd.choices("abé!", k=30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, low string")
    needles = spark.createDataFrame(list(enumerate(terms)), "ord int, literal string")
    got = {r.id: r.c for r in M.with_candidates(df, "low", needles, "c").select("id", F.size("c").alias("c")).collect()}
    assert got == {i: sum(t in (x or "") for t in terms) for i, x in enumerate(rows)}


def test_plain_patterns():
    cases = {r"the\s+cat": ["the cat"], r"the\s+(cat|la)[,.]": ["the cat,", "the cat.", "the la,", "the la."], r"a(b|bc)": None, r"a(|b)": None,
             r"a\s+(\s+b|c)": None, "a b": None, r"a\s*b": None, r"\s+a": [" a"], r"a.b": None, r"[a-c]d": None, r"(?i)a": None, r"\ba": None,
             r"[[a]b": None, "": None, "(": None, "[abcdefghij][abc]": None, "ay(ou|oo)": ["ayoo", "ayou"]}
    assert {p: M.plain_forms(p) for p in cases} == cases
    rnd = random.Random(6)
    parts = ["a", "b", "é", r"\s+", "[ab]", "(a|b)", "(ab|c)", r"(a\s+|b)", "[,.]", "c"]
    for p in ["".join(rnd.choices(parts, k=rnd.randint(1, 5))) for _ in range(600)]:
        forms = M.plain_forms(p)
        for t in ["".join(rnd.choices("abcé, \n", k=rnd.randint(0, 14))) for _ in range(8)] if forms else []:
            low, m = re.sub(r"\s+", " ", t), re.search(p, t)
            at = min(((low.find(f), f) for f in forms if f in low), default=None)
            assert (m is None) == (at is None), (p, t)
            if m:
                places = M._spaced_places(t, len(low))
                assert (places[at[0]], places[at[0] + len(at[1])]) == m.span(), (p, t)


def test_plain_patterns_need_no_regex_per_text(spark, monkeypatch):
    """Each candidate was once matched with its text by Java, which reads the pattern and the text anew."""
    rows = [f"é🔥 go \n　 the{i} \t Cat, and the{i} cat. " + "x" * i + "İ the0  CAT." for i in range(30)] + [None, "", "the1 cat"]
    pats = spark.createDataFrame([(i, rf"the{i}\s+(cat|dog)[,.]") for i in range(30)] + [(40, r"go\s+"), (41, r"x{3,}")], "ord int, pattern string")
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").withColumn("low", F.lower("text"))
    get = lambda: [SG.with_urgency_signals(SG.with_action_signals(df, "text", "low", pats, "a"), "text", "low", pats, "u").orderBy("id").collect()]
    inline = get()
    monkeypatch.setattr(dicts, "MAX_INLINE_ROWS", -1)
    assert get() == inline
    needles = pats.selectExpr("cast(ord AS long) AS ord", "pattern").mapInArrow(SG._pattern_needles, "ord long, pattern string, java string, literal string")
    found = M.with_first_matches(df, "text", "low", needles, "c", 20, 40, SG.java_pattern).select(F.explode("c").alias("c")).select("c.*").collect()
    assert {r.name for r in found if r.java} == {r"x{3,}"} and all(r.near and r.hit for r in found if not r.java)
