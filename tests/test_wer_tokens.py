"""WER against hand values (FIXTURES.md 14) and token highlights (13)."""

from pyspark.sql import functions as F

from sift.operators import tokens as TK
from sift.operators import wer as W


def test_wer_hand_values(spark):
    pairs = [("same", "a b c", "a b c"), ("sub", "a b c", "a x c"),
             ("merge", "hello world foo", "hello-world foo"), ("ins", "a b", "a b c"),
             ("empty", "", "a")]
    df = spark.createDataFrame(pairs, "name string, reference string, hypothesis string")
    out = {r["name"]: r["w"] for r in W.with_wer(df).collect()}
    assert out["same"]["wer"] == 0.0
    assert (out["sub"]["substitutions"], out["sub"]["wer"]) == (1, 0.3333)
    assert (out["merge"]["substitutions"], out["merge"]["deletions"]) == (1, 1)
    assert (out["ins"]["insertions"], out["ins"]["wer"]) == (1, 0.5)
    assert out["empty"]["error"] == "empty reference"
    rep = W.corpus_report(df).collect()[0]
    assert rep["n_failed"] == 1 and rep["n_ok"] == 4


def test_highlights_all_equal_and_specials(spark):
    df = spark.createDataFrame([(1, ["[CLS]", "##ab", "cd", "[SEP]"], [9.0, 0.5, 0.5, 9.0])],
                               "id int, toks array<string>, scores array<double>")
    h = TK.highlights(df, "toks", "scores").collect()[0]["highlights"]
    assert [e["token"] for e in h] == ["ab", "cd"] and [e["score"] for e in h] == [0.0, 0.0]


def _table(ref, hyp):
    """(cost, -hits), least first, by the whole table."""
    t = [[(j, 0) for j in range(len(hyp) + 1)]]
    for i, r in enumerate(ref, 1):
        row = [(i, 0)]
        for j, h in enumerate(hyp, 1):
            hit = (t[i - 1][j - 1][0], t[i - 1][j - 1][1] - 1) if r == h else (t[i - 1][j - 1][0] + 1, t[i - 1][j - 1][1])
            row.append(min(hit, (t[i - 1][j][0] + 1, t[i - 1][j][1]), (row[-1][0] + 1, row[-1][1])))
        t.append(row)
    return t[-1][-1][0], -t[-1][-1][1]


def test_alignments_equal_the_whole_table(monkeypatch):
    import random
    rnd = random.Random(2)
    pairs = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]) for _ in range(600)]
    for cells in (W.CELLS, 40):  # all together, and few at a time
        monkeypatch.setattr(W, "CELLS", cells)
        cost, hits = W.align_counts(pairs)
        assert list(zip(cost.tolist(), hits.tolist())) == [_table(*p) for p in pairs]
    assert W.align_counts([])[0].size == 0


def test_highlights_equal_a_plain_loop(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal
    rnd = random.Random(9)
    rows = [(i, [rnd.choice(["[CLS]", "##ab", "▁", "x", "▁y##", None, "é"]) for _ in range(rnd.randint(0, 30))],
             [rnd.choice([None, rnd.random(), rnd.randint(0, 3) / 8, 1 / 32]) for _ in range(rnd.randint(0, 30))]) for i in range(200)]
    rows += [(300, None, [1.0]), (301, ["a"], None), (302, [], []), (303, ["a", "b"], [5.0, 5.0])]

    def plain(toks, scores):
        if toks is None or scores is None:
            return None
        kept = [(i, t.replace("##", "").replace("▁", ""), s) for i, (t, s) in enumerate(zip(toks, scores))
                if t is not None and s is not None and t not in TK.SPECIAL_TOKENS and t.replace("##", "").replace("▁", "")]
        if not kept:
            return []
        low, high = min(k[2] for k in kept), max(k[2] for k in kept)
        q = lambda s: float(Decimal(repr((s - low) / ((high - low) or 1.0))).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP))
        return [(i, t, s) for s, i, t in sorted(((q(s), i, t) for i, t, s in kept), key=lambda x: (-x[0], x[1]))[:15]]
    df = spark.createDataFrame(rows, "id int, toks array<string>, scores array<double>").repartition(3)
    got = {r["id"]: r["highlights"] for r in TK.highlights(df, "toks", "scores").collect()}
    assert {k: None if v is None else [tuple(e) for e in v] for k, v in got.items()} == {i: plain(t, s) for i, t, s in rows}
