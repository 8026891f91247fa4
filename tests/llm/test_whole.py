"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
import pyarrow as pa

from sift.llm import common, jaccard, links
from test_llm import brute_components, prose


def components(df):
    return {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_join(df)[0].collect()}


def test_near_copies_of_which_one_shares_a_passage(spark):
    rows, want = [], {}
    for c in range(200):
        a, passage = prose(60, 1000 + c), prose(16, 3000 + c)
        three = [(3 * c + i, t) for i, t in enumerate((a, f"{a} {passage}", f"{prose(60, 5000 + c)} {passage}"))]
        sets, label = brute_components(three)
        want |= {d: (len(sets[i]), 3 * c + label[i]) for i, (d, _) in enumerate(three)}
        rows += three
    assert components(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_spread_keys_lose_no_links(spark, monkeypatch):
    """Copies make keys hot; their few different sets fall into different salts."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", 2)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    rows, want = [], {}
    for c in range(12):
        base = prose(60, 7000 + c)
        texts = [base] * 8 + [f"{base} tail", f"new {base}"][:1 + c % 2] + [prose(60, 8000 + c)]
        sets, label = brute_components([(0, t) for t in texts])
        n = len(rows)
        want |= {n + i: (len(sets[i]), n + label[i]) for i in range(len(texts))}
        rows += [(n + i, t) for i, t in enumerate(texts)]
    assert components(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_pipeline_keeps_a_row_of_each_component(spark):
    """Null and repeated ids: different texts stay, copies go, equal rows become one."""
    import corpus_pipeline
    a, b = prose(60, 1), prose(60, 2)
    null = [prose(60, 20 + i) for i in range(5)]
    same = [prose(60, 40 + i) for i in range(3)]
    rows = ([(None, t, 1) for t in null] + [(None, null[0], 1)] * 3 + [(None, None, 1), (None, " ", 2), (None, " ", 2)]
            + [(7, t, 1) for t in same] + [(1, a, 1), (5, f"{a} tail", 1), (5, b, 1), (6, f"{b} tail", 1), (9, f"{null[1]} tail", 1), (9, f"{null[1]} tail", 1)])
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    want = [(None, t, 1) for t in null] + [(None, None, 1), (None, " ", 2), (None, " ", 2)] + [(7, t, 1) for t in same] + [(1, a, 1), (5, b, 1)]
    assert got.columns == ["doc_id", "text", "n_chars"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_training_sample_bounds_rows(spark):
    """An id that repeats brings one of its rows."""
    rows = [(i % 10, prose(8, i)) for i in range(200)] + [(50 + i, prose(8, 900 + i)) for i in range(5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = common.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 4000).collect()
    assert sorted(r["id"] for r in got) == sorted({i for i, _ in rows})
    assert all((r["id"], r["text"]) in rows and r["label"] == r["id"] % 2 for r in got)


def _sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _classes(rows):
    """Component of each row, by all pairs."""
    sets, label = _sets(rows), list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(rows))]


def _chained(rnd, n):
    """Texts that are similar along chains, two shared passages, and copies."""
    rows, base = [], [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(40)]
    for i in range(n):
        words = list(base)
        for at in rnd.sample(range(120), rnd.choice([1, 2, 3, 4])):
            words[at] = f"x{rnd.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(passage + [f"y{rnd.randint(0, 10**9)}" for _ in range(rnd.choice([6, 10, 60]))])))
        if i % 5 == 0:
            rows.append((2000 + i, rows[-1][1]))
    return rows + [(None, "two words"), (None, None), (5000, ""), (5001, "one two three four five six"), (5001, "One two three four five six")]


def test_chained_groups_equal_brute_force(spark, monkeypatch):
    rows = _chained(random.Random(7), 120)
    expected = _classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)

    def check():
        got, links = jaccard.jaccard_join(df)
        named = {}
        for r in got.collect():
            named.setdefault((r["doc_id"], r["text_hash"]), r["label"])
        hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.withColumn("h", jaccard.text_hash("text")).collect()}
        label = [named[i, hashes[i, t]] if _sets([(i, t)])[0] else f"none{n}" for n, (i, t) in enumerate(rows)]
        by = lambda names: sorted(sorted(i for i, x in enumerate(names) if x == y) for y in set(names))
        # equal texts are one node, also where ids are null or repeat
        assert by(label) == by([e if s else f"none{n}" for n, (e, s) in enumerate(zip(expected, _sets(rows)))])
        return links.count()
    n_nodes = len({t for _, t in rows})
    assert check() <= 4 * n_nodes  # links grow with the nodes
    for settings in ({"ROUNDS": 0}, {"ROUNDS": 0, "TILE": 8}, {"ROUNDS": 1, "CLUSTER": 0, "TILE": 8}, {"ROUNDS": 0, "CLUSTER": 0, "SALT_ROWS": 2, "HOT_LEAST": 2}):
        with monkeypatch.context() as m:
            for name, value in settings.items():
                m.setattr(jaccard, name, value)
            check()


def test_components_meet_shrinking_edges(spark, monkeypatch):
    """Edges are stored once, not in both directions, and those inside a component are not met again."""
    met, kept = [], links.materialize

    def counted(df, name):
        out = kept(df, name)
        met.extend([out.count()] if name == "edges" else [])
        return out
    monkeypatch.setattr(links, "materialize", counted)
    monkeypatch.setattr(jaccard, "materialize", counted)
    rows = [(g * 100 + i, g * 100 + j) for g in range(5) for i in range(12) for j in range(i)]
    frame = spark.createDataFrame(rows, "a long, b long")
    got = {r["node"]: r["label"] for r in jaccard._Join.labels(None, frame).collect()}
    assert got == {g * 100 + i: g * 100 for g in range(5) for i in range(12)}
    assert met[0] == len(rows) and sum(met[1:]) <= len(rows) // 2


def test_join_hands_workers_few_rows_at_once(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, run = spark.conf.get(name), jaccard._Join.run

    def noted(self):
        seen.append(int(spark.conf.get(name)))
        return run(self)
    monkeypatch.setattr(jaccard._Join, "run", noted)
    a = prose(30, 1)
    assert components(spark.createDataFrame([(1, a), (2, f"{a} tail"), (3, "")], "doc_id long, text string"))[2][1] == 1
    assert seen == [common.BATCH_ROWS] and spark.conf.get(name) == before


def test_tiles_find_what_bitmaps_allow():
    """Both kinds of tile pairs, with bitmaps of several widths, against every pair."""
    rnd, rows = random.Random(5), []
    pool = [rnd.getrandbits(64) for _ in range(400)]
    for i in range(60):
        s = np.array(sorted(set(pool[:rnd.choice((20, 60, 90, 130))]) | {rnd.getrandbits(64) for _ in range(rnd.randrange(25))}), np.uint64)
        rows.append((i, len(s), i % 7, jaccard.bitmap(s)))
    grid = lambda b: np.frombuffer(b, np.uint64)
    for lo, hi in ((0, 0), (0, 1)):
        side = [0 if lo == hi else i % 2 for i in range(60)]
        given = [(9, lo, hi, side[i], *rows[i]) for i in sorted(range(60), key=lambda i: side[i])]
        names = ["key", "lo", "hi", "side", "node", "size", "label", "bits"]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*given)], names)
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if rows[i][2] != rows[j][2] and (lo == hi or side[i] != side[j])
                and 4 * min(rows[i][1], rows[j][1]) >= 3 * max(rows[i][1], rows[j][1])
                and jaccard.may_match(grid(rows[i][3]), rows[i][1], grid(rows[j][3]), rows[j][1])}
        got = [tuple(r.values()) for b in jaccard._tiles(True)(iter([batch])) for r in b.to_pylist()]
        assert want and sorted(got) == sorted(want)
        nodes = [r["node"] for b in jaccard._tiles(False)(iter([batch])) for r in b.to_pylist()]
        assert nodes == sorted({x for p in want for x in p})
