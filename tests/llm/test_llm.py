"""Small cases of each operator: brute force, round trips and edge rows."""

import hashlib
import io
import random
import re
import zlib

import numpy as np

import pytest
from pyspark.sql import functions as F

from sift.llm import bpe, common, imatch, jaccard, mixing, quality, secrets, sharding, topk, toxicity, warc

R = random.Random(3)
VOCAB = ["".join(R.choice("aeioulnrst") for _ in range(R.randint(2, 8))) for _ in range(400)]
LONG = " ".join(R.choice(VOCAB) for _ in range(3000))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


BASE = prose(60, 1)
TEXTS = [None, "", "  \n ", "one two", BASE, BASE, BASE + " tail", prose(80, 2), LONG, "É" * 50 + " ß 漢字 \U0001F600", "a<|endoftext|>b it's"]
ROWS = [(i, t, "en", None if i == 3 else f"s{i % 3}", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (4, BASE, "en", "s1", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(spark, docs, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.default_path())
    clash = docs.withColumn("token_ids", F.lit("x")).withColumn("decoded", F.lit(1))
    got = bpe.decode(bpe.encode(clash)).select("text", "n_tokens", "token_ids", "decoded").collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["token_ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["n_tokens"] == len(ids)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty).count() == 0


def test_shards_are_contiguous_and_even(docs, empty):
    got = sharding.byte_shards(docs, 3).collect()
    sizes = sorted(((r[0] if r[0] is not None else -1), len((r[1] or "").encode()) + 1) for r in ROWS)
    total, start, slots = sum(s for _, s in sizes), 0, {}
    want = []
    for d, s in sizes:
        shard = min(2, start * 3 // total)
        want.append((d, s, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        start += s
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in got) == want
    assert {r["doc_id"]: r["text_crc32"] for r in got}[7] == zlib.crc32(TEXTS[7].encode())
    assert sharding.byte_shards(empty, 3).count() == 0


def test_warc_round_trip(spark):
    html = "x" * 1500
    rows = [(1, "http://a/ä b%20", html), (5, None, html), (3, "u", html), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    assert len(got) == len(rows)
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 3, 5)] == [("revisit", 5), ("revisit", 5), ("response", None)]
    assert got[1]["url"] == rows[0][1] and got[5]["url"] is None and got[1]["payload_bytes"] == 1500
    assert bytes(got[4]["payload"]) == b"short" and got[6]["payload_bytes"] == 0
    assert got[3]["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_warc_reader_refuses_damage():
    member = warc.encode_record(1, "u", b"payload")
    assert len(list(warc.read_records(io.BytesIO(member * 3)))) == 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(member[:-9])))
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = zlib.decompress(member, 31).replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bad.compress(data) + bad.flush())))


def test_top_k_equals_brute_force(spark):
    r = random.Random(1)
    vecs = {i: [r.choice([-2, -1, 0, 1, 2]) for _ in range(4)] for i in range(60)}
    rows = list(vecs.items()) + [(100, None), (101, [1.0, None]), (102, [float("nan")]), (None, [1.0])]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows],
                               "vec_id long, e array<float>")
    got = topk.top_k(df.select("vec_id", topk.quantised("e").alias("v")), F.col("vec_id") % 20 == 0, 5).collect()
    want = []
    for q in (0, 20, 40):
        s = sorted((-65536 * sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q)
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s[:5])]
    assert sorted(tuple(r) for r in got) == want


def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return sets, label


def test_jaccard_equals_brute_force(spark, empty):
    r = random.Random(9)
    rows = []
    for c in range(6):
        words = prose(80, 50 + c).split()
        for k in range(12):
            own = list(words)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = r.choice(VOCAB)
            rows.append((len(rows), " ".join(own)))
    shared = prose(70, 99)
    rows += [(len(rows) + i, shared + " " + prose(60, 200 + i)) for i in range(8)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "Two Words"), (n + 3, "two words"), (n + 4, "two")]
    sets, label = brute_components(rows)
    got, _ = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == {
        i: (len(sets[i]), label[i]) for i in range(len(rows))}
    assert jaccard.jaccard_join(empty)[0].count() == 0


def test_fingerprints(docs, empty):
    got = imatch.edited_likeness(docs.filter("doc_id <> 4 OR source = 's1'")).collect()
    assert len(got) == len([r for r in ROWS if r[0] is not None])
    by_text = {}
    order = sorted([(r[0], r[1] or "") for r in ROWS if r[0] is not None])
    want = []
    for i, (d, t) in enumerate(order):
        h = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[:len(t) - h] + order[(i + 1) % len(order)][1][:h]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    for r in got:
        by_text.setdefault(TEXTS[r["doc_id"]] or "", set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.edited_likeness(empty).count() == 0


def test_secrets(spark, docs):
    text = 'x Api_Key: "abcd1234EF" AKIAABCDEFGHIJKL token=short ' + "0f" * 20 + " Zq8xT3vLk29QwRt7YbN4pDs6 password: token: abcdefghij"
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(77, text)], "doc_id long, text string"))
    model = secrets.train(spark.createDataFrame([(i, prose(60, i)) for i in range(200)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secrets.scan(df, model).select("doc_id", "text", secrets.joined("spans").alias("s")).collect()}
    spans = [(x.split(":")[0], text[int(x.split(":")[1]):int(x.split(":")[2])]) for x in got[77]["s"].split(",")]
    assert spans == [("assign", 'Api_Key: "abcd1234EF'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0f" * 20), ("markov", "Zq8xT3vLk29QwRt7YbN4pDs6")]
    assert got[0]["s"] == "" and got[8]["s"] == ""
    red = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(df, model)).collect()}
    assert red[77].count("[SECRET]") == 4 and "abcd1234EF" not in red[77] and red[0] is None and red[8] == LONG


def test_bpe_equals_the_library_on_every_code_point():
    """In three surroundings, and ids outside the vocabulary."""
    from tokenizers import Tokenizer
    path = bpe.default_path()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    ours, names = bpe.Vocabulary(text), bpe.Names(text)
    points = [chr(i) for i in range(0x30000) if not 0xD800 <= i <= 0xDFFF]
    for lo in range(0, len(points), 10_000):
        texts = [t for c in points[lo:lo + 10_000] for t in (c, f"ab{c}e\u0301c", f"x {c}1 Y")]
        got = ours.encode_batch(texts)
        want = library.encode_batch(texts, add_special_tokens=False)
        bad = [t for t, g, w in zip(texts, got, want) if np.frombuffer(g, "<u4").tolist() != w.ids]
        assert not bad, (len(bad), bad[:5])
    some = [0, 5, 2**32 - 1, 70_000, 100]
    assert names.decode(np.array(some, "<u4").tobytes()) == library.decode([0, 5, 100], skip_special_tokens=False)
    assert names.decode(b"") == ""


def test_mixing(spark, docs, empty):
    rows = [(i, prose(5 + i % 40, i), f"s{i % 4}" if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (r["id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 400
    by = {}
    for r in got:
        assert r["size"] == len(rows[r["id"]][1].split()) and 0 <= r["copies"] <= 3
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["copies"] * r["size"]
    assert abs(sum(x[1] for x in by.values()) - sum(x["size"] for x in got)) < 1e-6
    for taken, target, size in by.values():
        assert abs(taken - target) <= 45 and target <= 3 * size + 1e-9
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0
    m = mixing.mix(docs)
    assert mixing.apply_mix(docs, mixing.mix_groups(docs)).count() == sum(r["copies"] for r in m.collect())


def test_mixing_targets_of_capped_sources(spark):
    """Targets against a plain computation: weights 5, 2, 1 by code point, capped sources, null last."""
    sizes = {"a": 10, "B": 400, "é": 3, "c": 50, "d": 900, None: 7, "zz": 2000}
    rows = [(i, "w " * n, src) for i, (src, total) in enumerate(sizes.items()) for n in [total // 5] * 5 + [total % 5]]
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        free = total - sum(3 * sizes[s] for s in full)
        level = free / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    want = {s: 3 * sizes[s] if s in full else weight[s] * level for s in order}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(full) > 1
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["copies"] <= 3


def test_mixing_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    same = [(None, None, "s")] * 700 + [(5, "many words in this one", "s")] * 900
    rows = same + [(100 + i, prose(5, i), f"t{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    groups = mixing.mix_groups(df)
    assert groups.count() == 302 and groups.agg(F.sum("m")).first()[0] == len(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for src in {r["source"] for r in got}:
        some = [r for r in got if r["source"] == src]
        assert abs(sum(r["copies"] * r["size"] for r in some) - some[0]["target"]) <= 5
    stored = common.materialize(df, "test-mix")
    taken = mixing.apply_mix(stored, mixing.mix_groups(stored)).groupBy("doc_id").count().collect()
    want: dict = {}
    for r in got:
        want[r["id"]] = want.get(r["id"], 0) + r["copies"]
    assert {r["doc_id"]: r["count"] for r in taken} == {k: v for k, v in want.items() if v}


EXTRA = ("copies", "grade", "base", "spans", "__n", "label", "k", "tag", "row", "part", "severity")


def test_stages_leave_further_columns_as_they_are(spark, docs, tmpdir_path):
    import corpus_pipeline
    spark.createDataFrame([(4, 0)], "doc_id long, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    plain = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source", "n_chars")]
    df = docs.select(*plain, *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in EXTRA],
                     F.create_map(F.lit("key"), F.col("doc_id")).alias("m"))
    df = common.materialize(df.union(df.filter("doc_id = 4")), "test-extra")  # a repeated row
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, tmpdir_path)
        assert out.columns == df.columns and out.dtypes == df.dtypes, name
        got = out.collect()
        assert got, name
        for r in got:
            at = "-" if r["doc_id"] is None else r["doc_id"]
            assert all(r[c] == f"{c}:{at}" for c in EXTRA) and r["m"] == {"key": r["doc_id"]}, name
        df = common.materialize(out, f"test-{name}")


def test_pipeline_of_an_empty_table(spark, docs, tmpdir_path):
    import corpus_pipeline
    docs.limit(0).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    assert corpus_pipeline.run(spark, tmpdir_path).count() == 0


def test_pipeline_drops_what_it_should(spark, tmpdir_path):
    """End to end: a toxic text goes, one of three copies stays, a secret is masked, clean texts stay."""
    import corpus_pipeline
    rows = [(i, prose(60, i) + (" vile rotten vile" if i % 5 == 0 else ""), "en", "s") for i in range(200)]
    copy = prose(80, 999)
    rows += [(1000, copy, "en", "s"), (1001, copy, "en", "s"), (1002, copy + " tail", "en", "s"), (1003, prose(60, 5000) + " password = hunter2hunter2", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    docs = common.read(spark, tmpdir_path, "documents")
    clean = corpus_pipeline.drop_toxic(spark, docs, tmpdir_path)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows if r[0] >= 200 or r[0] % 5}
    near = corpus_pipeline.drop_near_copies(spark, clean, tmpdir_path)
    assert {r["doc_id"] for r in near.collect()} == {r[0] for r in rows if (r[0] < 200 and r[0] % 5) or r[0] in (1000, 1003)}
    masked = corpus_pipeline.redact_secrets(spark, near, tmpdir_path)
    assert "hunter2hunter2" not in masked.filter("doc_id = 1003").first()["text"]
    out = corpus_pipeline.run(spark, tmpdir_path)
    assert out.select("doc_id").distinct().count() > 100 and out.filter("doc_id IN (1001, 1002)").count() == 0


def test_pivot_keeps_words():
    a, b = mixing.pivot((10, 0.4), (4, 0.5), 0.3)
    assert abs(10 * a + 4 * b - 6) < 1e-9 and (a in (0, 1) or b in (0, 1))


def test_toxicity(spark, empty):
    rows = [(i, prose(30, i) + (" vile rotten vile" if i % 5 == 0 else "")) for i in range(300)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    for r in got:
        assert (r["p_toxic"] >= toxicity.REJECT) == (r["doc_id"] < 1000 and r["doc_id"] % 5 == 0)
        assert abs(r["severity"] - r["p_toxic"] - r["p_severe"]) < 1e-9
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_quality(spark, empty):
    rows = [(i, prose(40, i) if i % 3 else prose(40, i).upper().replace(" ", "!! ")) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(df, quality.train(df, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(400) if got[i]["held_out"]] == held
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert 0 <= got[1000]["score"] <= 1 and quality.score(empty, quality.train(empty, labels)).count() == 0


def test_machine_pairs_in_linear_time():
    import numpy as np
    r = np.random.default_rng(1)
    m = quality.Machine(np.zeros((1, 1)), 0.3, r.normal(size=6), r.normal(size=(6, 3)))
    x = r.normal(size=(2, 6))
    want = [0.3 + v @ m.w + sum(m.v[i] @ m.v[j] * v[i] * v[j] for i in range(6) for j in range(i)) for v in x]
    assert np.allclose(m.logits(x), want)


def test_pipeline_runs_every_stage(spark, docs, tmpdir_path):
    import corpus_pipeline
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(4, 0)], "doc_id long, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "secrets", "mixing", "bpe"]
    near = corpus_pipeline.drop_near_copies(spark, docs, tmpdir_path)
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 7, 8, 9, 10]
    out = corpus_pipeline.run(spark, tmpdir_path)
    assert "n_tokens" in out.columns and out.count() > 0
