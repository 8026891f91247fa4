"""Phrases, SimHash components and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import groupby

import numpy as np
import xxhash

from sift.llm import covering, links, phrases, repair


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- phrases -------------------------------------------------------------------

def test_packed_grams_and_filters_are_lossless():
    rnd = np.random.default_rng(3)
    for n, width in [(2, 40), (3, 40), (5, 40), (2, 64), (5, 64), (4, 56)]:
        bits = n * width
        ids = [rnd.integers(0, 1 << width, 5000, dtype=np.uint64, endpoint=False) if width < 64 else rnd.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(n)]
        for x in ids:
            x[:400] = x[0]  # one gram many times
        lanes = phrases.permute(phrases.pack(ids, width), bits)
        back = phrases.unpack(phrases.permute(lanes, bits, undo=True), n, width)
        assert all((a == b).all() for a, b in zip(ids, back))
        keys, counts = phrases.merged(lanes, np.ones(5000, np.int64))
        assert counts.max() == 400 and counts.sum() == 5000
        at = keys[0] >> np.uint64(61)
        for r in range(8):
            some, c = [x[at == r] for x in keys], counts[at == r]
            got, again = phrases.decode(phrases.encode(some, c, bits, 3), bits, 3, r)
            assert (again == c).all() and all((a == b).all() for a, b in zip(some, got))
        assert len(phrases.decode(phrases.encode([x[:0] for x in keys], counts[:0], bits, 3), bits, 3, 0)[1]) == 0


def test_merged_tells_keys_that_share_their_first_lane_apart():
    a = [np.array([5, 5, 5, 1], np.uint64), np.array([2, 1, 2, 0], np.uint64)]
    keys, counts = phrases.merged(a, np.array([1, 2, 3, 4]))
    assert [x.tolist() for x in keys] == [[1, 5, 5], [0, 1, 2]] and counts.tolist() == [4, 2, 4]


def phrases_by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, 6):
                for i in range(len(w) - s + 1):
                    f[lang, tuple(w[i:i + s])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for lang in n:
        kept = []
        for (at, p), a in cand.items():
            if at != lang:
                continue
            if any(len(q) > len(p) and la == lang and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (la, q), b in cand.items()):
                continue
            score, _, left, right = min(((1000 * a * n[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def text_rows(rnd, n):
    vocabulary = ["the", "The", "of", "x", "é", "new", "york", "\x85", "a\x1cb", "日本"] + [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        some = rnd.choices(vocabulary, [9, 3, 9, 4, 4, 6, 6, 2, 2, 2] + [0.1] * 300, k=rnd.randint(0, 60))
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]) for w in some)
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), text + rnd.choice(["", "new york city hall is here"])))
    return rows + [("en", None), (None, ""), ("fr", "  \t. "), ("de", "b " * 3000)]


def test_phrases_equal_brute_force(spark, monkeypatch):
    rows = text_rows(random.Random(11), 300)
    expected = phrases_by_hand(rows, 4, 60)
    assert len(expected) > 100
    df = frame(spark, [(lang, t, 1, "z") for lang, t in rows], "lang string, text string, rank int, a string").repartition(5)

    def got():
        return sorted(tuple(r) for r in phrases.collocations(df, min_count=4, top=60).collect())
    assert got() == expected
    for name, value in [("TASK_ROWS", 700), ("RANGE_ROWS", 50), ("FILTER_BITS", 1 << 8), ("WIDTHS", (13, 40))]:
        monkeypatch.setattr(phrases, name, value)  # many filters, useless bit tables, ids that clash
    assert got() == expected


def test_rare_words_with_the_id_of_a_frequent_one_are_gaps(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WIDTHS", (12,))
    words = [("en", f"w{i}", 200 if i < 5 else 1) for i in range(3000)]
    found = frame(spark, words, "lang string, word string, f long")
    often, width, seed, impostors = phrases._word_ids(found, 100)
    ids = {(r["lang"].encode(), r["word"].encode()): r["id"] for r in often.collect()}
    assert width == 12 and len(set(ids.values())) == 5 and impostors
    known = phrases._Ids(b"en", width, seed, impostors)
    for _, w, f in words:
        assert known[w.encode()] == ids[b"en", w.encode()] if f > 1 else known[w.encode()] not in ids.values()


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(frame(spark, [], "lang string, text string")).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("en", "one two")], "lang string, text string")).count() == 0


# --- SimHash -------------------------------------------------------------------

def simhash_by_hand(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(values):
    """Index of the component of each distinct value, by all pairs."""
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v
    some = sorted(label)
    for i, a in enumerate(some):
        for b in some[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def test_fingerprints_equal_brute_force(monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(covering, "STEP_WORDS", 7)
    for n in [0, 1, 2, 3, 4, 9, 40, 200]:
        t = rnd.choice(["", " \t"]) + " ".join(rnd.choice(["The", "É", "b", "\x85", "x\x1cy"]) for _ in range(n))
        assert covering.simhash(t) == simhash_by_hand(t)


def test_every_three_bits_are_free_in_some_table():
    for kept in (0, covering.split(0)[5], covering.split(covering.split(0)[2])[9]):
        free = [b for b in range(64) if not kept >> b & 1]
        masks = covering.split(kept)
        assert all(any(not (1 << a | 1 << b | 1 << c) & m & ~kept for m in masks) for a in free for b in free for c in free)


def test_simhash_components_equal_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = [(None, None), (7, ""), (5, " \n"), (None, "alone with no id"), (9000, "two words"), (9001, "Two  Words")]
    for i in range(40):
        base = rnd.choices(vocabulary, k=rnd.randint(30, 300))
        for j in range(rnd.randint(1, 8)):
            some = list(base)
            for _ in range(rnd.randint(0, 3)):
                some[rnd.randrange(len(some))] = rnd.choice(vocabulary)
            rows.append((1000 - 10 * i - j, " ".join(some)))
    rows += rows[10:14] + [(3, "long " * 30_000)]
    df = frame(spark, [(i, t, "x", 5) for i, t in rows], "doc_id int, text string, node string, component_id int").repartition(4)
    got, _ = covering.near_duplicates(df)
    prints = [simhash_by_hand(t) for _, t in rows]
    of = components_by_hand(prints)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    expected = [(i, f"{f:016x}", least.get(of[f])) for (i, _), f in zip(rows, prints)]
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=order) == sorted(expected, key=order)
    assert len(set(of.values())) < len(set(prints)) < len(rows)
    empty, found = covering.near_duplicates(frame(spark, [], "doc_id long, text string"))
    assert empty.count() == 0 and found.count() == 0


def test_full_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(covering, "BUCKET", 256)
    rnd = random.Random(2)
    center = rnd.getrandbits(64)
    close = {center}
    while len(close) < 1500:  # a dense group
        close.add(rnd.choice(sorted(close)[:50] + [center]) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(2, 6))))
    far = {center & ~0xFFFF | rnd.getrandbits(16) for _ in range(600)} | {rnd.getrandbits(64) for _ in range(400)}
    values = sorted(close | far)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = covering.links(frame(spark, [(v,) for v in signed], "node long"))
    pairs = found.collect()
    assert all(((a ^ b) & 2**64 - 1).bit_count() <= 3 for a, b in pairs)
    label = {r["node"]: r["label"] for r in links.components(found).collect()}
    of = components_by_hand(values)
    groups = lambda named: sorted(sorted(x[1] for x in g) for _, g in groupby(sorted(named), lambda x: x[0]))
    assert groups((label.get(s, s), v) for s, v in zip(signed, values)) == groups((of[v], v) for v in values)


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1001), (-5, 1000)]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["label"] for r in links.components(frame(spark, pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(401)} | {1000: -5, 1001: -5, -5: -5}
    assert links.components(frame(spark, [], "a long, b long")).count() == 0


def test_attach_with_hot_and_cold_keys(spark, monkeypatch):
    monkeypatch.setattr(links, "HOT_KEYS", 3)
    rows = [(1, i) for i in range(50)] + [(k, 0) for k in range(2, 30)]
    table = [(1, 50, "a")] + [(k, 1, f"b{k}") for k in range(2, 30)]
    got = links.attach(frame(spark, rows, "k int, x int"), frame(spark, table, "k int, rows long, v string"), "k", ["v"])
    assert sorted(map(tuple, got.collect())) == sorted((k, x, "a" if k == 1 else f"b{k}") for k, x in rows)


# --- conversations --------------------------------------------------------------

def cheapest(symbols):
    """(cost, audit): least cost, then ASCII-least, by trying every edit."""
    n = len(symbols)

    @lru_cache(None)
    def go(i, state, inserted):
        # states: 0 nothing, 1 after s, 2 after u, 3 after a
        found = [(0, "")] if i == n and state in (0, 3) else []
        to = lambda c: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, c))
        add = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1]))
        if inserted < 4:
            for c in "ua":
                if to(c):
                    add(2, "I", go(i, to(c), inserted + 1))
        if i < n:
            fault, c = symbols[i]
            add(3, "D", go(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if to(c):
                    add(extra, "K", go(i + 1, to(c), 0))
                for new in "ua":
                    if to(new):
                        add(2 + extra, "R", go(i + 1, to(new), 0))
        return min(found) if found else (10**9, "")
    return go(0, 0, 0)


def repair_by_hand(rows):
    shown = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        at = (turn is not None, turn or 0, hashlib.sha256(f"{role}\0{text}".encode()).digest())
        kept += [(at, turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, some in convs.items():
        some.sort(key=lambda r: r[0])
        seen, faults = set(), []
        for _, _, role, text in some:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        c = [r[2][:1] or "-" for r in some]
        turns = [r[1] for r in some if r[1] is not None]
        cost, audit = cheapest(tuple(zip(faults, c)))
        state, fixed, left = "", [], list(some)
        for letter in audit:
            _, _, role, text = left.pop(0) if letter != "I" else (0, 0, "", "")
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if state == "u" else "user"
            fixed.append(f"{role}:{text}")
            state = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in fixed))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(c, c[1:])), cost, audit,
                    hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return out


def conversation_rows(rnd, convs):
    rows = []
    for conv in [None, *range(convs)]:
        style = rnd.random()
        for turn in range(rnd.randint(0, 12) if conv else 40):
            role = rnd.choice(["user", "assistant"]) if style < 0.3 else ["user", "assistant"][turn % 2] if turn or style < 0.7 else "system"
            text = rnd.choice(["Yes.", "No!", "", " \n", None, "cut off", "Done. \t", "é?", "Yes.", "dot.\x85", "long " * 2000 + "."])
            rows.append((conv, turn + (turn > 6), role, text))
            if rnd.random() < 0.1:
                rows.append((conv, rnd.choice([turn, None, None]), rnd.choice(["tool", None, "user", "assistant", "sys"]), rnd.choice(["Hm.", None])))
    return rows + rows[20:30] + rows[20:30]


def test_repairs_equal_brute_force(spark, monkeypatch):
    rows = conversation_rows(random.Random(6), 120)
    expected = repair_by_hand(rows)
    df = frame(spark, [(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, audit string").repartition(5)

    def got():
        damaged = repair.damage(df)
        return [tuple(r) for r in repair.digests(damaged, repair.plans(damaged)).collect()]
    order = lambda r: str(r[0])
    assert sorted(got(), key=order) == sorted(expected, key=order)
    monkeypatch.setattr(repair, "SEGMENT", 3)  # conversations of many segments
    assert sorted(got(), key=order) == sorted(expected, key=order)


def test_one_conversation_of_one_repeated_row(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 500)
    rows = [(1, t, "user", "same.") for t in range(2000)] + [(1, 5, "user", "same.")] * 1000 + [(2, None, "", "No role.")] * 2
    plain = repair.undamaged(frame(spark, rows, "conv_id int, turn int, role string, text string"))
    plan = repair.plans(plain)
    got = {r["conv"]: r for r in plan.collect()}
    # one row is kept, a row inserted, 2,999 go
    assert (got[1]["duplicate"], got[1]["cost"], got[1]["gaps"], got[1]["illegal"]) == (2999, 3 * 2999 + 2, 0, 2999)
    assert sorted(got[1]["audit"]) == sorted("K" + "I" + "D" * 2999) or got[1]["audit"] == "D" * 3000
    assert got[2]["cost"] == 6 and got[2]["audit"] == "DD" and got[2]["gaps"] == 0
    fixed = repair.repair_conversations(plain, plan).collect()
    assert sorted((r["conv_id"], r["position"], r["role"], r["text"]) for r in fixed) == [(1, 0, "user", "same."), (1, 1, "assistant", "")]


def test_runs_by_binary_powers_equal_single_steps():
    rnd = random.Random(3)
    fault = lambda c: ("blank", "u") if c == "x" else ("truncated" if c.isupper() else None, c.lower())
    for _ in range(400):
        s = "".join(rnd.choice("xsuaoSUAO") * rnd.randint(1, 5) for _ in range(rnd.randint(0, 6)))
        assert repair.repair([(c, len(list(g))) for c, g in groupby(s)]) == cheapest(tuple(map(fault, s)))


def test_repair_of_an_empty_table(spark):
    rows = repair.damage(frame(spark, [], "conv_id long, turn long, role string, text string"))
    assert repair.digests(rows, repair.plans(rows)).count() == 0
