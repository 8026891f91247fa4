"""Phrase collocation mining with counting quotient filters.

1. Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
   these into words ``[^\\x20\\x09]+``. One pass counts the words of each language.
2. A word's id is a hash of language and word, cut to 40 to 64 bits: wide
   enough that no two words of ``min_count`` occurrences share one. A rarer
   word with the id of such a word is listed and read as a gap, so ids are exact.
3. For n = 2, 3, ... every task packs its n-grams of word ids into n * width bits,
   permutes these bits invertibly (Feistel rounds over 64-bit lanes) and keeps
   them in a counting quotient filter: the top bits are the quotient, whose
   run lengths are written in unary, all the other bits the remainder, so
   nothing is lost; a count byte follows. Filters are cut by the quotient's
   first bits and merged, sorted, across tasks; the permutation is undone for
   phrases that reach ``min_count``. Permuted keys spread evenly and a frequent
   phrase is one entry a task, so there are no hot ranges.
4. A phrase can be frequent only if both its parts of n - 1 words are: a bit
   table of these, of at most ``FILTER_BITS`` bits, keeps most others out of the
   filters. It may let rare ones through, which only costs room.
5. Scores come from joins of the frequent phrases, in decimals of 38 digits.

Defined results: null and empty texts have no words; null languages are
``und``; repeated rows count as often as they occur; ties of score and count
are ordered by the phrase's bytes; an empty table gives no rows. Texts are used whole,
extra columns are ignored. Texts are taken to be valid UTF-8.
"""

from __future__ import annotations

import struct
from collections import Counter
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import materialize, partitions

WIDTHS = (40, 48, 56, 64)
FILTER_BITS = 1 << 27  # 16 MB
RANGE_ROWS = 1 << 20  # n-grams of the corpus a range of quotients
TASK_ROWS = 1_500_000  # n-grams that a task holds before it writes its filter
STEP_BYTES = 4_000_000
IMPOSTORS = 1000
SALTS = 16
BREAKS = b".,;:!?\n\x0b\x0c\r"
END = b"\xff"  # no byte of UTF-8
_TABLE = bytes(END[0] if c in BREAKS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


def words(text: bytes) -> list[bytes]:
    """Words of a text, with ``END`` between pieces."""
    return text.translate(_TABLE).replace(END, b" " + END + b" ").split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# --- packed, permuted n-grams ------------------------------------------------

def lane_widths(bits: int) -> list[int]:
    return [64] * ((bits - 1) // 64) + [(bits - 1) % 64 + 1]


def _mask(width: int):
    return U((1 << width) - 1)


def pack(ids: list[np.ndarray], width: int) -> list[np.ndarray]:
    """n ids of ``width`` bits, end to end in 64-bit lanes."""
    lanes = [np.zeros(len(ids[0]), U) for _ in lane_widths(len(ids) * width)]
    for j, x in enumerate(ids):
        lane, inside = divmod(j * width, 64)
        lanes[lane] |= x << U(inside)
        if inside + width > 64:
            lanes[lane + 1] |= x >> U(64 - inside)
    return lanes


def unpack(lanes: list[np.ndarray], n: int, width: int) -> list[np.ndarray]:
    out = []
    for j in range(n):
        lane, inside = divmod(j * width, 64)
        x = lanes[lane] >> U(inside)
        if inside + width > 64:
            x = x | (lanes[lane + 1] << U(64 - inside))
        out.append(x & _mask(width))
    return out


def _steps(lanes: int):
    return [(r, i) for r in range(3) for i in reversed(range(lanes))]


def _feistel(lanes, r, i, width):
    y = np.full(len(lanes[0]), r * 16 + i + 1, U)
    for j in range(1, len(lanes)):
        y = mixed(y * U(0x9E3779B97F4A7C15) + lanes[(i + j) % len(lanes)])
    return lanes[i] ^ (y & _mask(width))


def permute(lanes: list[np.ndarray], bits: int, undo: bool = False) -> list[np.ndarray]:
    """A permutation of all numbers of ``bits`` (over 64) bits, and its inverse."""
    lanes, widths = list(lanes), lane_widths(bits)
    for r, i in (reversed(_steps(len(lanes))) if undo else _steps(len(lanes))):
        lanes[i] = _feistel(lanes, r, i, widths[i])
    return lanes


# --- counting quotient filter ------------------------------------------------

def merged(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(counts):
        return lanes, counts
    order = np.argsort(lanes[0])
    got = [x[order] for x in lanes]
    same = got[0][1:] == got[0][:-1]
    if any((same & (x[1:] != x[:-1])).any() for x in got[1:]):  # keys that differ in later lanes only
        order = np.lexsort(lanes[::-1])
        got = [x[order] for x in lanes]
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in got:
        new[1:] |= x[1:] != x[:-1]
    at = np.nonzero(new)[0]
    return [x[at] for x in got], np.add.reduceat(counts[order], at)


def encode(lanes: list[np.ndarray], counts: np.ndarray, bits: int, range_bits: int) -> bytes:
    """The filter of sorted distinct keys that agree in the first ``range_bits`` bits."""
    m = len(counts)
    q = min((b for b in (8, 16, 24, 32) if b >= range_bits), key=lambda b: (1 << (b - range_bits)) + m * (65 - b))
    slots = 1 << (q - range_bits)
    quotient = (lanes[0] >> U(64 - q)) & U(slots - 1)
    runs = np.zeros(slots + m, np.uint8)
    runs[quotient.astype(np.int64) + np.arange(m)] = 1
    parts = [np.ascontiguousarray(lanes[0].view(np.uint8).reshape(m, 8)[:, :(64 - q) // 8]).tobytes()]
    for x, w in zip(lanes[1:], lane_widths(bits)[1:]):
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(m, 8)[:, :(w + 7) // 8]).tobytes())
    large = counts[counts >= 255]
    return b"".join([struct.pack("<IBI", m, q, len(large)), np.packbits(runs).tobytes(), *parts,
                     np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype(np.int64).tobytes()])


def decode(blob: bytes, bits: int, range_bits: int, at_range: int) -> tuple[list[np.ndarray], np.ndarray]:
    m, q, n_large = struct.unpack_from("<IBI", blob)
    at = struct.calcsize("<IBI")

    def take(rows, width):
        nonlocal at
        got = np.frombuffer(blob, np.uint8, rows * width, at).reshape(rows, width)
        at += rows * width
        return got

    def lane(width):
        x = np.zeros((m, 8), np.uint8)
        x[:, :width] = take(m, width)
        return x.view(U).reshape(m)

    slots = 1 << (q - range_bits)
    runs = np.unpackbits(take(1, (slots + m + 7) // 8)[0])[:slots + m]
    quotient = (np.nonzero(runs)[0] - np.arange(m)).astype(U) | U(at_range << (q - range_bits))
    lanes = [lane((64 - q) // 8) | (quotient << U(64 - q))] + [lane((w + 7) // 8) for w in lane_widths(bits)[1:]]
    counts = take(m, 1)[:, 0].astype(np.int64)
    counts[counts == 255] = take(n_large, 8).view(np.int64).reshape(n_large)
    return lanes, counts


# --- tasks -------------------------------------------------------------------

def _by_lang(batches):
    """(lang, texts) steps of (lang, text) batches, both binary."""
    for b in batches:
        held: dict[bytes, list[bytes]] = {}
        size = 0
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py()
            if t:
                held.setdefault(lang, []).append(t)
                size += len(t)
            if size > STEP_BYTES:
                yield from held.items()
                held, size = {}, 0
        yield from held.items()


def _count_words(batches):
    counts: dict[bytes, Counter] = {}

    def rows():
        for lang, c in counts.items():
            c.pop(END, None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(c), pa.binary()).cast(pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()),
                 pa.array(list(c.values()), pa.int64())], ["lang", "word", "f"])
        counts.clear()

    for lang, texts in _by_lang(batches):
        counts.setdefault(lang, Counter()).update(words(END.join(texts)))
        if sum(map(len, counts.values())) > 500_000:
            yield from rows()
    yield from rows()


class _Ids(dict):
    """Ids of a language's words; forgets all beyond a bound."""

    def __init__(self, lang: bytes, width: int, seed: int, impostors: set):
        super().__init__()
        self.start = xxhash.xxh64_intdigest(lang + b"#%d" % seed, 42)
        self.mask, self.none = (1 << width) - 1, {w for at, w in impostors if at == lang} | {END}

    def __missing__(self, w):
        if len(self) > 400_000:
            self.clear()
        x = self[w] = 0 if w in self.none else xxhash.xxh64_intdigest(w, self.start) & self.mask
        return x


def gram_hash(ids: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(ids[0]), len(ids), U)
    for x in ids:
        h = mixed(h * U(0x9E3779B97F4A7C15) + x)
    return h


def _member(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    top = U(len(table) * 64 - 1)
    hit = np.ones(len(h), bool)
    for at in (h & top, (h >> U(32)) & top):
        hit &= (table[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
    return hit


def _shard(n: int, width: int, seed: int, impostors: set, table, range_bits: int):
    """Filters of a task's n-grams whose parts may be frequent."""
    bits = n * width

    def flush(held):
        lanes = [np.concatenate(x) for x in zip(*held)]
        lanes, counts = merged(lanes, np.ones(len(lanes[0]), np.int64))
        at = lanes[0] >> U(64 - range_bits)
        cuts = np.r_[0, np.nonzero(at[1:] != at[:-1])[0] + 1, len(at)]
        for group in range(0, len(cuts) - 1, 64):
            ends = cuts[group:group + 65]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(at[i]) for i in ends[:-1]], pa.int32()),
                 pa.array([encode([x[i:j] for x in lanes], counts[i:j], bits, range_bits) for i, j in zip(ends, ends[1:])], pa.binary())],
                ["range", "filter"])

    def run(batches):
        known: dict[bytes, _Ids] = {}
        held, rows, bitmap = [], 0, table.value
        for lang, texts in _by_lang(batches):
            if lang not in known:
                if len(known) > 20:
                    known.clear()
                known[lang] = _Ids(lang, width, seed, impostors)
            got = words(END.join(texts))
            ids = np.fromiter(map(known[lang].__getitem__, got), U, len(got))
            m = len(ids) - n + 1
            if m < 1:
                continue
            part = _member(bitmap, gram_hash([ids[i:len(ids) - n + 2 + i] for i in range(n - 1)]))
            ok = part[:-1] & part[1:]
            for i in range(n):
                ok &= ids[i:i + m] != 0
            at = np.nonzero(ok)[0]
            if len(at):
                held.append(permute(pack([ids[at + i] for i in range(n)], width), bits))
                rows += len(at)
            if rows > TASK_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)
    return run


def _merge(n: int, width: int, range_bits: int, least: int):
    """Filters sorted by range -> phrases of at least ``least`` occurrences."""
    bits = n * width

    def joined(held):
        return merged([np.concatenate(x) for x in zip(*(h[0] for h in held))], np.concatenate([h[1] for h in held]))

    def frequent(held):
        lanes, counts = joined(held)
        keep = counts >= least
        ids = unpack(permute([x[keep] for x in lanes], bits, undo=True), n, width)
        m = int(keep.sum())
        flat = np.stack(ids, 1).reshape(-1).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, n), pa.int32()), pa.array(flat)),
             pa.array(counts[keep], pa.int64()), pa.array(gram_hash(ids).view(np.int64))], ["ids", "f", "h"])

    def run(batches):
        held, rows, now = [], 0, None
        for b in batches:
            for at, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if at != now:
                    if held:
                        yield frequent(held)
                    held, rows, now = [], 0, at
                held.append(decode(blob.as_py(), bits, range_bits, at))
                rows += len(held[-1][1])
                if rows > 2 * RANGE_ROWS:
                    held = [joined(held)]
                    rows = len(held[0][1]) // 2  # room for as many again
        if held:
            yield frequent(held)
    return run


# --- jobs --------------------------------------------------------------------

def _bit_table(spark, grams: DataFrame, size: int):
    """Broadcast bit table of the hashes ``h`` (two probes); at most FILTER_BITS bits."""
    n_bits = min(FILTER_BITS, max(1 << 12, 1 << ceil(log2(16 * max(size, 1)))))
    top = F.lit(n_bits - 1).cast("long")
    at = grams.select(F.explode(F.array(F.col("h").bitwiseAND(top), F.shiftrightunsigned("h", 32).bitwiseAND(top))).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("x")).toPandas()
    table = np.zeros(n_bits // 64, U)
    table[got["i"].to_numpy(np.int64)] = got["x"].to_numpy(np.int64).view(U)
    return spark.sparkContext.broadcast(table)


def _word_ids(found: DataFrame, least: int) -> tuple[DataFrame, int, int, set]:
    """Frequent words with ids, the ids' width and seed, and the rarer words
    that would pass for a frequent one."""
    total = found.count()
    first = next((i for i, w in enumerate(WIDTHS) if total < 1 << (w // 2)), len(WIDTHS) - 1)
    for attempt in range(64):
        width, seed = WIDTHS[min(first + attempt, len(WIDTHS) - 1)], attempt
        x = F.xxhash64(F.concat("lang", F.lit(f"#{seed}")), "word")
        named = found.withColumn("id", x.bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
        shared = (named.groupBy("id").agg(F.count("*").alias("n"), F.max("f").alias("most")).filter(
            (F.col("most") >= least) & ((F.col("n") > 1) | (F.col("id") == 0))).select("id"))
        clash = named.join(shared, "id").select("id", "lang", "word", "f").limit(IMPOSTORS + 1).collect()
        often = [r["id"] for r in clash if r["f"] >= least]
        if len(clash) <= IMPOSTORS and len(set(often)) == len(often) and 0 not in often:
            return named.filter(F.col("f") >= least), width, seed, {
                (r["lang"].encode(), r["word"].encode()) for r in clash if r["f"] < least}
    raise ValueError("no seed tells the frequent words apart")


def frequent_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, text_col: str = "text",
                     lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, words): ``ids, f`` of every phrase of 1 to ``max_words`` words with
    at least ``min_count`` occurrences, and ``id, lang, word, f, n`` of the
    frequent words (n: all word occurrences of the language)."""
    spark, p = docs.sparkSession, partitions(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"),
                        F.col(text_col).cast("string").cast("binary").alias("text"))
    found = materialize(texts.mapInArrow(_count_words, "lang string, word string, f long")
                        .groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = found.groupBy("lang").agg(F.sum("f").alias("n"))
    often, width, seed, impostors = _word_ids(found, min_count)
    often = materialize(often.join(totals, "lang").select("id", "lang", "word", "f", "n"), "frequent-words")

    n_words = found.agg(F.sum("f")).first()[0] or 0
    range_bits = max(3, ceil(log2(max(1, n_words / RANGE_ROWS))))

    def word_hashes(batches):
        for b in batches:
            h = gram_hash([b.column(0).to_numpy(zero_copy_only=False).view(U)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    grams = often.select("id").mapInArrow(word_hashes, "h long")
    levels = [often.select(F.array("id").alias("ids"), "f")]
    for n in range(2, max_words + 1):
        size = grams.count()
        if not size:
            break
        table = _bit_table(spark, grams, size)
        grams = materialize(
            texts.mapInArrow(_shard(n, width, seed, impostors, table, range_bits), "range int, filter binary")
            .repartition(p, "range").sortWithinPartitions("range")
            .mapInArrow(_merge(n, width, range_bits, min_count), "ids array<long>, f long, h long"), f"phrases-{n}")
        levels.append(grams.select("ids", "f"))
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.union(more)
    return phrases, often


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words by the score of
    their lowest-scoring cut, without phrases that a longer one explains:
    ``lang, rank, phrase, a, l, r, n, score``."""
    phrases, often = frequent_phrases(docs, min_count, max_words, text_col, lang_col)
    cand = phrases.filter(F.size("ids") > 1).withColumnRenamed("f", "a")

    # counts of both parts of every cut; single words start or end very many phrases and are salted
    salt = lambda part: F.when(F.size(part) == 1, F.pmod(F.xxhash64("ids"), F.lit(SALTS))).otherwise(0)
    lookup = phrases.select("ids", "f", F.explode(F.when(F.size("ids") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                                  .otherwise(F.array(F.lit(0)))).alias("salt")).withColumn("salt", F.col("salt").cast("long"))
    part = lambda c, f: lookup.select(F.col("ids").alias(c), F.col("f").alias(f), F.col("salt").alias(f"{c}_salt"))
    cuts = cand.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")).select(
        "ids", "a", "k", F.expr("slice(ids, 1, k)").alias("head"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("tail"))
    cuts = cuts.withColumn("head_salt", salt("head").cast("long")).withColumn("tail_salt", salt("tail").cast("long"))
    cuts = cuts.join(part("head", "l"), ["head", "head_salt"]).join(part("tail", "r"), ["tail", "tail_salt"])
    of_word = often.select(F.col("id").alias("first"), "lang", "n")
    # a phrase inside a longer one that occurs as often; steps of one word suffice, as counts only fall
    inner = cand.filter(F.size("ids") > 2).select(
        F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "a")
    inner = inner.groupBy("ids").agg(F.max("a").alias("longer"))
    whole = cuts.groupBy("ids", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))  # at most max_words - 1
    whole = whole.join(inner, "ids", "left").filter("longer IS NULL OR longer < a").withColumn("first", F.element_at("ids", 1))
    scored = _salted(whole, of_word).withColumn("best", F.expr(
        "array_min(transform(cuts, x -> struct(cast((1000BD * cast(a AS decimal(19,0)) * cast(n AS decimal(19,0))) "
        "div (cast(x.l AS decimal(19,0)) * cast(x.r AS decimal(19,0))) AS long) AS score, x.k AS k, x.l AS l, x.r AS r)))"))
    scored = scored.select("lang", "ids", "a", "best.l", "best.r", "n", "best.score")
    # ties of score and count wait for the phrase's text
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = materialize(scored.withColumn("rank", F.rank().over(by)).filter(F.col("rank") <= top).drop("rank"), "ranked")
    text = (near.select("ids", F.posexplode("ids").alias("pos", "id")).join(often.select("id", "word"), "id")
            .groupBy("ids").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"])).alias("phrase")))
    out = near.join(text, "ids")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (out.withColumn("rank", rank).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _salted(whole: DataFrame, of_word: DataFrame) -> DataFrame:
    """Language and total of each phrase, by its first word."""
    copies = of_word.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return whole.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS))).join(copies, ["first", "salt"])
