"""Secret scans: fixed patterns, plus random-looking strings told from
ordinary identifiers by two character Markov models.

Base kinds (leftmost matches that do not overlap, per kind): ``assign`` a key
word, a colon or equals sign and a value of 8 or more characters (the span is
the whole match); ``access`` AKIA keys of 16 or more; ``hex`` runs of 32 or
more. The method adds kind ``markov``: tokens of 20 or more of
``[A-Za-z0-9+/_=-]`` with 8 or more different characters that overlap no base
span and whose log-likelihood ratio (random over ordinary, first-order models
that fall back on character frequencies) exceeds ``MARGIN`` nats.

Training, from labelled samples: label 1 the base matches' values in all
documents and base64, base62-like and hex digests of document ids; label 0 the
tokens of about ``SAMPLE`` documents (chosen by a hash of the id: a documented
bound) with base matches cut out. Only the pair counts (at most 2 * 67 * 67
rows) reach the driver; the model is an array literal in the plan. Everything
runs as DataFrame expressions; there is no shuffle in the scan.

Defined results: a null or empty text has no spans; repeated rows each give a
row; an empty table trains flat models and gives no rows. Offsets count code
points, ends are exclusive. Extra columns pass through; a column named as an
output is replaced. Whole texts are scanned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm.common import without

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # greedy runs: the same as all AKIA[A-Z0-9]+ of 16 or more
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORDS_OF = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLE = 2000
MARGIN = 12.0
BACK_OFF = 20.0  # pairs' weight of the characters' own frequencies
DISTINCT = 8
SPAN = "struct<start:int,ord:int,end:int,value:string>"


def _spans(text: Column, pattern: str, ord_: int, value_group: int = 0) -> Column:
    """Spans of all matches: the pieces between them tell where they start."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(pieces.alias("p"), whole.alias("m"), value.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("got"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["got"]).otherwise(
            F.concat(acc["got"], F.array(span))).alias("got"))

    return F.aggregate(zipped, start, step, lambda acc: acc["got"])


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def with_base(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base``: the base spans by start, then kind."""
    df = without(df, "base").withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    low = F.lower("__t")
    hinted = F.lit(False)
    for w in WORDS_OF:
        hinted = hinted | low.contains(w)
    t = F.col("__t")
    df = df.withColumns({
        "__assign": F.when(hinted, F.filter(_spans(t, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 8)).otherwise(_none()),
        "__access": F.when(t.contains("AKIA"), _spans(t, ACCESS, 1)).otherwise(_none()),
        "__hex": F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(_none())})
    return df.withColumn("base", F.array_sort(F.concat("__assign", "__access", "__hex"))).drop("__t", "__assign", "__access", "__hex")


def _pairs(tokens: DataFrame) -> DataFrame:
    """Counts of neighbouring characters in (label, token) rows."""
    chars = tokens.select("label", F.split("token", "").alias("c"))
    pair = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.element_at("c", i), F.element_at("c", i + 1)))
    return (chars.filter(F.size("c") > 1).select("label", F.explode(pair).alias("pair"))
            .groupBy("label", "pair").count())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of character pairs, row-major over ``ALPHABET``."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = max(1, docs.count() // sample)
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.rtrim(F.base64(F.unhex(digest)), F.lit("="))
    picked = docs.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    made = picked.select(F.explode(F.array(b64, F.translate(b64, "+/", "x7"), F.substring(digest, 1, 40),
                                           F.upper(F.translate(F.substring(b64, 1, 24), "+/", "Q4")))).alias("token"))
    seen = with_base(docs).select(F.explode("base.value").alias("token"))
    rest = picked.select(F.explode(F.regexp_extract_all(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " "),
        F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("token"))
    # a bound on the repeats of one value keeps a secret copied a million times from being the model
    values = seen.distinct()
    rows = _pairs(made.union(values).select(F.lit(1).alias("label"), "token").unionByName(
        rest.select(F.lit(0).alias("label"), "token"))).collect()  # at most 2 * 67 * 67 kept rows
    n = len(ALPHABET)
    counts = [[[0.0] * n for _ in range(n)] for _ in range(2)]
    for label, pair, c in rows:
        if len(pair) == 2 and pair[0] in ALPHABET and pair[1] in ALPHABET:
            counts[label][ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += c
    # a character after which little was seen falls back on how frequent characters are at all
    alone = [[0.5 + sum(counts[k][a][b] for a in range(n)) for b in range(n)] for k in (0, 1)]
    alone = [[x / sum(xs) for x in xs] for xs in alone]
    log = lambda k, a, b: math.log((counts[k][a][b] + BACK_OFF * alone[k][b]) / (sum(counts[k][a]) + BACK_OFF))
    return [log(1, a, b) - log(0, a, b) for a in range(n) for b in range(n)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of ``ALPHABET`` characters."""
    n = len(ALPHABET)
    codes = [ALPHABET.find(chr(i)) for i in range(128)]
    code = F.from_json(F.lit(str(codes)), "array<int>")
    table = F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in model) + "]"), "array<double>")
    cs = F.transform(F.split(token, ""), lambda c: F.get(code, F.ascii(c)))
    step = lambda acc, c: F.struct(
        c.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.get(table, acc["last"] * n + c)).otherwise(0.0)).alias("sum"))
    return F.aggregate(cs, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """Adds ``base`` and ``spans`` (arrays of start, ord, end, value; ord indexes ``KINDS``)."""
    df = with_base(without(docs, "base", "spans"), text_col)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    random = lambda s: (
        ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        & (F.size(F.array_distinct(F.split(s["value"], ""))) >= DISTINCT) & (ratio(s["value"], model) > margin))
    df = df.withColumn("__tokens", F.when(t.rlike(TOKEN), _spans(t, TOKEN, 3)).otherwise(_none()))
    return df.withColumn("spans", F.array_sort(F.concat("base", F.filter("__tokens", random)))).drop("__tokens")


def joined(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(ord_: int) -> Column:
    return F.size(F.filter("base", lambda s: s["ord"] == ord_)).cast("long")


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span's text by ``mark``; overlapping spans become one mark."""
    t = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t)))
    clean = F.when(t.isNull() | (F.size("spans") == 0), t).otherwise(F.aggregate("spans", start, step, tail))
    return scanned.withColumn(text_col, clean)
