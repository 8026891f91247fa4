"""Document fingerprints: I-Match with several randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band,
here terms of between 1 in 1,000 and 1 in 10 of all documents. A document's
distinct lexicon terms are sorted and hashed: once for the whole lexicon and
once for each of several random subsets of it (a term belongs to a subset by
its hash). Subsets are of different density, so that short and long documents
both have subsets that hold only a few of their terms; those still agree when
part of a text is replaced. The fingerprint lists the hashes (a fixed place
for each subset; ``-`` where the subset holds none of the document's terms).
Likeness is the share of agreeing places among those that either text fills.

The band bounds the lexicon: terms in at least 1 of 1,000 documents are at
most 1,000 times the mean number of distinct terms of a document, however
many documents there are. Its size is checked before it is broadcast; beyond
``MAX_BROADCAST`` terms the same join is left to Spark.

Defined results: null and empty texts and texts without words have the
fingerprint ``empty``; a text with words but none in the lexicon has ``x:`` and
one hash of its distinct terms' hashes, so equal texts agree and others do not.
Likeness of equal fingerprints is 1; of ``empty`` or ``x:`` with another, 0. Repeated rows each
give a row; rows of one id are ordered by text; null ids come first; the next
document of the last one is the first (itself, if it is alone). Extra columns
are ignored. An empty table gives no rows. All work is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import materialize, order_buckets, order_key, partitions

BAND = (0.001, 0.1)  # shares of documents
MAX_BROADCAST = 4_000_000  # terms, 8 bytes each
# (share 1 in n of the lexicon, number of disjoint random subsets of that share)
LEXICONS = ((1, 1), (8, 8), (64, 24), (512, 32))
PLACES = sum(n for _, n in LEXICONS)
ENOUGH = 8
EMPTY = "empty"


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple = BAND) -> DataFrame:
    """Hashes ``h`` of the terms in the band, counted over all documents."""
    n = docs.count()
    df = (docs.select(F.explode(terms(F.col(text_col))).alias("t")).select(F.xxhash64("t").alias("h"))
          .groupBy("h").count())
    return df.filter((F.col("count") >= max(2.0, band[0] * n)) & (F.col("count") <= max(2.0, band[1] * n))).select("h")


def _subsets(hs: Column, share: int, draws: int) -> Column:
    """The terms of each of ``draws`` disjoint random lexicons of one ``share``-th;
    a term's subset is computed once."""
    if share == 1:
        return F.array(hs)
    tagged = F.transform(hs, lambda h: F.struct(F.pmod(F.xxhash64(h, F.lit(share)), F.lit(share)).alias("d"), h.alias("h")))
    held = F.filter(tagged, lambda x: x["d"] < draws)
    # bound through a one-element array: a lambda evaluates any other expression in its body anew for each draw
    return F.transform(F.array(held), lambda ts: F.transform(
        F.sequence(F.lit(0), F.lit(draws - 1)),
        lambda d: F.transform(F.filter(ts, lambda x: x["d"] == d), lambda x: x["h"])))[0]


def _places(col: str) -> Column:
    """Hashes of the sorted lexicon terms in each lexicon."""
    return F.transform(F.concat(*[_subsets(F.col(col), *x) for x in LEXICONS]), lambda x: F.when(
        F.size(x) == 0, F.lit("-")).otherwise(F.substring(F.lower(F.hex(F.xxhash64(x))), -8, 8)))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing places among those that either fingerprint fills (0 to
    1), over the sparsest lexicons that fill ``ENOUGH`` places between them: the
    denser ones change with any edit and tell less."""
    x, y = F.split(a, ":"), F.split(b, ":")
    zipped = F.arrays_zip(x.alias("a"), y.alias("b"))
    filled = lambda skip: F.filter(F.slice(zipped, skip + 1, PLACES), lambda p: (p["a"] != "-") | (p["b"] != "-"))
    share = lambda ps: F.size(F.filter(ps, lambda p: p["a"] == p["b"])) / F.greatest(F.size(ps), F.lit(1))
    plain = a.startswith("x:") | b.startswith("x:") | (a == EMPTY) | (b == EMPTY)
    out = F.when(a == b, F.lit(1.0)).when(plain, F.lit(0.0))
    skip = PLACES
    for _, draws in LEXICONS[:0:-1]:
        skip -= draws
        out = out.when(F.size(filled(skip)) >= ENOUGH, share(filled(skip)))
    return out.otherwise(share(filled(0)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list]:
    """Rows in even id ranges (``bucket``), each range ending with a copy of the
    first row of the range after it (``guest``), so that neighbours are found
    with one shuffle and no window over all rows. Returns the frame, and its order."""
    k = order_key(id_col)
    cuts = order_buckets(docs, k, 4 * partitions(docs.sparkSession))
    n = max(1, len(cuts.bounds))
    rows = docs.select(F.col(id_col).alias("id"), k.alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    home = cuts.of(F.col("k"))
    first = F.array_contains(F.from_json(F.lit("[" + ",".join(map(str, cuts.bounds)) + "]"), "array<bigint>"), F.col("k"))
    places = F.when(first, F.array(F.struct(home.alias("bucket"), F.lit(False).alias("guest")), F.struct(
        F.pmod(home - 1, F.lit(n)).cast("int").alias("bucket"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(home.alias("bucket"), F.lit(False).alias("guest"))))
    rows = rows.withColumn("at", F.explode(places)).select("id", "k", "text", "at.bucket", "at.guest")
    return rows, ["guest", "k", "text"]


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str], lex: DataFrame, keep: list[str]) -> DataFrame:
    """Fingerprint of each text column in ``texts`` (column -> output); rows are
    told apart by ``keys``, by whose first rows are already dealt out; ``keep``
    lists further columns to carry."""
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.array(F.lit("")), terms(F.col(c))).alias("ts"))
                                for i, c in enumerate(texts)])).alias("w")
    long = rows.select(*keys, *keep, which).select(*keys, *keep, F.col("w.i").alias("i"), F.explode("w.ts").alias("t"))
    # the empty term stands for the text itself, so that no text is lost in the join
    long = long.select(*keys, *keep, "i", F.xxhash64("t").alias("h"))
    none = F.xxhash64(F.lit(""))
    small = lex.count() <= MAX_BROADCAST
    held = long.join(F.broadcast(lex.withColumn("in", F.lit(True))) if small else lex.withColumn("in", F.lit(True)), "h", "left")
    per = held.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in keep],
        *[F.array_sort(F.collect_list(F.when((F.col("i") == i) & F.col("in"), F.col("h")))).alias(f"__h{i}") for i in range(len(texts))],
        # order-free digests of all terms, for texts without lexicon terms
        *[F.sum(F.when((F.col("i") == i) & (F.col("h") != none), F.shiftright("h", 24))).alias(f"__s{i}") for i in range(len(texts))])
    for i, out in enumerate(texts.values()):
        per = per.withColumn(out, F.when(F.col(f"__s{i}").isNull(), F.lit(EMPTY))
                             .when(F.size(f"__h{i}") == 0, F.concat(F.lit("x:"), F.lower(F.hex(F.xxhash64(f"__s{i}")))))
                             .otherwise(F.array_join(_places(f"__h{i}"), ":")))
    return per.drop(*[f"__{c}{i}" for c in "hs" for i in range(len(texts))])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple = BAND) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness to it
    and to the next document's (columns as in the op2 query)."""
    lex = materialize(lexicon(docs, text_col, band), "lexicon")
    rows, order = with_next(docs, id_col, text_col)
    w = Window.partitionBy("bucket").orderBy(*order)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = (rows.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("text").over(w))
            .withColumn("next", F.coalesce("next", "text")))
    rows = rows.select("id", "bucket", "rn", "guest", "text", F.length("text").cast("long").alias("n_chars"), F.concat(
        F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    fp = fingerprints(rows, ["bucket", "rn"], {"text": "fingerprint", "edited": "edited_fingerprint"}, lex,
                      ["id", "guest", "n_chars", "edited_sha256"])
    w = Window.partitionBy("bucket").orderBy("rn")
    fp = fp.withColumn("next_fp", F.coalesce(F.lead("fingerprint").over(w), F.col("fingerprint")))
    return fp.filter(~F.col("guest")).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"))
