"""``normalize`` - one narrow projection, no shuffle (with inline dictionaries).

Fixed step order: strip URLs -> emoji tags -> slang -> mentions -> hashtags
-> whitespace; the script mix and the content hash are computed on the raw
text, the token count on the normalised text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift import dictionaries as D
from sift.functions import text as X
from sift.operators.dicts import small_rows
from sift.operators.blocks import in_blocks
from sift.operators.matching import with_candidates


def _slang_rows(slang: DataFrame) -> DataFrame:
    """``lk, rep`` of a slang table, one row per lower-cased token. Columns go by
    the names ``token`` and ``replacement``, else by position. A null
    replacement deletes the token; of several rows of a token the one with the
    largest ``ord`` counts (ties, or no ``ord``: the greatest replacement)."""
    c = slang.columns
    token, rep = ("token", "replacement") if {"token", "replacement"} <= set(c) else c[:2]
    order = F.col("ord") if "ord" in c else F.lit(0)
    rows = slang.select(F.lower(token).alias("lk"), F.struct(order.alias("o"), F.coalesce(F.col(rep), F.lit("")).alias("r")).alias("v"))
    return rows.filter("lk IS NOT NULL").groupBy("lk").agg(F.max("v.r").alias("r") if "ord" not in c else F.max("v")["r"].alias("r")).toDF("lk", "rep")


def _slang_map(slang) -> dict | None:
    """Inline form of a list or small table; None for a large table."""
    if slang is None or isinstance(slang, list):
        rows = D.SLANG if slang is None else slang
        return {str(k).lower(): ("" if v is None else str(v)) for k, v in rows}
    rows = small_rows(_slang_rows(slang))
    return None if rows is None else {r["lk"]: r["rep"] for r in rows}


def _emoji_rows(emoji: DataFrame) -> DataFrame:
    """``ord, emoji, tag``: null emoji are left out, a null tag is empty."""
    return emoji.filter("emoji IS NOT NULL").select("ord", "emoji", F.coalesce("tag", F.lit("")).alias("tag"))


def _fold_emoji(df: DataFrame, emoji, flag: str) -> DataFrame:
    """``__tags`` (each key of ``__nourl`` replaced by its tag, in order) and ``flag``."""
    pairs = D.EMOJI if emoji is None else emoji
    text = F.col("__nourl")
    if isinstance(pairs, DataFrame):
        rows = _emoji_rows(emoji)
        small = small_rows(rows, ["ord", "emoji", "tag"])
        if small is None:
            # A key that shares a character with a tag may match a tag put in before it, so it
            # stays a candidate of every text; others match the text itself or not at all.
            chars = rows.select(F.explode(F.split("tag", "")).alias("c")).distinct().collect()  # characters: a bounded set
            own = "".join(sorted({" "} | {r["c"] for r in chars}))
            literal = F.when(F.translate("emoji", own, "") == F.col("emoji"), F.col("emoji")).otherwise("")
            d = with_candidates(df, "__nourl", rows.withColumn("literal", literal), "__emoji")
            return d.withColumn(flag, F.exists("__emoji", lambda e: F.contains(text, e["emoji"]))).withColumn("__tags", F.aggregate(
                "__emoji", text, lambda t, e: F.replace(t, e["emoji"], F.concat(F.lit(" "), e["tag"], F.lit(" "))))).drop("__emoji")
        pairs = [(r["emoji"], r["tag"]) for r in small]
    d = df.withColumn(flag, X.contains_any_literal(text, [e for e, _ in pairs]))
    return d.withColumn("__tags", F.when(F.col(flag), X.replace_all_literal(text, [(e, f" {t} ") for e, t in pairs])).otherwise(text))


def _replace_slang(df: DataFrame, slang) -> DataFrame:
    """``__slang`` from the collapsed ``__flat``. A table too large to inline is joined with
    the distinct tokens of each block of texts (``operators.blocks``), which are looked up there."""
    flat = F.col("__flat")
    mapping = _slang_map(slang)
    if mapping is not None:
        # rows without a dictionary token are left as they are: they are collapsed already
        d = df.withColumn("__has", X.has_token_in(flat, mapping.keys()))
        return d.withColumn("__slang", F.when(F.col("__has"), X.collapse_ws(X.map_tokens(flat, mapping))).otherwise(flat)).drop("__has")
    lows = lambda f: F.transform(X.words(f), F.lower)
    rows = _slang_rows(slang)
    d = in_blocks(df, F.octet_length("__flat"),
                  lambda r: r.select("__block", F.explode("__a1").alias("__h")).distinct(),
                  rows.select(F.col("lk").alias("__h"), F.struct("lk", "rep").alias("__p")), _replaced,
                  [lambda row: X.words(row("__flat")), lambda row: lows(row("__flat"))], [("__mapped", "string")])
    return d.withColumn("__slang", F.when(F.col("__mapped").isNotNull(), X.collapse_ws("__mapped")).otherwise(flat)).drop("__mapped")


def _replaced(table: pa.StructArray):
    """Maps the words of texts and their lower-case forms to the texts with what ``table``
    (``lk, rep``) has for them, null where it has nothing."""
    keys, reps = table.field("lk"), table.field("rep")

    def found(words: pa.Array, lows: pa.Array):
        at = pc.index_in(lows.flatten(), value_set=keys)
        new = pc.if_else(at.is_valid(), reps.take(at), words.flatten())
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum([0, *n])
        keep = pc.not_equal(new, "").to_numpy(zero_copy_only=False)
        hits = np.cumsum([0, *at.is_valid().to_numpy(zero_copy_only=False)])
        kept = np.cumsum([0, *keep])
        lists = pa.ListArray.from_arrays(pa.array(kept[ends].astype(np.int32)), new.filter(pa.array(keep)))
        text = pc.binary_join(lists, " ")
        yield 0, [pc.if_else(pa.array(hits[ends[1:]] > hits[ends[:-1]]), text, pa.scalar(None, pa.string()))]
    return found


def normalize(df: DataFrame, text_col: str = "text", slang=None, emoji=None,
              prefix: str = "") -> DataFrame:
    """Adds ``has_emoji, normalized_text, token_count, content_hash,
    stripped_urls, lang_mix`` next to the input columns.

    ``slang``/``emoji``: caller tables of any size (see ``sift.dictionaries``) or lists;
    ``None`` means the default dictionaries. Tables larger than the
    inline bound take a join form with the same results.
    """
    raw = F.col(text_col)
    p = prefix
    # Each intermediate that is read more than once is its own projected
    # column: Catalyst does not de-duplicate work inside CASE branches.
    out = _fold_emoji(df.withColumn("__nourl", X.strip_urls(raw)), emoji, f"{p}has_emoji")
    out = _replace_slang(out.withColumn("__flat", X.collapse_ws("__tags")), slang)
    out = out.withColumn(f"{p}normalized_text", X.strip_marks("__slang"))
    out = out.withColumns({
        f"{p}token_count": X.count_spaced_tokens(F.col(f"{p}normalized_text")),
        f"{p}content_hash": X.sha256_hex(raw),
        f"{p}stripped_urls": X.extract_urls(raw),
    })
    out = X.with_script_mix(out, text_col, f"{p}lang_mix")
    return out.select(*df.columns, *[f"{p}{c}" for c in (
        "has_emoji", "normalized_text", "token_count", "content_hash", "stripped_urls", "lang_mix")])
