"""From documents to token ids: five stages, each written and read again.

1. toxicity: documents whose P(severity grade > 0) reaches the operating point go.
2. jaccard: of each component of near copies (similarity 0.75 on five-word
   shingles) one row stays (``jaccard.keep_one``); texts without words all stay.
3. secrets: every secret span is replaced by a mark; no document goes.
4. mixing: each document appears as often as the mix to target weights takes
   it (0 to 3 times); equal rows are copies.
5. bpe: token ids of every row.

All stages but the last return the columns of documents; further columns of
the input, whatever their names and types, pass through as they are. A null text is kept by every filter. SQL cannot
express models, random rounding and BPE, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.llm import bpe, common, jaccard, mixing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), common.read(spark, sf_dir, "labels"))
    scored = toxicity.score(common.packed(docs, "doc_id", "text"), model)
    return common.unpacked(scored.filter(F.col("p_toxic") < toxicity.REJECT), docs.columns, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    found = secrets.redact(secrets.scan(common.packed(docs, "doc_id", "text"), secrets.train(narrow)))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cols = {c: F.col("__rest")[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(F.size("spans") == 0, cols["n_chars"]).otherwise(F.length("text").cast(kind))
    return found.select(*[cols[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.mix_groups(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("secrets", redact_secrets),
          ("mixing", mix_sources), ("bpe", encode_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
