"""Registered queries of this subpackage (thin: they call the operators and
derive the contract's columns) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sift.llm.common import read

REGISTRY: dict = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op4_warc(spark, sf_dir):
    from sift.llm import warc
    files = warc.write_archives(read(spark, sf_dir, "pages"))
    return warc.read_archives(spark, files, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_topk(spark, sf_dir):
    from sift.llm import topk
    v = read(spark, sf_dir, "embeddings").select("vec_id", topk.quantised("embedding").alias("v"))
    return topk.top_k(v, F.col("vec_id") % 50 == 0, 5)


@query
def op8_sharding(spark, sf_dir):
    from sift.llm import sharding
    s = sharding.byte_shards(read(spark, sf_dir, "documents"), 8)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_bpe(spark, sf_dir):
    from sift.llm import bpe
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decode(bpe.encode(docs).drop("text")))


@query
def op10_mixing(spark, sf_dir):
    from sift.llm import mixing
    m = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


@query
def op2_fingerprints(spark, sf_dir):
    from sift.llm import imatch
    return imatch.edited_likeness(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_secrets(spark, sf_dir):
    from sift.llm import secrets
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", secrets.counted(0).alias("n_assign"), secrets.counted(1).alias("n_access"),
                        secrets.counted(2).alias("n_hex"), F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
                        secrets.joined("spans").alias("spans"))


@query
def op6_jaccard(spark, sf_dir):
    from sift.llm import jaccard
    rows, _ = jaccard.jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


@query
def op3_toxicity(spark, sf_dir):
    from sift.llm import toxicity
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text").withColumn("rejected", F.col("p_toxic") >= toxicity.REJECT)


@query
def op9_quality(spark, sf_dir):
    from sift.llm import quality
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query
def op11_phrases(spark, sf_dir):
    from sift.llm import phrases
    return phrases.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


@query
def op12_simhash(spark, sf_dir):
    from sift.llm import covering
    rows, _ = covering.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "fingerprint", "component_id")


@query
def op13_repair(spark, sf_dir):
    from sift.llm import repair
    rows = repair.damage(read(spark, sf_dir, "conversations"))
    return repair.digests(rows, repair.plans(rows))
