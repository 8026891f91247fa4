"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads whole driver tables (or inputs Spark derives from them in
``sift.plans.derive``) and runs library operators; ``sift.plans.oracle``
holds the DuckDB twin for each. Output columns are flat scalars with the
same names on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions import scores as S
from sift.functions import text as X
from sift.operators import curation as C
from sift.operators import scoring as SC
from sift.operators import signals as SG
from sift.operators.normalize import normalize
from sift.operators.triage import batch_triage
from sift.plans import derive as DV
from sift.schemas import CURATED_COLUMNS
from sift.session import read_table, scratch_path, stored

REGISTRY: dict = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


CORPUS_MODEL = SC.LinearModel(DV.CORPUS_BIAS, DV.CORPUS_WEIGHTS)


def _triage_docs(spark, sf_dir, scorer=None):
    d = DV.documents(spark, sf_dir)
    return batch_triage(d, scorer or SC.linear_scorer(CORPUS_MODEL), lexicon=DV.CORPUS_LEXICON,
                        action_patterns=DV.CORPUS_ACTION_PATTERNS,
                        urgency_patterns=DV.CORPUS_URGENCY_PATTERNS)


@query("batch_triage")
def q_batch_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13 over every document: normalise, signals, score, uncertainty."""
    t = _triage_docs(spark, sf_dir)
    return t.select(
        "doc_id", "id", "label", "confidence", "entropy",
        F.col("probabilities")[0].alias("p_aman"), F.col("probabilities")[1].alias("p_waspada"),
        F.col("probabilities")[2].alias("p_tinggi"),
        F.array_join("prediction_set", ",").alias("prediction_set"),
        F.size("prediction_set").alias("set_size"), "is_ambiguous",
        "signal_count", SG.signal_types(F.col("signals")).alias("signal_types"),
        "token_count", "normalized_text", F.array_join("stripped_urls", " ").alias("urls"),
        F.sha2("text_preview", 256).alias("preview_hash"))


def _scores(df):
    p = F.col(SC.PROBS)
    return df.select("doc_id", p[0].alias("p_aman"), p[1].alias("p_waspada"), p[2].alias("p_tinggi"))


@query("score_text")
def q_score_text(spark, sf_dir):
    """The linear model on every normalised document, by its weight table
    (any vocabulary)."""
    n = normalize(DV.documents(spark, sf_dir), "text")
    return _scores(SC.table_scorer(SC.weight_table(spark, CORPUS_MODEL), CORPUS_MODEL.bias, "doc_id")(n))


@query("score_external")
def q_score_external(spark, sf_dir):
    """K2: the same model as an external scorer, loaded once a Python worker."""
    model = CORPUS_MODEL
    n = normalize(DV.documents(spark, sf_dir), "text")
    return _scores(SC.udf_scorer(lambda: model.probabilities)(n))


@query("score_vocabulary")
def q_score_vocabulary(spark, sf_dir):
    """D1 with a weight for every token of the corpus, joined by token."""
    # dealt out as the scorer asks, so that the vocabulary reads the same texts
    n = normalize(DV.documents(spark, sf_dir), "text").select("doc_id", "normalized_text").repartition("doc_id")
    return _scores(SC.table_scorer(DV.vocabulary_weights(n), DV.CORPUS_BIAS, "doc_id")(n))


@query("normalize_text")
def q_normalize_text(spark, sf_dir):
    """B8-B16, E2 over documents with injected URLs, emoji, Arabic, slang."""
    d = DV.docs_with_artefacts(spark, sf_dir)
    n = normalize(d, "text")
    return n.select(
        "doc_id", F.col("normalized_text"), "token_count", "content_hash",
        X.short_id("text").alias("doc_key"),
        F.col("lang_mix.id").alias("lang_id"), F.col("lang_mix.ar").alias("lang_ar"),
        F.col("lang_mix.other").alias("lang_other"), "has_emoji",
        F.size("stripped_urls").alias("n_urls"), F.array_join("stripped_urls", " ").alias("urls"))


@query("lexicon_signals")
def q_lexicon_signals(spark, sf_dir):
    """Lexicon containment per document."""
    d = DV.documents(spark, sf_dir)
    s = SG.lexicon_signals(F.col("text"), DV.CORPUS_LEXICON)
    return d.select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").alias("n_lexicon"),
        F.array_join(F.transform("s", lambda e: e["extracted_text"]), ",").alias("terms"),
        F.array_join(F.transform("s", lambda e: e["significance"]), ",").alias("levels"))


@query("pattern_signals")
def q_pattern_signals(spark, sf_dir):
    """First-match windows for action and urgency patterns."""
    d = DV.documents(spark, sf_dir)
    a = SG.action_signals(F.col("text"), DV.CORPUS_ACTION_PATTERNS)
    u = SG.urgency_signals(F.col("text"), DV.CORPUS_URGENCY_PATTERNS)
    return d.select("doc_id", a.alias("a"), u.alias("u")).select(
        "doc_id", F.size("a").alias("n_action"), F.size("u").alias("n_urgency"),
        F.array_join(F.transform("a", lambda e: e["extracted_text"]), " | ").alias("action_texts"),
        F.array_join(F.transform("u", lambda e: e["extracted_text"]), " | ").alias("urgency_texts"),
        F.array_join(F.transform("u", lambda e: e["context_explanation"]), " | ").alias("urgency_context"))


@query("lexicon_large")
def q_lexicon_large(spark, sf_dir):
    """C1, E3 with a lexicon of five terms a document."""
    d = DV.documents(spark, sf_dir).select("doc_id", "text")
    s = SG.with_lexicon_signals(d.withColumn("low", F.lower("text")), "low", DV.corpus_lexicon(d), "s")
    return s.select("doc_id", F.size("s").alias("n_lexicon"),
                    F.sha2(F.array_join("s.extracted_text", ","), 256).alias("terms_hash"),
                    F.sha2(F.array_join("s.significance", ","), 256).alias("levels_hash"))


@query("patterns_large")
def q_patterns_large(spark, sf_dir):
    """C2, C3, E4 with two patterns a document."""
    d = DV.documents(spark, sf_dir).select("doc_id", "text").withColumn("low", F.lower("text"))
    pats = stored(DV.corpus_patterns(d), "sift-patterns")  # read four times
    digest = lambda c, n: (F.size(c).alias(f"n_{n}"), F.sha2(F.array_join(f"{c}.extracted_text", "|"), 256).alias(f"{n}_hash"))
    # the digest goes on, not the signals, which are many times the text
    s = SG.with_action_signals(d, "text", "low", pats, "a").select(*d.columns, *digest("a", "action"))
    s = SG.with_urgency_signals(s, "text", "low", pats, "u").select("*", *digest("u", "urgency"))
    return s.select("doc_id", "n_action", "n_urgency", "action_hash", "urgency_hash")


@query("slang_large")
def q_slang_large(spark, sf_dir):
    """B10, E2 with a slang table of up to eight tokens a document."""
    d = DV.documents(spark, sf_dir).select("doc_id", "text")
    n = normalize(d, "text", slang=DV.corpus_slang(d))
    return n.select("doc_id", "normalized_text", "token_count")


@query("signal_rollup")
def q_signal_rollup(spark, sf_dir):
    """Union + dedup per document, counts per type."""
    d = DV.documents(spark, sf_dir)
    s = SG.extract_signals(d, "text", lexicon=DV.CORPUS_LEXICON, action_patterns=DV.CORPUS_ACTION_PATTERNS,
                           urgency_patterns=DV.CORPUS_URGENCY_PATTERNS)
    return SG.rollup_by_type(s)


@query("signal_summary")
def q_signal_summary(spark, sf_dir):
    """Per-document deduplicated signal list as type string."""
    d = DV.documents(spark, sf_dir)
    s = SG.extract_signals(d, "text", lexicon=DV.CORPUS_LEXICON, action_patterns=DV.CORPUS_ACTION_PATTERNS,
                           urgency_patterns=DV.CORPUS_URGENCY_PATTERNS)
    return s.select("doc_id", "signal_count", SG.signal_types(F.col("signals")).alias("signal_types"))


@query("majority_labels")
def q_majority_labels(spark, sf_dir):
    """Votes -> label and sub-label flags for every row."""
    a = DV.annotated_corpus(spark, sf_dir)
    return C.sublabel_flags(C.label_corpus(a)).select(
        "doc_id", "label", *[f"{c}_agg" for c in ("toxicity", "identity_attack", "insults",
                                                   "threat_incitement_to_violence", "profanity_obscenity",
                                                   "polarized", "sexually_explicit")])


@query("curated_corpus")
def q_curated_corpus(spark, sf_dir):
    """Label, drop SKIP, min length, dedup by text hash, project."""
    a = DV.annotated_corpus(spark, sf_dir)
    out = C.min_length(C.drop_skipped(C.label_corpus(a)), 10)
    out = C.dedup_first(C.with_text_hash(out), "text_hash", "doc_id", unique_order=True)
    return C.sublabel_flags(out).select(*CURATED_COLUMNS)


@query("dedup_documents")
def q_dedup_documents(spark, sf_dir):
    """B4, B5, G1 on documents: first (lowest id) per text hash."""
    d = DV.documents(spark, sf_dir).select("doc_id", "text", "source")
    d = C.with_text_hash(C.min_length(d, 10))
    return C.dedup_first(d, "text_hash", "doc_id", unique_order=True).select("doc_id", "text_hash", "source")


def _curated(spark, sf_dir):
    return q_curated_corpus(spark, sf_dir)


@query("class_distribution")
def q_class_distribution(spark, sf_dir):
    """F1, G2."""
    return C.class_distribution(_curated(spark, sf_dir))


@query("class_weights")
def q_class_weights(spark, sf_dir):
    """F16."""
    w = C.class_weights(_curated(spark, sf_dir))
    return w.withColumn("weight", F.round("weight", 6))


@query("source_counts")
def q_source_counts(spark, sf_dir):
    """counts per (label, topic)."""
    return C.class_counts(_curated(spark, sf_dir), "label", "topic")


@query("min_class_count")
def q_min_class_count(spark, sf_dir):
    """F17."""
    return C.min_class_count(_curated(spark, sf_dir))


# --- Sampling and splits (G7-G12) -------------------------------------------
from sift.operators import sampling as SM  # noqa: E402


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    """Exact per-class 80/20 by seeded hash."""
    cur = _curated(spark, sf_dir).select("text_id", "label")
    return SM.stratified_split(cur, "label", "text_id", 0.2, DV.SEED)


@query("split_counts")
def q_split_counts(spark, sf_dir):
    """class counts per split."""
    return C.class_counts(q_stratified_split(spark, sf_dir), "split", "label")


@query("balanced_sample")
def q_balanced_sample(spark, sf_dir):
    """G7 + G9: 200 per class, short classes topped up by oversampling."""
    cur = _curated(spark, sf_dir).select("text_id", "label")
    return SM.balanced_sample(cur, "label", "text_id", 200, DV.SEED).select("text_id", "label", "source", "copy")


@query("capped_sample")
def q_capped_sample(spark, sf_dir):
    """min(50, n_c) per class."""
    cur = _curated(spark, sf_dir).select("text_id", "label")
    return SM.first_k_per_group(cur, "label", "text_id", 50, DV.SEED)


@query("positional_split")
def q_positional_split(spark, sf_dir):
    """G10 + G12: seeded shuffle of all documents, first 80 % train."""
    d = DV.documents(spark, sf_dir).select("doc_id", "lang")
    return SM.positional_split(d, "doc_id", 0.8, DV.SEED)


# --- Uncertainty and fusion (D2-D9, B24-B28, B30, B32) ----------------------
from sift.operators import fusion as FU  # noqa: E402


@query("uncertainty")
def q_uncertainty(spark, sf_dir):
    """D2-D6, D9, B26-B28 over every document's derived score."""
    d = DV.documents(spark, sf_dir).select("doc_id")
    u = S.uncertainty(DV.derived_probs("doc_id"))
    risk = (F.col("doc_id") * 7) % 101
    return d.select("doc_id", u.alias("u"), risk.alias("risk")).select(
        "doc_id", F.col("u.label").alias("label"), F.col("u.confidence").alias("confidence"),
        F.round("u.entropy", 4).alias("entropy"),
        F.array_join("u.prediction_set", ",").alias("prediction_set"), F.col("u.set_size").alias("set_size"),
        F.col("u.is_ambiguous").alias("is_ambiguous"),
        S.encode_label(F.col("u.label")).alias("label_code"),
        S.risk_band(F.col("risk")).alias("risk_band"),
        (F.col("u.label") != "AMAN").alias("escalate"))


def _fused(spark, sf_dir):
    d = DV.documents(spark, sf_dir).select(
        "doc_id", DV.derived_probs("doc_id").alias("loc"), DV.expert_probs("doc_id").alias("ex"),
        DV.expert_label("doc_id").alias("el"))
    return FU.fuse_frame(d, "loc", "ex", "el", "f")


@query("fuse_scores")
def q_fuse_scores(spark, sf_dir):
    """40/60 fusion, renormalisation, critical override."""
    return _fused(spark, sf_dir).select(
        "doc_id", F.col("f.label").alias("label"),
        F.col("f.probabilities")[0].alias("p_aman"), F.col("f.probabilities")[1].alias("p_waspada"),
        F.col("f.probabilities")[2].alias("p_tinggi"), F.round("f.entropy", 4).alias("entropy"),
        F.array_join("f.prediction_set", ",").alias("prediction_set"),
        F.col("f.confidence").alias("confidence"), F.col("f.overridden").alias("overridden"))


def _replies(spark, sf_dir):
    d = DV.documents(spark, sf_dir).select("doc_id")
    return FU.parse_reply(d.withColumn("reply", DV.expert_reply_text("doc_id")), "reply")


@query("parse_replies")
def q_parse_replies(spark, sf_dir):
    """Fence strip, JSON parse, validation, phrase digest."""
    r = _replies(spark, sf_dir)
    probs = S.map_to_probs(F.col("expert.probabilities"))
    v = FU.violations(F.col("expert.label"), probs, S.confidence_band(probs), "expert.recommendation",
                      "expert.risk_score", F.col("expert.ambiguity_notes"))
    return r.select(
        "doc_id", "parse_ok", F.col("expert.label").alias("label"),
        F.col("expert.risk_score").alias("risk_score"), F.col("expert.recommendation").alias("recommendation"),
        FU.note_with_phrases(F.col("expert.ambiguity_notes"), F.col("expert.key_phrases")).alias("ambiguity"),
        F.when(F.col("parse_ok"), F.array_join(v, ",")).alias("violations"))


from sift.operators import quarantine as QU  # noqa: E402


def _split_replies(spark, sf_dir):
    d = DV.documents(spark, sf_dir).select("doc_id", DV.checked_reply_text("doc_id").alias("reply"))
    return QU.split_write(QU.check_replies(d), scratch_path(spark, "sift-quarantine"))


@query("quarantine")
def q_quarantine(spark, sf_dir):
    """Every reply, as read back from the valid or the bad side, with its reasons."""
    valid, bad, _ = _split_replies(spark, sf_dir)
    return (valid.select("doc_id", F.lit("valid").alias("status"), F.lit("").alias("reasons"), F.col("expert.risk_score").alias("risk_score"))
            .unionByName(bad.select("doc_id", F.lit("bad").alias("status"), F.array_join("reasons", ",").alias("reasons"),
                                    F.col("expert.risk_score").alias("risk_score"))))


@query("quarantine_counts")
def q_quarantine_counts(spark, sf_dir):
    """Counts observed while writing, next to those of the rows written."""
    valid, bad, seen = _split_replies(spark, sf_dir)
    written = bad.select(F.explode("reasons").alias("name")).unionByName(bad.select(F.lit("bad").alias("name"))).unionByName(
        valid.select(F.lit("valid").alias("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("written"))
    observed = spark.createDataFrame([(k, v) for k, v in seen.items() if k != "rows"], "name string, observed long")
    return observed.join(written, "name", "left").select("name", "observed", F.coalesce("written", F.lit(0)).alias("written"))


@query("array_replies")
def q_array_replies(spark, sf_dir):
    """B24 b: fenced or plain JSON arrays of strings; others are not accepted."""
    d = DV.documents(spark, sf_dir)
    a = d.select("doc_id", QU.string_array(DV.array_reply_text()).alias("a"))
    return a.select("doc_id", F.col("a").isNotNull().alias("accepted"), F.size("a").alias("n"), F.sha2(F.array_join("a", "|"), 256).alias("items_hash"))


@query("curation_counts")
def q_curation_counts(spark, sf_dir):
    """Rows dropped while curating, counted in the same pass, and the rows written."""
    from sift.sources.files import write_corpus
    out, seen = C.curate(DV.annotated_corpus(spark, sf_dir), "doc_id")
    path = scratch_path(spark, "sift-curated")
    write_corpus(out, path)
    rows = [(k, int(v)) for k, v in seen.get.items()] + [("written", spark.read.parquet(path).count())]
    return spark.createDataFrame(rows, "name string, n long")


def _deep(spark, sf_dir):
    from sift.operators.triage import deep_triage
    replies = DV.documents(spark, sf_dir).select("doc_id", DV.expert_reply_text("doc_id").alias("reply"))
    return deep_triage(_triage_docs(spark, sf_dir), replies, "doc_id", "reply")


@query("deep_triage")
def q_deep_triage(spark, sf_dir):
    """Batch triage; rows that it does not call safe are joined with
    expert replies (left join), fused and validated."""
    return _deep(spark, sf_dir).select(
        "doc_id", "label", "parse_ok", "final_label", "final_entropy",
        F.array_join("final_set", ",").alias("final_set"), "final_confidence",
        "risk_score", "recommendation", F.array_join("violations", ",").alias("violations"))


@query("radar_log")
def q_radar_log(spark, sf_dir):
    """RADAR log rows of the escalated documents, then SWEEP rows
    of all documents; the first write of an id stays (equal texts have one id)."""
    from sift.operators.store import new_log_rows
    from sift.operators.triage import radar_log_rows, sweep_log_rows
    ts, arrival = F.lit(DV.AS_OF).cast("timestamp_ntz"), [F.col("doc_id").alias("arrival")]
    # each batch is written once: picking its winners reads it twice
    deep = stored(radar_log_rows(_deep(spark, sf_dir), ts=ts, keep=arrival), "sift-radar")
    swept = stored(sweep_log_rows(_triage_docs(spark, sf_dir), ts=ts, keep=arrival), "sift-sweep")
    radar = new_log_rows(deep, None)
    sweep = new_log_rows(swept, radar)
    return radar.unionByName(sweep).select("id", "timestamp", "predicted_label", "risk_score", "confidence", "entropy",
                                           "is_ambiguous", "pipeline_mode", "arrival", F.sha2("input_text", 256).alias("text_sha256"))


# --- Logs, feedback, analyst reports (A14-A16, E5, E8, F4-F9, F18, G3-G6) ----
from sift.operators import reports as R  # noqa: E402
from sift.operators import store as ST  # noqa: E402

SPLIT_TS = "2024-01-16 00:00:00"


@query("log_first_write")
def q_log_first_write(spark, sf_dir):
    """Two batches appended with first-write-wins per id."""
    logs = DV.analysis_logs(spark, sf_dir).withColumn(
        "id", F.concat(F.substring_index("id", "-", 1), F.lit("-"),
                       F.regexp_extract("input_text", "^(\\w+)", 1)))
    b1 = logs.filter(F.col("timestamp") < F.lit(SPLIT_TS).cast("timestamp_ntz"))
    b2 = logs.filter(F.col("timestamp") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))
    stored = ST.new_log_rows(b1, None)
    added = ST.new_log_rows(b2, stored)
    cols = ["id", "timestamp", "predicted_label", "risk_score", "pipeline_mode"]
    return stored.select(*cols, F.lit(1).alias("batch")).unionByName(added.select(*cols, F.lit(2).alias("batch")))


def _feedback(spark, sf_dir):
    return ST.resolve_feedback(DV.feedback_events(spark, sf_dir))


@query("feedback_upsert")
def q_feedback_upsert(spark, sf_dir):
    """Resolved feedback view (first original, latest correction)."""
    return _feedback(spark, sf_dir)


@query("apply_feedback")
def q_apply_feedback(spark, sf_dir):
    """Corrected labels override curated labels."""
    cur = _curated(spark, sf_dir).select("text_id", "label")
    return ST.apply_feedback(cur, _feedback(spark, sf_dir), "text_id")


@query("retrain_gate")
def q_retrain_gate(spark, sf_dir):
    """F18."""
    return ST.retrain_gate(_feedback(spark, sf_dir), 50)


def _logs(spark, sf_dir):
    return DV.analysis_logs(spark, sf_dir)


@query("search_threats")
def q_search_threats(spark, sf_dir):
    """G3, B21-B23, B29."""
    return R.search_threats(_logs(spark, sf_dir), DV.AS_OF, label="tinggi", days_back=7, limit=20, keyword="9}")


@query("search_all")
def q_search_all(spark, sf_dir):
    """G3 with no label filter, unknown label ignored, look-back disabled."""
    return R.search_threats(_logs(spark, sf_dir), DV.AS_OF, label="unknown", days_back=0, limit=30, keyword="_1")


@query("latest_triage")
def q_latest_triage(spark, sf_dir):
    """G4."""
    return R.latest_triage(_logs(spark, sf_dir), 20)


@query("history")
def q_history(spark, sf_dir):
    """G5."""
    return R.history(_logs(spark, sf_dir), 25)


@query("daily_stats")
def q_daily_stats(spark, sf_dir):
    """F4."""
    return R.daily_stats(_logs(spark, sf_dir), _feedback(spark, sf_dir), DV.AS_OF)


@query("trend_pivot")
def q_trend_pivot(spark, sf_dir):
    """F5."""
    return R.trend(_logs(spark, sf_dir), DV.AS_OF, 7)


@query("dashboard_counts")
def q_dashboard_counts(spark, sf_dir):
    """F6."""
    return R.dashboard_counts(_logs(spark, sf_dir), DV.AS_OF)


def _results(spark, sf_dir):
    return _logs(spark, sf_dir).select(F.col("predicted_label").alias("label"), "entropy",
                                       F.substring_index("input_text", " ", 1).alias("source"),  # the event type
                                       F.col("arrival").alias("ord"))


@query("batch_summary")
def q_batch_summary(spark, sf_dir):
    """F7 (summary row)."""
    return R.batch_summary(_results(spark, sf_dir))[0]


@query("top_sources")
def q_top_sources(spark, sf_dir):
    """Top-3 sources by count, ties by first seen."""
    return R.batch_summary(_results(spark, sf_dir))[1]


@query("triage_tally")
def q_triage_tally(spark, sf_dir):
    """F8."""
    return R.label_distribution(_logs(spark, sf_dir), "predicted_label")


@query("latest_distribution")
def q_latest_distribution(spark, sf_dir):
    """distribution over the latest 20 sweep rows only."""
    return R.label_distribution(R.latest_triage(_logs(spark, sf_dir), 20), "label")


# --- Evaluation (F10-F15, H4, H6) -------------------------------------------
from sift.operators import evaluation as EV  # noqa: E402


def _pred(spark, sf_dir):
    return DV.predictions(spark, sf_dir)


@query("predictions")
def q_predictions(spark, sf_dir):
    """Every labelled document's text scored: true, pred, max prob, entropy, correct."""
    lab = read_table(spark, sf_dir, "labels")
    scored = SC.linear_scorer(CORPUS_MODEL)(normalize(DV.documents(spark, sf_dir).select("doc_id", "text"), "text"))
    u = S.uncertainty(F.col(SC.PROBS))
    return (lab.join(scored.select("doc_id", u.alias("u")), "doc_id")
            .select("doc_id", DV.true_label().alias("true_label"), F.col("u.label").alias("pred_label"),
                    F.array_max("u.probabilities").alias("max_prob"), F.round("u.entropy", 4).alias("entropy"))
            .withColumn("correct", F.col("true_label") == F.col("pred_label")))


@query("confusion")
def q_confusion(spark, sf_dir):
    """F10."""
    return EV.confusion(_pred(spark, sf_dir))


@query("crosstab_margins")
def q_crosstab_margins(spark, sf_dir):
    """F11."""
    return EV.crosstab_margins(_pred(spark, sf_dir))


@query("class_report")
def q_class_report(spark, sf_dir):
    """F12."""
    return EV.class_report(_pred(spark, sf_dir))


@query("kpi_gate")
def q_kpi_gate(spark, sf_dir):
    """H4."""
    return EV.kpi_gate(EV.class_report(_pred(spark, sf_dir)))


@query("error_patterns")
def q_error_patterns(spark, sf_dir):
    """F13."""
    return EV.error_patterns(_pred(spark, sf_dir))


@query("calibration")
def q_calibration(spark, sf_dir):
    """F14."""
    return EV.calibration(_pred(spark, sf_dir))


@query("histogram")
def q_histogram(spark, sf_dir):
    """20-bin entropy histogram per true label."""
    return EV.histogram(_pred(spark, sf_dir), "entropy", "true_label", 20)


@query("class_balance")
def q_class_balance(spark, sf_dir):
    """F16 on the labelled predictions' true labels (weights for H2)."""
    return C.class_weights(_pred(spark, sf_dir), "true_label").withColumn("weight", F.round("weight", 6))


# --- Tokens, transcripts, models, sources -----------------------------------
from sift.operators import tokens as TK  # noqa: E402
from sift.operators import wer as WR  # noqa: E402


def derived_token_scores(doc: str = "doc_id"):
    """A deterministic per-token score stand-in for attention weights."""
    return F.transform(X.words("text"), lambda w, i: ((F.col(doc) * 31 + i * 17) % 97) / 97.0)


@query("token_highlights")
def q_token_highlights(spark, sf_dir):
    """Top-15 min-max scaled token scores per document."""
    d = DV.documents(spark, sf_dir).select("doc_id", "text")
    d = d.withColumns({"toks": X.words("text"), "scores": derived_token_scores()})
    h = TK.highlights(d, "toks", "scores", 15)
    return h.select("doc_id", F.posexplode("highlights").alias("r", "h")).select(
        "doc_id", (F.col("r") + 1).alias("rank"), F.col("h.token").alias("token"), F.col("h.score").alias("score"))


@query("tokenizer_compare")
def q_tokenizer_compare(spark, sf_dir):
    """words vs word pieces per language."""
    return TK.tokenizer_compare(DV.documents(spark, sf_dir), "text", "lang")


def _transcript_pairs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    w = X.words("text")
    hyp = F.array_join(F.filter(F.transform(w, lambda x, i: F.when(i % 5 == 3, F.concat(x, F.lit("x"))).otherwise(x)),
                                lambda x, i: i % 7 != 6), " ")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("name"),
                    F.col("text").alias("reference"), hyp.alias("hypothesis"))


@query("wer_pairs")
def q_wer_pairs(spark, sf_dir):
    """Per-pair WER, MER, WIL, WIP and S/D/I counts."""
    p = WR.with_wer(_transcript_pairs(spark, sf_dir))
    return p.select("name", "w.wer", "w.mer", "w.wil", "w.wip", "w.hits", "w.substitutions", "w.deletions",
                    "w.insertions", "w.ref_words", "w.hyp_words", "w.error")


@query("wer_corpus")
def q_wer_corpus(spark, sf_dir):
    """Corpus mean WER and status band."""
    return WR.corpus_report(_transcript_pairs(spark, sf_dir))


from sift.operators import report_docs as RD  # noqa: E402
from sift.sources import files as SF  # noqa: E402


def _round_trip(spark, doc, schema):
    """Write the document, read it by its schema, give its values."""
    path = scratch_path(spark, "sift-report")
    SF.write_report(doc, path)
    return RD.leaves(SF.read_report(spark, path, schema))


@query("report_dataset")
def q_report_dataset(spark, sf_dir):
    """The curation report."""
    raw = DV.annotated_corpus(spark, sf_dir).select("doc_id")
    split = q_stratified_split(spark, sf_dir)
    doc = RD.dataset_report(raw, split, {"TINGGI": "violence", "WASPADA": "toxic, identity attack or insult", "AMAN": "none of these"},
                            {"min_text_length": "10", "split_method": "stratified 80/20"})
    return _round_trip(spark, doc, RD.DATASET_REPORT)


@query("report_training")
def q_report_training(spark, sf_dir):
    """Class weights, metrics, report, matrix and gates."""
    doc = RD.training_report(_curated(spark, sf_dir).select("label"), _pred(spark, sf_dir), {"epochs": "10", "batch_size": "16"})
    return _round_trip(spark, doc, RD.TRAINING_REPORT)


@query("report_selection")
def q_report_selection(spark, sf_dir):
    """The shorter report."""
    return _round_trip(spark, RD.selection_report(_pred(spark, sf_dir), {"iterations": "3"}), RD.SELECTION_REPORT)


@query("report_wer")
def q_report_wer(spark, sf_dir):
    """Manifest (a JSON object of all references) joined with the
    inventory and the hypotheses by file name, evaluated, reported. Files of turn 5 have no hypothesis."""
    pairs = _transcript_pairs(spark, sf_dir)
    manifest = pairs.select(F.to_json(F.create_map("name", "reference")).alias("value"))  # one object a line
    files = pairs.select(F.concat(F.lit("/media/"), "name").alias("path"))
    hypotheses = pairs.filter(~F.col("name").endswith("_5")).select("name", "hypothesis")
    doc, _ = RD.wer_report(WR.manifest_pairs(files, manifest, hypotheses), {"language": "mixed"})
    return _round_trip(spark, doc, RD.WER_REPORT)


@query("transcript_triage")
def q_transcript_triage(spark, sf_dir):
    """Reject short transcripts; the rest go through the whole sweep
    and, where it does not call them safe, the deep analysis (D14)."""
    from sift.operators.triage import deep_triage, transcript_gate
    c = read_table(spark, sf_dir, "conversations").withColumn("tid", F.col("conv_id") * 100 + F.col("turn"))
    g = transcript_gate(c, "text", 5)
    t = batch_triage(g.filter("reject_reason IS NULL"), SC.linear_scorer(CORPUS_MODEL), lexicon=DV.CORPUS_LEXICON,
                     action_patterns=DV.CORPUS_ACTION_PATTERNS, urgency_patterns=DV.CORPUS_URGENCY_PATTERNS)
    deep = deep_triage(t, c.select("tid", DV.expert_reply_text("tid").alias("reply")), "tid")
    none = F.lit(None).cast("string")
    safe = t.filter(F.col("label") == "AMAN")
    cols = ["conv_id", "turn"]
    return (g.filter("reject_reason IS NOT NULL").select(*cols, "reject_reason", none.alias("label"), none.alias("final_label"))
            .unionByName(safe.select(*cols, "reject_reason", "label", none.alias("final_label")))
            .unionByName(deep.select(*cols, "reject_reason", "label", "final_label")))


@query("strip_html")
def q_strip_html(spark, sf_dir):
    """B17-B20 over raw pages: tag strip, title, preview, length guard."""
    p = read_table(spark, sf_dir, "pages")
    body = X.strip_html("html")
    d = p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("body"))
    d = d.withColumn("clean", X.collapse_ws("body"))
    return d.select("page_id", "title", F.length("body").alias("n_chars"),
                    F.concat(F.substring("clean", 1, 100), F.lit("...")).alias("preview"),
                    (F.length("clean") > 20).alias("keep"), F.sha2("clean", 256).alias("clean_hash"))


def _requests(spark, sf_dir):
    from sift.operators.store import request_key
    return request_key(DV.documents(spark, sf_dir).select("doc_id", "lang", "source"), ["source", "lang"])


@query("cache_lookup")
def q_cache_lookup(spark, sf_dir):
    """Request key = sha256 of sorted-key JSON; hits vs misses
    against a cache holding the requests of even documents."""
    req = _requests(spark, sf_dir)
    cache = req.filter(F.col("doc_id") % 2 == 0).groupBy("cache_key").agg(F.min("doc_id").cast("string").alias("response"))
    return ST.cache_lookup(req, cache).select("doc_id", "cache_key", "hit")


@query("cache_write_back")
def q_cache_write_back(spark, sf_dir):
    """Two batches (documents of under 1,000 characters, then all) answered through
    an empty cache: each distinct request is computed once, the second batch finds the first's."""
    path = scratch_path(spark, "sift-cache")
    chars = DV.documents(spark, sf_dir).select("doc_id", "n_chars")
    req = _requests(spark, sf_dir).join(chars, "doc_id")
    answer = lambda batch: lambda missing: missing.select(
        "cache_key", F.concat_ws("/", F.upper("lang"), F.reverse("source"), F.lit(batch)).alias("response"))
    first = ST.read_through(req.filter("n_chars < 1000"), path, "1", answer("first"), ["lang", "source"])
    second = ST.read_through(req, path, "2", answer("second"), ["lang", "source"])
    cols = ["doc_id", "response", "hit"]
    return first.select(F.lit(1).alias("batch"), *cols).unionByName(second.select(F.lit(2).alias("batch"), *cols))


@query("source_fallback")
def q_source_fallback(spark, sf_dir):
    """A10: per target (lang), primary rows if any, else secondary rows."""
    from sift.sources.collect import fallback
    d = DV.documents(spark, sf_dir)
    primary = d.filter((F.col("n_chars") % 2 == 0) & (F.col("lang") != "es")).select(
        "doc_id", F.col("lang").alias("target"), F.lit("primary").alias("origin"))
    secondary = d.filter((F.col("n_chars") % 2 == 1) | (F.col("lang") == "es")).select(
        "doc_id", F.col("lang").alias("target"), F.lit("secondary").alias("origin"))
    return fallback(primary, secondary, "target")


@query("feed_posts")
def q_feed_posts(spark, sf_dir):
    """RSS and Atom payloads made of all pages -> posts, with a key."""
    from sift.sources import collect as CO
    items = CO.feed_items(DV.feed_payloads(read_table(spark, sf_dir, "pages")))
    posts = CO.rss_posts(items, "pages", "feed").unionByName(CO.forum_posts(items, "forum", "feed"))
    return CO.with_post_id(posts).select("page_id", "kind", "ord", "source", "url", F.length("text").alias("n_chars"),
                                         F.sha2("text", 256).alias("text_hash"), "post_id")


@query("union_clean")
def q_union_clean(spark, sf_dir):
    """Documents + conversations + pages unioned, blank texts
    dropped, missing source/url defaulted."""
    from sift.sources.collect import union_clean
    d = DV.documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("post_id"),
                                          "text", "source")
    c = read_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("post_id"),
        "text")
    p = read_table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("post_id"),
                                                  X.strip_html("html").alias("text"), "url")
    u = union_clean([d, c, p])
    return u.select("post_id", "source", "url", F.sha2("text", 256).alias("text_hash"))


@query("train_eval")
def q_train_eval(spark, sf_dir):
    """Fit on the balanced training split of the normalised texts, report on the test split."""
    from sift.operators import ml as ML
    cur = _training_corpus(spark, sf_dir)
    split = SM.stratified_split(cur, "label", "text_id", 0.2, DV.SEED)
    train = SM.balanced_sample(split.filter(F.col("split") == "train"), "label", "text_id", 200, DV.SEED,
                               source_col="sample_source")
    model = ML.train_classifier(train, "text", max_iter=30)
    return EV.class_report(ML.predictions(model, split.filter(F.col("split") == "test")))


def _training_corpus(spark, sf_dir):
    """The curated corpus with its normalised text."""
    return normalize(_curated(spark, sf_dir), "text").select("text_id", F.col("normalized_text").alias("text"), "label")


@query("model_selection")
def q_model_selection(spark, sf_dir):
    """H2: candidates of class-weighted training with their weighted F1 on the validation split."""
    from sift.operators import ml as ML
    _, tried = ML.select_model(_training_corpus(spark, sf_dir), "text_id", max_iter=15, num_features=1 << 14)
    return spark.createDataFrame(tried, "reg_param double, weighted_f1 double, chosen boolean")


@query("retrain_report")
def q_retrain_report(spark, sf_dir):
    """H5: gate, corrections, balanced sample, fit; the new model's report on the corrected corpus."""
    from sift.operators import ml as ML
    # written once: the sample reads them three times, the gate and the report once more
    corpus, feedback = stored(_training_corpus(spark, sf_dir), "sift-corpus"), stored(_feedback(spark, sf_dir), "sift-feedback")
    model = ML.retrain_from_feedback(corpus, feedback, "text_id", max_iter=15, num_features=1 << 14)
    fixed = ST.apply_feedback(corpus, feedback, "text_id")
    return EV.class_report(ML.predictions(model, fixed))


@query("pca_2d")
def q_pca_2d(spark, sf_dir):
    """Centred 2-D projection of the embeddings."""
    from sift.operators import ml as ML
    e = read_table(spark, sf_dir, "embeddings")
    out, _ = ML.pca_2d(e, "embedding")
    return out.select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("embedding_norms")
def q_embedding_norms(spark, sf_dir):
    """Unit-normalised vectors attached to their rows (norm check)."""
    from sift.operators import ml as ML
    e = ML.unit_vectors(read_table(spark, sf_dir, "embeddings"), "embedding")
    sq = lambda c: F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", "label", F.round(F.sqrt(sq("embedding")), 6).alias("norm"), F.round(sq("unit"), 6).alias("unit_norm_sq"))


# --- Readers over payloads that Spark lands from the tables (A1-A6, A9, E7) --------
from sift.sources import collect as CO  # noqa: E402


@query("annotated_snapshot")
def q_annotated_snapshot(spark, sf_dir):
    """A1, A2: the annotated corpus written as a snapshot and read by its schema."""
    path = scratch_path(spark, "sift-annotated")
    SF.write_snapshot(DV.annotated_corpus(spark, sf_dir).drop("doc_id"), path)
    a = SF.read_annotated(spark, path)
    return C.label_corpus(a).select("text_id", "topic", "label", F.array_join("toxicity", ",").alias("toxicity"), F.sha2("text", 256).alias("text_hash"))


@query("corpus_csv")
def q_corpus_csv(spark, sf_dir):
    """A3, A4: both splits of the curated corpus written as CSV (newlines, quotes and edge
    spaces kept), partitioned by split, and read by its schema."""
    cur = _curated(spark, sf_dir)
    split = SM.stratified_split(cur.select("text_id", "label"), "label", "text_id", 0.2, DV.SEED).select("text_id", "split")
    path = scratch_path(spark, "sift-csv")
    SF.write_corpus(cur.join(split, "text_id"), path, "csv", "split")
    back = SF.read_corpus_csv(spark, path)
    return back.select("text_id", "label", "split", "topic", "toxicity_agg", "text_hash", F.sha2("text", 256).alias("raw_hash"))


@query("uploads")
def q_uploads(spark, sf_dir):
    """A5: each text as an uploaded CSV cell and as lines of an uploaded TXT."""
    d = DV.documents(spark, sf_dir).select("text")
    csv, txt = scratch_path(spark, "sift-upload-csv"), scratch_path(spark, "sift-upload-txt")
    SF.write_corpus(d, csv, "csv")
    d.select("text").write.text(txt)
    cells, lines = CO.uploaded_texts(spark, csv, "csv", "cells"), CO.uploaded_texts(spark, txt, "txt", "lines")
    return cells.unionByName(lines).groupBy("source", F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("forum_listing")
def q_forum_listing(spark, sf_dir):
    """A listing per document (title: its first words, selftext: the rest or empty)."""
    d = DV.documents(spark, sf_dir)
    child = F.struct(F.struct(F.substring("text", 1, 20).alias("title"), F.when(F.col("doc_id") % 3 > 0, F.substring("text", 21, 300)).alias("selftext"),
                              F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("/p/"), F.col("doc_id").cast("string"))).alias("permalink")).alias("data"))
    path = scratch_path(spark, "sift-listing")
    d.select(F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data"))).alias("value")).write.text(path)
    posts = CO.forum_listing(spark, path, "https://forum", "https://forum/new")
    return posts.select("source", "url", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@query("video_comments")
def q_video_comments(spark, sf_dir):
    """A video per conversation and its turns as comments; videos without an id of their own drop out."""
    c = read_table(spark, sf_dir, "conversations")
    vid = F.concat(F.lit("v"), F.col("conv_id").cast("string"))
    videos, comments = scratch_path(spark, "sift-videos"), scratch_path(spark, "sift-comments")
    c.select("conv_id").distinct().filter("conv_id % 7 <> 6").select(F.to_json(F.struct(
        F.struct(vid.alias("videoId")).alias("id"), F.struct(F.lit("t").alias("title")).alias("snippet"))).alias("value")).write.text(videos)
    text = F.concat(F.lit("<b>"), F.col("role"), F.lit("</b> "), F.substring("text", 1, 200))
    item = F.struct(F.struct(F.struct(F.struct(text.alias("textDisplay")).alias("snippet")).alias("topLevelComment")).alias("snippet"))
    c.select(F.to_json(F.struct(vid.alias("video_id"), F.array(item).alias("items"))).alias("value")).write.text(comments)
    out = CO.comment_threads(spark, videos, comments)
    return out.select("source", "url", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


# --- Single operators on texts, briefs and vectors --------------------------------

@query("script_signals")
def q_script_signals(spark, sf_dir):
    """C4: documents followed by up to 60 Arabic words."""
    d = DV.documents(spark, sf_dir).select("doc_id", F.concat(
        F.substring("text", 1, 400), F.repeat(F.lit(" مرحبا"), (F.col("doc_id") % 61).cast("int"))).alias("text"))
    s = X.with_script_mix(d, "text", "mix").select("doc_id", SG.script_signal(F.col("mix.ar")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.try_element_at("s", F.lit(1))["extracted_text"].alias("extracted"),
                    F.try_element_at("s", F.lit(1))["significance"].alias("significance"))


@query("title_body")
def q_title_body(spark, sf_dir):
    """Title and tag-stripped body of every page."""
    p = read_table(spark, sf_dir, "pages")
    text = X.title_body(F.regexp_extract("html", "<title>([^<]*)</title>", 1), X.strip_html("html"))
    return p.select("page_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_hash"))


@query("flat_briefs")
def q_flat_briefs(spark, sf_dir):
    """Nested briefs of the escalated documents, flattened, with the shown recommendation and risk band."""
    d = _deep(spark, sf_dir).filter("parse_ok")
    brief = F.struct(F.struct(F.col("final_label").alias("label"), F.col("final_confidence").alias("confidence"), F.col("final_entropy").alias("entropy")).alias("classification"),
                     F.col("risk_score"), F.col("recommendation"), F.col("expert.summary_narrative").alias("summary_narrative"), F.col("ambiguity_notes"),
                     F.col("signals").alias("signals_detected"))
    flat = FU.flatten_brief(d.select("doc_id", brief.alias("brief")))
    return flat.select("doc_id", "label", "confidence", "entropy", "risk_score", S.risk_band("risk_score").alias("risk_band"),
                       S.shown_recommendation("recommendation").alias("shown"), "summary", "ambiguity", F.size("signals").alias("n_signals"))


@query("seeded_shuffle")
def q_seeded_shuffle(spark, sf_dir):
    """Every document in seeded order."""
    return SM.seeded_shuffle(DV.documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", DV.SEED)


@query("attached_vectors")
def q_attached_vectors(spark, sf_dir):
    """Unit vectors attached to documents by id; documents without one keep a null."""
    from sift.operators import ml as ML
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = ML.attach_vectors(DV.documents(spark, sf_dir).select("doc_id"), e, "doc_id", "vec_id")
    return out.select("doc_id", F.size("unit").alias("dim"), F.round(F.element_at("unit", 1), 6).alias("first"))


@query("layout_fallback")
def q_layout_fallback(spark, sf_dir):
    """D11 without vectors: entropy against text length, with the label."""
    from sift.operators import ml as ML
    return ML.layout_2d(_triage_docs(spark, sf_dir), "doc_id").select("doc_id", "x", "y", "label")


@query("pca_variance")
def q_pca_variance(spark, sf_dir):
    """Share of the variance of each of the two components."""
    from sift.operators import ml as ML
    _, model = ML.pca_2d(read_table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(i + 1, round(float(v), 6)) for i, v in enumerate(model.explainedVariance)], "component int, ratio double")


@query("histogram_max_prob")
def q_histogram_max_prob(spark, sf_dir):
    """20-bin histogram of the highest probability."""
    return EV.histogram(_pred(spark, sf_dir), "max_prob", None, 20)


@query("quartiles")
def q_quartiles(spark, sf_dir):
    """quartiles of the entropy by correctness."""
    return EV.quartiles(_pred(spark, sf_dir), "entropy", "correct")


@query("error_examples")
def q_error_examples(spark, sf_dir):
    """the first five wrong predictions."""
    return EV.error_examples(_pred(spark, sf_dir), "doc_id", 5).select("doc_id", "true_label", "pred_label", "entropy")
