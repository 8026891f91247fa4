"""DuckDB oracle SQL for the registered queries (same names, same columns).

Views available: the driver tables (documents, labels, events, pages,
conversations, embeddings, benchmark, ...).
"""

from __future__ import annotations

from sift.plans import derive as DV
from sift.plans import sqlx as Q
from sift.schemas import SUBLABEL_COLUMNS

ORACLES: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn()
        return fn
    return deco


def _normalized(x: str) -> str:
    return Q.collapse_ws(Q.mentions_hashtags(Q.slang_map(Q.emoji_fold(Q.strip_urls(x)))))


def _triage_cte(source: str = "documents", key: str = "doc_id") -> str:
    """base, scored (p from the text's tokens) and u (uncertainty of p)."""
    sig = Q.all_signals("text", DV.CORPUS_LEXICON, DV.CORPUS_ACTION_PATTERNS, DV.CORPUS_URGENCY_PATTERNS,
                        Q.script_mix("text")[1])
    return f"""
WITH base AS (
  SELECT *, {sig} AS signals, {_normalized('text')} AS nt
  FROM {source}
), {Q.text_scores('base', key, 'nt', DV.CORPUS_BIAS)}, u AS (
  SELECT *, {', '.join(f'{v} AS u_{k}' for k, v in Q.uncertainty_cols('p').items())} FROM scored
)"""


def _scores_only(weights: str | None = None) -> str:
    return f"""
WITH base AS (SELECT doc_id, {_normalized('text')} AS nt FROM documents),
{Q.text_scores('base', 'doc_id', 'nt', DV.CORPUS_BIAS, weights)}
SELECT doc_id, p[1] AS p_aman, p[2] AS p_waspada, p[3] AS p_tinggi FROM scored"""


@oracle("score_text")
def _():
    return _scores_only()


@oracle("score_external")
def _():
    return _scores_only()


@oracle("score_vocabulary")
def _():
    return _scores_only(DV.VOCABULARY_WEIGHTS_SQL)


@oracle("batch_triage")
def _():
    from sift.functions.text import URL_RE
    return _triage_cte() + f"""
SELECT doc_id, substring(sha256(text), 1, 16) AS id, u_label AS label, u_confidence AS confidence,
  round(u_entropy, 4) AS entropy,
  u_probabilities[1] AS p_aman, u_probabilities[2] AS p_waspada, u_probabilities[3] AS p_tinggi,
  array_to_string(u_prediction_set, ',') AS prediction_set, CAST(len(u_prediction_set) AS INTEGER) AS set_size,
  len(u_prediction_set) > 1 AS is_ambiguous,
  CAST(len(signals) AS INTEGER) AS signal_count, {Q.signal_types('signals')} AS signal_types,
  CAST(len({Q.words('nt')}) AS INTEGER) AS token_count, nt AS normalized_text,
  array_to_string(regexp_extract_all(text, {Q.q(URL_RE)}), ' ') AS urls, sha256(substring(text, 1, 200)) AS preview_hash
FROM u"""


@oracle("normalize_text")
def _():
    t1 = Q.strip_urls("text")
    emo = Q.emoji_fold(t1)
    from sift import dictionaries as D
    has = Q.has_any(t1, [e for e, _ in D.EMOJI])
    norm = Q.collapse_ws(Q.mentions_hashtags(Q.slang_map(emo)))
    mi, ma, mo = Q.script_mix("text")
    from sift.functions.text import URL_RE
    return f"""
WITH d AS ({DV.DOCS_WITH_ARTEFACTS_SQL}), n AS (
  SELECT *, {norm} AS normalized_text FROM d)
SELECT doc_id, normalized_text, CAST(len({Q.words('normalized_text')}) AS INTEGER) AS token_count,
  sha256(text) AS content_hash, substring(sha256(text), 1, 16) AS doc_key,
  {mi} AS lang_id, {ma} AS lang_ar, {mo} AS lang_other, {has} AS has_emoji,
  CAST(len(regexp_extract_all(text, {Q.q(URL_RE)})) AS INTEGER) AS n_urls,
  array_to_string(regexp_extract_all(text, {Q.q(URL_RE)}), ' ') AS urls
FROM n"""


@oracle("lexicon_signals")
def _():
    s = Q.lexicon_signals("text", DV.CORPUS_LEXICON)
    return f"""
WITH s AS (SELECT doc_id, {s} AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_lexicon,
  array_to_string(list_transform(s, lambda e: e.extracted_text), ',') AS terms,
  array_to_string(list_transform(s, lambda e: e.significance), ',') AS levels
FROM s"""


@oracle("pattern_signals")
def _():
    a = Q.action_signals("text", DV.CORPUS_ACTION_PATTERNS)
    u = Q.urgency_signals("text", DV.CORPUS_URGENCY_PATTERNS)
    return f"""
WITH s AS (SELECT doc_id, {a} AS a, {u} AS u FROM documents)
SELECT doc_id, CAST(len(a) AS INTEGER) AS n_action, CAST(len(u) AS INTEGER) AS n_urgency,
  array_to_string(list_transform(a, lambda e: e.extracted_text), ' | ') AS action_texts,
  array_to_string(list_transform(u, lambda e: e.extracted_text), ' | ') AS urgency_texts,
  array_to_string(list_transform(u, lambda e: e.context_explanation), ' | ') AS urgency_context
FROM s"""


@oracle("lexicon_large")
def _():
    return f"""
WITH lex AS ({DV.CORPUS_LEXICON_SQL}),
hit AS (SELECT doc_id, ord, term, CASE ord % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS level
  FROM documents JOIN lex ON contains(lower(text), lower(term))),
g AS (SELECT doc_id, COUNT(*) AS n, string_agg(term, ',' ORDER BY ord) AS terms, string_agg(level, ',' ORDER BY ord) AS levels FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_lexicon, sha256(coalesce(terms, '')) AS terms_hash, sha256(coalesce(levels, '')) AS levels_hash
FROM documents d LEFT JOIN g USING (doc_id)"""


@oracle("patterns_large")
def _():
    low = "lower(text)"
    start = f"length(regexp_extract({low}, '(?s)^(.*?)(?:' || pattern || ')', 1))"
    mlen = f"length(regexp_extract({low}, '(?s)^.*?(' || pattern || ')', 1))"
    win = lambda b, a: Q.strip_u(f"substring(text, greatest(s - {b}, 0) + 1, least(s + m + {a}, length({low})) - greatest(s - {b}, 0))")
    return f"""
WITH two AS ({DV.TWO_WORDS_SQL}), pat AS ({DV.CORPUS_PATTERNS_SQL}),
hit AS (SELECT doc_id, text, ord, {start} AS s, {mlen} AS m
  FROM documents JOIN pat ON contains({low}, a) AND regexp_matches({low}, pattern)),
g AS (SELECT doc_id, COUNT(*) AS n, string_agg({win(20, 40)}, '|' ORDER BY ord) AS a,
  string_agg(substring({low}, s + 1, m), '|' ORDER BY ord) AS u FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_action, CAST(coalesce(n, 0) AS INTEGER) AS n_urgency,
  sha256(coalesce(a, '')) AS action_hash, sha256(coalesce(u, '')) AS urgency_hash
FROM documents d LEFT JOIN g USING (doc_id)"""


@oracle("slang_large")
def _():
    return f"""
WITH slang AS ({DV.CORPUS_SLANG_SQL}),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (
  SELECT doc_id, {Q.words(Q.emoji_fold(Q.strip_urls('text')))} AS ws FROM documents)),
m AS (SELECT doc_id, string_agg(coalesce(rep, w), ' ' ORDER BY pos) FILTER (WHERE coalesce(rep, w) <> '') AS t
  FROM w LEFT JOIN slang ON slang.token = lower(w) GROUP BY doc_id),
n AS (SELECT d.doc_id, {Q.collapse_ws(Q.mentions_hashtags("coalesce(t, '')"))} AS normalized_text FROM documents d LEFT JOIN m USING (doc_id))
SELECT doc_id, normalized_text, CAST(len({Q.words('normalized_text')}) AS INTEGER) AS token_count FROM n"""


def _signals_cte() -> str:
    sig = Q.all_signals("text", DV.CORPUS_LEXICON, DV.CORPUS_ACTION_PATTERNS, DV.CORPUS_URGENCY_PATTERNS,
                        Q.script_mix("text")[1])
    return f"WITH s AS (SELECT doc_id, {sig} AS signals FROM documents)"


@oracle("signal_rollup")
def _():
    return _signals_cte() + """
SELECT x.signal_type, x.significance, COUNT(*) AS n
FROM (SELECT unnest(signals) AS x FROM s) GROUP BY 1, 2"""


@oracle("signal_summary")
def _():
    return _signals_cte() + f"""
SELECT doc_id, CAST(len(signals) AS INTEGER) AS signal_count, {Q.signal_types('signals')} AS signal_types FROM s"""


def _vote(c: str) -> str:
    ones = f"coalesce(list_sum(list_transform({c}, lambda v: TRY_CAST(v AS INTEGER))), 0)"
    return f"CAST(CASE WHEN {ones} * 2 > len({c}) THEN 1 ELSE 0 END AS INTEGER)"


def _label_sql() -> str:
    return (f"CASE WHEN {_vote('is_noise_or_spam_text')} = 1 THEN 'SKIP' "
            f"WHEN {_vote('threat_incitement_to_violence')} = 1 THEN 'TINGGI' "
            f"WHEN {_vote('toxicity')} = 1 OR {_vote('identity_attack')} = 1 OR {_vote('insults')} = 1 THEN 'WASPADA' "
            f"ELSE 'AMAN' END")


@oracle("majority_labels")
def _():
    aggs = ", ".join(f"{_vote(c)} AS {c}_agg" for c in SUBLABEL_COLUMNS)
    return f"WITH a AS ({DV.ANNOTATED_SQL}) SELECT doc_id, {_label_sql()} AS label, {aggs} FROM a"


def _curated_cte() -> str:
    aggs = ", ".join(f"{_vote(c)} AS {c}_agg" for c in SUBLABEL_COLUMNS)
    return f"""
WITH a AS ({DV.ANNOTATED_SQL}),
l AS (SELECT *, {_label_sql()} AS label FROM a),
f AS (SELECT *, {Q.text_hash('text')} AS text_hash FROM l WHERE label <> 'SKIP' AND length(text) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS rn FROM f),
cur AS (SELECT text_id, text, label, text_hash, topic, {aggs} FROM r WHERE rn = 1)"""


@oracle("curated_corpus")
def _():
    return _curated_cte() + " SELECT * FROM cur"


@oracle("dedup_documents")
def _():
    return f"""
WITH f AS (SELECT doc_id, source, {Q.text_hash('text')} AS text_hash FROM documents WHERE length(text) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) AS rn FROM f)
SELECT doc_id, text_hash, source FROM r WHERE rn = 1"""


@oracle("class_distribution")
def _():
    return _curated_cte() + """,
c AS (SELECT label, COUNT(*) AS n FROM cur GROUP BY label)
SELECT label, n, round(n * 100.0 / SUM(n) OVER (), 1) AS pct, CAST(SUM(n) OVER () AS BIGINT) AS total FROM c"""


@oracle("class_weights")
def _():
    return _curated_cte() + """,
c AS (SELECT label, COUNT(*) AS n_c FROM cur GROUP BY label)
SELECT label, n_c, round(SUM(n_c) OVER () / (COUNT(*) OVER () * n_c), 6) AS weight FROM c"""


@oracle("source_counts")
def _():
    return _curated_cte() + " SELECT label, topic, COUNT(*) AS n FROM cur GROUP BY label, topic"


@oracle("min_class_count")
def _():
    return _curated_cte() + """,
c AS (SELECT label, COUNT(*) AS n FROM cur GROUP BY label)
SELECT MIN(n) AS min_class_count, MIN(n) < 2 AS warn FROM c"""


# --- Sampling ----------------------------------------------------------------
def _ranked_cur() -> str:
    return _curated_cte() + """,
h AS (SELECT text_id, label, sha256(text_id || ':42') AS h FROM cur),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, text_id) AS rn,
              COUNT(*) OVER (PARTITION BY label) AS n_c FROM h)"""


@oracle("stratified_split")
def _():
    return _ranked_cur() + """
SELECT text_id, label, CASE WHEN rn <= round(0.2 * n_c) THEN 'test' ELSE 'train' END AS split FROM rk"""


@oracle("split_counts")
def _():
    return _ranked_cur() + """,
s AS (SELECT label, CASE WHEN rn <= round(0.2 * n_c) THEN 'test' ELSE 'train' END AS split FROM rk)
SELECT split, label, COUNT(*) AS n FROM s GROUP BY split, label"""


@oracle("balanced_sample")
def _():
    return _ranked_cur() + """,
picked AS (SELECT text_id, label, 'original' AS source, 0 AS copy FROM rk WHERE rn <= 200),
short AS (SELECT *, (200 - n_c) // n_c + CASE WHEN rn <= (200 - n_c) % n_c THEN 1 ELSE 0 END AS copies
          FROM rk WHERE n_c < 200),
extra AS (SELECT text_id, label, 'oversampled' AS source, CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy
          FROM short WHERE copies > 0)
SELECT text_id, label, source, CAST(copy AS INTEGER) AS copy FROM picked UNION ALL SELECT * FROM extra"""


@oracle("capped_sample")
def _():
    return _ranked_cur() + " SELECT text_id, label FROM rk WHERE rn <= 50"


@oracle("positional_split")
def _():
    return """
WITH h AS (SELECT doc_id, lang, sha256(CAST(doc_id AS VARCHAR) || ':42') AS h FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rn, COUNT(*) OVER () AS n FROM h)
SELECT doc_id, lang, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM r"""


# --- Uncertainty and fusion ------------------------------------------------
@oracle("uncertainty")
def _():
    u = Q.uncertainty_cols("p")
    return f"""
WITH b AS (SELECT doc_id, {DV.derived_probs_sql('doc_id')} AS p FROM documents),
u AS (SELECT doc_id, {u['label']} AS label, {u['confidence']} AS confidence, {u['entropy']} AS entropy,
             {u['prediction_set']} AS pset FROM b)
SELECT doc_id, label, confidence, round(entropy, 4) AS entropy, array_to_string(pset, ',') AS prediction_set,
  CAST(len(pset) AS INTEGER) AS set_size, len(pset) > 1 AS is_ambiguous,
  CAST(list_position(['AMAN','WASPADA','TINGGI'], label) - 1 AS INTEGER) AS label_code,
  CASE WHEN (doc_id * 7) % 101 <= 30 THEN 'low' WHEN (doc_id * 7) % 101 <= 60 THEN 'medium' ELSE 'high' END AS risk_band,
  label <> 'AMAN' AS escalate
FROM u"""


def _fused_cte(b: str | None = None, keep: str = "doc_id") -> str:
    """Fusion of ``loc`` with ``ex`` and ``el``, columns of the query ``b``; ``keep`` goes through."""
    fused = Q.fuse("loc", "ex")
    bumped = "[fz[1], fz[2], greatest(fz[3], 0.5)]"
    b = b or f"""WITH b AS (SELECT doc_id, {DV.derived_probs_sql('doc_id')} AS loc, {DV.expert_probs_sql('doc_id')} AS ex,
                  {DV.expert_label_sql('doc_id')} AS el FROM documents)"""
    return f"""
{b},
f1 AS (SELECT *, {fused} AS fz FROM b),
f2 AS (SELECT *, {Q.argmax_label('fz')} AS lab FROM f1),
f3 AS (SELECT *, coalesce(el = 'TINGGI' AND lab <> 'TINGGI' AND loc IS NOT NULL AND ex IS NOT NULL, false) AS ov FROM f2),
f4 AS (SELECT *, CASE WHEN ov THEN {Q.renormalize(bumped, guard_zero=False)} ELSE fz END AS fin FROM f3),
f AS (SELECT {keep}, CASE WHEN loc IS NULL THEN ex WHEN ex IS NULL THEN loc ELSE fin END AS pr,
             CASE WHEN loc IS NULL THEN el WHEN ex IS NULL THEN {Q.argmax_label('loc')} WHEN ov THEN 'TINGGI' ELSE lab END AS label,
             ov FROM f4)"""


@oracle("fuse_scores")
def _():
    return _fused_cte() + f"""
SELECT doc_id, label, pr[1] AS p_aman, pr[2] AS p_waspada, pr[3] AS p_tinggi,
  round(CASE WHEN pr IS NOT NULL THEN {Q.entropy('pr')} END, 4) AS entropy, array_to_string({Q.prediction_set('pr')}, ',') AS prediction_set,
  {Q.confidence('pr')} AS confidence, ov AS overridden
FROM f"""


def _reply_cte() -> str:
    ep = DV.expert_probs_sql("doc_id")
    phrases = ("'; '.join")  # noqa: F841 (documentation only)
    digest = "'''a'' (AMAN); ''b'' (TINGGI); ''c'' (AMAN); ''d'' (WASPADA); ''e'' (AMAN)'"
    note = ("CASE WHEN doc_id % 7 = 0 THEN 'short' ELSE 'note about doc ' || CAST(doc_id AS VARCHAR) END")
    return f"""
WITH r AS (SELECT doc_id, doc_id % 9 <> 4 AS parse_ok, {DV.expert_label_sql('doc_id')} AS label,
                  {ep} AS pr, CAST((doc_id * 17) % 111 AS BIGINT) AS risk_score,
                  CASE WHEN doc_id % 3 = 0 THEN 'ESCALATE' WHEN doc_id % 3 = 1 THEN 'MONITOR' ELSE 'ARCHIVE' END AS recommendation,
                  {note} AS note,
                  CASE WHEN doc_id % 2 = 0 THEN {note} ELSE {note} || chr(10) || chr(10) || '[Key phrases: ' || {digest} || ']' END AS ambiguity
           FROM documents)"""


def _violations_sql(label: str, pr: str, rec: str, risk: str, note: str) -> str:
    tot = f"list_reduce(list_prepend(0.0::DOUBLE, {pr}), lambda a, b: a + b)"
    checks = [
        f"CASE WHEN NOT coalesce({label} IN ('AMAN','WASPADA','TINGGI'), false) THEN 'label' END",
        f"CASE WHEN NOT coalesce({tot} >= 0.99 AND {tot} <= 1.01, false) THEN 'probability_sum' END",
        f"CASE WHEN NOT coalesce({rec} IN ('ARCHIVE','MONITOR','ESCALATE'), false) THEN 'recommendation' END",
        f"CASE WHEN NOT coalesce({risk} >= 0 AND {risk} <= 100, false) THEN 'risk_score' END",
        f"CASE WHEN NOT coalesce(length({Q.strip_u(note)}) >= 10, false) THEN 'ambiguity_notes' END",
    ]
    return f"array_to_string(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL), ',')"


@oracle("parse_replies")
def _():
    v = _violations_sql("label", "pr", "recommendation", "risk_score", "note")
    return _reply_cte() + f"""
SELECT doc_id, parse_ok,
  CASE WHEN parse_ok THEN label END AS label, CASE WHEN parse_ok THEN risk_score END AS risk_score,
  CASE WHEN parse_ok THEN recommendation END AS recommendation, CASE WHEN parse_ok THEN ambiguity END AS ambiguity,
  CASE WHEN parse_ok THEN {v} END AS violations
FROM r"""


def _reply_rows(key: str, source: str) -> str:
    """Replies derived from ids: parse_ok, label, pr, risk_score, recommendation, note."""
    return (f"SELECT {key} AS k, {key} % 9 <> 4 AS parse_ok, {DV.expert_label_sql(key)} AS label, {DV.expert_probs_sql(key)} AS pr, "
            f"CAST(({key} * 17) % 111 AS BIGINT) AS risk_score, "
            f"CASE WHEN {key} % 3 = 0 THEN 'ESCALATE' WHEN {key} % 3 = 1 THEN 'MONITOR' ELSE 'ARCHIVE' END AS recommendation, "
            f"CASE WHEN {key} % 7 = 0 THEN 'short' ELSE 'note about doc ' || CAST({key} AS VARCHAR) END AS note FROM {source}")


def _deep_cte(source: str = "documents", key: str = "doc_id", more: str = "") -> str:
    """u (the sweep) and ``f``: escalated rows fused with their replies; a reply that
    fails to parse leaves the local score alone."""
    b = _triage_cte(source, key) + f""",
r AS ({_reply_rows(key, source)}),
b AS (SELECT u.{key}, u.u_label AS sweep_label, text, u.p AS loc, CASE WHEN r.parse_ok THEN r.pr END AS ex,
        CASE WHEN r.parse_ok THEN r.label END AS el, r.parse_ok, r.risk_score, r.recommendation, r.note {more}
      FROM u JOIN r ON r.k = u.{key} WHERE u.u_label <> 'AMAN')"""
    return _fused_cte(b, f"{key}, sweep_label, text, parse_ok, risk_score, recommendation, note {more}")


def _checked_cte() -> str:
    v = _violations_sql("label", "pr", "recommendation", "risk_score", "note")
    rows = _reply_rows("doc_id", "documents").replace(f"{DV.expert_probs_sql('doc_id')} AS pr",
                                                      f"CASE WHEN doc_id % 10 = 3 THEN [5.0, 3.0, 3.0] ELSE {DV.expert_probs_sql('doc_id')} END AS pr")
    return f"""
WITH r AS ({rows}),
c AS (SELECT k AS doc_id, CASE WHEN parse_ok THEN {v} ELSE 'parse' END AS reasons, CASE WHEN parse_ok THEN risk_score END AS risk_score FROM r)"""


@oracle("quarantine")
def _():
    return _checked_cte() + " SELECT doc_id, CASE WHEN reasons = '' THEN 'valid' ELSE 'bad' END AS status, reasons, risk_score FROM c"


@oracle("quarantine_counts")
def _():
    return _checked_cte() + """,
n AS (SELECT unnest(['valid', 'bad', 'parse', 'label', 'probability_sum', 'confidence', 'recommendation', 'risk_score', 'ambiguity_notes', 'signals']) AS name),
g AS (SELECT name, (SELECT COUNT(*) FROM c WHERE (name = 'valid' AND reasons = '') OR (name = 'bad' AND reasons <> '')
  OR list_contains(string_split(reasons, ','), name)) AS observed FROM n)
SELECT name, observed, observed AS written FROM g"""


@oracle("array_replies")
def _():
    return """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 <= 2 THEN list_slice(string_split(text, ' '), 1, 6) WHEN doc_id % 7 = 3 THEN [] END AS a FROM documents)
SELECT doc_id, a IS NOT NULL AS accepted, CAST(len(a) AS INTEGER) AS n, CASE WHEN a IS NOT NULL THEN sha256(coalesce(array_to_string(a, '|'), '')) END AS items_hash FROM a"""


@oracle("curation_counts")
def _():
    return _curated_cte() + """
SELECT 'rows' AS name, COUNT(*) AS n FROM l UNION ALL SELECT 'skipped', COUNT(*) FROM l WHERE label = 'SKIP'
UNION ALL SELECT 'too_short', COUNT(*) FROM l WHERE label <> 'SKIP' AND length(text) < 10
UNION ALL SELECT 'kept', COUNT(*) FROM f UNION ALL SELECT 'written', COUNT(*) FROM cur"""


@oracle("deep_triage")
def _():
    v = _violations_sql("label", "pr", "recommendation", "risk_score", "note")
    return _deep_cte() + f"""
SELECT doc_id, sweep_label AS label, parse_ok, label AS final_label,
  round(CASE WHEN pr IS NOT NULL THEN {Q.entropy('pr')} END, 4) AS final_entropy,
  array_to_string({Q.prediction_set('pr')}, ',') AS final_set, {Q.confidence('pr')} AS final_confidence,
  CASE WHEN parse_ok THEN risk_score END AS risk_score,
  CASE WHEN parse_ok THEN recommendation END AS recommendation,
  CASE WHEN parse_ok THEN {v} ELSE 'parse' END AS violations
FROM f"""


@oracle("radar_log")
def _():
    first = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1"
    return _deep_cte() + f""",
radar AS (SELECT substring(sha256(text), 1, 16) AS id, label AS predicted_label, CAST(risk_score AS INTEGER) AS risk_score,
    {Q.confidence('pr')} AS confidence, round({Q.entropy('pr')}, 4) AS entropy, len({Q.prediction_set('pr')}) > 1 AS is_ambiguous,
    'RADAR' AS pipeline_mode, doc_id AS arrival, sha256(text) AS text_sha256 FROM f WHERE parse_ok {first}),
sweep AS (SELECT substring(sha256(text), 1, 16) AS id, u_label AS predicted_label, 0 AS risk_score, u_confidence AS confidence,
    round(u_entropy, 4) AS entropy, len(u_prediction_set) > 1 AS is_ambiguous, 'SWEEP' AS pipeline_mode, doc_id AS arrival,
    sha256(text) AS text_sha256 FROM u {first})
SELECT *, TIMESTAMP '{DV.AS_OF} 00:00:00' AS timestamp FROM
  (SELECT * FROM radar UNION ALL SELECT * FROM sweep WHERE id NOT IN (SELECT id FROM radar))"""


# --- Logs, feedback, reports -------------------------------------------------
def _logs_cte() -> str:
    return f"WITH logs AS ({DV.ANALYSIS_LOGS_SQL})"


@oracle("log_first_write")
def _():
    return f"""
WITH l0 AS ({DV.ANALYSIS_LOGS_SQL}),
l AS (SELECT * REPLACE (split_part(id, '-', 1) || '-' || regexp_extract(input_text, '^([A-Za-z0-9_]+)', 1) AS id) FROM l0),
b1 AS (SELECT * FROM l WHERE timestamp < TIMESTAMP '2024-01-16 00:00:00'),
b2 AS (SELECT * FROM l WHERE timestamp >= TIMESTAMP '2024-01-16 00:00:00'),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) AS rn FROM b1) WHERE rn = 1),
f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) AS rn FROM b2) WHERE rn = 1)
SELECT id, timestamp, predicted_label, risk_score, pipeline_mode, 1 AS batch FROM f1
UNION ALL
SELECT id, timestamp, predicted_label, risk_score, pipeline_mode, 2 AS batch FROM f2
WHERE id NOT IN (SELECT id FROM f1)"""


def _fb_cte() -> str:
    return f"""
fbe AS ({DV.FEEDBACK_SQL}),
fb AS (SELECT text_hash, arg_max({{'t': timestamp, 'c': corrected_label, 'n': notes}}, seq) AS l,
              arg_min(original_label, seq) AS original_label, COUNT(*) AS n_events FROM fbe GROUP BY text_hash),
fbr AS (SELECT text_hash, l.t AS timestamp, original_label, l.c AS corrected_label, coalesce(l.n, '') AS notes, n_events FROM fb)"""


@oracle("feedback_upsert")
def _():
    return "WITH " + _fb_cte() + " SELECT * FROM fbr"


@oracle("apply_feedback")
def _():
    return _curated_cte() + "," + _fb_cte() + """
SELECT c.text_id, coalesce(f.corrected_label, c.label) AS label,
  CASE WHEN f.corrected_label IS NOT NULL THEN 'feedback' ELSE 'corpus' END AS label_source
FROM cur c LEFT JOIN fbr f ON c.text_id = f.text_hash"""


@oracle("retrain_gate")
def _():
    return "WITH " + _fb_cte() + " SELECT COUNT(*) AS feedback_count, COUNT(*) >= 50 AS ready FROM fbr"


def _search(label_filter: str, days: int, kw: str, limit: int) -> str:
    conds = ["1=1"]
    if label_filter:
        conds.append(f"predicted_label = '{label_filter}'")
    if days > 0:
        conds.append(f"timestamp >= CAST(DATE '{DV.AS_OF}' - INTERVAL {days} DAY AS TIMESTAMP)")
    if kw:
        conds.append(f"input_text ILIKE '%{kw}%'")
    return _logs_cte() + f"""
SELECT id, timestamp, substring(input_text, 1, 150) AS text, predicted_label AS label,
  coalesce(risk_score, 0) AS risk_score, confidence, coalesce(round(entropy, 4), 0.0) AS entropy, pipeline_mode AS mode
FROM logs WHERE {' AND '.join(conds)} ORDER BY timestamp DESC, id LIMIT {limit}"""


@oracle("search_threats")
def _():
    return _search("TINGGI", 7, "9}", 20)


@oracle("search_all")
def _():
    return _search("", 0, "_1", 30)


def _latest_sql() -> str:
    return _logs_cte() + """,
lt AS (SELECT id, timestamp, substring(input_text, 1, 200) AS text, predicted_label AS label, confidence,
  coalesce(round(entropy, 4), 0.0) AS entropy FROM logs WHERE pipeline_mode = 'SWEEP'
  ORDER BY timestamp DESC, id LIMIT 20)"""


@oracle("latest_triage")
def _():
    return _latest_sql() + " SELECT * FROM lt"


@oracle("latest_distribution")
def _():
    return _latest_sql() + " SELECT label, COUNT(*) AS n FROM lt GROUP BY label"


@oracle("history")
def _():
    return _logs_cte() + """
SELECT id, timestamp, substring(input_text, 1, 120) || '...' AS preview, predicted_label AS label, pipeline_mode
FROM logs ORDER BY timestamp DESC, id LIMIT 25"""


@oracle("daily_stats")
def _():
    return _logs_cte() + "," + _fb_cte() + f""",
day AS (SELECT * FROM logs WHERE CAST(timestamp AS DATE) = DATE '{DV.AS_OF}')
SELECT predicted_label, COUNT(*) AS n, round(AVG(entropy), 4) AS avg_entropy, round(AVG(risk_score), 1) AS avg_risk,
  (SELECT COUNT(*) FROM day) AS total_today, (SELECT COUNT(*) FROM fbr) AS feedback_collected
FROM day GROUP BY predicted_label"""


@oracle("trend_pivot")
def _():
    return _logs_cte() + f"""
SELECT CAST(timestamp AS DATE) AS dt,
  COUNT(*) FILTER (WHERE predicted_label = 'AMAN') AS AMAN,
  COUNT(*) FILTER (WHERE predicted_label = 'WASPADA') AS WASPADA,
  COUNT(*) FILTER (WHERE predicted_label = 'TINGGI') AS TINGGI
FROM logs WHERE timestamp >= CAST(DATE '{DV.AS_OF}' - INTERVAL 7 DAY AS TIMESTAMP) GROUP BY 1"""


@oracle("dashboard_counts")
def _():
    parts = []
    for l in ("AMAN", "WASPADA", "TINGGI"):
        parts.append(f"CAST(SUM(CASE WHEN predicted_label = '{l}' AND CAST(timestamp AS DATE) = DATE '{DV.AS_OF}' THEN 1 ELSE 0 END) AS BIGINT) AS today_{l.lower()}")
        parts.append(f"CAST(SUM(CASE WHEN predicted_label = '{l}' THEN 1 ELSE 0 END) AS BIGINT) AS all_{l.lower()}")
    parts.append(f"CAST(SUM(CASE WHEN CAST(timestamp AS DATE) = DATE '{DV.AS_OF}' THEN 1 ELSE 0 END) AS BIGINT) AS today_total")
    parts.append("COUNT(*) AS all_total")
    return _logs_cte() + f" SELECT {', '.join(parts)} FROM logs"


def _results_cte() -> str:
    return _logs_cte() + """,
res AS (SELECT predicted_label AS label, entropy, split_part(input_text, ' ', 1) AS source, arrival AS ord FROM logs)"""


@oracle("batch_summary")
def _():
    parts = [f"CAST(SUM(CASE WHEN label = '{l}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{l.lower()}"
             for l in ("AMAN", "WASPADA", "TINGGI")]
    return _results_cte() + f"""
SELECT {', '.join(parts)}, COUNT(*) AS n,
  round(coalesce(SUM(entropy), 0.0) / greatest(COUNT(*), 1), 4) AS mean_entropy,
  round(SUM(CASE WHEN label = 'TINGGI' THEN 1 ELSE 0 END) * 100.0 / greatest(COUNT(*), 1), 1) AS pct_critical
FROM res"""


@oracle("top_sources")
def _():
    return _results_cte() + """
SELECT source, COUNT(*) AS n, MIN(ord) AS first_seen FROM res GROUP BY source ORDER BY n DESC, first_seen LIMIT 3"""


@oracle("triage_tally")
def _():
    return _logs_cte() + " SELECT predicted_label, COUNT(*) AS n FROM logs GROUP BY predicted_label"


# --- Evaluation ----------------------------------------------------------------
def _pred_cte() -> str:
    u = Q.uncertainty_cols("p")
    return f"""
WITH pb AS (SELECT l.doc_id, {DV.TRUE_LABEL_SQL} AS true_label, {DV.derived_probs_sql('l.doc_id')} AS p FROM labels l),
pred AS (SELECT doc_id, true_label, {u['label']} AS pred_label, list_max({u['probabilities']}) AS max_prob,
                round({u['entropy']}, 4) AS entropy FROM pb),
pr AS (SELECT *, true_label = pred_label AS correct FROM pred)"""


@oracle("predictions")
def _():
    u = Q.uncertainty_cols("p")
    return f"""
WITH base AS (SELECT doc_id, {_normalized('text')} AS nt FROM documents),
{Q.text_scores('base', 'doc_id', 'nt', DV.CORPUS_BIAS)},
s AS (SELECT l.doc_id, {DV.TRUE_LABEL_SQL} AS true_label, {u['label']} AS pred_label, list_max({u['probabilities']}) AS max_prob,
  round({u['entropy']}, 4) AS entropy FROM labels l JOIN scored USING (doc_id))
SELECT *, true_label = pred_label AS correct FROM s"""


@oracle("confusion")
def _():
    return _pred_cte() + """,
g AS (SELECT a.l AS true_label, b.l AS pred_label FROM (SELECT unnest(['AMAN','WASPADA','TINGGI']) AS l) a,
      (SELECT unnest(['AMAN','WASPADA','TINGGI']) AS l) b),
c AS (SELECT true_label, pred_label, COUNT(*) AS n FROM pr GROUP BY 1, 2),
j AS (SELECT g.true_label, g.pred_label, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (true_label, pred_label))
SELECT true_label, pred_label, n,
  CASE WHEN SUM(n) OVER (PARTITION BY true_label) > 0 THEN round(n / SUM(n) OVER (PARTITION BY true_label), 4) ELSE 0.0 END AS row_share
FROM j"""


@oracle("crosstab_margins")
def _():
    return _pred_cte() + """
SELECT coalesce(true_label, 'All') AS true_label, coalesce(pred_label, 'All') AS pred_label, COUNT(*) AS n
FROM pr GROUP BY CUBE (true_label, pred_label)"""


def _report_cte() -> str:
    per = []
    for l in ("AMAN", "WASPADA", "TINGGI"):
        per.append(f"""SELECT '{l}' AS class,
  CASE WHEN SUM(CASE WHEN pred_label = '{l}' THEN 1 ELSE 0 END) > 0 THEN SUM(CASE WHEN true_label = '{l}' AND pred_label = '{l}' THEN 1 ELSE 0 END) / SUM(CASE WHEN pred_label = '{l}' THEN 1 ELSE 0 END) ELSE 0.0 END AS precision,
  CASE WHEN SUM(CASE WHEN true_label = '{l}' THEN 1 ELSE 0 END) > 0 THEN SUM(CASE WHEN true_label = '{l}' AND pred_label = '{l}' THEN 1 ELSE 0 END) / SUM(CASE WHEN true_label = '{l}' THEN 1 ELSE 0 END) ELSE 0.0 END AS recall,
  CAST(SUM(CASE WHEN true_label = '{l}' THEN 1 ELSE 0 END) AS BIGINT) AS support FROM pr""")
    return _pred_cte() + f""",
per0 AS ({' UNION ALL '.join(per)}),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per0),
acc AS (SELECT 'accuracy' AS class, AVG(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS precision,
          AVG(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS recall, COUNT(*) AS support,
          AVG(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS f1 FROM pr),
mac AS (SELECT 'macro avg' AS class, SUM(precision) / 3 AS precision, SUM(recall) / 3 AS recall,
          CAST(SUM(support) AS BIGINT) AS support, SUM(f1) / 3 AS f1 FROM per),
wtd AS (SELECT 'weighted avg' AS class, SUM(precision * support) / SUM(support) AS precision,
          SUM(recall * support) / SUM(support) AS recall, CAST(SUM(support) AS BIGINT) AS support,
          SUM(f1 * support) / SUM(support) AS f1 FROM per),
rep AS (SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support
        FROM (SELECT * FROM per UNION ALL SELECT * FROM acc UNION ALL SELECT * FROM mac UNION ALL SELECT * FROM wtd))"""


@oracle("class_report")
def _():
    return _report_cte() + " SELECT * FROM rep"


@oracle("kpi_gate")
def _():
    return _report_cte() + """
SELECT w.f1 AS weighted_f1, c.precision AS critical_precision, w.f1 >= 0.7 AS f1_pass,
  c.precision >= 0.75 AS precision_pass, w.f1 >= 0.7 AND c.precision >= 0.75 AS kpi_pass
FROM (SELECT f1 FROM rep WHERE class = 'weighted avg') w, (SELECT precision FROM rep WHERE class = 'TINGGI') c"""


@oracle("error_patterns")
def _():
    return _pred_cte() + """
SELECT true_label, pred_label, COUNT(*) AS n,
  round((SELECT COUNT(*) FILTER (WHERE true_label <> pred_label) / COUNT(*) FROM pr), 4) AS error_rate
FROM pr WHERE true_label <> pred_label GROUP BY 1, 2"""


@oracle("calibration")
def _():
    band = "CASE WHEN max_prob >= 0.75 THEN 'HIGH' WHEN max_prob >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"
    return _pred_cte() + f"""
SELECT round(AVG(CASE WHEN correct THEN entropy END), 4) AS entropy_correct,
  round(AVG(CASE WHEN NOT correct THEN entropy END), 4) AS entropy_wrong,
  round(AVG(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 4) AS accuracy,
  round(AVG(CASE WHEN {band} = 'HIGH' THEN 1.0 ELSE 0.0 END), 4) AS share_high,
  round(AVG(CASE WHEN {band} = 'MEDIUM' THEN 1.0 ELSE 0.0 END), 4) AS share_medium,
  round(AVG(CASE WHEN {band} = 'LOW' THEN 1.0 ELSE 0.0 END), 4) AS share_low
FROM pr"""


@oracle("histogram")
def _():
    return _pred_cte() + """,
mm AS (SELECT MIN(entropy) AS lo, MAX(entropy) AS hi FROM pr)
SELECT true_label, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((entropy - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin,
  COUNT(*) AS n
FROM pr, mm GROUP BY 1, 2"""


@oracle("class_balance")
def _():
    return _pred_cte() + """,
c AS (SELECT true_label, COUNT(*) AS n_c FROM pr GROUP BY true_label)
SELECT true_label, n_c, round(SUM(n_c) OVER () / (COUNT(*) OVER () * n_c), 6) AS weight FROM c"""


# --- Tokens, transcripts, sources -------------------------------------------
@oracle("token_highlights")
def _():
    return f"""
WITH d AS (SELECT doc_id, {Q.words('text')} AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS raw, unnest(generate_series(0, len(toks) - 1)) AS pos FROM d),
s AS (SELECT doc_id, pos, replace(replace(raw, '##', ''), '▁', '') AS token,
             ((doc_id * 31 + pos * 17) % 97) / 97.0 AS score FROM t
      WHERE raw NOT IN ('[CLS]', '[SEP]', '[PAD]', '<s>', '</s>', '<pad>')),
s2 AS (SELECT * FROM s WHERE token <> ''),
m AS (SELECT *, MIN(score) OVER (PARTITION BY doc_id) AS mn, MAX(score) OVER (PARTITION BY doc_id) AS mx FROM s2),
sc AS (SELECT doc_id, pos, token,
              round((score - mn) / CASE WHEN mx <> mn THEN mx - mn ELSE 1.0 END, 4) AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM sc)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, token, score FROM r WHERE rank <= 15"""


@oracle("tokenizer_compare")
def _():
    from sift.operators.tokens import PIECE_RE
    return f"""
WITH d AS (SELECT lang, len({Q.words('text')}) AS a, len(regexp_extract_all(text, {Q.q(PIECE_RE)})) AS b FROM documents),
g AS (SELECT lang, COUNT(*) AS n_docs, AVG(a) AS avg_words, AVG(b) AS avg_pieces FROM d GROUP BY lang)
SELECT lang, n_docs, round(avg_words, 4) AS avg_words, round(avg_pieces, 4) AS avg_pieces,
  round(avg_pieces - avg_words, 2) AS delta,
  round(CASE WHEN avg_pieces > 0 THEN (avg_pieces - avg_words) * 100.0 / avg_pieces ELSE 0.0 END, 2) AS reduction_pct
FROM g"""


def _wer_cte() -> str:
    """Alignment tables by anti-diagonals, whose cells depend on the two diagonals before only. A
    cell holds cost * 2**32 - hits of its best alignment; ``a`` has a row per pair."""
    inf, one = 1 << 60, 1 << 32
    cell = (f"CASE WHEN d + 1 - i < 0 OR d + 1 - i > len(h) THEN {inf} WHEN i = 0 THEN (d + 1) * {one} WHEN d + 1 - i = 0 THEN i * {one} "
            f"ELSE least(p2[i] + CASE WHEN r[i] = h[d + 1 - i] THEN -1 ELSE {one} END, p1[i] + {one}, p1[i + 1] + {one}) END")
    return f"""
WITH RECURSIVE w AS (SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS name, {Q.words('text')} AS r FROM conversations),
q AS (SELECT name, r, list_filter(list_transform(r, lambda x, i: CASE WHEN (i - 1) % 5 = 3 THEN x || 'x' ELSE x END), lambda x, i: (i - 1) % 7 <> 6) AS h FROM w),
dp(name, d, p1, p2) AS (
  SELECT name, 0, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE {inf} END), list_transform(range(0, len(r) + 1), lambda i: {inf})
  FROM q WHERE len(r) > 0
  UNION ALL
  SELECT dp.name, d + 1, list_transform(range(0, len(r) + 1), lambda i: {cell}), p1 FROM dp JOIN q ON q.name = dp.name WHERE d < len(r) + len(h)),
k AS (SELECT q.name, len(r) AS n, len(h) AS p, p1[len(r) + 1] AS key FROM dp JOIN q ON q.name = dp.name WHERE d = len(r) + len(h)),
c AS (SELECT name, n, p, key, CASE WHEN key > 0 THEN (key + {one} - 1) // {one} ELSE 0 END AS cost FROM k),
x AS (SELECT *, cost * {one} - key AS hits, n + p - 2 * (cost * {one} - key) - cost AS s FROM c),
a AS (SELECT q.name, {', '.join(f"CAST(printf('%.4f', {v}) AS DOUBLE) AS {k}" for k, v in (
        ('wer', 'cost / n'), ('mer', 'CASE WHEN hits + cost > 0 THEN cost / (hits + cost) ELSE 0.0 END'), ('wil', '1 - (CASE WHEN p > 0 THEN (hits / n) * (hits / p) ELSE 0.0 END)'),
        ('wip', 'CASE WHEN p > 0 THEN (hits / n) * (hits / p) ELSE 0.0 END')))},
    CAST(hits AS INTEGER) AS hits, CAST(s AS INTEGER) AS substitutions, CAST(n - hits - s AS INTEGER) AS deletions, CAST(p - hits - s AS INTEGER) AS insertions,
    CAST(len(r) AS INTEGER) AS ref_words, CAST(len(h) AS INTEGER) AS hyp_words, CASE WHEN r IS NULL THEN 'missing text' WHEN len(r) = 0 THEN 'empty reference' END AS error
  FROM q LEFT JOIN x ON x.name = q.name)"""


@oracle("wer_pairs")
def _():
    return _wer_cte() + " SELECT * FROM a"


@oracle("wer_corpus")
def _():
    return _wer_cte() + """,
m AS (SELECT round(avg(wer) FILTER (WHERE error IS NULL), 4) AS mean_wer, COUNT(*) FILTER (WHERE error IS NULL) AS n_ok,
  COUNT(*) FILTER (WHERE error IS NOT NULL) AS n_failed FROM a)
SELECT *, CASE WHEN mean_wer < 0.15 THEN 'good' WHEN mean_wer < 0.30 THEN 'acceptable' ELSE 'retrain' END AS status FROM m"""


def _leaf(path: str, value: str, source: str) -> str:
    return f"SELECT {path} AS path, CAST({value} AS VARCHAR) AS value FROM {source}"


def _metrics_sql() -> str:
    """After ``pr``: per (class metrics), rep (the report's rows) and cell (the matrix)."""
    return """,
lab AS (SELECT unnest(['AMAN','WASPADA','TINGGI']) AS l, generate_subscripts(['AMAN','WASPADA','TINGGI'], 1) - 1 AS i),
cnt AS (SELECT l, i, (SELECT COUNT(*) FROM pr WHERE true_label = l AND pred_label = l) AS tp, (SELECT COUNT(*) FROM pr WHERE pred_label = l) AS pp,
  (SELECT COUNT(*) FROM pr WHERE true_label = l) AS sup FROM lab),
pc AS (SELECT l, sup, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS r FROM cnt),
per AS (SELECT l, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f, sup FROM pc),
acc AS (SELECT (SELECT SUM(tp) FROM cnt) / COUNT(*) AS a, COUNT(*) AS n FROM pr),
rep AS (SELECT * FROM per UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
  UNION ALL SELECT 'macro avg', SUM(p) / 3, SUM(r) / 3, SUM(f) / 3, CAST(SUM(sup) AS BIGINT) FROM per
  UNION ALL SELECT 'weighted avg', SUM(p * sup) / SUM(sup), SUM(r * sup) / SUM(sup), SUM(f * sup) / SUM(sup), CAST(SUM(sup) AS BIGINT) FROM per),
cell AS (SELECT a.i AS i, b.i AS j, (SELECT COUNT(*) FROM pr WHERE true_label = a.l AND pred_label = b.l) AS n FROM lab a, lab b)"""


def _result_leaves() -> list[str]:
    pick = {"weighted_f1": ("f", "weighted avg"), "macro_f1": ("f", "macro avg"), "critical_precision": ("p", "TINGGI"), "critical_recall": ("r", "TINGGI")}
    return [_leaf(f"'results.{k}'", f"round({c}, 4)", f"rep WHERE l = '{name}'") for k, (c, name) in pick.items()] + [
        _leaf("'confusion_matrix.' || i || '.' || j", "n", "cell")]


@oracle("report_dataset")
def _():
    one = "(SELECT 1)"
    s = _ranked_cur() + """,
s AS (SELECT label, CASE WHEN rn <= round(0.2 * n_c) THEN 'test' ELSE 'train' END AS split FROM rk) """
    return s + " UNION ALL ".join([
        _leaf("'rows.raw_rows'", "COUNT(*)", "documents"), _leaf("'rows.cleaned_rows'", "COUNT(*)", "s"),
        _leaf("'rows.' || split || '_rows'", "COUNT(*)", "s GROUP BY split"),
        _leaf("'class_distribution.' || split || '.' || label", "COUNT(*)", "s GROUP BY split, label"),
        _leaf("'label_mapping.TINGGI'", "'violence'", one), _leaf("'label_mapping.WASPADA'", "'toxic, identity attack or insult'", one),
        _leaf("'label_mapping.AMAN'", "'none of these'", one), _leaf("'params.min_text_length'", "'10'", one),
        _leaf("'params.split_method'", "'stratified 80/20'", one)])


@oracle("report_training")
def _():
    one = "(SELECT 1)"
    cur = _curated_cte().strip()
    return _pred_cte() + _metrics_sql() + "," + cur[len("WITH"):] + """,
wc AS (SELECT label, COUNT(*) AS n_c FROM cur GROUP BY label),
wt AS (SELECT label, round(SUM(n_c) OVER () / (COUNT(*) OVER () * n_c), 6) AS w FROM wc) """ + " UNION ALL ".join([
        *_result_leaves(), _leaf("'class_weights.' || label", "w", "wt"),
        *[_leaf(f"'classification_report.' || l || '.{k}'", v, "rep") for k, v in
          (("precision", "round(p, 4)"), ("recall", "round(r, 4)"), ("f1", "round(f, 4)"), ("support", "sup"))],
        _leaf("'passing_criteria.weighted_f1_min'", "0.7::DOUBLE", one), _leaf("'passing_criteria.critical_precision_min'", "0.75::DOUBLE", one),
        _leaf("'passing_criteria.weighted_f1_pass'", "round(f, 4) >= 0.7", "rep WHERE l = 'weighted avg'"),
        _leaf("'passing_criteria.critical_precision_pass'", "round(p, 4) >= 0.75", "rep WHERE l = 'TINGGI'"),
        _leaf("'params.epochs'", "'10'", one), _leaf("'params.batch_size'", "'16'", one)])


@oracle("report_selection")
def _():
    return _pred_cte() + _metrics_sql() + " " + " UNION ALL ".join([*_result_leaves(), _leaf("'params.iterations'", "'3'", "(SELECT 1)")])


@oracle("report_wer")
def _():
    return _wer_cte() + """,
e AS (SELECT wer, CASE WHEN name LIKE '%\\_5' ESCAPE '\\' OR error = 'missing text' THEN 'missing text' ELSE error END AS error FROM a),
m AS (SELECT round(avg(wer) FILTER (WHERE error IS NULL), 4) AS w, COUNT(*) FILTER (WHERE error IS NULL) AS ok, COUNT(*) FILTER (WHERE error IS NOT NULL) AS bad FROM e) """ + " UNION ALL ".join([
        _leaf("'params.language'", "'mixed'", "(SELECT 1)"), _leaf("'num_files'", "ok", "m"), _leaf("'num_failed'", "bad", "m"),
        _leaf("'average_wer'", "w", "m"), _leaf("'status'", "CASE WHEN w < 0.15 THEN 'good' WHEN w < 0.30 THEN 'acceptable' ELSE 'retrain' END", "m"),
        _leaf("'errors.' || error", "COUNT(*)", "e WHERE error IS NOT NULL GROUP BY error")])


@oracle("transcript_triage")
def _():
    gate = f"""
WITH g AS (SELECT conv_id, turn, text, conv_id * 100 + turn AS tid,
  CASE WHEN length({Q.strip_u('text')}) < 5 THEN 'transcript too short' END AS reject_reason FROM conversations),
acc AS (SELECT * FROM g WHERE reject_reason IS NULL),"""
    return _deep_cte("acc", "tid", ", conv_id, turn").replace("WITH base AS", gate.strip() + "\nbase AS", 1) + """
SELECT conv_id, turn, reject_reason, NULL AS label, NULL AS final_label FROM g WHERE reject_reason IS NOT NULL
UNION ALL SELECT conv_id, turn, NULL, u_label, NULL FROM u WHERE u_label = 'AMAN'
UNION ALL SELECT conv_id, turn, NULL, sweep_label, label FROM f"""


@oracle("strip_html")
def _():
    from sift.functions.text import HTML_TAG_RE
    body = f"regexp_replace(html, {Q.q(HTML_TAG_RE)}, '', 'g')"
    return f"""
WITH d AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {body} AS body FROM pages),
c AS (SELECT *, trim(regexp_replace(body, {Q.q(Q.WS + '+')}, ' ', 'g')) AS clean FROM d)
SELECT page_id, title, CAST(length(body) AS INTEGER) AS n_chars, substring(clean, 1, 100) || '...' AS preview,
  length(clean) > 20 AS keep, sha256(clean) AS clean_hash
FROM c"""


@oracle("cache_lookup")
def _():
    return """
WITH r AS (SELECT doc_id, sha256(to_json({'lang': lang, 'source': source})) AS cache_key FROM documents),
c AS (SELECT DISTINCT cache_key FROM r WHERE doc_id % 2 = 0)
SELECT doc_id, cache_key, cache_key IN (SELECT cache_key FROM c) AS hit FROM r"""


@oracle("cache_write_back")
def _():
    return """
WITH r AS (SELECT doc_id, n_chars, lang, source, upper(lang) || '/' || reverse(source) || '/' AS a FROM documents),
f AS (SELECT DISTINCT lang, source FROM r WHERE n_chars < 1000)
SELECT 1 AS batch, doc_id, a || 'first' AS response, false AS hit FROM r WHERE n_chars < 1000
UNION ALL SELECT 2, doc_id, a || CASE WHEN f.lang IS NULL THEN 'second' ELSE 'first' END, f.lang IS NOT NULL
FROM r LEFT JOIN f ON f.lang = r.lang AND f.source = r.source"""


@oracle("feed_posts")
def _():
    from sift.functions.text import HTML_TAG_RE
    stripped = f"regexp_replace(html, {Q.q(HTML_TAG_RE)}, '', 'g')"
    plain = f"regexp_replace({stripped}, '[^\\p{{L}}\\p{{N}}\\p{{P}}\\s]', ' ', 'g')"
    body = f"substring({Q.collapse_ws(plain)}, 1, 600)"
    again = f"regexp_replace('<p>' || b || '</p>', {Q.q(HTML_TAG_RE)}, '', 'g')"
    long = "CASE WHEN length(x) > 10 THEN t || '. ' || x ELSE t END"
    url = "CASE WHEN u = '' THEN 'feed' ELSE u END"
    return f"""
WITH p AS (SELECT page_id, 'Page ' || CAST(page_id AS VARCHAR) AS t, coalesce(url, '') AS u, {body} AS b FROM pages),
k AS (SELECT *, unnest(['rss', 'atom']) AS kind FROM p),
a7 AS (SELECT page_id, kind, 'RSS: pages' AS source, u, CASE WHEN x <> '' THEN t || '. ' || x ELSE t END AS text
  FROM (SELECT *, CASE WHEN kind = 'rss' THEN {again} ELSE 'short' END AS x FROM k)),
a8 AS (SELECT page_id, kind, 'forum' AS source, u, {long} AS text FROM (SELECT *, {Q.strip_u(again)} AS x FROM k)),
r AS (SELECT * FROM a7 WHERE length(text) > 20
  UNION ALL SELECT page_id, kind, source, u, substring(text, 1, 500) FROM a8 WHERE length(text) > 15)
SELECT page_id, kind, CAST(0 AS INTEGER) AS ord, source, {url} AS url, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_hash,
  substring(sha256(source || chr(1) || {url} || chr(1) || text), 1, 16) AS post_id FROM r"""


@oracle("source_fallback")
def _():
    return """
WITH p AS (SELECT doc_id, lang AS target, 'primary' AS origin FROM documents WHERE n_chars % 2 = 0 AND lang <> 'es'),
s AS (SELECT doc_id, lang AS target, 'secondary' AS origin FROM documents WHERE n_chars % 2 = 1 OR lang = 'es')
SELECT * FROM p UNION ALL SELECT * FROM s WHERE target NOT IN (SELECT DISTINCT target FROM p)"""


@oracle("union_clean")
def _():
    from sift.functions.text import HTML_TAG_RE
    return f"""
WITH u AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS post_id, text, source, CAST(NULL AS VARCHAR) AS url FROM documents
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text, NULL, NULL FROM conversations
  UNION ALL
  SELECT 'p' || CAST(page_id AS VARCHAR), regexp_replace(html, {Q.q(HTML_TAG_RE)}, '', 'g'), NULL, url FROM pages)
SELECT post_id, coalesce(source, 'OSINT') AS source, coalesce(url, '') AS url, sha256(text) AS text_hash
FROM u WHERE coalesce({Q.strip_u('text')}, '') <> ''"""


@oracle("embedding_norms")
def _():
    return """
WITH e AS (SELECT vec_id, label, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda a, b: a + b)) AS norm, embedding FROM embeddings)
SELECT vec_id, label, round(norm, 6) AS norm,
  round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: (CAST(x AS DOUBLE) / norm) * (CAST(x AS DOUBLE) / norm))), lambda a, b: a + b), 6) AS unit_norm_sq
FROM e"""


@oracle("annotated_snapshot")
def _():
    return f"""WITH a AS ({DV.ANNOTATED_SQL}) SELECT text_id, topic, {_label_sql()} AS label, array_to_string(toxicity, ',') AS toxicity, sha256(text) AS text_hash FROM a"""


@oracle("corpus_csv")
def _():
    return _ranked_cur() + """
SELECT text_id, cur.label, CASE WHEN rn <= round(0.2 * n_c) THEN 'test' ELSE 'train' END AS split, topic, toxicity_agg, text_hash, sha256(text) AS raw_hash
FROM cur JOIN rk USING (text_id)"""


@oracle("uploads")
def _():
    blank = Q.strip_u("text")
    return f"""
WITH l AS (SELECT {Q.strip_u('x')} AS x FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS x FROM documents)),
u AS (SELECT 'cells' AS source, text FROM documents WHERE {blank} <> '' UNION ALL SELECT 'lines', x FROM l WHERE x <> '')
SELECT source, sha256(text) AS text_hash, COUNT(*) AS n FROM u GROUP BY 1, 2"""


@oracle("forum_listing")
def _():
    t, b = Q.strip_u("substring(text, 1, 20)"), Q.strip_u("CASE WHEN doc_id % 3 > 0 THEN substring(text, 21, 300) ELSE '' END")
    return f"""
WITH p AS (SELECT doc_id, {t} AS t, {b} AS b FROM documents),
x AS (SELECT doc_id, CASE WHEN b <> '' THEN t || '. ' || b ELSE t END AS text FROM p)
SELECT 'forum' AS source, CASE WHEN doc_id % 4 > 0 THEN 'https://forum/p/' || doc_id ELSE 'https://forum/new' END AS url,
  CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_hash FROM x WHERE length(text) > 15"""


@oracle("video_comments")
def _():
    from sift.functions.text import HTML_TAG_RE
    body = Q.strip_u(f"regexp_replace('<b>' || role || '</b> ' || substring(text, 1, 200), {Q.q(HTML_TAG_RE)}, '', 'g')")
    return f"""
WITH x AS (SELECT conv_id, {body} AS text FROM conversations WHERE conv_id % 7 <> 6)
SELECT 'video' AS source, 'https://www.youtube.com/watch?v=v' || conv_id AS url, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_hash
FROM x WHERE length(text) > 15"""


@oracle("script_signals")
def _():
    ar = Q.script_mix("text")[1]
    return f"""
WITH d AS (SELECT doc_id, substring(text, 1, 400) || repeat(' مرحبا', doc_id % 61) AS text FROM documents),
s AS (SELECT doc_id, {Q.script_signal(ar)} AS s FROM d)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n, s[1].extracted_text AS extracted, s[1].significance AS significance FROM s"""


@oracle("title_body")
def _():
    from sift.functions.text import HTML_TAG_RE
    t = Q.strip_u("regexp_extract(html, '<title>([^<]*)</title>', 1)")
    b = Q.strip_u(f"regexp_replace(html, {Q.q(HTML_TAG_RE)}, '', 'g')")
    return f"""
WITH x AS (SELECT page_id, {t} AS t, {b} AS b FROM pages), y AS (SELECT page_id, CASE WHEN b <> '' THEN t || '. ' || b ELSE t END AS x FROM x)
SELECT page_id, CAST(length(x) AS INTEGER) AS n_chars, sha256(x) AS text_hash FROM y"""


@oracle("flat_briefs")
def _():
    digest = "'''a'' (AMAN); ''b'' (TINGGI); ''c'' (AMAN); ''d'' (WASPADA); ''e'' (AMAN)'"
    return _deep_cte("documents", "doc_id", ", signals") + f"""
SELECT doc_id, label, {Q.confidence('pr')} AS confidence, round({Q.entropy('pr')}, 4) AS entropy, risk_score,
  CASE WHEN risk_score <= 30 THEN 'low' WHEN risk_score <= 60 THEN 'medium' ELSE 'high' END AS risk_band,
  CASE recommendation WHEN 'ARCHIVE' THEN 'ARSIP' WHEN 'MONITOR' THEN 'PANTAU' WHEN 'ESCALATE' THEN 'ESKALASI' ELSE recommendation END AS shown,
  'summary ' || doc_id AS summary,
  CASE WHEN doc_id % 2 = 0 THEN note ELSE note || chr(10) || chr(10) || '[Key phrases: ' || {digest} || ']' END AS ambiguity,
  CAST(len(signals) AS INTEGER) AS n_signals FROM f WHERE parse_ok"""


@oracle("seeded_shuffle")
def _():
    return "SELECT doc_id, lang FROM documents ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':42'), doc_id"


@oracle("attached_vectors")
def _():
    return """
WITH e AS (SELECT vec_id, len(embedding) AS dim, CAST(embedding[1] AS DOUBLE) / sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS u FROM embeddings)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(u, 6) AS first FROM documents LEFT JOIN e ON vec_id = doc_id"""


@oracle("layout_fallback")
def _():
    return _triage_cte() + " SELECT doc_id, round(u_entropy, 4) AS x, CAST(length(text) AS DOUBLE) AS y, u_label AS label FROM u"


@oracle("histogram_max_prob")
def _():
    return _pred_cte() + """,
mm AS (SELECT MIN(max_prob) AS lo, MAX(max_prob) AS hi FROM pr)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((max_prob - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin, COUNT(*) AS n
FROM pr, mm GROUP BY 1"""


@oracle("quartiles")
def _():
    return _pred_cte() + """
SELECT correct, round(quantile_cont(entropy, 0.25), 6) AS q1, round(quantile_cont(entropy, 0.5), 6) AS q2, round(quantile_cont(entropy, 0.75), 6) AS q3
FROM pr GROUP BY correct"""


@oracle("error_examples")
def _():
    return _pred_cte() + " SELECT doc_id, true_label, pred_label, entropy FROM pr WHERE true_label <> pred_label ORDER BY doc_id LIMIT 5"
