"""Inputs derived from the driver tables, for registered queries.

The driver tables hold no annotations, logs, predictions or expert replies,
so each query derives them from the given tables by arithmetic on ids.
Every derivation here has a DuckDB twin (``*_SQL``) with identical
semantics; the oracle queries in ``sift.plans.oracle`` are built on them.
All derivations read whole tables; nothing is filtered to keep checks
cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.operators.partitioning import spread
from sift.session import read_table

AS_OF = "2024-01-30"
SEED = 42

# --- Parameters for the driver corpus (en/fr/de/es invented prose) ---------
# The reference's own dictionaries are Indonesian and never occur in the
# driver corpus, so signal queries use these corpus-word dictionaries.
CORPUS_LEXICON = [
    ("the", "article", "LOW", "common word"),
    ("nicht", "negation", "HIGH", "german negation"),
    ("que ", "relative", "MEDIUM", "romance connector"),
    ("ment", "suffix", "CONTEXT_DEPENDENT", "adverb ending"),
    ("ción", "suffix", "MEDIUM", "spanish noun ending"),
    ("ß", "letter", "HIGH", "sharp s"),
    ("###", "junk", "MEDIUM", "junk marker"),
    ("@mail", "contact", "HIGH", "mail address part"),
]
CORPUS_ACTION_PATTERNS = [
    r"the\s+(and\s+)?",
    r"nicht\s+",
    r"que\s+la",
    r"ing\s*[,.]",
    r"ción\s+(de|la)\s+",
]
CORPUS_URGENCY_PATTERNS = [
    r"und\s+(der|die|das)",
    r"tion",
    r"eaux\s+",
    r"\$\$\$",
]

# A fixed linear model over frequent corpus words (thousandths, label order).
CORPUS_BIAS = (300, 0, -200)
CORPUS_WEIGHTS = {
    "the": (9000, -4000, -6000), "of": (-3000, 12000, -4000), "and": (2000, 4000, -9000), "to": (6000, -9000, 1000),
    "in": (-2000, 3000, -1000), "is": (4000, -7000, 9000), "that": (-9000, 2000, 15000), "|": (-8000, -3000, 20000),
    "der": (12000, -3000, -8000), "die": (-6000, 14000, 2000), "und": (-4000, -2000, 18000), "von": (3000, 9000, -9000),
    "de": (7000, 2000, -9000), "la": (-5000, 15000, -2000), "que": (-9000, 1000, 21000), "el": (6000, -8000, 4000),
    "le": (-3000, 2000, 9000), "et": (11000, -9000, 1000), "les": (-7000, 16000, -4000), "für": (-20000, 9000, 30000),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"), "doc_id")


# --- Artefact injection for the normaliser (URLs, emoji, Arabic, slang) ----
ARTEFACT_CASES = 7


def docs_with_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    m = F.col("doc_id") % ARTEFACT_CASES
    sid = F.col("doc_id").cast("string")
    t = (F.when(m == 0, F.concat(F.col("text"), F.lit(" https://example.org/d/"), sid))
         .when(m == 1, F.concat(F.lit("@user"), sid, F.lit(" "), F.col("text"), F.lit(" #tag"),
                                (F.col("doc_id") % 5).cast("string")))
         .when(m == 2, F.concat(F.col("text"), F.lit(" 🔥 ⚠️ end")))
         .when(m == 3, F.concat(F.lit("www.example.com/"), sid, F.lit(" "), F.col("text"),
                                F.lit(" مرحبا بالعالم")))
         .when(m == 4, F.concat(F.lit("GW "), F.col("text"), F.lit(" yg bgt wkwk")))
         .when(m == 5, F.concat(F.col("text"), F.lit(" kyk, kyk")))
         .otherwise(F.col("text")))
    return d.select("doc_id", t.alias("text"), "lang", "source")


DOCS_WITH_ARTEFACTS_SQL = f"""
SELECT doc_id,
  CASE doc_id % {ARTEFACT_CASES}
    WHEN 0 THEN text || ' https://example.org/d/' || CAST(doc_id AS VARCHAR)
    WHEN 1 THEN '@user' || CAST(doc_id AS VARCHAR) || ' ' || text || ' #tag' || CAST(doc_id % 5 AS VARCHAR)
    WHEN 2 THEN text || ' 🔥 ⚠️ end'
    WHEN 3 THEN 'www.example.com/' || CAST(doc_id AS VARCHAR) || ' ' || text || ' مرحبا بالعالم'
    WHEN 4 THEN 'GW ' || text || ' yg bgt wkwk'
    WHEN 5 THEN text || ' kyk, kyk'
    ELSE text END AS text,
  lang, source
FROM documents"""


# --- A deterministic scorer stand-in: integer percentages from ids ---------
# Probabilities are exact k/100 doubles, so both engines hold identical
# values; every 11th document has no score (fallback path).

def derived_probs(id_col: str = "doc_id"):
    i = F.col(id_col)
    a = i % 71
    w = (i * 37) % (F.lit(101) - a)
    t = F.lit(100) - a - w
    arr = F.array((a / 100.0).cast("double"), (w / 100.0).cast("double"), (t / 100.0).cast("double"))
    return F.when(i % 11 == 10, F.lit(None).cast("array<double>")).otherwise(arr)


def derived_probs_sql(id_col: str = "doc_id") -> str:
    a = f"({id_col} % 71)"
    w = f"(({id_col} * 37) % (101 - {a}))"
    t = f"(100 - {a} - {w})"
    return (f"CASE WHEN {id_col} % 11 = 10 THEN NULL ELSE "
            f"[{a} / 100.0, {w} / 100.0, {t} / 100.0]::DOUBLE[] END")


def expert_probs(id_col: str = "doc_id"):
    """A second scorer for fusion: another exact percentage triple."""
    i = F.col(id_col)
    t = (i * 13) % 61
    a = (i * 7) % (F.lit(101) - t)
    w = F.lit(100) - a - t
    return F.array((a / 100.0).cast("double"), (w / 100.0).cast("double"), (t / 100.0).cast("double"))


def expert_probs_sql(id_col: str = "doc_id") -> str:
    t = f"(({id_col} * 13) % 61)"
    a = f"(({id_col} * 7) % (101 - {t}))"
    w = f"(100 - {a} - {t})"
    return f"[{a} / 100.0, {w} / 100.0, {t} / 100.0]::DOUBLE[]"


def expert_label(id_col: str = "doc_id"):
    i = F.col(id_col)
    return (F.when(i % 5 == 0, "TINGGI").when(i % 5 == 1, "WASPADA").otherwise("AMAN"))


def expert_label_sql(id_col: str = "doc_id") -> str:
    return (f"CASE WHEN {id_col} % 5 = 0 THEN 'TINGGI' WHEN {id_col} % 5 = 1 THEN 'WASPADA' "
            f"ELSE 'AMAN' END")


# --- A weight for every token of the corpus ---------------------------------

def vocabulary_weights(normalized: DataFrame) -> DataFrame:
    """``token, weights`` of every distinct token, by arithmetic on its first
    character and length."""
    tok = normalized.select(F.explode_outer(F.split(F.lower("normalized_text"), " ")).alias("token")).filter("token <> ''").distinct()
    a, n = F.ascii("token"), F.length("token")
    w = [((a * 37 + n * 101) % 20001 - 10000), ((a * 53 + n * 11) % 20001 - 10000), ((a * 71 + n * 7) % 20001 - 10000)]
    return tok.select("token", F.array(*w).alias("weights"))


VOCABULARY_WEIGHTS_SQL = """
SELECT w, (ascii(w) * 37 + length(w) * 101) % 20001 - 10000 AS w0, (ascii(w) * 53 + length(w) * 11) % 20001 - 10000 AS w1,
  (ascii(w) * 71 + length(w) * 7) % 20001 - 10000 AS w2 FROM tok"""


# --- Dictionaries taken from the corpus, which grow with it ------------------

def corpus_lexicon(d: DataFrame) -> DataFrame:
    """``ord, term, meaning, threat_level, note``: five pieces of each text."""
    i, j = F.col("doc_id"), F.col("j")
    pieces = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select(
        (i * 5 + j).alias("ord"), F.substring(F.col("text"), ((i * 7) % 60 + j * 40 + 1).cast("int"), (i % 7 + 5).cast("int")).alias("term"))
    first = pieces.filter("term <> ''").groupBy("term").agg(F.min("ord").alias("ord"))
    return first.select("ord", "term", F.lit("piece").alias("meaning"), F.element_at(
        F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW", "CONTEXT_DEPENDENT"))), (F.col("ord") % 4 + 1).cast("int")).alias("threat_level"),
        F.concat(F.lit("n"), F.col("ord").cast("string")).alias("note"))


CORPUS_LEXICON_SQL = """
SELECT min(ord) AS ord, term FROM (
  SELECT doc_id * 5 + j AS ord, substring(text, (doc_id * 7) % 60 + j * 40 + 1, doc_id % 7 + 5) AS term
  FROM documents, unnest(generate_series(0, 4)) AS g(j)) WHERE term <> '' GROUP BY term"""

TWO_WORDS = "([a-zà-ÿ]{3,}) +([a-zà-ÿ]{2,})"


def corpus_patterns(d: DataFrame) -> DataFrame:
    """``ord, pattern``: two patterns from the first two words of each text that fit."""
    w = [F.regexp_extract(F.lower("text"), TWO_WORDS, k) for k in (1, 2)]
    both = d.select("doc_id", w[0].alias("a"), w[1].alias("b")).filter("a <> ''").select(F.inline(F.array(
        F.struct((F.col("doc_id") * 2).alias("ord"), F.concat("a", F.lit(r"\s+"), "b").alias("pattern")),
        F.struct((F.col("doc_id") * 2 + 1).alias("ord"), F.concat("a", F.lit(r"\s+("), "b", F.lit("|la|the)[,.]")).alias("pattern")))))
    return both.groupBy("pattern").agg(F.min("ord").alias("ord"))


CORPUS_PATTERNS_SQL = f"""
SELECT min(ord) AS ord, pattern, any_value(a) AS a FROM (
  SELECT doc_id * 2 AS ord, a || '\\s+' || b AS pattern, a FROM two
  UNION ALL SELECT doc_id * 2 + 1, a || '\\s+(' || b || '|la|the)[,.]', a FROM two) GROUP BY pattern"""
TWO_WORDS_SQL = f"""
SELECT * FROM (SELECT doc_id, regexp_extract(lower(text), '{TWO_WORDS}', 1) AS a, regexp_extract(lower(text), '{TWO_WORDS}', 2) AS b
  FROM documents) WHERE a <> ''"""


def corpus_slang(d: DataFrame) -> DataFrame:
    """``ord, token, replacement``: the first eight words of each text, reversed; every ninth is deleted."""
    w = F.slice(F.array_remove(F.split(F.lower("text"), " +"), ""), 1, 8)
    tok = d.select("doc_id", F.posexplode(w).alias("j", "token")).filter("token RLIKE '^[a-zà-ÿ]+$'")
    first = tok.groupBy("token").agg(F.min(F.col("doc_id") * 8 + F.col("j")).alias("ord"))
    return first.select("ord", "token", F.when(F.col("ord") % 9 == 0, F.lit(None).cast("string")).otherwise(F.reverse("token")).alias("replacement"))


CORPUS_SLANG_SQL = """
SELECT token, CASE WHEN min(ord) % 9 = 0 THEN '' ELSE reverse(token) END AS rep FROM (
  SELECT doc_id * 8 + generate_subscripts(ws, 1) - 1 AS ord, unnest(ws) AS token FROM (
    SELECT doc_id, list_slice(list_filter(string_split_regex(lower(text), ' +'), lambda x: x <> ''), 1, 8) AS ws FROM documents))
WHERE regexp_full_match(token, '[a-zà-ÿ]+') GROUP BY token"""


# --- Annotated corpus from documents + labels ------------------------------

def _v(cond):
    return F.when(cond, "1").otherwise("0")


def annotated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture-1 shaped rows: 3-vote (sometimes 2-vote or empty) arrays."""
    d = documents(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    i = F.col("doc_id")
    x = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    q = F.coalesce(F.col("quality"), (i % 2).cast("int")) == 0
    return j.select(
        F.col("doc_id").cast("string").alias("text_id"), "doc_id", "text",
        F.col("source").alias("topic"),
        F.array(_v(x), _v(x | (i % 3 == 0)), _v(i % 3 == 0)).alias("toxicity"),
        F.array(_v(i % 5 == 0), _v(q), _v(i % 7 == 0)).alias("identity_attack"),
        F.array(_v(i % 4 == 1), _v(i % 6 == 1)).alias("insults"),
        F.array(_v(x & (i % 2 == 0)), _v(x & (i % 3 == 0)), _v(i % 11 == 0)).alias("threat_incitement_to_violence"),
        F.array(_v(i % 2 == 1), _v(i % 3 == 0), _v(i % 5 == 0)).alias("profanity_obscenity"),
        F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(_v(i % 2 == 0))).alias("polarized"),
        F.array(F.lit("0"), F.lit("0"), _v(i % 19 == 0)).alias("sexually_explicit"),
        F.array(_v(i % 17 == 0), _v((i % 17 == 0) | (F.col("n_chars") < 60)), F.lit("0")).alias("is_noise_or_spam_text"),
    )


def _vs(cond: str) -> str:
    return f"CASE WHEN {cond} THEN '1' ELSE '0' END"


ANNOTATED_SQL = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS text_id, d.doc_id, d.text, d.source AS topic,
  [{_vs('COALESCE(l.toxic,0)=1')}, {_vs('COALESCE(l.toxic,0)=1 OR d.doc_id % 3 = 0')}, {_vs('d.doc_id % 3 = 0')}] AS toxicity,
  [{_vs('d.doc_id % 5 = 0')}, {_vs('COALESCE(l.quality, CAST(d.doc_id % 2 AS INTEGER)) = 0')}, {_vs('d.doc_id % 7 = 0')}] AS identity_attack,
  [{_vs('d.doc_id % 4 = 1')}, {_vs('d.doc_id % 6 = 1')}] AS insults,
  [{_vs('COALESCE(l.toxic,0)=1 AND d.doc_id % 2 = 0')}, {_vs('COALESCE(l.toxic,0)=1 AND d.doc_id % 3 = 0')}, {_vs('d.doc_id % 11 = 0')}] AS threat_incitement_to_violence,
  [{_vs('d.doc_id % 2 = 1')}, {_vs('d.doc_id % 3 = 0')}, {_vs('d.doc_id % 5 = 0')}] AS profanity_obscenity,
  CASE WHEN d.doc_id % 13 = 0 THEN []::VARCHAR[] ELSE [{_vs('d.doc_id % 2 = 0')}] END AS polarized,
  ['0', '0', {_vs('d.doc_id % 19 = 0')}] AS sexually_explicit,
  [{_vs('d.doc_id % 17 = 0')}, {_vs('d.doc_id % 17 = 0 OR d.n_chars < 60')}, '0'] AS is_noise_or_spam_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


# --- Analysis logs and feedback events from `events` -----------------------

def analysis_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows shaped like ``analysis_logs`` (Fixture 10); id = user and day, so
    a user's later events the same day are duplicate ids."""
    e = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("latency_ms"),
        F.concat(et, F.lit(" "), F.col("props")).alias("input_text"),
        F.lit(None).cast("string").alias("true_label"),
        F.when(et == "error", "TINGGI").when(et.isin("click", "signup"), "WASPADA").otherwise("AMAN").alias("predicted_label"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("int"))
        .otherwise((F.floor(F.col("value")) % 101).cast("int")).alias("risk_score"),
        F.when(F.col("value") >= 30, "HIGH").when(F.col("value") >= 15, "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(F.col("event_id") % 9 == 0, F.lit(None).cast("double"))
        .otherwise(F.round(F.col("value") / 32.0, 4)).alias("entropy"),
        (F.col("event_id") % 3 == 0).alias("is_ambiguous"),
        F.when(F.col("user_id") % 2 == 0, "SWEEP").otherwise("RADAR").alias("pipeline_mode"),
        F.col("event_id").alias("arrival"),
    )


ANALYSIS_LOGS_SQL = """
SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS id,
  ts AS timestamp, value AS latency_ms, event_type || ' ' || props AS input_text,
  CAST(NULL AS VARCHAR) AS true_label,
  CASE WHEN event_type = 'error' THEN 'TINGGI' WHEN event_type IN ('click','signup') THEN 'WASPADA' ELSE 'AMAN' END AS predicted_label,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) END AS risk_score,
  CASE WHEN value >= 30 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(value / 32.0, 4) END AS entropy,
  event_id % 3 = 0 AS is_ambiguous,
  CASE WHEN user_id % 2 = 0 THEN 'SWEEP' ELSE 'RADAR' END AS pipeline_mode,
  event_id AS arrival
FROM events"""


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback corrections (Fixture 11) keyed by user; seq = event id."""
    e = read_table(spark, sf_dir, "events")
    labs = F.array(F.lit("AMAN"), F.lit("WASPADA"), F.lit("TINGGI"))
    return e.select(
        F.col("user_id").cast("string").alias("text_hash"),
        F.col("ts").alias("timestamp"),
        F.element_at(labs, (F.col("event_id") % 3 + 1).cast("int")).alias("original_label"),
        F.element_at(labs, ((F.col("event_id") + F.col("user_id")) % 3 + 1).cast("int")).alias("corrected_label"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("props")).alias("notes"),
        F.col("event_id").alias("seq"),
    )


FEEDBACK_SQL = """
SELECT CAST(user_id AS VARCHAR) AS text_hash, ts AS timestamp,
  ['AMAN','WASPADA','TINGGI'][CAST(event_id % 3 + 1 AS INTEGER)] AS original_label,
  ['AMAN','WASPADA','TINGGI'][CAST((event_id + user_id) % 3 + 1 AS INTEGER)] AS corrected_label,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS notes,
  event_id AS seq
FROM events"""


# --- Predictions: documents x labels vs the derived scorer -----------------

def true_label():
    return (F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "TINGGI")
            .when(F.col("toxic") == 1, "WASPADA").otherwise("AMAN"))


TRUE_LABEL_SQL = ("CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'TINGGI' "
                  "WHEN l.toxic = 1 THEN 'WASPADA' ELSE 'AMAN' END")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture-12 rows for every labelled document (H6)."""
    from sift.functions import scores as S
    lab = read_table(spark, sf_dir, "labels")
    p = derived_probs("doc_id")
    u = S.uncertainty(p)
    return (lab.select("doc_id", true_label().alias("true_label"), u.alias("u"))
            .select("doc_id", "true_label", F.col("u.label").alias("pred_label"),
                    F.array_max("u.probabilities").alias("max_prob"),
                    F.round("u.entropy", 4).alias("entropy"))
            .withColumn("correct", F.col("true_label") == F.col("pred_label")))


# --- Expert replies (JSON text) from ids ------------------------------------

def expert_reply_text(id_col: str = "doc_id"):
    """Reply JSON built from ids: every 4th fenced, every 9th broken, some
    with key phrases, one in 7 with a too-short note, risk 0..110."""
    i = F.col(id_col)
    p = expert_probs(id_col)
    body = F.format_string(
        '{"label": "%s", "probabilities": {"AMAN": %s, "WASPADA": %s, "TINGGI": %s}, '
        '"reasoning": "r%d", "summary_narrative": "summary %d", "risk_score": %d, '
        '"recommendation": "%s", "ambiguity_notes": "%s", "key_phrases": %s}',
        expert_label(id_col), p[0].cast("string"), p[1].cast("string"), p[2].cast("string"),
        i, i, ((i * 17) % 111).cast("int"),
        F.when(i % 3 == 0, "ESCALATE").when(i % 3 == 1, "MONITOR").otherwise("ARCHIVE"),
        F.when(i % 7 == 0, F.lit("short")).otherwise(F.concat(F.lit("note about doc "), i.cast("string"))),
        F.when(i % 2 == 0, F.lit("[]")).otherwise(F.lit(
            '[{"text": "a", "label": "AMAN", "reason": "x"}, {"text": "b", "label": "TINGGI", "reason": "y"}, '
            '{"text": "c", "label": "AMAN", "reason": "z"}, {"text": "d", "label": "WASPADA", "reason": "w"}, '
            '{"text": "e", "label": "AMAN", "reason": "v"}, {"text": "f", "label": "TINGGI", "reason": "u"}]')))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    broken = F.concat(F.lit("{\"label\": \"AMAN\", "), i.cast("string"))
    return F.when(i % 9 == 4, broken).when(i % 4 == 0, fenced).otherwise(body)


def checked_reply_text(id_col: str = "doc_id"):
    """Replies as above, of which every tenth has probabilities that sum to 11."""
    i = F.col(id_col)
    return F.when(i % 10 == 3, F.replace(expert_reply_text(id_col), F.lit('{"AMAN": '), F.lit('{"AMAN": 1'))).otherwise(expert_reply_text(id_col))


def array_reply_text(text_col: str = "text", id_col: str = "doc_id"):
    """JSON arrays of a text's first words, in four out of seven documents as an array
    of strings (plain or fenced), else with a number, a null or as an object."""
    i, words = F.col(id_col) % 7, F.to_json(F.slice(F.split(text_col, " "), 1, 6))
    return (F.when(i == 1, F.concat(F.lit("```json\n"), words, F.lit("\n```"))).when(i == 2, F.concat(F.lit("```"), words, F.lit("```")))
            .when(i == 3, F.lit("[]")).when(i == 4, F.lit('["a", 1]')).when(i == 5, F.lit('{"a": "b"}')).when(i == 6, F.lit('["a", null, "b"'))
            .otherwise(words))


# --- Feed payloads from pages -------------------------------------------------

def feed_payloads(pages: DataFrame) -> DataFrame:
    """``page_id, kind, payload``: each page as an RSS item (with a description) and an Atom
    entry (with content), its tag-stripped text cut and escaped."""
    from sift.functions import text as X

    def esc(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c
    body = F.substring(X.collapse_ws(F.regexp_replace(X.strip_html("html"), r"[^\p{L}\p{N}\p{P}\s]", " ")), 1, 600)
    d = pages.select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("t"), F.coalesce("url", F.lit("")).alias("u"), body.alias("b"))
    html = F.concat(F.lit("<p>"), F.col("b"), F.lit("</p>"))
    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:c="x"><channel><title>f</title><item><title>'), esc(F.col("t")), F.lit("</title><link>"),
                   esc(F.col("u")), F.lit("</link><description>"), esc(html), F.lit("</description></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><link rel="self" href="self"/><entry><title type="html">'), esc(F.col("t")),
                    F.lit('</title><link rel="enclosure" href="no"/><link href="'), esc(F.col("u")), F.lit('"/><summary>short</summary><content type="html">'),
                    esc(html), F.lit("</content></entry></feed>"))
    return d.select("page_id", F.inline(F.array(F.struct(F.lit("rss").alias("kind"), rss.alias("payload")),
                                               F.struct(F.lit("atom").alias("kind"), atom.alias("payload")))))
