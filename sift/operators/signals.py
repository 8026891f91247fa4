"""Rule signals as in-row array expressions (no shuffle, no UDF);
dictionaries that are too large to inline go through ``operators.matching``, which
finds each text's candidates by an equi-join, with the same results.

Each document gets ``signals: array<struct<signal_type, extracted_text,
significance, context_explanation>>`` in the fixed order lexicon ->
call-to-action -> temporal -> script mix, de-duplicated on
(signal_type, extracted_text) keeping the first.

Match offsets come from ``split(lower(text), pattern, 2)``: the first part's
length is the match start in code points, and the text length minus the
second part's length is the match end. ``regexp_instr`` is not used because
it counts UTF-16 units, which is wrong after supplementary-plane characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift import dictionaries as D
from sift.functions import text as X
from sift.operators.dicts import small_rows
from sift.operators.matching import plain_forms, required_forms, required_literal, with_candidates, with_first_matches
from sift.operators.partitioning import pinned

KEEP_LEVELS = ("HIGH", "MEDIUM")
SIGNAL_ARRAY = ("array<struct<signal_type:string,extracted_text:string,"
                "significance:string,context_explanation:string>>")


def _sig(t, txt, sig, expl) -> Column:
    return F.struct(F.lit(t).alias("signal_type") if isinstance(t, str) else t.alias("signal_type"),
                    txt.alias("extracted_text"),
                    (F.lit(sig) if isinstance(sig, str) else sig).alias("significance"),
                    expl.alias("context_explanation"))


def java_pattern(p: str) -> str:
    """Python regex -> Java regex with Unicode ``\\w`` and the exact ``\\s`` class
    (Java's leaves out U+001C-U+001F)."""
    spaces = {"s": X.WS, "S": X.NWS}
    return "(?U)" + re.sub(r"\\(.)", lambda m: spaces.get(m[1], m[0]), p)


def _lexicon_frame(lexicon: DataFrame) -> DataFrame:
    """``ord, term, sig, expl, k``: terms in lexicon order with their lower-case form.
    Null terms are left out, other nulls are empty."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return lexicon.filter("term IS NOT NULL").select(
        "ord", "term", F.when(F.col("threat_level").isin(*KEEP_LEVELS), F.col("threat_level")).otherwise("LOW").alias("sig"),
        F.concat(part("meaning"), F.lit(" - "), part("note")).alias("expl"), F.lower("term").alias("k"))


def _lexicon_list(lexicon) -> list[tuple]:
    """(k, term, sig, expl) of a list of (term, meaning, level, note)."""
    return [(term.lower(), term, level if level in KEEP_LEVELS else "LOW", f"{meaning} - {note}") for term, meaning, level, note in lexicon]


def _lexicon_hits(hits: Column) -> Column:
    return F.transform(hits, lambda e: _sig("EUPHEMISM", e["term"], e["sig"], e["expl"]))


def _lexicon_inline(rows: list[tuple], low: Column) -> Column:
    if not rows:
        return F.array().cast(SIGNAL_ARRAY)
    names = ("k", "term", "sig", "expl")
    entries = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return _lexicon_hits(F.filter(entries, lambda e: F.contains(low, e["k"])))


def lexicon_signals(text: Column, lexicon: list | None = None, low: Column | None = None) -> Column:
    """C1 for a list of (term, meaning, level, note): lower-cased substring containment, one signal
    per term in order. HIGH/MEDIUM keep their level, every other level becomes LOW."""
    return _lexicon_inline(_lexicon_list(D.LEXICON if lexicon is None else lexicon), F.lower(text) if low is None else low)


def with_lexicon_signals(df: DataFrame, low: str, lexicon, out: str) -> DataFrame:
    """``out`` with the signals of a list or table (``ord, term, meaning,
    threat_level, note``) of any size on the lower-cased column ``low``."""
    if not isinstance(lexicon, DataFrame):
        return df.withColumn(out, lexicon_signals(F.lit(None), lexicon, F.col(low)))
    terms = _lexicon_frame(lexicon)
    rows = small_rows(terms, ["ord", "term", "sig", "expl", "k"])
    if rows is not None:
        return df.withColumn(out, _lexicon_inline([(r["k"], r["term"], r["sig"], r["expl"]) for r in rows], F.col(low)))
    # the needles are the signals as they come out: nothing is left to do per hit
    signal = _sig("EUPHEMISM", F.col("term"), F.col("sig"), F.col("expl"))
    needles = terms.select("ord", signal.alias("s"), F.col("k").alias("literal")).select("ord", "s.*", "literal")
    found = with_candidates(df, low, needles, out, [f.name for f in needles.schema if f.name not in ("ord", "literal")])
    return found.withColumn(out, F.when(F.col(low).isNotNull(), F.col(out)).otherwise(F.array().cast(SIGNAL_ARRAY)))


def _may_match(low: Column, pattern: str) -> Column:
    """Whether the text holds the literal that every match of ``pattern`` holds."""
    literal = required_literal(pattern)
    return F.contains(low, F.lit(literal)) if literal else F.lit(True)


def staged_pattern_offsets(df: DataFrame, low_col: str, groups) -> DataFrame:
    """For each (prefix, patterns) group and pattern i, ``{prefix}{i}`` =
    struct(s, e) of the first match in ``low_col`` or null; each split is
    evaluated once, and only on rows where the (cached) regex matches."""
    parts, offs = {}, {}
    for prefix, patterns in groups:
        for i, p in enumerate(patterns):
            pc = f"{prefix}{i}p"
            parts[pc] = F.when(_may_match(F.col(low_col), p) & F.col(low_col).rlike(java_pattern(p)), F.split(F.col(low_col), F.lit(java_pattern(p)), 2))
            offs[f"{prefix}{i}"] = F.when(F.col(pc).isNotNull(), F.struct(
                F.length(F.element_at(F.col(pc), 1)).alias("s"),
                (F.length(low_col) - F.length(F.element_at(F.col(pc), 2))).alias("e")))
    return df.withColumns(parts).withColumns(offs).drop(*parts.keys())


def _first_match(text: Column, pattern: str, low: Column | None = None):
    """(matched, start, end) of the first match of ``pattern`` in lower(text).

    ``matched`` is a cached-regex ``rlike``; callers put the offset work
    under ``when(matched, ...)`` so the split only runs on matching rows."""
    low = F.lower(text) if low is None else low
    parts = F.split(low, F.lit(java_pattern(pattern)), 2)
    matched = _may_match(low, pattern) & low.rlike(java_pattern(pattern))
    start = F.length(F.element_at(parts, 1))
    end = F.length(low) - F.length(F.try_element_at(parts, F.lit(2)))
    return matched, start, end, low


def _window(text: Column, low: Column, start: Column, end: Column, before: int, after: int) -> Column:
    lo = F.greatest(start - before, F.lit(0))
    hi = F.least(end + after, F.length(low))
    return X.strip_u(F.substring(text, lo + 1, hi - lo))


def _action(near: Column, hit: Column, name: Column) -> Column:
    return _sig("CALL_TO_ACTION", near, "MEDIUM", F.concat(F.lit("call-to-action pattern: '"), name, F.lit("'")))


def _urgency(near: Column, hit: Column, name: Column) -> Column:
    return _sig("TEMPORAL", hit, "LOW", F.concat(F.lit("urgency near: '"), near, F.lit("'")))


#: How much of the text before and after a match a signal shows.
AROUND = {_action: (20, 40), _urgency: (15, 30)}


def _at(signal, text: Column, low: Column, start: Column, end: Column, name: Column) -> Column:
    return signal(_window(text, low, start, end, *AROUND[signal]), F.substring(low, start + 1, end - start), name)


def _inline_patterns(text: Column, patterns: list[str], low: Column | None, signal) -> Column:
    out = []
    for p in patterns:
        m, s, e, lw = _first_match(text, p, low)
        out.append(F.when(m, _at(signal, text, lw, s, e, F.lit(p.strip()))))
    return _compact(out)


def action_signals(text: Column, patterns: list | None = None, low: Column | None = None) -> Column:
    """C2 for a list: per pattern, the original text from 20 before to 40 after the first
    match, stripped; significance MEDIUM."""
    return _inline_patterns(text, D.ACTION_PATTERNS if patterns is None else patterns, low, _action)


def urgency_signals(text: Column, patterns: list | None = None, low: Column | None = None) -> Column:
    """C3 for a list: per pattern, the matched lower-case text; the -15/+30 context goes
    into the explanation; significance LOW."""
    return _inline_patterns(text, D.URGENCY_PATTERNS if patterns is None else patterns, low, _urgency)


def _pattern_needles(batches):
    """(ord, pattern) -> ord, pattern, its Java form (null if its literals are all that it matches) and a literal, a row for each of those of which it needs one."""
    for b in batches:
        rows = []
        for o, p in zip(*(b.column(i).to_pylist() for i in (0, 1))):
            plain = plain_forms(p)
            rows += [(o, p, None if plain else java_pattern(p), form) for form in plain or required_forms(p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.string()] * 3))],
                                         ["ord", "pattern", "java", "literal"])


def _with_pattern_signals(df: DataFrame, text_col: str, low: str, patterns, default: list[str], signal, out: str) -> DataFrame:
    """``out`` with the signals of a list or table (``ord, pattern``) of any size."""
    text, lw = F.col(text_col), F.col(low)
    if isinstance(patterns, DataFrame):
        table = patterns.filter("pattern IS NOT NULL").select(F.col("ord").cast("long").alias("ord"), "pattern")
        rows = small_rows(table, ["ord", "pattern"])
        if rows is None:
            # a pattern takes a while to read: all tasks share them
            needles = table.repartition(df.sparkSession.sparkContext.defaultParallelism, "pattern").mapInArrow(
                _pattern_needles, "ord long, pattern string, java string, literal string")
            d = with_first_matches(df, text_col, low, needles, "__c", *AROUND[signal], java_pattern)
            other = lambda c: c["java"].isNotNull()
            d = d.withColumn("__c", F.transform("__c", lambda c: c.withField("parts", F.when(other(c), F.split(lw, c["java"], 2)))))
            # a text in two parts has a match; an empty one at its start leaves it whole
            d = d.withColumn("__c", F.filter("__c", lambda c: ~other(c) | (F.size(c["parts"]) > 1) | F.rlike(lw, c["java"])))
            return d.withColumn(out, F.transform("__c", lambda c: F.when(~other(c), signal(c["near"], c["hit"], c["name"])).otherwise(_at(
                signal, text, lw, F.length(F.element_at(c["parts"], 1)), F.length(lw) - F.length(F.try_element_at(c["parts"], F.lit(2))), c["name"])))).drop("__c")
        patterns = [r["pattern"] for r in rows]
    patterns = default if patterns is None else patterns
    staged = staged_pattern_offsets(df, low, [("__m", patterns)])
    items = [F.when(F.col(f"__m{i}").isNotNull(), _at(signal, text, lw, F.col(f"__m{i}.s"), F.col(f"__m{i}.e"), F.lit(p.strip())))
             for i, p in enumerate(patterns)]
    return staged.withColumn(out, _compact(items)).drop(*[f"__m{i}" for i in range(len(patterns))])


def with_action_signals(df: DataFrame, text_col: str, low: str, patterns, out: str) -> DataFrame:
    return _with_pattern_signals(df, text_col, low, patterns, D.ACTION_PATTERNS, _action, out)


def with_urgency_signals(df: DataFrame, text_col: str, low: str, patterns, out: str) -> DataFrame:
    return _with_pattern_signals(df, text_col, low, patterns, D.URGENCY_PATTERNS, _urgency, out)


def script_signal(ar_ratio: Column) -> Column:
    """C4: Arabic-run share above 5 %: >20 % HIGH, >10 % MEDIUM, else LOW."""
    sig = F.when(ar_ratio > 0.2, "HIGH").when(ar_ratio > 0.1, "MEDIUM").otherwise("LOW")
    pct = F.format_string("%.1f%%", ar_ratio * 100)
    s = _sig("OTHER", F.concat(F.lit("arabic script ratio: "), pct), sig,
             F.concat(F.lit("arabic script share of "), pct, F.lit("; needs review")))
    return _compact([F.when(ar_ratio > 0.05, s)])


def _compact(items) -> Column:
    if not items:
        return F.array().cast(SIGNAL_ARRAY)
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def dedup_signals(arr: Column) -> Column:
    """Keep the first signal of each (signal_type, extracted_text).

    One left fold whose lambda only touches its own arguments (an outer
    column inside a lambda can be inlined by Catalyst and then recomputed
    per element)."""
    init = F.struct(F.array().cast("array<struct<t:string,x:string>>").alias("keys"),
                    F.array().cast(SIGNAL_ARRAY).alias("out"))

    def step(acc, s):
        k = F.struct(s["signal_type"].alias("t"), s["extracted_text"].alias("x"))
        seen = F.array_contains(acc["keys"], k)
        return F.struct(F.when(seen, acc["keys"]).otherwise(F.array_append(acc["keys"], k)).alias("keys"),
                        F.when(seen, acc["out"]).otherwise(F.array_append(acc["out"], s)).alias("out"))
    return F.aggregate(arr, init, step, lambda acc: acc["out"])


def extract_signals(df: DataFrame, text_col: str = "text", ar_col: str | None = None,
                    lexicon=None, action_patterns=None, urgency_patterns=None,
                    out: str = "signals") -> DataFrame:
    """C5 composite on the raw text; adds ``signals`` and ``signal_count``. Each
    dictionary is a list or a table of any size (None: the defaults)."""
    d = df if ar_col else X.with_script_mix(df, text_col, "__mix")
    ar = F.col(ar_col or "__mix.ar")
    d = d.withColumn("__low", F.lower(text_col))
    d = with_lexicon_signals(d, "__low", lexicon, "__lexicon")
    d = with_action_signals(d, text_col, "__low", action_patterns, "__action")
    d = with_urgency_signals(d, text_col, "__low", urgency_patterns, "__urgency")
    return (d.withColumn("__all", F.concat("__lexicon", "__action", "__urgency", script_signal(ar)))
            .withColumn(out, dedup_signals(F.col("__all")))
            .drop("__low", "__lexicon", "__action", "__urgency", "__all", "__mix")
            .withColumns({"signal_count": F.size(out)}))


def signal_types(arr: Column, none: str = "—") -> Column:
    """Signal types joined by ", "; a dash when there are none."""
    j = F.array_join(F.transform(arr, lambda s: s["signal_type"]), ", ")
    return F.when(F.size(arr) > 0, j).otherwise(F.lit(none))


def rollup_by_type(df: DataFrame, col: str = "signals") -> DataFrame:
    """Count of signals per type and significance (partial aggregation). The signals are
    pinned: the optimizer asks whether an exploded array is empty below the projections that
    make it, and would write them all out there a second time."""
    return (pinned(df.select(col), col).select(F.explode(col).alias("s"))
            .groupBy(F.col("s.signal_type").alias("signal_type"),
                     F.col("s.significance").alias("significance"))
            .agg(F.count(F.lit(1)).alias("n")))

