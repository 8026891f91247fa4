"""DuckDB SQL builders mirroring ``sift.functions`` (oracle side only).

These produce SQL text for the driver's DuckDB cross-check; they are not an
execution path of the library.
"""

from __future__ import annotations

import math

from sift import dictionaries as D
from sift.functions.text import ARABIC_RUN_RE, HASHTAG_RE, LATIN_RUN_RE, MENTION_RE, URL_RE, WS  # noqa: F401
from sift.schemas import DEFAULT_SCHEME


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_u(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS + '+')}), lambda w: w <> '')"


def collapse_ws(x: str) -> str:
    return strip_u(f"regexp_replace({x}, {q(WS + '+')}, ' ', 'g')")


def strip_urls(x: str) -> str:
    return f"regexp_replace({x}, {q(URL_RE)}, '', 'g')"


def emoji_fold(x: str, pairs=None) -> str:
    pairs = pairs if pairs is not None else D.EMOJI
    out = x
    for e, t in pairs:
        out = f"replace({out}, {q(e)}, {q(' ' + t + ' ')})"
    return out


def has_any(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def slang_map(x: str, pairs=None) -> str:
    pairs = pairs if pairs is not None else D.SLANG
    m = "MAP {" + ", ".join(f"{q(k.lower())}: {q(v)}" for k, v in pairs) + "}"
    return (f"array_to_string(list_filter(list_transform({words(x)}, lambda w: coalesce(({m})[lower(w)], w)),"
            f" lambda w: w <> ''), ' ')")


def mentions_hashtags(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, {q(MENTION_RE)}, '', 'g'), "
            f"{q(HASHTAG_RE)}, '\\1', 'g')")


def script_mix(x: str):
    ar = f"CAST(len(regexp_extract_all({x}, {q(ARABIC_RUN_RE)})) AS DOUBLE)"
    la = f"CAST(len(regexp_extract_all({x}, {q(LATIN_RUN_RE)})) AS DOUBLE)"
    tot = f"({ar} + {la} + 1.0)"
    return (f"round({la} / {tot}, 3)", f"round({ar} / {tot}, 3)",
            f"round(1.0 - {la} / {tot} - {ar} / {tot}, 3)")


def text_hash(x: str) -> str:
    return f"sha256(lower({strip_u(x)}))"


def labels_list(scheme=DEFAULT_SCHEME) -> str:
    return "[" + ", ".join(q(l) for l in scheme.labels) + "]"


def argmax_label(p: str, scheme=DEFAULT_SCHEME) -> str:
    return f"({labels_list(scheme)})[list_position({p}, list_max({p}))]"


def entropy(p: str) -> str:
    return (f"(0.0 - list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_filter({p}, lambda x: x > 0), "
            f"lambda x: x * log2(x))), lambda a, b: a + b))")


def prediction_set(p: str, alpha: float = 0.1, scheme=DEFAULT_SCHEME) -> str:
    """Sorted by (-p, index); keep k while the sum of the first k-1 is below
    1 - alpha (sequential left fold, same order as the reference)."""
    thr = repr(1.0 - alpha)
    srt = f"list_sort(list_transform({p}, lambda x, i: {{'np': -x, 'i': i}}))"
    keep = (f"list_filter({srt}, lambda s, k: list_reduce(list_prepend(0.0::DOUBLE, "
            f"list_transform(list_slice({srt}, 1, k - 1), lambda y: -y.np)), lambda a, b: a + b) < {thr})")
    return f"list_transform({keep}, lambda s: ({labels_list(scheme)})[s.i])"


def confidence(p: str, scheme=DEFAULT_SCHEME) -> str:
    parts = " ".join(f"WHEN list_max({p}) >= {b} THEN {q(n)}" for b, n in scheme.confidence_bands)
    return f"CASE {parts} ELSE {q(scheme.low_confidence)} END"


def uncertainty_cols(p: str, scheme=DEFAULT_SCHEME, alpha: float = 0.1) -> dict:
    fb = "[" + ", ".join(repr(float(x)) for x in scheme.fallback_probs) + "]::DOUBLE[]"
    allset = labels_list(scheme)
    pset = f"CASE WHEN {p} IS NULL THEN {allset} ELSE {prediction_set(p, alpha, scheme)} END"
    return {
        "label": f"CASE WHEN {p} IS NULL THEN {q(scheme.fallback)} ELSE {argmax_label(p, scheme)} END",
        "probabilities": f"coalesce({p}, {fb})",
        "confidence": f"CASE WHEN {p} IS NULL THEN {q(scheme.low_confidence)} ELSE {confidence(p, scheme)} END",
        "entropy": f"CASE WHEN {p} IS NULL THEN {repr(math.log2(len(scheme.labels)))} ELSE {entropy(p)} END",
        "prediction_set": pset,
    }


def renormalize(p: str, guard_zero: bool = True) -> str:
    tot = f"list_reduce(list_prepend(0.0::DOUBLE, {p}), lambda a, b: a + b)"
    scaled = f"list_transform({p}, lambda x: round(x / {tot}, 4))"
    return f"CASE WHEN {tot} > 0 THEN {scaled} ELSE {p} END" if guard_zero else scaled


def text_scores(source: str, key: str, text: str, bias, weights: str | None = None) -> str:
    """CTEs ``tok``, ``weight``, ``sums`` and ``scored`` (source's columns and p): a linear
    model over token counts of ``text`` (collapsed), with p null where there is no token."""
    from sift.plans.derive import CORPUS_WEIGHTS
    rows = ", ".join(f"({q(w)}, {v[0]}, {v[1]}, {v[2]})" for w, v in CORPUS_WEIGHTS.items())
    weights = weights or f"SELECT * FROM (VALUES {rows}) AS v(w, w0, w1, w2)"
    e = [f"exp(({b} + coalesce(s{i}, 0) / n) / 1000.0)" for i, b in enumerate(bias)]
    p = ", ".join(f"round({x} / ({' + '.join(e)}), 4)" for x in e)
    return f"""
tok AS (SELECT {key} AS k, unnest(string_split(lower({text}), ' ')) AS w FROM {source} WHERE {text} <> ''),
weight AS (SELECT DISTINCT * FROM ({weights})),
sums AS (SELECT k, COUNT(*) AS n, sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2 FROM tok LEFT JOIN weight USING (w) GROUP BY k),
scored AS (SELECT x.*, CASE WHEN n > 0 THEN [{p}] END AS p FROM {source} x LEFT JOIN sums ON sums.k = x.{key})"""


def fuse(local: str, expert: str, wl: float = 0.4, we: float = 0.6) -> str:
    mixed = (f"list_transform(list_zip({local}, {expert}), lambda z: round({wl} * coalesce(z[1], 0.0) "
             f"+ {we} * coalesce(z[2], 0.0), 4))")
    return renormalize(mixed)


def sig_struct(t: str, txt: str, sig: str, expl: str) -> str:
    return f"{{'signal_type': {t}, 'extracted_text': {txt}, 'significance': {sig}, 'context_explanation': {expl}}}"


def lexicon_signals(text: str, rows) -> str:
    items = ", ".join(
        "{" + f"'k': {q(term.lower())}, 'term': {q(term)}, "
        f"'sig': {q(level if level in ('HIGH', 'MEDIUM') else 'LOW')}, 'expl': {q(meaning + ' - ' + note)}" + "}"
        for term, meaning, level, note in rows)
    return (f"list_transform(list_filter([{items}], lambda e: contains(lower({text}), e.k)), "
            f"lambda e: {sig_struct(q('EUPHEMISM'), 'e.term', 'e.sig', 'e.expl')})")


def _first_match(text: str, pat: str):
    low = f"lower({text})"
    matched = f"regexp_matches({low}, {q(pat)})"
    start = f"length(regexp_extract({low}, {q('(?s)^(.*?)(?:' + pat + ')')}, 1))"
    mlen = f"length(regexp_extract({low}, {q('(?s)^.*?(' + pat + ')')}, 1))"
    end = f"({start} + {mlen})"
    return matched, start, end, low


def _window(text: str, low: str, start: str, end: str, before: int, after: int) -> str:
    lo = f"greatest({start} - {before}, 0)"
    hi = f"least({end} + {after}, length({low}))"
    return strip_u(f"substring({text}, {lo} + 1, {hi} - {lo})")


def action_signals(text: str, pats) -> str:
    items = []
    for p in pats:
        m, s, e, low = _first_match(text, p)
        ctx = _window(text, low, s, e, 20, 40)
        items.append(f"CASE WHEN {m} THEN {sig_struct(q('CALL_TO_ACTION'), ctx, q('MEDIUM'), q(f'call-to-action pattern: {chr(39)}{p.strip()}{chr(39)}'))} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def urgency_signals(text: str, pats) -> str:
    items = []
    for p in pats:
        m, s, e, low = _first_match(text, p)
        ctx = _window(text, low, s, e, 15, 30)
        matched = f"substring({low}, {s} + 1, {e} - {s})"
        expl = f"('urgency near: ''' || {ctx} || '''')"
        items.append(f"CASE WHEN {m} THEN {sig_struct(q('TEMPORAL'), matched, q('LOW'), expl)} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def script_signal(ar: str) -> str:
    pct = f"format('{{:.1f}}%', {ar} * 100)"
    sig = f"CASE WHEN {ar} > 0.2 THEN 'HIGH' WHEN {ar} > 0.1 THEN 'MEDIUM' ELSE 'LOW' END"
    s = sig_struct(q("OTHER"), f"('arabic script ratio: ' || {pct})", sig,
                   f"('arabic script share of ' || {pct} || '; needs review')")
    return f"list_filter([CASE WHEN {ar} > 0.05 THEN {s} END], lambda x: x IS NOT NULL)"


def dedup_signals(arr: str) -> str:
    return (f"list_filter({arr}, lambda s, i: len(list_filter(list_slice({arr}, 1, i - 1), "
            f"lambda y: y.signal_type = s.signal_type AND y.extracted_text = s.extracted_text)) = 0)")


def all_signals(text: str, lexicon, action, urgency, ar: str) -> str:
    cat = (f"list_concat(list_concat(list_concat({lexicon_signals(text, lexicon)}, {action_signals(text, action)}), "
           f"{urgency_signals(text, urgency)}), {script_signal(ar)})")
    return dedup_signals(cat)


def signal_types(arr: str) -> str:
    return f"CASE WHEN len({arr}) > 0 THEN array_to_string(list_transform({arr}, lambda s: s.signal_type), ', ') ELSE '—' END"
