"""Text column expressions (all JVM-side, inside whole-stage codegen).

Regex classes are spelled out so Spark (Java regex) and Python agree:
Java's ``\\s``/``\\w`` are ASCII-only, Python's are Unicode. ``WS`` is exactly
the set of characters for which Python's ``str.isspace()`` is true, so
``split(WS+)`` equals ``str.split()`` and stripping with it equals
``str.strip()``. ``WORD`` is letters, digits and underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed character classes (Python str.isspace set; Unicode word characters).
WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NWS = "[^" + WS[1:]
WORD = r"[\p{L}\p{N}_]"

URL_RE = rf"https?://{NWS}+|www\.{NWS}+"
MENTION_RE = rf"@{WORD}+"
HASHTAG_RE = rf"#({WORD}+)"
ARABIC_RUN_RE = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]+"
LATIN_RUN_RE = r"[a-zA-Z]+"
HTML_TAG_RE = r"<[^>]+>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_u(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), rf"^{WS}+|{WS}+$", "")


def collapse_ws(c) -> Column:
    """Every whitespace run becomes one space, then strip (B12). After the
    replacement the only whitespace left is ' ', so a plain trim strips."""
    return F.trim(F.regexp_replace(_c(c), f"{WS}+", " "))


def count_spaced_tokens(c) -> Column:
    """Token count of a collapsed text (single spaces, no edge spaces):
    spaces + 1, or 0 for the empty string. No array is built."""
    col = _c(c)
    return F.when(col == "", F.lit(0)).otherwise(
        F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit(""))) + 1).cast("int")


def count_runs(c, cls: str, marker: str) -> Column:
    """Number of maximal runs of ``cls`` characters in one linear regex pass,
    without building an array: each run plus the non-class text after it
    becomes ``marker`` (a member of ``cls``), leaving a class-free prefix
    followed by one marker per run; the trailing markers are counted."""
    neg = "[^" + cls[1:]
    r = F.regexp_replace(_c(c), f"{cls}+{neg}*", marker)
    return F.length(r) - F.length(F.rtrim(r, F.lit(marker)))


def words(c) -> Column:
    """``str.split()``: whitespace tokens, no empty tokens."""
    return F.array_remove(F.split(_c(c), f"{WS}+"), "")


def token_count(c) -> Column:
    return F.size(words(c))


def extract_urls(c) -> Column:
    """All URL matches, in order."""
    col = _c(c)
    return F.when(_maybe_url(col), F.regexp_extract_all(col, F.lit(URL_RE), 0)).otherwise(
        F.when(col.isNotNull(), F.array().cast("array<string>")))


def _maybe_url(col: Column) -> Column:
    """Texts without a URL's beginning skip the pattern."""
    return F.contains(col, F.lit("http")) | F.contains(col, F.lit("www."))


def strip_urls(c) -> Column:
    col = _c(c)
    return F.when(_maybe_url(col), F.regexp_replace(col, URL_RE, "")).otherwise(col)


def strip_mentions(c) -> Column:
    return F.regexp_replace(_c(c), MENTION_RE, "")


def unwrap_hashtags(c) -> Column:
    return F.regexp_replace(_c(c), HASHTAG_RE, "$1")


def strip_marks(c) -> Column:
    """Mentions removed, then hashtags unwrapped, then whitespace collapsed; ``c`` is
    collapsed already, so texts without a mark are left as they are."""
    col = _c(c)
    marked = F.contains(col, F.lit("@")) | F.contains(col, F.lit("#"))
    return F.when(marked, collapse_ws(unwrap_hashtags(strip_mentions(col)))).otherwise(col)


def strip_html(c) -> Column:
    """Delete tags; entities are left as they are."""
    return F.regexp_replace(_c(c), HTML_TAG_RE, "")


def sha256_hex(c) -> Column:
    return F.sha2(_c(c), 256)


def text_hash(c) -> Column:
    """sha256 of the stripped, lower-cased text."""
    return F.sha2(F.lower(strip_u(c)), 256)


def short_id(c) -> Column:
    """First 16 hex digits of sha256 of the raw text (B15 document id)."""
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def with_script_mix(df, text_col: str, out: str):
    """B13 staged: each run count and share is its own projected column, so nothing
    is evaluated twice per row."""
    text, la, ar = F.col(text_col), f"{out}__la", f"{out}__ar"
    ar_any = (F.octet_length(text) > F.length(text)) & text.rlike(ARABIC_RUN_RE[:-1])  # plain ASCII skips the pattern
    arabic = F.regexp_replace(text, f"{ARABIC_RUN_RE}[^" + ARABIC_RUN_RE[1:-1] + "*", "\u0627")
    marks = df.withColumns({la: F.regexp_replace(text, f"{LATIN_RUN_RE}[^a-zA-Z]*", "a"), ar: F.when(ar_any, arabic).otherwise(F.lit(""))})
    runs = marks.withColumns({la: (F.length(la) - F.length(F.rtrim(F.col(la), F.lit("a")))).cast("double"),
                              ar: (F.length(ar) - F.length(F.rtrim(F.col(ar), F.lit("\u0627")))).cast("double")})
    total = F.col(ar) + F.col(la) + F.lit(1.0)
    shares = runs.withColumns({la: F.col(la) / total, ar: F.col(ar) / total})
    return (shares.withColumn(out, F.struct(F.round(la, 3).alias("id"), F.round(ar, 3).alias("ar"),
                                            F.round(F.lit(1.0) - F.col(la) - F.col(ar), 3).alias("other")))
            .drop(la, ar))


def preview(c, n: int, ellipsis: str = "") -> Column:
    """First ``n`` characters, optionally followed by a marker."""
    s = F.substring(_c(c), 1, n)
    return F.concat(s, F.lit(ellipsis)) if ellipsis else s


def title_body(title, body, sep: str = ". ") -> Column:
    """``"{title}. {body}"`` when body is non-empty, else title."""
    t, b = strip_u(title), strip_u(body)
    return F.when(F.coalesce(b, F.lit("")) != "", F.concat(t, F.lit(sep), b)).otherwise(t)


def replace_all_literal(c, pairs) -> Column:
    """Fold of literal replacements in order (B9). ``pairs`` = [(find, repl)]."""
    out = _c(c)
    for find, repl in pairs:
        out = F.replace(out, F.lit(find), F.lit(repl))
    return out


def contains_any_literal(c, needles) -> Column:
    col = _c(c)
    if not needles:
        return F.lit(False)
    out = None
    for n in needles:
        e = F.contains(col, F.lit(n))
        out = e if out is None else (out | e)
    return out


def map_tokens(c, mapping) -> Column:
    """Whole-token lookup on lower-cased tokens, single pass; an empty
    replacement deletes the token; tokens rejoined by one space (B10).
    ``mapping`` is a dict, or a map column of the row's own."""
    toks = words(c)
    if isinstance(mapping, dict):
        if not mapping:
            return F.array_join(toks, " ")
        mapping = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    mapped = F.transform(toks, lambda w: F.coalesce(F.try_element_at(mapping, F.lower(w)), w))
    return F.array_join(F.array_remove(mapped, ""), " ")


def has_token_in(c, keys) -> Column:
    """Whether a collapsed text holds one of the tokens ``keys``, in lower case: a hashed
    ``arrays_overlap`` of built-ins, no lambda and no regex alternation."""
    if not keys:
        return F.lit(False)
    toks = F.split(F.lower(_c(c)), " ")
    return F.coalesce(F.arrays_overlap(toks, F.array(*[F.lit(k) for k in sorted(keys)])), F.lit(False))
