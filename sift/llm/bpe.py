"""BPE encoding and decoding by a prefix-sharing trie.

The encoding of a prefix is fixed by its last token: it is the encoding of
what stands before that token, followed by it, and exactly one token that ends
the prefix can follow what stands before (the two must not be merged across
their boundary at any step). So the distinct words of a batch go into a trie,
which is walked depth first with one last token a level; words that share a
prefix share its states, and a word's ids are read back along its own path.

A vocabulary file of the ``tokenizers`` library (``word_bpe_49k.json`` by
default; its path is a parameter) gives tokens, merges, special tokens and the
word pattern; it must be a BPE over byte symbols with an end-of-word suffix.
The driver reads it and broadcasts its text (1.7 MB, as large for any input).

Defined results: a null text encodes as an empty one, to no ids; null ids
decode to an empty text; ids outside the vocabulary decode to nothing. Special
tokens that occur in a text become their ids, as in the library. Whole texts
are encoded, whatever their length. Columns named as an output are replaced;
all others pass through. Repeated rows each give a row. There is no shuffle.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from sift.llm.common import without

CHARS = 1_500_000  # texts are taken in steps of so many characters, so that memory is bounded
CACHED_WORDS = 60_000  # a worker forgets its words beyond this; results do not depend on it


# Unicode calls these separators white space for Python, not for the library.
ODD = re.compile("[\x1c-\x1f]").search
# Characters that the library's Unicode tables may class or compose in another way: those which
# Python's tables do not assign, and three marks of another combining class.
RARE = np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)
RARE[[0x1df6, 0x1e4ec, 0x1e4ed]] = True


def has_rare(text: str) -> bool:
    return bool(RARE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1
    character, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], n = chr(n), n + 1
    return [out[b] for b in range(256)]


def _from_the_end(tokens: dict[str, int]) -> dict:
    root: dict = {}
    for text, token in tokens.items():
        node = root
        for c in reversed(text):
            node = node.setdefault(c, {})
        node[""] = token
    return root


class Vocabulary:
    """Tokens, and which of them can stand next to each other."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names |= {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.normalizer, self.split = json.dumps(spec["normalizer"]), json.dumps(split)
        # Python's own normalisation is used where it does the same
        self.plain = ({"type": "NFC"} in spec["normalizer"]["normalizers"]
                      and spec["normalizer"]["normalizers"][-1] == {"type": "Lowercase"}
                      and len(spec["normalizer"]["normalizers"]) == 3)
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = r
            made[self.ids[a + b]] = (*pair, r)
        # edge[side][t]: the symbols at that edge of t as it is put together,
        # each with the merge that ends it (none ends t itself)
        self.edge: list[dict[int, list[tuple[int, float]]]] = [{}, {}]
        none = float("inf")
        for t in self.names:
            for side in (0, 1):
                steps, x, until = [(t, none)], t, none
                while x in made:
                    until, x = made[x][2], made[x][side]
                    steps.append((x, until))
                self.edge[side][t] = steps[::-1]
        self.apart: dict[int, bool] = {}  # by first token * 2**32 + second
        # tokens that their own text encodes to: each half is one, and the
        # halves are merged by their own merge, not by an earlier one
        whole = {t for t in self.names if t not in made}
        for t, (a, b, r) in sorted(made.items(), key=lambda x: x[1][2]):
            if a in whole and b in whole and self._first_merge(a, b) == r:
                whole.add(t)
        self.inner = {s: i for s, i in self.ids.items() if i in whole and not s.endswith(self.suffix)}
        self.final = {s[:-len(self.suffix)]: i for s, i in self.ids.items() if i in whole and s.endswith(self.suffix)}
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.rare: set[str] = set()  # runs with a character of RARE
        # tokens by their symbols from the last to the first; "" holds the token that starts there
        self.inner_ends, self.final_ends = _from_the_end(self.inner), _from_the_end(self.final)

    def _first_merge(self, a: int, b: int) -> float:
        """The merge that first joins symbols across the boundary of a and b
        (infinity: none does), replaying both sides in merge order."""
        left, right = self.edge[1][a], self.edge[0][b]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = self.rank.get((x, y), float("inf"))
            # equal merges are done from the left: before the boundary, then at it, then after it
            if r < x_until and r <= y_until:
                return r
            if x_until == y_until == float("inf"):
                return float("inf")
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def follows(self, a: int, b: int) -> bool:
        ok = self.apart.get(a << 32 | b)
        if ok is None:
            if len(self.apart) > 2 * CACHED_WORDS:
                self.apart.clear()
            ok = self.apart[a << 32 | b] = self._first_merge(a, b) == float("inf")
        return ok

    def encode_words(self, words: set[str]) -> None:
        """Put the ids of ``words`` into the cache, by one walk of their trie."""
        symbols = self.symbols
        trie: dict = {}
        for w in words:
            s = w if w.isascii() and w.isprintable() else "".join([symbols[x] for x in w.encode()])
            node = trie
            for c in s[:-1]:
                node = node.setdefault(c, {})
            # a final symbol is a leaf of its own, as it carries the suffix
            node.setdefault("", []).append((w, s))
        last: list[int] = []  # of each prefix on the current path: the last token, and where it starts
        start: list[int] = []
        apart, follows, cache = self.apart.get, self.follows, self.cache
        inner, final = self.inner_ends, self.final_ends

        def ending(path: str, ends: dict) -> tuple[int, int]:
            """The last token of ``path`` and where it starts: the longest that can follow
            what stands before it."""
            found, at = [], len(path)
            while at:
                at -= 1
                ends = ends.get(path[at])
                if ends is None:
                    break
                t = ends.get("")
                if t is not None:
                    found.append((t, at))
            for t, at in reversed(found):
                if not at:
                    return t, 0
                ok = apart(last[at - 1] << 32 | t)
                if ok or ok is None and follows(last[at - 1], t):
                    return t, at
            raise ValueError("a byte has no token in this vocabulary")

        todo = [("", trie)]
        while todo:
            path, node = todo.pop()
            if path:
                del last[len(path) - 1:], start[len(path) - 1:]
                t, at = ending(path, inner)
                last.append(t)
                start.append(at)
            for c, child in node.items():
                if c:
                    todo.append((path + c, child))
                    continue
                for w, s in child:
                    t, at = ending(s, final)
                    ids = [t]
                    while at:
                        ids.append(last[at - 1])
                        at = start[at - 1]
                    cache[w] = struct.pack(f"<{len(ids)}I", *ids[::-1])

    def _slow_pieces(self, text: str) -> list:
        """Words (str) and special tokens (int) of any text, by the library's own normalizer and splitter."""
        out: list = []
        for i, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                out.append(self.special[part])
            elif part:
                tok = _pieces(self.normalizer, self.split)
                out += [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))]
        return out

    def _chunks(self, text: str) -> list[str] | None:
        """Normalised runs between white space, or None where only the slow way
        is sure to equal the library: special tokens, and separators that
        Python and the library see differently."""
        if not self.plain or ODD(text) or self.at_special and self.at_special.search(text):
            return None
        if not text.isascii():
            # the library lowers each character by itself, so sigma has no final form
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower().split()

    def forget(self) -> None:
        for held in (self.cache, self.chunks, self.rare, self.apart):
            held.clear()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Words never span white space,
        so the ids of a run between white space are kept, too."""
        every = [self._chunks(t) for t in texts]
        runs = set().union(*(c for c in every if c is not None))
        if len(self.cache) > CACHED_WORDS or len(self.chunks) > 2 * CACHED_WORDS:
            # all is forgotten but the runs that this batch shares with those before, the frequent ones
            self.cache.clear()
            self.rare.clear()
            self.chunks = {c: self.chunks[c] for c in runs if c in self.chunks}
        new = runs.difference(self.chunks)
        wide = [c for c in new if not c.isascii()]
        if wide and has_rare("".join(wide)):
            self.rare |= {c for c in wide if has_rare(c)}
        if self.rare:  # texts with such a run go the slow way as they were, before Python normalised them
            every = [None if c is not None and not self.rare.isdisjoint(c) else c for c in every]
            new -= self.rare
        slow = {i: self._slow_pieces(texts[i]) for i, c in enumerate(every) if c is None}
        new = {c: self.words(c) for c in new}
        words = {w for ws in new.values() for w in ws} | {w for ws in slow.values() for w in ws if isinstance(w, str)}
        words.difference_update(self.cache)
        if words:
            enabled = gc.isenabled()
            gc.disable()  # a trie has no cycles; the collector would walk it over and over
            try:
                self.encode_words(words)
            finally:
                if enabled:
                    gc.enable()
        word = self.cache.__getitem__
        for c, ws in new.items():
            self.chunks[c] = b"".join(map(word, ws))
        chunk = self.chunks.__getitem__
        return [b"".join(map(chunk, c)) if c is not None else
                b"".join(word(w) if isinstance(w, str) else struct.pack("<I", w) for w in slow[i])
                for i, c in enumerate(every)]


class Names:
    """Token texts by id, for decoding."""

    def __init__(self, text: str):
        spec = json.loads(text)
        by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = np.full(max(by_id, default=-1) + 2, None, object)
        self.names[list(by_id)] = list(by_id.values())
        self.known = np.array([t is not None for t in self.names])

    def decode(self, ids: bytes) -> str:
        at = np.minimum(np.frombuffer(ids, "<u4"), len(self.names) - 1)  # the last place is no token
        if not self.known[at].all():
            at = at[self.known[at]]
        return " ".join(self.names[at].tolist())


_loaded: dict[type, tuple] = {}
_normalizers: dict[tuple[str, str], object] = {}


def _of(kind: type, text: str):
    """One ``kind`` a worker process, for the file whose text is given."""
    key = hash(text)
    if _loaded.get(kind, (None,))[0] != key:
        _loaded[kind] = key, kind(text)
    return _loaded[kind][1]


def _pieces(normalizer: str, split: str):
    """The library's normalizer and word splitter, once a worker process."""
    if (normalizer, split) not in _normalizers:
        from tokenizers import Tokenizer
        bare = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "pre_tokenizer": json.loads(split),
                "post_processor": None, "decoder": None, "normalizer": json.loads(normalizer),
                "model": {"type": "BPE", "vocab": {}, "merges": []}}
        _normalizers[normalizer, split] = Tokenizer.from_str(json.dumps(bare))
    return _normalizers[normalizer, split]


def _steps(sizes):
    """Ranges of rows with about CHARS in each."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``token_ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""
    with open(path or default_path(), encoding="utf-8") as f:
        vocab = df.sparkSession.sparkContext.broadcast(f.read())
    df = without(df, *(c for c in ("token_ids", "n_tokens") if c != text_col))
    schema = StructType([*df.schema.fields, StructField("token_ids", BinaryType()), StructField("n_tokens", LongType())])

    def run(batches):
        v = _of(Vocabulary, vocab.value)
        for b in batches:
            col = b.column(b.schema.get_field_index(text_col))
            texts = [t or "" for t in col.to_pylist()]
            for lo, hi in _steps([len(t) for t in texts]):
                ids = v.encode_batch(texts[lo:hi])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    [*part.schema.names, "token_ids", "n_tokens"])
        v.forget()  # the worker goes on to other tasks

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "token_ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of the ids as the library's decode gives it (special tokens kept)."""
    with open(path or default_path(), encoding="utf-8") as f:
        vocab = df.sparkSession.sparkContext.broadcast(f.read())
    df = without(df, out)
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches):
        v = _of(Names, vocab.value)
        for b in batches:
            ids = [x or b"" for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            for lo, hi in _steps([len(x) for x in ids]):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(v.decode, ids[lo:hi]), pa.string())],
                                                 [*part.schema.names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """Encoded and decoded frame -> the contract's digests."""
    return df.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                     F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
