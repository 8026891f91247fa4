"""Conversation structure repair by a run-length dynamic program.

A repaired conversation's role initials match ``(s?(ua)+)?``. Edits: Keep (0),
Rerole to user or assistant (2), Delete (3; blank and duplicate rows must go),
Insert an empty user or assistant row (2); truncated rows that stay cost 1.

1. Rows become one symbol each: role initial, and whether the row is truncated or
   must go. Faults, symbols and the order of rows come from JVM functions over narrow
   rows, in which the text is a SHA-256 of role and text; equal rows of a
   turn are one row with a count. A row was seen earlier if its hash occurs
   at an earlier turn (a joined minimum) or its count is over one.
2. Rows are range-partitioned by conversation, turn and hash, so a
   conversation of any size spreads over tasks. Each task writes run lengths of
   equal symbols. Conversations that lie within one segment are repaired at once:
   costs to the end come backwards from run to run, each run by the
   binary powers of its min-plus transition (4 states: nothing yet, after
   s, after u, after a), which are cached; the audit is unrolled
   forwards, taking the ASCII-least edit that still gives the least cost.
3. Segments of conversations that tasks or ``SEGMENT`` rows cut apart are
   chained: transitions of whole segments give the costs at every cut, each
   segment is unrolled from each state in a task of its own, and the pieces that
   fit together make the audit. Only one small row a segment is ordered within one task.
4. Texts meet their conversation's audit in one sorted shuffle, in which the
   repaired text is hashed as it streams by, never held.

An audit fixes the roles of its R and I edits, as from each state one role
only is legal, so equal audits give equal repairs.

Defined results: a null role or text is one space; nulls in ``conv_id:turn``
are one space, too. A role's initial is its first character (an empty role has
none and cannot be kept). Null turns come first; rows of one turn are ordered by
SHA-256 of role, a zero byte and text; repeated rows stay repeated. A null
conv_id is a conversation like others. Whole texts are used, extra columns
ignored; an empty table gives no rows. The audit is one string a conversation,
so it is limited to 2 GB there, and SHA-256 of a conversation's repair is sequential
by its nature: one task streams that text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm.common import MIN_LONG, materialize, order_key, partitions

SEGMENT = 200_000  # rows that a task repairs at once
SALTS = 16
BLANK, DUPLICATE, TRUNCATED, FINE = 0, 1, 2, 3
GAP_CLASS = r"\x20\x09-\x0D"
INF = 1 << 60
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
MOVES = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
MADE = {NOTHING: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}  # the one role that R and I can give
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
# Symbols: "x" must go; s, u, a, o (another initial) for whole rows, capitals for truncated ones.


# --- the dynamic program -----------------------------------------------------

def _times(a, b):
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


IDENTITY = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


@lru_cache(None)
def inserts():
    """Least costs of any number of inserts."""
    one = tuple(tuple(0 if i == j else INSERT if MOVES[i, MADE[i]] == j else INF for j in range(4)) for i in range(4))
    return _times(_times(one, one), _times(one, one))


def _edits(symbol: str, state: int):
    """(letter, cost, state after) of the edits of a row, ASCII order."""
    yield "D", DELETE, state
    if symbol == "x":
        return
    extra, role = CUT if symbol.isupper() else 0, symbol.lower()
    if (state, role) in MOVES:
        yield "K", extra, MOVES[state, role]
    if MADE[state] != role:
        yield "R", REROLE + extra, MOVES[state, MADE[state]]


@lru_cache(None)
def power(symbol: str, bit: int):
    """Min-plus transition of 2**bit equal rows, each after any inserts."""
    if bit:
        half = power(symbol, bit - 1)
        return _times(half, half)
    row = [[INF] * 4 for _ in range(4)]
    for i in range(4):
        for _, cost, j in _edits(symbol, i):
            row[i][j] = min(row[i][j], cost)
    return _times(inserts(), tuple(map(tuple, row)))


def ends() -> tuple:
    """Least cost to a legal end, from each state after the last row."""
    return tuple(min(row[NOTHING], row[AFTER_A]) for row in inserts())


@lru_cache(1 << 16)
def _before(symbol: str, run: int, after: tuple) -> tuple:
    """Costs before a run, from those after it (both less their least, which is returned first)."""
    v, bit = after, 0
    while run:
        if run & 1:
            m = power(symbol, bit)
            v = tuple(min(m[i][j] + v[j] for j in range(4)) for i in range(4))
        run, bit = run >> 1, bit + 1
    least = min(v)
    return least, tuple(min(x - least, INF) for x in v)


def transition(runs) -> tuple:
    """Min-plus matrix of a sequence of (symbol, length) runs."""
    out = IDENTITY
    for symbol, n in runs:
        bit = 0
        while n:
            if n & 1:
                out = _times(out, power(symbol, bit))
            n, bit = n >> 1, bit + 1
        out = tuple(tuple(min(x, INF) for x in row) for row in out)
    return out


@lru_cache(1 << 16)
def _choice(symbol: str | None, state: int, after: tuple) -> tuple[str, int]:
    """Least letters for one row (None: the end) from ``state``, and the state after it."""
    if symbol is None:
        best = lambda q: min(inserts()[q][j] + (0 if j in (NOTHING, AFTER_A) else INF) for j in range(4))
    else:
        best = lambda q: min(power(symbol, 0)[q][j] + after[j] for j in range(4))
    letters = ""
    while True:
        left = best(state)
        if symbol is None and state in (NOTHING, AFTER_A) and left == 0:
            return letters, state
        made = MOVES[state, MADE[state]]
        options = [(letter, cost + after[q], q) for letter, cost, q in _edits(symbol, state)] if symbol else []
        options.append(("I", INSERT + best(made), made))
        letter, _, state = min((o for o in options if o[1] == left), key=lambda o: o[0])
        letters += letter
        if letter != "I":
            return letters, state


def costs_before(runs, after: tuple) -> tuple[int, tuple]:
    """Least cost, and costs above it from each state, before all of ``runs``."""
    total = 0
    for symbol, n in reversed(runs):
        least, after = _before(symbol, n, after)
        total += least
    return total, after


def _inside(symbol: str, n: int, after: tuple) -> list[tuple[tuple, int]]:
    """Costs after each of the ``n`` rows of a run, last row first, equal neighbours counted."""
    out = [(after, 1)]
    for i in range(1, n):
        before = _before(symbol, 1, out[-1][0])[1]
        if before == out[-1][0]:  # a fixed point
            out[-1] = (before, out[-1][1] + n - i)
            break
        out.append((before, 1))
    return out


def unroll(runs, after: tuple, state: int, last: bool) -> tuple[str, int]:
    """The audit of ``runs`` from ``state``, given the costs after them; with
    the inserts at the end, if they are a conversation's last."""
    at_run = [after]
    for symbol, n in reversed(runs):
        at_run.append(_before(symbol, n, at_run[-1])[1])
    at_run.reverse()
    out = []
    for i, (symbol, n) in enumerate(runs):
        for v, count in reversed(_inside(symbol, n, at_run[i + 1])):
            while count:
                letters, then = _choice(symbol, state, v)
                times = count if then == state else 1
                out.append(letters * times)
                state, count = then, count - times
    if last:
        letters, state = _choice(None, state, ())
        out.append(letters)
    return "".join(out), state


def normalised(v: tuple) -> tuple[int, tuple]:
    least = min(v)
    return least, tuple(min(x - least, INF) for x in v)


def repair(runs) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    least, after = normalised(ends())
    total, before = costs_before(runs, after)
    return total + least + before[NOTHING], unroll(runs, after, NOTHING, True)[0]


# --- jobs --------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged by crc32 of
    ``conv_id:turn``; copies is 0 for dropped rows and 2 for repeated ones."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns for rows as they are."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), F.lit(1).cast("long").alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.col("role").cast("binary"), F.lit(b"\x00"), F.col("text").cast("binary")), 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """Narrow rows: ``conv, at, digest, symbol`` (as if seen first), ``blank, truncated, copies, again``."""
    # \z: only the very end; whitespace is the contract's
    cut = ~F.col("text").rlike(rf"[.!?][{GAP_CLASS}]*\z")
    blank = ~F.col("text").rlike(rf"[^{GAP_CLASS}]")
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        F.col("conv_id").alias("conv"), order_key("turn").alias("at"), _digest().alias("digest"), "copies",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(FINE).alias("fault"))
    narrow = materialize(narrow.groupBy("conv", "at", "digest").agg(
        F.sum("copies").alias("copies"), F.first("initial").alias("initial"), F.first("fault").alias("fault")), "turns")
    # rows seen at an earlier turn; one row may recur over a third of a table, so both sides are salted
    seen = (narrow.filter("copies > 0").groupBy("conv", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
            .filter("first < last").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first",
                                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")))
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.pmod(F.xxhash64("at"), F.lit(SALTS)) == F.col("s"))
    return narrow.join(seen, on, "left").select(
        "conv", "at", "digest", "copies", "initial", "fault", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again"))


COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "turns"]
ENDS = ["first_turn", "last_turn", "first_role", "last_role"]


class _Part:
    """Run lengths and counts of consecutive rows of a conversation."""

    def __init__(self, conv, at, digest, open_):
        self.conv, self.at, self.digest, self.open = conv, at, digest, open_
        self.runs: list[list] = []
        self.n = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def _run(self, symbol, n):
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def add(self, at, copies, initial, fault, again):
        if not copies:
            return
        n = self.n
        n["n_rows"] += copies
        if fault == BLANK:
            n["blank"] += copies
            self._run("x", copies)
        else:
            repeats = copies if again else copies - 1
            n["duplicate"] += repeats
            if not again:
                n["truncated"] += fault == TRUNCATED
                self._run(initial.upper() if fault == TRUNCATED else initial, 1)
            if repeats:
                self._run("x", repeats)
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in ("su", "ua", "au"):
            n["illegal"] += 1
        n["illegal"] += copies - 1
        self.last_role = initial
        if at != MIN_LONG:
            n["turns"] += at != self.last_turn
            self.first_turn = at if self.first_turn is None else self.first_turn
            self.last_turn = at

    def row(self):
        runs = [tuple(r) for r in self.runs]
        cost, audit = (None, None) if self.open else repair(runs)
        return (self.conv, self.at, self.digest, not self.open, cost, audit, _written(runs) if self.open else None,
                *self.n.values(), self.first_turn, self.last_turn, self.first_role, self.last_role)


def _written(runs) -> str:
    return ",".join(f"{s}{n}" for s, n in runs)


def _read(runs: str) -> list[tuple[str, int]]:
    return [(r[0], int(r[1:])) for r in runs.split(",") if r]


def _batch(rows: list[tuple], conv_type, fields: str) -> pa.RecordBatch:
    """Rows of ``conv`` and the named fields ("name type, ...")."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    names = [f.split() for f in fields.split(", ")]
    types = [conv_type, *(kinds[t] for _, t in names)]
    cols = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv", *(n for n, _ in names)])


_STATS = ", ".join([f"{c} long" for c in COUNTS] + ["first_turn long", "last_turn long", "first_role string", "last_role string"])
PART = "start_at long, start_digest binary, closed boolean, cost long, audit string, runs string, " + _STATS
CHAIN = "start_at long, start_digest binary, before long, after array<long>, ends boolean, runs string, " + _STATS
TRIED = "start_at long, start_digest binary, before long, audits array<string>, states array<long>, " + _STATS
PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _parts(batches):
    """Rows sorted by conv, at, digest -> parts. A task's first and last conversations
    and those of several segments stay open; the others are repaired here."""
    now = None
    for b in batches:
        ready, kind = [], b.column(0).type
        for conv, at, digest, copies, initial, fault, again in zip(*(c.to_pylist() for c in b.columns)):
            if now is None:
                now = _Part(conv, at, digest, True)
            elif conv != now.conv:
                ready.append(now.row())
                now = _Part(conv, at, digest, False)
            elif now.n["n_rows"] >= SEGMENT:
                now.open = True
                ready.append(now.row())
                now = _Part(conv, at, digest, True)
            now.add(at, copies, initial, fault, again)
        if ready:
            yield _batch(ready, kind, PART)
    if now is not None:
        now.open = True
        yield _batch([now.row()], kind, PART)


def _matrices(batches):
    for b in batches:
        got = [[x for row in transition(_read(r)) for x in row] for r in b.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int64()))], [*b.schema.names, "matrix"])


def _backwards(batches):
    """Open parts sorted by conv and descending start -> the costs after each."""
    conv, v, offset, started = None, None, 0, False
    for b in batches:
        out = []
        for r in b.to_pylist():
            ends_here = not started or r["conv"] != conv
            if ends_here:
                conv, started = r["conv"], True
                offset, v = normalised(ends())
            m, after = r["matrix"], v
            least, v = normalised(tuple(min(m[4 * i + j] + after[j] for j in range(4)) for i in range(4)))
            offset += least
            out.append((r["conv"], r["start_at"], r["start_digest"], offset + v[NOTHING], after, ends_here, r["runs"],
                        *(r[c] for c in COUNTS + ENDS)))
        yield _batch(out, b.column(0).type, CHAIN)


def _unrolled(batches):
    for b in batches:
        for r in b.to_pylist():
            runs = _read(r["runs"])
            got = [unroll(runs, tuple(r["after"]), q, r["ends"]) for q in range(4)]
            yield _batch([(r["conv"], r["start_at"], r["start_digest"], r["before"], [a for a, _ in got], [q for _, q in got],
                           *(r[c] for c in COUNTS + ENDS))], b.column(0).type, TRIED)


def _gaps(first, last, turns) -> int:
    return last - first + 1 - turns if turns else 0


def _forwards(batches):
    """Unrolled parts sorted by conv and start -> plans."""
    now = audit = state = None

    def row():
        n = now
        return (n["conv"], _gaps(n["first_turn"], n["last_turn"], n["turns"]), n["blank"], n["duplicate"], n["truncated"], n["illegal"],
                n["before"], "".join(audit))

    for b in batches:
        out, kind = [], b.column(0).type
        for r in b.to_pylist():
            if now is None or r["conv"] != now["conv"]:
                if now is not None:
                    out.append(row())
                now, audit, state = r, [], NOTHING
            else:
                if r["n_rows"] and now["n_rows"]:
                    now["illegal"] += now["last_role"] + r["first_role"] not in ("su", "ua", "au")
                now["turns"] -= r["turns"] > 0 and now["last_turn"] == r["first_turn"]
                for c in COUNTS:
                    now[c] += r[c]
                for c in ("first_turn", "first_role"):
                    now[c] = r[c] if now[c] is None else now[c]
                for c in ("last_turn", "last_role"):
                    now[c] = now[c] if r[c] is None else r[c]
            audit.append(r["audits"][state])
            state = r["states"][state]
        yield _batch(out, kind, PLAN)
    if now is not None:
        yield _batch([row()], kind, PLAN)


def plans(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each
    conversation of damaged (or ``undamaged``) rows."""
    p = partitions(rows.sparkSession)
    conv = f"conv {rows.schema['conv_id'].dataType.simpleString()}, "
    narrow = materialize(_symbols(rows), "symbols")
    parts = materialize(narrow.repartitionByRange(p, "conv", "at", "digest").sortWithinPartitions("conv", "at", "digest")
                        .mapInArrow(_parts, conv + PART), "parts")
    closed = parts.filter("closed").select(
        "conv", F.expr("if(turns > 0, last_turn - first_turn + 1 - turns, 0L)").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    chained = (parts.filter("NOT closed").drop("closed", "cost", "audit")
               .mapInArrow(_matrices, f"{conv}start_at long, start_digest binary, runs string, {_STATS}, matrix array<long>")
               .repartition(p, "conv").sortWithinPartitions("conv", F.desc("start_at"), F.desc("start_digest"))
               .mapInArrow(_backwards, conv + CHAIN))
    chained = materialize(chained, "chain")
    tried = (chained.repartition(p, "conv", "start_at", "start_digest").mapInArrow(_unrolled, conv + TRIED)
             .repartition(p, "conv").sortWithinPartitions("conv", "start_at", "start_digest").mapInArrow(_forwards, conv + PLAN))
    return materialize(closed.union(tried), "plans")


EDITED = PLAN + ", position long, role string, text string"


def _apply(batches):
    """Sorted by conv: a plan, then its rows -> the plan (position null), then the repaired rows."""
    audit, at, state, position = "", 0, NOTHING, 0

    def step(conv, role, text):
        """Edits up to the next row, or to the end (role None)."""
        nonlocal at, state, position
        while at < len(audit):
            letter = audit[at]
            if letter != "I" and role is None:
                return
            at += 1
            if letter == "D":
                return
            initial = role[:1] if letter == "K" else MADE[state]
            state = MOVES[state, initial]
            yield (conv, *[None] * 7, position, role if letter == "K" else "user" if initial == "u" else "assistant",
                   "" if letter == "I" else text)
            position += 1
            if letter != "I":
                return

    def inserts_at_end(conv):
        yield from step(conv, None, None)

    conv, started = None, False
    for b in batches:
        kind, n_plan = b.column(0).type, 8
        for lo in range(0, b.num_rows, 1000):
            out = []
            for r in zip(*(c.slice(lo, 1000).to_pylist() for c in b.columns)):
                if not r[-1]:  # a plan
                    if started:
                        out += inserts_at_end(conv)
                    conv, started, audit, at, state, position = r[0], True, r[n_plan - 1], 0, NOTHING, 0
                    out.append((*r[:n_plan], None, None, None))
                else:
                    out += step(conv, r[n_plan], r[n_plan + 1])
            yield _batch(out, kind, EDITED)
    if started:
        yield _batch(list(inserts_at_end(conv)), kind, EDITED)


def edited(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan (position null), followed in its partition by
    its repaired rows: ``conv, <plan>, position, role, text``."""
    p, conv = partitions(rows.sparkSession), f"conv {rows.schema['conv_id'].dataType.simpleString()}, "
    none = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in PLAN.split(", "))]
    text = F.lit(None).cast("string")
    heads = plan.select("*", text.alias("role"), text.alias("text"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(False).alias("is_row"))
    body = rows.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        F.col("conv_id").alias("conv"), *none, "role", "text", order_key("turn").alias("at"), _digest().alias("digest"), F.lit(True).alias("is_row"))
    return (heads.union(body).repartition(p, "conv").sortWithinPartitions("conv", "is_row", "at", "digest")
            .drop("at", "digest").mapInArrow(_apply, conv + EDITED))


def repair_conversations(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired rows: ``conv_id, position, role, text``."""
    return edited(rows, plan).filter("position IS NOT NULL").select(F.col("conv").alias("conv_id"), "position", "role", "text")


def _hashes(batches):
    head, sha = None, None
    for b in batches:
        out, kind = [], b.column(0).type
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[8] is None:
                if head is not None:
                    out.append((*head, sha.hexdigest()))
                head, sha = r[:8], hashlib.sha256()
            else:
                sha.update((("\n" if r[8] else "") + f"{r[9]}:{r[10]}").encode("utf-8", "surrogatepass"))
        yield _batch(out, kind, PLAN + ", repaired_sha256 string")
    if head is not None:
        yield _batch([(*head, sha.hexdigest())], kind, PLAN + ", repaired_sha256 string")


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan and ``repaired_sha256`` of each conversation (``role:text`` rows, newline-joined)."""
    conv = f"conv {rows.schema['conv_id'].dataType.simpleString()}, "
    return edited(rows, plan).mapInArrow(_hashes, conv + PLAN + ", repaired_sha256 string").withColumnRenamed("conv", "conv_id")
