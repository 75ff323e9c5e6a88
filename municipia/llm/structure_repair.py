"""Repair of conversation structure: the cheapest edits that leave an optional system turn and pairs of user and assistant.

A row becomes a symbol: the initial of its role and its fault. Rows of a conversation are cut into chunks by turn, so a chunk's
symbols are a short string and equal strings are worked out once for all conversations. Re-Pair finds a grammar over all those
strings: round by round, the pairs that occur most (counted by Spark, weighted by the number of chunks) become rules. A rule has
one min-plus matrix over the four states of the pattern (nothing yet, system, user, assistant); an entry is the least cost and
a rope of the edits' initials. Matrices are multiplied bottom-up: symbols, rules, strings, chunks, conversations.

Equal costs go to the ASCII-least initials. Multiplying keeps that right: from one state, initials determine the state after
them, so of two ways of equal cost between the same states neither starts with the other, and what follows can't turn their order.

Texts are shuffled once, in order, to hash what is repaired: SHA-256 runs over a conversation's text from first to last, which
no plan can part, but a task holds a row of it at a time.

Defined results: nulls are one space; rows of one turn follow in order of role and the SHA-256 of their text; a null
conv_id is a conversation of its own; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from municipia.llm.shared import Scratch

#: Turns of a chunk; chunks that are joined at once.
CHUNK, JOINED = 64, 64
#: Rules of the grammar at most, and rounds that look for them; more rules change no result.
RULES, ROUNDS = 64, 12
#: Costs of the edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: White space that leaves a text blank.
WHITE = " \t\n\x0b\f\r"

#: Initials of roles, any other as 'o'; a symbol is chr(BASE + 4 * fault + place of the initial).
INITIALS, FAULTS, BASE = "suao", ("whole", "truncated", "deleted"), ord("a")
#: The first character of a rule.
RULE = 0xE000
#: States of the pattern, and where a role leads from each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {"u": "user", "a": "assistant"}

Rope = Any  # a string, or a pair of ropes
Matrix = dict[tuple[int, int], tuple[int, Rope]]


# --- matrices -------------------------------------------------------------------------------------------------------


def flat(rope: Rope) -> str:
    leaves, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            leaves.append(x)
        else:
            stack += (x[1], x[0])
    return "".join(leaves)


def better(x: tuple[int, Rope], y: tuple[int, Rope] | None) -> bool:
    return y is None or x[0] < y[0] or x[0] == y[0] and flat(x[1]) < flat(y[1])


def times(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = {}
    for (a, b), (cost, rope) in x.items():
        for c in range(4):
            if (found := y.get((b, c))) is not None:
                way = (cost + found[0], (rope, found[1]) if rope and found[1] else rope or found[1])
                if better(way, out.get((a, c))):
                    out[a, c] = way
    return out


def inserts() -> Matrix:
    """Up to two insertions: more lead nowhere that fewer don't."""
    out: Matrix = {(q, q): (0, "") for q in range(4)}
    for q in range(4):
        state = q
        for k in (1, 2):
            state = next(AFTER[state][r] for r in "ua" if r in AFTER[state])
            if (q, state) not in out:
                out[q, state] = (k * INSERT, "I" * k)
    return out


def symbol_matrix(initial: str, fault: str) -> Matrix:
    """Insertions before a row, then the row's own edit."""
    out: Matrix = {(q, q): (DELETE, "D") for q in range(4)}
    if fault != "deleted":
        extra = LEFT_TRUNCATED if fault == "truncated" else 0
        for q in range(4):
            ways = [(AFTER[q][initial], (extra, "K"))] if initial in AFTER[q] else []
            ways += [(AFTER[q][r], (REROLE + extra, "R")) for r in "ua" if r in AFTER[q]]
            for state, way in ways:
                if better(way, out.get((q, state))):
                    out[q, state] = way
    return times(inserts(), out)


@dataclass(frozen=True)
class Run:
    """What some successive rows do: their matrix, the first and last initial, and neighbours that don't belong together."""

    matrix: Matrix
    first: str
    last: str
    illegal: int

    def __add__(self, other: Run) -> Run:
        odd = self.last + other.first not in ("su", "ua", "au")
        return Run(times(self.matrix, other.matrix), self.first, other.last, self.illegal + other.illegal + odd)


def symbols() -> dict[str, Run]:
    return {chr(BASE + 4 * f + i): Run(symbol_matrix(initial, fault), initial, initial, 0) for f, fault in enumerate(FAULTS) for i, initial in enumerate(INITIALS)}


Rules = list[tuple[str, str, str]]


def evaluated(rules: Rules) -> dict[str, Run]:
    """Every symbol's and rule's run, bottom-up."""
    known = symbols()
    for name, left, right in rules:
        known[name] = known[left] + known[right]
    return known


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """The least cost and its initials from nothing to nothing or a closed pair."""
    ended = times({k: v for k, v in matrix.items() if k[0] == NOTHING}, inserts())
    best = None
    for state in (NOTHING, ASSISTANT):
        if (way := ended.get((NOTHING, state))) is not None and better(way, best):
            best = way
    return best[0], flat(best[1])


# --- the grammar ----------------------------------------------------------------------------------------------------


def compressed(column: Column, rules: Rules) -> Column:
    for name, left, right in rules:
        column = F.replace(column, F.lit(left + right), F.lit(name))
    return column


def re_pair(strings: DataFrame, most: int = RULES, rounds: int = ROUNDS) -> Rules:
    """Rules (name, left, right) for the pairs that are most frequent in strings (seq, n: how often each occurs).

    A round takes several pairs without a common symbol. The driver sees at most as many pairs as symbols squared.
    """
    rules: Rules = []
    for _ in range(rounds):
        s = F.col("s")
        pairs = F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
        found = strings.select("n", compressed(F.col("seq"), rules).alias("s")).select("n", F.explode(pairs).alias("pair"))
        counted = found.groupBy("pair").agg(F.sum("n").alias("n")).where("n >= 2").orderBy(F.desc("n"), "pair").limit(4 * most).collect()
        used: set[str] = set()
        before = len(rules)
        for row in counted:
            left, right = row.pair
            if len(rules) < most and not used & {left, right}:
                used |= {left, right}
                rules.append((chr(RULE + len(rules)), left, right))
        if len(rules) == before or len(rules) == most:
            break
    return rules


# --- rows -----------------------------------------------------------------------------------------------------------


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of conversations with the faults that a checksum of conv_id and turn deals out: c, turn, role, text, n copies."""
    fate = F.crc32(F.concat(_key(F.col("conv_id")), F.lit(":"), _key(F.col("turn")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.where(fate != 0).select(
        _key(F.col("conv_id")).alias("c"),
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def chunk_of(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / CHUNK), F.lit(-(1 << 62))).cast("long")


def _chunks(rows: DataFrame) -> DataFrame:
    """c, at (place of the chunk), chunk, seq (a symbol for each row), and the chunk's counts."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = rows.select("c", "turn", "role", F.sha2("text", 256).alias("tkey"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"), "n")
    # equal rows of one turn stand together: one row and their number
    runs = narrow.groupBy("c", "turn", "role", "tkey", "blank", "open").agg(F.sum("n").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = runs.groupBy("c", "role", "tkey").agg(F.min(when).alias("earliest"))
    told = runs.join(firsts, ["c", "role", "tkey"]).withColumn("first", ~F.col("blank") & when.eqNullSafe(F.col("earliest")))
    initial = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1))
    place = F.when((F.substring("role", 1, 1) == "") | (initial == 0), 3).otherwise(initial - 1)
    symbol = lambda fault: F.char(BASE + 4 * FAULTS.index(fault) + place)
    deleted = F.repeat(symbol("deleted"), F.when(F.col("first"), F.col("n") - 1).otherwise(F.col("n")).cast("int"))
    seq = F.concat(F.when(F.col("first"), F.when(F.col("open"), symbol("truncated")).otherwise(symbol("whole"))).otherwise(""), deleted)
    one = F.col("first").cast("long")
    grouped = told.withColumns({"chunk": chunk_of(F.col("turn")), "seq": seq}).groupBy("c", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "tkey", "seq"))), lambda r: r["seq"]), "").alias("seq"),
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - one)).alias("duplicate"),
        F.sum(F.when(F.col("first") & F.col("open"), 1).otherwise(0)).alias("truncated"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )
    return grouped.withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy("chunk")).cast("long") - 1)


# --- evaluation in tasks --------------------------------------------------------------------------------------------

RUN = "costs array<int>, audits array<string>, first string, last string, illegal long"
_RUN_TYPES = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64())
PLACES = [(a, b) for a in range(4) for b in range(4)]


def _row(run: Run) -> tuple:
    ways = [run.matrix.get(p) for p in PLACES]
    return [w and w[0] for w in ways], [w and flat(w[1]) for w in ways], run.first, run.last, run.illegal


def _run(costs: list, audits: list, first: str, last: str, illegal: int) -> Run:
    return Run({p: (c, a) for p, c, a in zip(PLACES, costs, audits, strict=True) if c is not None}, first, last, illegal)


def _string_runs(strings: DataFrame, rules: Rules) -> DataFrame:
    """seq and its run, each distinct string once, along the grammar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = evaluated(rules)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                rows = [_row(reduce(Run.__add__, map(known.__getitem__, s))) for s in some.column("s").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("seq"), *(pa.array(c, t) for c, t in zip(zip(*rows), _RUN_TYPES, strict=True))], names=["seq", "costs", "audits", "first", "last", "illegal"])

    return strings.select("seq", compressed(F.col("seq"), rules).alias("s")).mapInArrow(run, f"seq string, {RUN}")


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of JOINED successive chunks of a conversation as one."""
    up = F.floor(F.col("at") / JOINED).cast("long").alias("up")
    held = runs.groupBy("c", up).agg(F.sort_array(F.collect_list(F.struct("at", "costs", "audits", "first", "last", "illegal"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                rows = [_row(reduce(Run.__add__, (_run(*(r[k] for k in ("costs", "audits", "first", "last", "illegal"))) for r in runs))) for runs in some.column("runs").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("c"), some.column("up"), *(pa.array(c, t) for c, t in zip(zip(*rows), _RUN_TYPES, strict=True))], names=["c", "at", "costs", "audits", "first", "last", "illegal"])

    return held.mapInArrow(run, f"c string, at long, {RUN}")


def cut_audit(audit: str, sizes: list[int]) -> list[str]:
    """The edits of each chunk of so many rows; insertions stand before the next row, the last ones at the end."""
    parts, at = [], 0
    for size in sizes:
        start = at
        while size:
            size -= audit[at] != "I"
            at += 1
        parts.append(audit[start:at])
    if parts:
        parts[-1] += audit[at:]
    return parts


def _edits(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """c, cost, audit, illegal, parts (chunk, edits) of every conversation that has rows."""
    sizes = chunks.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("chunk", "rows"))).alias("sizes"))
    kind = pa.list_(pa.struct([("chunk", pa.int64()), ("edits", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                some = batch.slice(i, 1000)
                costs, audits, parts = [], [], []
                for c, a, sizes in zip(*(some.column(k).to_pylist() for k in ("costs", "audits", "sizes")), strict=True):
                    cost, audit = cheapest(_run(c, a, "", "", 0).matrix)
                    costs.append(cost)
                    audits.append(audit)
                    parts.append([{"chunk": s["chunk"], "edits": e} for s, e in zip(sizes, cut_audit(audit, [s["rows"] for s in sizes]), strict=True)])
                yield pa.RecordBatch.from_arrays([some.column("c"), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), some.column("illegal"), pa.array(parts, kind)], names=["c", "cost", "audit", "illegal", "parts"])

    return runs.join(sizes, "c").select("c", "costs", "audits", "illegal", "sizes").mapInArrow(run, "c string, cost long, audit string, illegal long, parts array<struct<chunk:long,edits:string>>")


def repaired(role: str, text: str, copies: int, edits: Iterator[str], state: int) -> Iterator[tuple[int, str]]:
    """The lines that a row and the insertions before it leave, each with the state after it."""
    while copies:
        edit = next(edits)
        copies -= edit != "I"
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else next(r for r in "ua" if r in AFTER[state])
        state = AFTER[state][initial]
        yield state, f"{role}:{text}" if edit == "K" else f"{NAMES[initial]}:{text if edit == 'R' else ''}"


def _ordered(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Each chunk's edits, then its rows in order, all of a conversation in one task's stream."""
    parts = edits.select("c", F.explode("parts").alias("p")).select("c", "p.chunk", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("tkey"), F.col("p.edits").alias("text"), F.lit(0).cast("long").alias("n"))
    texts = rows.select("c", chunk_of(F.col("turn")).alias("chunk"), F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("tkey"), "text", "n")
    return parts.unionByName(texts).repartition("c").sortWithinPartitions("c", "chunk", "kind", "turn", "role", "tkey").select("c", "kind", "role", "text", "n")


def _lines(ordered: DataFrame, digest: bool) -> DataFrame:
    """c and the SHA-256 of what is repaired; or its lines with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, line, edits, sha = None, NOTHING, 0, iter(""), hashlib.sha256()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            if digest:
                return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], names=["c", "repaired_sha256"])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["c", "line", "turn_text"])

        def kept(found: Iterator[tuple[int, str]]) -> None:
            nonlocal state, line
            for state, text in found:  # noqa: B007
                if digest:
                    sha.update((("\n" if line else "") + text).encode())
                else:
                    out.append((now, line, text))
                line += 1

        def closed() -> None:
            """Insertions behind the last row of a chunk."""
            left = "".join(edits)
            kept(repaired("", "", len(left), iter(left.replace("I", "R")), state))

        for found in batches:
            for i in range(0, found.num_rows, 500):
                for c, kind, role, text, n in zip(*(found.slice(i, 500).column(k).to_pylist() for k in ("c", "kind", "role", "text", "n")), strict=True):
                    if not kind:
                        closed()
                    if c != now:
                        if digest and now is not None:
                            out.append((now, sha.hexdigest()))
                        now, state, line, sha = c, NOTHING, 0, hashlib.sha256()
                    if kind:
                        kept(repaired(role, text, n, edits, state))
                    else:
                        edits = iter(text)
                if len(out) > 500:
                    yield batch()
        closed()
        if digest and now is not None:
            out.append((now, sha.hexdigest()))
        if out:
            yield batch()

    return ordered.mapInArrow(run, "c string, repaired_sha256 string" if digest else "c string, line long, turn_text string")


def _worked_out(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The chunks and the edits of rows (c, turn, role, text, n), both as tables."""
    chunks = scratch.written(_chunks(rows))
    strings = scratch.written(chunks.groupBy("seq").agg(F.count("*").alias("n")))
    rules = re_pair(strings)
    runs = chunks.select("c", "at", "seq").join(_string_runs(strings, rules), "seq").drop("seq")
    longest = chunks.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    while longest:
        runs, longest = scratch.written(_joined(runs)), longest // JOINED
    return chunks, scratch.written(_edits(runs, chunks))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, line, turn_text: the repaired conversations of turns (conv_id, turn, role, text) as they are, without damage."""
    text = lambda c: F.coalesce(c, F.lit(" "))
    rows = turns.select(_key(F.col("conv_id")).alias("c"), "turn", text("role").alias("role"), text("text").alias("text"), F.lit(1).cast("long").alias("n"))
    _, edits = _worked_out(rows, Scratch(turns.sparkSession))
    return _lines(_ordered(rows, edits), digest=False).select(F.when(F.col("c") != " ", F.col("c")).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "line", "turn_text")


def repair_report(turns: DataFrame) -> DataFrame:
    """conv_id, faults, cost, audit and digest of every conversation after damage()."""
    scratch = Scratch(turns.sparkSession)
    rows = damaged(turns)
    chunks, edits = _worked_out(rows, scratch)
    counts = chunks.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")], F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"))
    hashes = _lines(_ordered(rows, edits), digest=True)
    every = turns.groupBy("conv_id").agg(F.count("*").alias("__n")).select("conv_id", _key(F.col("conv_id")).alias("c"))
    found = every.join(counts, "c", "left").join(edits.select("c", "illegal", "cost", "audit"), "c", "left").join(hashes, "c", "left")
    none = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return found.select("conv_id", *[none(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE table_of AS (
  SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))
), keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') AS c, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), fated AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT), lambda v, b: xor(v >> 8, crcs[(xor(v, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM keyed, table_of
), rows AS (
  SELECT c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS r,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows
), told AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(r) OVER (PARTITION BY c ORDER BY i) || r AS neighbours FROM placed
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (neighbours NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM told GROUP BY c
), dp AS (
  SELECT c, n + 1 AS i, {cost: 0, audit: '', lines: ''} AS v0, {cost: 10, audit: 'II', lines: 'user:' || chr(10) || 'assistant:' || chr(10)} AS vs,
    {cost: 5, audit: 'I', lines: 'assistant:' || chr(10)} AS vu, {cost: 0, audit: '', lines: ''} AS va FROM counts
  UNION ALL
  SELECT c, i,
    list_min([w0, {cost: wu.cost + 5, audit: 'I' || wu.audit, lines: 'user:' || chr(10) || wu.lines}, {cost: wa.cost + 10, audit: 'II' || wa.audit, lines: 'user:' || chr(10) || 'assistant:' || chr(10) || wa.lines}]),
    list_min([ws, {cost: wu.cost + 5, audit: 'I' || wu.audit, lines: 'user:' || chr(10) || wu.lines}, {cost: wa.cost + 10, audit: 'II' || wa.audit, lines: 'user:' || chr(10) || 'assistant:' || chr(10) || wa.lines}]),
    list_min([wu, {cost: wa.cost + 5, audit: 'I' || wa.audit, lines: 'assistant:' || chr(10) || wa.lines}]),
    list_min([wa, {cost: wu.cost + 5, audit: 'I' || wu.audit, lines: 'user:' || chr(10) || wu.lines}])
  FROM (
    SELECT t.c, t.i,
      list_min(list_filter([{cost: v0.cost + 2, audit: 'D' || v0.audit, lines: v0.lines}, CASE WHEN more IS NOT NULL AND r = 's' THEN {cost: vs.cost + more, audit: 'K' || vs.audit, lines: said || vs.lines} END,
        CASE WHEN more IS NOT NULL AND r = 'u' THEN {cost: vu.cost + more, audit: 'K' || vu.audit, lines: said || vu.lines} END, CASE WHEN more IS NOT NULL THEN {cost: vu.cost + more + 1, audit: 'R' || vu.audit, lines: as_user || vu.lines} END], lambda x: x IS NOT NULL)) AS w0,
      list_min(list_filter([{cost: vs.cost + 2, audit: 'D' || vs.audit, lines: vs.lines},
        CASE WHEN more IS NOT NULL AND r = 'u' THEN {cost: vu.cost + more, audit: 'K' || vu.audit, lines: said || vu.lines} END, CASE WHEN more IS NOT NULL THEN {cost: vu.cost + more + 1, audit: 'R' || vu.audit, lines: as_user || vu.lines} END], lambda x: x IS NOT NULL)) AS ws,
      list_min(list_filter([{cost: vu.cost + 2, audit: 'D' || vu.audit, lines: vu.lines},
        CASE WHEN more IS NOT NULL AND r = 'a' THEN {cost: va.cost + more, audit: 'K' || va.audit, lines: said || va.lines} END, CASE WHEN more IS NOT NULL THEN {cost: va.cost + more + 1, audit: 'R' || va.audit, lines: as_assistant || va.lines} END], lambda x: x IS NOT NULL)) AS wu,
      list_min(list_filter([{cost: va.cost + 2, audit: 'D' || va.audit, lines: va.lines},
        CASE WHEN more IS NOT NULL AND r = 'u' THEN {cost: vu.cost + more, audit: 'K' || vu.audit, lines: said || vu.lines} END, CASE WHEN more IS NOT NULL THEN {cost: vu.cost + more + 1, audit: 'R' || vu.audit, lines: as_user || vu.lines} END], lambda x: x IS NOT NULL)) AS wa
    FROM dp JOIN (SELECT c, i, r, CASE fault WHEN 'none' THEN 0 WHEN 'truncated' THEN 5 END AS more, role || ':' || text || chr(10) AS said, 'user:' || text || chr(10) AS as_user, 'assistant:' || text || chr(10) AS as_assistant FROM told) t ON t.c = dp.c AND t.i = dp.i - 1
  )
), best AS (SELECT c, v0.cost AS cost, v0.audit AS audit, sha256(left(v0.lines, greatest(length(v0.lines) - 1, 0))) AS digest FROM dp WHERE i = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM keyed) LEFT JOIN counts USING (c) LEFT JOIN best USING (c)
"""
