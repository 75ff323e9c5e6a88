"""Interaction of five filters: what each removes at each place of each of the 120 orders, and what others had removed before.

Four filters look at a text alone. The fifth, exact duplication, needs all texts: they are range-partitioned by text, and each
range is inserted into a compressed (radix) trie whose terminals hold the least id of their text; a document fails if the
terminal of its text holds a smaller id. Range boundaries are the shortest prefixes that part a sample of distinct texts, so
they adapt to how alike texts begin; a range that a prefix of ``PREFIX`` characters can't part, or that is larger than a trie
may be, is parted by a hash of whole texts. Sample and boundaries decide where a text goes, never what results.

Before the shuffle a task keeps one row of each text (that of the least id), so a text that a third of all documents share is
sent once by each task; its other rows are known duplicates and travel without their text. After the tries only masks of five
bits go on: counted by part, mask and label, they give every order's steps.

Defined results: a null text is empty, a null source is the part ''; a document without id has no smaller and is no smaller
document, so it never is a duplicate, nor has it labels; rows of one id and one text aren't duplicates of each other; a
document has a label if any of its label rows says so; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from municipia.llm.quality_rules import words_of

FILTERS = "ABCDE"
#: Bytes of text that a trie holds, about.
TRIE_BYTES = 16_000_000
#: Characters of a sampled prefix, sampled texts for each range, and the most sampled: 50 MB at the driver.
PREFIX, PER_RANGE, MOST_SAMPLED = 256, 32, 200_000
#: A task's rows of distinct texts before the shuffle: bytes of text and rows that it holds at once.
HELD_BYTES, HELD_ROWS = 24_000_000, 200_000


def own_failures(text: Column) -> Column:
    """The bits of the filters A to D that fail a text (1, 2, 4, 8)."""
    words = words_of(text)
    failed = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


class RadixTrie:
    """Whole texts along compressed edges; a node is [label, children by first character, least id or None]."""

    def __init__(self) -> None:
        self.root: list[Any] = ["", {}, None]

    def insert(self, text: str, least: Any) -> list[Any]:
        """The terminal of text, its id lowered to ``least``."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
            elif not text.startswith(child[0], at):
                child = self._parted(node, child, text, at)
            at += len(child[0])
            node = child
        if node[2] is None or least < node[2]:
            node[2] = least
        return node

    @staticmethod
    def _parted(parent: list[Any], child: list[Any], text: str, at: int) -> list[Any]:
        """A new node between parent and child, where the child's label leaves the text."""
        label, low, high = child[0], 1, len(child[0])
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if text.startswith(label[low:middle], at + low) else (low, middle)
        between = [label[:low], {label[low]: child}, None]
        child[0] = label[low:]
        parent[1][text[at]] = between
        return between


def boundaries(sample: list[str], ranges: int, per_range: int) -> tuple[list[str], list[int]]:
    """Ascending first prefixes of all ranges but the first, and by range the number of sampled texts it holds in full shares."""
    texts = sorted(sample)
    cuts: list[str] = []
    for i in range(1, ranges):
        at = i * len(texts) // ranges
        if not at or texts[at] == texts[at - 1]:
            continue
        same = next((k for k, (x, y) in enumerate(zip(texts[at], texts[at - 1])) if x != y), min(len(texts[at]), len(texts[at - 1])))
        cut = texts[at][: same + 1]
        if not cuts or cut > cuts[-1]:
            cuts.append(cut)
    held = [0] * (len(cuts) + 1)
    for t in texts:
        held[bisect_right(cuts, t)] += 1
    return cuts, [max(1, -(-n // (2 * per_range))) for n in held]


def _planned(docs: DataFrame, trie_bytes: int) -> tuple[list[str], list[int]]:
    """Boundaries and the parts by hash of each range, for texts of any total size."""
    size = F.octet_length("text")
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    ranges = max(1, -(-total // trie_bytes))
    wanted = min(MOST_SAMPLED, PER_RANGE * ranges)
    per_range = max(2, wanted // ranges)
    few = max(1, min(ranges, wanted // per_range))
    rate = min(1.0, wanted / max(1, n))
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1
    sample = [r[0] for r in docs.where(drawn).select(F.substring("text", 1, PREFIX).alias("p"), F.xxhash64("text").alias("h")).distinct().select("p").collect()] if ranges > 1 else []
    cuts, parts = boundaries(sample, few, per_range)
    more = -(-ranges // few)  # ranges that the sample is too small to part
    return cuts, [p * more for p in parts]


def _dealt(docs: DataFrame, cuts: list[str], parts: list[int]) -> DataFrame:
    """slot, text, doc_id, part, bits, n: one row of each text, id and part a task, the rest without text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = [sum(parts[:i]) for i in range(len(parts) + 1)]
    names = ["slot", "text", "doc_id", "part", "bits", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list[Any]] = {}  # by text: least id, bits, rows by part
        out: list[list[Any]] = [[] for _ in names]
        id_type: pa.DataType | None = None
        size = rows = 0

        def put(*row: Any) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def known(doc_id: Any, part: str, bits: int, n: int) -> None:
            put(-1 - xxhash.xxh64_intdigest(str(doc_id)) % first[-1], None, doc_id, part, bits, n)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), id_type, pa.string(), pa.int32(), pa.int64()), strict=True)], names=names)
            for column in out:
                column.clear()
            return made

        def flushed() -> Iterator[pa.RecordBatch]:
            held = 0
            for text, (doc_id, bits, mine) in least.items():
                at = bisect_right(cuts, text)
                slot = first[at] + (xxhash.xxh64_intdigest(text.encode()) % parts[at] if parts[at] > 1 else 0)
                for part, n in mine.items():
                    put(slot, text, doc_id, part, bits, n)
                held += len(text)
                if held > 2_000_000:
                    held = 0
                    yield batch()
            least.clear()
            if out[0]:
                yield batch()

        for found in batches:
            id_type = found.column("doc_id").type
            for i in range(0, found.num_rows, 500):
                some = found.slice(i, 500)
                for doc_id, part, bits, text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "part", "bits", "text")), strict=True):
                    if doc_id is None:
                        known(None, part, bits, 1)
                        continue
                    mine = least.get(text)
                    if mine is None:
                        least[text] = [doc_id, bits, {part: 1}]
                        size += len(text)
                    elif doc_id == mine[0]:
                        mine[2][part] = mine[2].get(part, 0) + 1
                    elif doc_id > mine[0]:
                        known(doc_id, part, bits | 16, 1)
                    else:
                        for p, n in mine[2].items():
                            known(mine[0], p, bits | 16, n)
                        mine[0], mine[2] = doc_id, {part: 1}
                    rows += 1
                if size > HELD_BYTES or rows > HELD_ROWS:
                    yield from flushed()
                    size = rows = 0
        if id_type is not None:
            yield from flushed()

    return docs.mapInArrow(run, f"slot long, text string, doc_id {kind}, part string, bits int, n long")


def _through_tries(dealt: DataFrame) -> DataFrame:
    """doc_id, part, bits, n with the duplicates' bit."""
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        names = ["doc_id", "part", "bits", "n"]
        if group.column("slot")[0].as_py() < 0:
            return group.select(names)
        ids, bits, trie = group.column("doc_id").to_pylist(), group.column("bits").to_pylist(), RadixTrie()
        ends = [trie.insert(text.as_py(), doc_id) for text, doc_id in zip(group.column("text"), ids, strict=True)]
        bits = [b | 16 if doc_id > end[2] else b for b, doc_id, end in zip(bits, ids, ends, strict=True)]
        return group.select(names).set_column(2, "bits", pa.array(bits, pa.int32()))

    return dealt.groupBy("slot").applyInArrow(run, f"doc_id {kind}, part string, bits int, n long")


def failures(docs: DataFrame, part_col: str = "source", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, part, bits (filters A to E that fail, 1 to 16) and the number n of such rows."""
    texts = docs.select("doc_id", F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cuts, parts = _planned(texts, trie_bytes)
    return _through_tries(_dealt(texts.select("doc_id", "part", own_failures(F.col("text")).alias("bits"), "text"), cuts, parts))


def _steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, its filter's bit, and the bits of the filters before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(order), k + 1, bit[f], sum(bit[x] for x in order[:k])) for order in permutations(FILTERS) for k, f in enumerate(order)]


def _places() -> list[tuple[int, int, int]]:
    """A filter's bit, the bits before it, and the number of orders in which they stand so; 80 rows."""
    bits = [1 << i for i in range(len(FILTERS))]
    return [(b, sum(before), factorial(k) * factorial(len(bits) - 1 - k)) for b in bits for k in range(len(bits)) for before in combinations([x for x in bits if x != b], k)]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part and order."""
    spark = docs.sparkSession
    rows = failures(docs, part_col, trie_bytes).groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    said = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    told = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    masks = rows.join(said.where("good or toxic"), "doc_id", "left").select("part", "bits", "n", *told).groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))

    places = F.array(*[F.struct(F.lit(b).alias("filter"), F.lit(e).alias("earlier"), F.lit(w).alias("orders")) for b, e, w in _places()])
    at = masks.withColumn("p", F.explode(places)).select("part", "bits", "good", "toxic", "n", "p.*")
    fails, before = F.col("bits").bitwiseAND(F.col("filter")) > 0, F.col("bits").bitwiseAND(F.col("earlier")) > 0
    removed = fails & ~before
    tests = (~fails & ~before, removed, fails & before, F.col("bits") == F.col("filter"), removed & F.col("good"), removed & F.col("toxic"))
    summed = at.groupBy("part", "filter", "earlier", "orders").agg(*[F.sum(F.when(t, F.col("n")).otherwise(0)).alias(c) for c, t in zip(COUNTS, tests, strict=True)])
    shares = summed.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = spark.createDataFrame(_steps(), "filter_order string, step int, filter int, earlier int")
    return summed.join(shares, ["part", "filter"]).join(F.broadcast(steps), ["filter", "earlier"]).select("part", "filter_order", "step", *COUNTS, "shapley")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS bits,
    coalesce((SELECT max(quality) FROM (SELECT CASE WHEN quality = 1 THEN 1 ELSE 0 END AS quality FROM labels l WHERE l.doc_id = w.doc_id)), 0) = 1 AS good,
    coalesce((SELECT max(toxic) FROM (SELECT CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS toxic FROM labels l WHERE l.doc_id = w.doc_id)), 0) = 1 AS toxic
  FROM w
),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
),
steps AS (SELECT filter_order, s::INTEGER AS step, bits[s] AS filter, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS earlier FROM orders, unnest(range(1, 6)) AS r(s)),
masks AS (SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL),
done AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN bits & (filter | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN bits & filter > 0 AND bits & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN bits & filter > 0 AND bits & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN bits = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN bits & filter > 0 AND bits & earlier = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN bits & filter > 0 AND bits & earlier = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM done
"""
