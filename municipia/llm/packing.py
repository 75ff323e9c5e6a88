"""Packing of documents into sequences of one window, planned by non-negative least squares over a length histogram.

Every document's ids, closed by an end id, are cut at each full window; the last piece is shorter. The histogram of piece
lengths has at most ``window`` entries, whatever the number of documents. Shallow combinations fill a window exactly: up to
``DEPTH`` pieces of at most two lengths. Non-negative least squares finds how often to repeat each so that the repeats use up
the histogram; rounded counts are taken as far as there are pieces, then whatever exact fills are still possible. The
residual pieces, longest first, form one stream that is cut at each window, and its end at powers of two, which need no
padding: so none is left anywhere, and only residual pieces are cut anew.

A piece finds its place by its rank among all pieces of its length: its rank in the task that wrote it plus the number of such
pieces in tasks before. The plan is a table of rank intervals, at most a few for each length. Ids are written once and read
again for cut pieces alone.

Defined results: a null or empty text is its end id alone; repeated rows and null ids are packed row by row; an empty table
gives no rows; other columns are left alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from municipia.llm.shared import among, blocks, kept, written

WINDOW, END_ID = 2048, 1
#: Pieces of a combination at most.
DEPTH = 5
#: Steps of the least-squares solver.
STEPS = 4000
#: Distinct words and bytes of them that a worker keeps; beyond either the table is begun anew, which changes no result.
TABLE_WORDS, TABLE_BYTES = 500_000, 20_000_000
#: Bytes of text that are encoded together.
ENCODED_BYTES = 4_000_000


# --- encoding -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


#: Texts of these characters alone have the same ids when their letters are put in lower case first.
CASED = r"^[\x{0}-\x{12f}\x{132}-\x{148}\x{14a}-\x{17e}\x{2010}-\x{2027}\x{20ac}\x{3000}-\x{9fff}]*$"


class SpacedWords:
    """The ids of each distinct word between blanks, for a tokenizer that drops case and white space and takes digits one by one.

    No pre-token reaches over white space, nor over a mark between a letter and white space: a blank is put there. Words are
    encoded many at a time with a digit between them, whose id parts them again; a word with that digit, or one of an added
    token, is encoded alone. Letters are put in lower case beforehand where that changes no id: not where marks may combine
    with them, nor where an added token might come about.
    """

    BETWEEN = "0"

    def __init__(self, path: str, words: int = TABLE_WORDS, size: int = TABLE_BYTES):
        self.tokenizer, self.most, self.size = tokenizer(path), words, size
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        digit, spaced, joined, cased = self._encoded([self.BETWEEN, f" {self.BETWEEN} \n", f"1{self.BETWEEN}2", "AÉa.\n"])
        if len(digit) != 1 or spaced != digit or joined[1:2] != digit or len(joined) != 3 or cased != self._encoded(["aéa ."])[0]:
            raise ValueError("this tokenizer keeps case, white space or runs of digits")
        self.digit = digit[0]
        self._clear()

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.held = 0
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if self.BETWEEN in w or any(t in w for t in self.added)]
        plain = [w for w in words if self.BETWEEN not in w and not any(t in w for t in self.added)] if alone else words
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        ids, counts, between = [], [], f" {self.BETWEEN} "
        for some in (groups[i : i + 10] for i in range(0, len(groups), 10)):
            for group, found in zip(some, self._encoded([between.join(g) for g in some]), strict=True):
                mine = np.array(found, "<u4")
                cut = mine == self.digit
                counts.append(np.diff(np.flatnonzero(cut) - np.arange(len(group) - 1), prepend=0, append=int((~cut).sum())))
                ids.append(mine[~cut])
        for i in range(0, len(alone), 1000):
            for found in self._encoded(alone[i : i + 1000]):
                ids.append(np.array(found, "<u4"))
                counts.append(np.array([len(found)], np.int64))
        self.rows.update(zip(plain + alone, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.held += sum(map(len, words))
        self.ids = np.concatenate([self.ids, *ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])

    def _alike(self, texts: pa.Array) -> pa.Array:
        """The texts with blanks and lower case where that changes no id."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring(texts, self.added[0], ignore_case=True)
        for token in self.added[1:]:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, token, ignore_case=True))
        marked = pc.or_(unsafe, pc.match_substring_regex(texts, r"\pM"))
        lower = pc.if_else(marked, texts, pc.ascii_lower(texts))
        lower = pc.if_else(pc.and_not(pc.match_substring_regex(texts, CASED), unsafe), pc.utf8_lower(texts), lower)
        return pc.replace_substring_regex(pc.replace_substring(lower, "\n", " "), r"(\pL)([.,;:!?])\s", r"\1 \2 ")

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and their number by text; a null text has none."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        cut = pc.split_pattern(self._alike(texts), " ")
        parts = pc.list_value_length(cut).to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        del cut
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > self.most or self.held + sum(map(len, new)) > self.size:
            self._clear()
            new = words
        self._learn(new)
        row = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        counts = self.starts[row + 1] - self.starts[row]
        first = np.repeat(self.starts[row] - (np.cumsum(counts) - counts), counts)
        return self.ids[first + np.arange(len(first))], np.add.reduceat(counts, np.cumsum(parts) - parts)


# --- the plan -------------------------------------------------------------------------------------------------------


def combinations(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(times, length, rest): so many pieces of a length and one of the rest, if not 0, fill the window; all of them occur."""
    window = len(histogram) - 1
    found = [(1, window, 0)] if histogram[window] else []
    for times in range(1, depth + 1):
        for length in range(1, window // times + 1):
            rest = window - times * length
            if not histogram[length] or length == window or (rest and (not histogram[rest] or times == depth)):
                continue
            if rest == length or times == 1 and length > rest:  # stands there as another one
                continue
            found.append((times, length, rest))
    return found


def least_squares(columns: list[tuple[int, int, int]], histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the columns with the least sum of squares of A x - histogram, by accelerated projected gradients."""
    if not columns:
        return np.zeros(0)
    times, length, rest = (np.array(x) for x in zip(*columns))
    once = (rest > 0).astype(float)
    size = len(histogram)
    used = lambda x: np.bincount(length, times * x, size) + np.bincount(rest, once * x, size)
    back = lambda r: times * r[length] + once * r[rest]
    step = 1.0 / max(1.0, float((times + once).max() * used(np.ones(len(columns))).max()))
    target = histogram.astype(float)
    target[0] = 0
    x = y = np.zeros(len(columns))
    pace = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(used(y) - target))
        if np.dot(y - new, new - x) > 0:  # the momentum leads uphill
            pace, y = 1.0, x
            new = np.maximum(0, y - step * back(used(y) - target))
        ahead = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = new + (pace - 1) / ahead * (new - x)
        x, pace = new, ahead
    return x


@dataclass(frozen=True)
class Plan:
    """slots: (length, low, high, times, sequence, offset) for ranks low..high-1 of a length; stream: (length, low, place)."""

    window: int
    slots: list[tuple[int, int, int, int, int, int]]
    stream: list[tuple[int, int, int]]
    #: Sequences before the stream's, and where the stream is cut behind its last full window.
    sequences: int
    full: int
    ends: list[int]


def planned(histogram: np.ndarray, depth: int = DEPTH) -> Plan:
    """The plan for pieces counted by length (index 0 is unused)."""
    window, free = len(histogram) - 1, histogram.astype(np.int64).copy()
    columns = combinations(histogram, depth)
    repeats = least_squares(columns, histogram)
    used, slots, sequences = np.zeros(window + 1, np.int64), [], 0
    for wanted in (np.round(repeats).astype(np.int64), np.full(len(columns), histogram.sum())):
        for i in np.argsort(-repeats, kind="stable"):
            times, length, rest = columns[i]
            n = int(min(wanted[i], free[length] // times, free[rest] if rest else wanted[i]))
            if n <= 0:
                continue
            for size, each, offset in ((length, times, 0), (rest, 1, times * length)):
                if size:
                    slots.append((size, int(used[size]), int(used[size]) + n * each, each, sequences, offset))
                    used[size] += n * each
                    free[size] -= n * each
            sequences += n
    place, stream = 0, []
    for length in range(window, 0, -1):
        if free[length]:
            stream.append((length, int(used[length]), place))
            place += int(free[length]) * length
    full, rest, at, ends = place // window, place % window, place - place % window, []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return Plan(window, slots, stream, sequences, full, ends)


# --- pieces ---------------------------------------------------------------------------------------------------------


def written_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A table of uid, shard, doc_id, doc_tokens, start, length, rank (among the shard's pieces of that length), crc, ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "shard", "doc_id", "doc_tokens", "start", "length", "rank", "crc", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, done = kept(SpacedWords, tokenizer_path), TaskContext.get().partitionId(), 0
        seen = np.zeros(window + 1, np.int64)
        for block in blocks(batches, limit=ENCODED_BYTES):
            ids, counts = words.encode_column(block.column("text"))
            counts = counts + 1
            ended = np.full(len(ids) + len(counts), end_id, "<u4")
            closing = np.zeros(len(ended), bool)
            closing[np.cumsum(counts) - 1] = True
            ended[~closing] = ids
            pieces = -(-counts // window)
            owner = np.repeat(np.arange(len(counts)), pieces)
            start = window * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            length = np.minimum(window, counts[owner] - start)
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            rank = np.empty(len(owner), np.int64)
            rank[order] = np.arange(len(owner)) - first + seen[length[order]]
            seen += np.bincount(length, minlength=window + 1)
            ends = np.concatenate([[0], np.cumsum(length)])
            raw = ended.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer((4 * ends).astype(np.int64).tobytes()), pa.py_buffer(raw)])
            uid = (np.int64(shard) << 40) + done + np.arange(len(owner))
            done += len(owner)
            columns = [uid, np.full(len(owner), shard, np.int32), None, counts[owner], start, length.astype(np.int32), rank, np.array(crc, np.int64), None]
            arrays = [pa.array(c) if c is not None else None for c in columns]
            arrays[2], arrays[8] = block.column("doc_id").take(pa.array(owner)), packed.cast(pa.binary())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return written(docs.select("doc_id", "text").mapInArrow(run, f"uid long, shard int, doc_id {kind}, doc_tokens long, start long, length int, rank long, crc long, ids binary"))


def _ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """pieces without ids, rank among all pieces of their length; the number of pieces by length."""
    counts = written(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")))
    before = counts.select("shard", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    found = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    ranked = pieces.drop("ids").join(before, ["shard", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "shard")
    return ranked, {r.length: r.n for r in found}


def _stream_spans(plan: Plan, at: Column, end: Column) -> Column:
    """array<struct<at, end, sequence_id, offset>>: a piece of the stream, cut where windows end."""
    bounds = F.array(*[F.lit(x).cast("long") for x in [plan.full * plan.window, *plan.ends]])
    next_window = (F.floor(at / plan.window) + 1) * plan.window
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(next_window), bounds), lambda c: (c > at) & (c < end))))

    def span(a: Column, b: Column) -> Column:
        passed = F.filter(bounds, lambda x: x <= a)
        whole = a < plan.full * plan.window
        sequence = F.when(whole, F.floor(a / plan.window)).otherwise(plan.full + F.size(passed) - 1) + plan.sequences
        offset = F.when(whole, F.pmod(a, F.lit(plan.window))).otherwise(a - F.array_max(passed))
        return F.struct(a.alias("at"), b.alias("end"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

    return F.zip_with(F.concat(F.array(at), cuts), F.concat(cuts, F.array(end)), span)


def _placed(pieces: DataFrame, window: int, depth: int) -> DataFrame:
    """uid, doc_id, doc_tokens, start (of the piece), within, size, crc, sequence_id, offset: spans of pieces by sequence.

    The plan is a broadcast table: at most one row for each length and combination, whatever the number of documents.
    """
    ranked, found = _ranked(pieces)
    histogram = np.zeros(window + 1, np.int64)
    for length, n in found.items():
        histogram[length] = n
    plan = planned(histogram, depth)
    spark = pieces.sparkSession
    held = ["uid", "doc_id", "doc_tokens", "start", "length", "crc"]
    rows = [(*s, None) for s in plan.slots] + [(length, low, int(histogram[length]), None, None, None, place) for length, low, place in plan.stream]
    slots = spark.createDataFrame(rows, "length int, low long, high long, times int, first long, shift long, place long")
    nth = F.col("rank") - F.col("low")
    # a piece lies in one interval of its length: a full one has few
    at = ranked.join(F.broadcast(slots), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    place = F.col("place") + nth * F.col("length")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("length").cast("long").alias("end"), (F.col("first") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"), (F.col("shift") + F.pmod(nth, F.col("times")) * F.col("length")).cast("long").alias("offset")))
    streamed = F.transform(_stream_spans(plan, place, place + F.col("length")), lambda s: F.struct((s["at"] - place).alias("at"), (s["end"] - place).alias("end"), s["sequence_id"].alias("sequence_id"), s["offset"].alias("offset")))
    spans = at.select(*held, F.explode(F.when(F.col("place").isNull(), whole).otherwise(streamed)).alias("s"))
    return spans.select(*held, F.col("s.at").alias("within"), (F.col("s.end") - F.col("s.at")).alias("size"), "s.sequence_id", "s.offset")


def _digests(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """spans (a written table) with the crc of their own ids."""
    cut = spans.where(F.col("size") < F.col("length"))
    ids = among(pieces.select("uid", "ids"), "uid", written(cut.select("uid").distinct()))
    fields = "doc_id, doc_tokens, start, within, size, sequence_id, offset".split(", ")
    kinds = ", ".join(f"{f} {spans.schema[f].dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.crc32(x[4 * a : 4 * (a + n)]) for x, a, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "within", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(found, pa.int64())], names=[*fields, "crc"])

    again = cut.join(ids, "uid").select(*fields, "ids").mapInArrow(run, f"{kinds}, crc long")
    return spans.where(F.col("size") == F.col("length")).select(*fields, "crc").union(again)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, depth: int = DEPTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of a document in a sequence."""
    pieces = written_pieces(docs, tokenizer_path, window, end_id)
    found = _digests(written(_placed(pieces, window, depth)), pieces)
    return found.select("doc_id", (F.col("start") + F.col("within")).alias("start"), F.col("size").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, depth: int = DEPTH) -> DataFrame:
    """sequence_id, ids array<int>, doc_ids: the packed sequences themselves; one holds ``window`` ids at most."""
    pieces = written_pieces(docs, tokenizer_path, window, end_id)
    spans = _placed(pieces, window, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [np.frombuffer(x, "<u4")[a : a + n].astype(np.int32) for x, a, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "within", "size")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("offset"), batch.column("doc_id"), pa.array(cut, pa.list_(pa.int32()))], names=["sequence_id", "offset", "doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = spans.join(pieces.select("uid", "ids"), "uid").select("sequence_id", "offset", "doc_id", "within", "size", "ids").mapInArrow(run, f"sequence_id long, offset long, doc_id {kind}, ids array<int>")
    held = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return held.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
