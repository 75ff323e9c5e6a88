"""Token ids in files of patched frame-of-reference blocks.

A file row is a segment: some whole documents in ascending id order, their lengths, and a payload of blocks of
``BLOCK_IDS`` ids. A block keeps its minimum, the differences packed at the width that ``PERCENTILE`` of them fit in, and
a list of exceptions (place and difference) for the rest; an index at the head gives each block's first byte, so any block
is read alone. Segments are rows of a Parquet table, which gives tasks that are lost or repeated nothing to mend.

Payload, little-endian: 'PFB1', uint32 ids, uint32 blocks, uint32 starts[blocks + 1] from the first body byte, then the
bodies: uint32 minimum, uint8 width, uint16 exceptions, packed bits, uint16 places[], uint32 differences[].

Defined results: a null or empty text has the end id alone; null ids come first; rows of one id, or of none, follow each other in order of a hash
of their text, so that many of them are parted between tasks; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from municipia.llm.shared import blocks, kept, shared_dir

MAGIC, HEAD = b"PFB1", 12
BLOCK_IDS, PERCENTILE = 256, 90
#: A segment is closed once it has so many ids; it always holds whole documents.
SEGMENT_IDS = 1 << 18
#: Distinct stems of words that a worker keeps; beyond it the table is begun anew, which changes no result.
TABLE_SIZE = 1_000_000
#: Bytes of text that are encoded together, and those of a range of doc_id at most, about.
ENCODED_BYTES, RANGE_BYTES = 6_000_000, 64_000_000


# --- blocks ---------------------------------------------------------------------------------------------------------


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, one after another."""
    total = int(counts.sum())
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return first + np.arange(total)


def _width(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest bits of each number of a table, the lowest first."""
    wide = np.ascontiguousarray(values, "<u2" if width <= 16 else "<u4")
    return np.unpackbits(wide.view(np.uint8).reshape(*values.shape, -1), axis=2, bitorder="little")[:, :, :width]


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE) -> bytes:
    """The payload of these ids (uint32)."""
    n = len(ids)
    count = -(-n // block_ids)
    if not n:
        return MAGIC + np.array([0, 0, 0], "<u4").tobytes()
    padded = np.full(count * block_ids, ids[-1], np.uint32)
    padded[:n] = ids
    rows = padded.reshape(count, block_ids)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    rank = min(block_ids - 1, int(np.ceil(block_ids * percentile / 100)) - 1)
    width = _width(np.partition(rows, rank, axis=1)[:, rank])
    over = rows > ((np.int64(1) << width) - 1).astype(np.uint32)[:, None]
    exceptions = over.sum(axis=1)
    packed = -(-block_ids * width // 8)
    sizes = 7 + packed + 6 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)])
    body = np.zeros(int(starts[-1]), np.uint8)
    for at, values, kind in ((0, low, "<u4"), (4, width, "u1"), (5, exceptions, "<u2")):
        raw = values.astype(kind).view(np.uint8).reshape(count, -1)
        body[starts[:-1, None] + at + np.arange(raw.shape[1])] = raw
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            raw = np.packbits(_bits(rows[mine], int(w)).reshape(len(mine), -1), axis=1, bitorder="little")
            body[starts[mine, None] + 7 + np.arange(raw.shape[1])] = raw
    block, place = np.nonzero(over)
    body[_spread(starts[:-1] + 7 + packed, 2 * exceptions)] = place.astype("<u2").view(np.uint8)
    body[_spread(starts[:-1] + 7 + packed + 2 * exceptions, 4 * exceptions)] = rows[block, place].astype("<u4").view(np.uint8)
    return MAGIC + np.array([n, count], "<u4").tobytes() + starts.astype("<u4").tobytes() + body.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids of blocks first up to, not including, last (all of them if None), as uint32."""
    if payload[:4] != MAGIC:
        raise ValueError("not a payload of packed ids")
    n, count = np.frombuffer(payload, "<u4", 2, 4).astype(np.int64)
    last = int(count) if last is None else min(last, int(count))
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(payload, "<u4", int(count) + 1, HEAD).astype(np.int64)[first:last]
    body = np.frombuffer(payload, np.uint8, -1, HEAD + 4 * (int(count) + 1))
    take = lambda at, kind, k: body[starts[:, None] + at + np.arange(k)].copy().view(kind)[:, 0].astype(np.int64)
    low, width, exceptions = take(0, "<u4", 4), take(4, "u1", 1), take(5, "<u2", 2)
    rows = np.zeros((len(starts), block_ids), np.int64)
    packed = -(-block_ids * width // 8)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            raw = body[starts[mine, None] + 7 + np.arange(-(-block_ids * w // 8))]
            bits = np.unpackbits(raw, axis=1, count=block_ids * int(w), bitorder="little").reshape(len(mine), block_ids, w)
            wide = np.zeros((len(mine), block_ids, 16 if w <= 16 else 32), np.uint8)
            wide[:, :, :w] = bits
            rows[mine] = np.packbits(wide, axis=2, bitorder="little").view("<u2" if w <= 16 else "<u4")[:, :, 0]
    place = body[_spread(starts + 7 + packed, 2 * exceptions)].copy().view("<u2")
    rows[np.repeat(np.arange(len(starts)), exceptions), place] = body[_spread(starts + 7 + packed + 2 * exceptions, 4 * exceptions)].copy().view("<u4")
    ids = (rows + low[:, None]).astype(np.uint32).ravel()
    return ids[: int(n) - first * block_ids]


# --- encoding -------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def _open(c: str) -> bool:
    """Whether c could be white space to some release of Unicode."""
    return c.isspace() or c in "\u180e\u200b\ufeff"


#: A word without white space.
PLAIN = re.compile(r"[^\s\u180e\u200b\ufeff]+")
#: A pre-token ends before one of these behind a letter, if nothing but white space comes after.
MARKS = ".,;:!?"
#: A line of letters, by every release of Unicode, and of a mark at most.
LETTERS = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[{MARKS}]?$"


def _byte_names() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    out = np.arange(256, dtype="<u2")
    out[hidden] = np.arange(256, 256 + len(hidden))
    return out


BYTE_NAMES = _byte_names()
#: A line feed and the first byte of one of the letters.
BESIDE = re.compile("Ċ[A-Za-z%s]" % "".join(chr(BYTE_NAMES[b]) for b in range(0xC3, 0xCA)))


class WordTable:
    """The ids of each distinct piece of a word behind a blank, one after another in one array.

    A pre-token never reaches over a blank, or a line feed, that has other characters than white space on both sides, nor
    over one mark between a letter and such a place. So a word's ids are those of its lines, and a line's are those of its
    stem and its last mark, its pieces; stems, each with the blank or line feed ahead of it, are encoded many at a time, parted
    again where an id starts with that. A stem of letters is one pre-token (two behind a line feed, which no id of letters
    holds), so the library's model meets it without the pattern that parts pre-tokens.
    A text with a word that is empty or has white space at an end is encoded whole, and so is one that holds an added token.
    A block of texts is cut, and its words and their pieces numbered, by Arrow; Python meets each distinct stem of a block once.
    """

    def __init__(self, path: str, size: int = TABLE_SIZE):
        self.tokenizer, self.size = tokenizer(path), size
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True
        self.of_letters = self._of_letters(vocabulary)
        self.marks = [np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4") for m in MARKS]
        self._clear()

    def _of_letters(self, vocabulary: dict[str, int]):
        """The library's tokenizer with this model for stems of letters whose bytes are named, if their pre-tokens are known."""
        from tokenizers import Tokenizer, pre_tokenizers

        cut = self.tokenizer.pre_tokenizer
        known = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.tokenizer.normalizer is None
        if not known or any(BESIDE.search(t) for t in vocabulary):
            return None
        out = Tokenizer(self.tokenizer.model)
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(c, "merged_with_next") for c in "ĠĊ"])
        return out

    def _clear(self) -> None:
        #: Each stem's row, behind those of the marks; a row's ids are ids[starts[row] : starts[row + 1]].
        self.rows: dict[str, int] = {}
        self.ids, self.starts = np.concatenate(self.marks), np.cumsum([0, *map(len, self.marks)])

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by word, for words that each start with a blank or a line feed."""
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        texts, by = ["".join(g) for g in groups], self.tokenizer
        if letters and self.of_letters:
            texts, by = [BYTE_NAMES[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-16-le") for t in texts], self.of_letters
        ids, counts = [], []
        for group, found in zip(groups, by.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            mine = np.array(found.ids, "<u4")
            at = np.flatnonzero(self.opens[mine])
            if len(at) == len(group):
                ids.append(mine)
                counts.append(np.diff(at, append=len(mine)))
            else:
                alone = self._whole(group)
                ids += alone
                counts.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])

    def _found(self, stems: list[str]) -> np.ndarray:
        """The row of each stem, -1 if it has none."""
        return np.fromiter(map(self.rows.get, stems, repeat(-1)), np.int64, len(stems))

    def _learnt(self, stems: list[str], letters: bool) -> np.ndarray:
        """The row of each of these distinct stems; those that have none get one."""
        row = self._found(stems)
        new = list(compress(stems, (row < 0).tolist()))
        ids, counts = self._joined(new, letters)
        row[row < 0] = fresh = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(new))
        self.rows.update(zip(new, fresh.tolist()))
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        return row

    def _rows_of(self, of_letters: list[str], others: list[str]) -> np.ndarray:
        """The row of each of these stems, distinct in either list."""
        most = len(self.rows) + len(of_letters) + len(others)
        if most > self.size and most - sum(np.count_nonzero(self._found(x) >= 0) for x in (of_letters, others)) > self.size:
            self._clear()
        return np.concatenate([self._learnt(of_letters, True), self._learnt(others, False)])

    @staticmethod
    def _cut(word: str) -> list[tuple[str, str]] | None:
        """The stem and mark of each line of a word; None if one is empty or has white space at an end."""
        clean = PLAIN.fullmatch(word)
        lines = (word,) if clean else word.split("\n")
        if not clean and any(not x or _open(x[0]) or _open(x[-1]) for x in lines):
            return None
        marked = ((x[:-1], x[-1]) if x[-1] in MARKS and x[-2:-1].isalpha() else (x, "") for x in lines)
        return [(("\n" if i else " ") + stem, mark) for i, (stem, mark) in enumerate(marked)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these distinct words; the first of each word's and their number; which of the words are unclean and have none."""
        cut = pc.split_pattern(words, "\n")
        n_lines = pc.list_value_length(cut).to_numpy().astype(np.int64)
        lines, first = cut.flatten(), np.cumsum(n_lines) - n_lines
        odd = ~pc.match_substring_regex(lines, LETTERS).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(odd, first) if len(words) else np.zeros(0, bool)
        lead = np.ones(len(lines), np.int8)
        lead[first] = 0
        taken = ~np.repeat(odd, n_lines)
        lines = lines.filter(pa.array(taken))
        lead = pa.array([" ", "\n"], lines.type).take(pa.array(lead[taken]))
        mark = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(lines, -1), pa.array(list(MARKS), lines.type)), -1).to_numpy()
        coded = pc.binary_join_element_wise(lead, pc.utf8_rtrim(lines, MARKS), pa.scalar("", lines.type)).dictionary_encode()
        of_letters = coded.dictionary.to_numpy(zero_copy_only=False).tolist()

        others: dict[str, int] = {}
        more, n_more, unclean = [], [], odd.copy()  # a mark is told as its place less the number of marks
        for at, word in zip(np.flatnonzero(odd), words.filter(pa.array(odd)).to_numpy(zero_copy_only=False).tolist(), strict=True):
            found, before = self._cut(word), len(more)
            for stem, end in found or ():
                more.append(others.setdefault(stem, len(others)))
                if end:
                    more.append(MARKS.index(end) - len(MARKS))
            unclean[at] = found is None
            n_more.append(len(more) - before)

        row = self._rows_of(of_letters, list(others))
        size = 1 + (mark >= 0)
        pieces = np.repeat(row[coded.indices.to_numpy()], size)
        pieces[(np.cumsum(size) - 1)[mark >= 0]] = mark[mark >= 0]
        more = np.array(more, np.int64)
        more = np.where(more < 0, more + len(MARKS), np.append(row, 0)[len(of_letters) + np.maximum(more, 0)])
        n = np.zeros(len(words), np.int64)
        owner = np.repeat(np.arange(len(words)), n_lines)[taken]
        np.add.at(n, owner, size)
        n[odd] = n_more
        begin = np.cumsum(np.where(odd, 0, n)) - n
        begin[odd] = len(pieces) + np.cumsum(n_more) - n_more
        pieces = np.concatenate([pieces, more])
        count = self.starts[pieces + 1] - self.starts[pieces]
        ends = np.concatenate([[0], np.cumsum(count)])
        return self.ids[_spread(self.starts[pieces], count)], ends[begin], ends[begin + n] - ends[begin], unclean

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and their number by text; a null text has none."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        parts = pc.list_value_length(cut).to_numpy().astype(np.int64)
        first = np.cumsum(parts) - parts
        coded = cut.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        heads = cut.flatten().take(pa.array(first)).to_numpy(zero_copy_only=False).tolist()
        del cut
        behind = np.ones(len(word), bool)
        behind[first] = False
        seen = np.zeros(len(coded.dictionary), bool)
        seen[word[behind]] = True
        at_word, n_word, not_told = (np.zeros(len(seen), kind) for kind in (np.int64, np.int64, bool))
        pool, at_word[seen], n_word[seen], not_told[seen] = self._words(coded.dictionary.filter(pa.array(seen)))

        owner = np.repeat(np.arange(len(texts), dtype=np.int32), parts)
        whole = np.zeros(len(texts), bool)
        whole[owner[behind & not_told[word]]] = True
        whole |= np.array([not h or _open(h[-1]) for h in heads])
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        own = texts.filter(pa.array(whole)).to_pylist()
        alone = iter(self._whole(own))
        starting = iter(self._whole([h for h, w in zip(heads, whole, strict=True) if not w]))
        lead = [next(alone) if w else next(starting) for w in whole]
        sizes = np.array([len(x) for x in lead], np.int64)

        at, count = at_word[word], n_word[word]
        count[whole[owner]] = 0
        at[first], count[first] = len(pool) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([pool, *lead])[_spread(at, count)], np.add.reduceat(count, first)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def word_table(path: str) -> WordTable:
    """One table for all tasks of a worker: what a word's ids are depends on nothing else."""
    return kept(WordTable, path)


# --- files ----------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text and write the ids, each document's closed by end_id, in ascending doc_id order.

    One shuffle, of the texts into ranges of doc_id, as many as their bytes ask for; a task then encodes, packs and writes its range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = word_table(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        ids_held, begun, segment = 0, 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x, _ in held])
            lengths = np.concatenate([n for _, _, n in held]).astype(np.int32)
            names = pa.concat_arrays([a for a, _, _ in held])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), x) for x in (names, pa.array(lengths))]
            row = [pa.array([shard], pa.int32()), pa.array([segment], pa.int64()), pa.array([begun], pa.int64()), pa.array([len(ids)], pa.int64()), *lists, pa.array([pack(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["shard", "segment", "first_id", "n_ids", "doc_ids", "lengths", "payload"])

        for block in blocks(batches, limit=ENCODED_BYTES):
            ids, counts = words.encode_column(block.column("text"))
            counts = counts + 1
            closing = np.zeros(len(ids) + len(counts), bool)
            closing[np.cumsum(counts) - 1] = True
            ended = np.full(len(closing), end_id, "<u4")
            ended[~closing] = ids
            ends, start = np.cumsum(counts), 0
            while start < len(counts):  # whole documents until the segment has its ids
                upto = min(len(counts), 1 + int(np.searchsorted(ends, segment_ids - ids_held + (ends[start - 1] if start else 0))))
                a, b = (ends[start - 1] if start else 0), ends[upto - 1]
                held.append((block.column("doc_id").slice(start, upto - start), ended[a:b], counts[start:upto]))
                ids_held, start = ids_held + int(b - a), upto
                if ids_held >= segment_ids:
                    yield closed()
                    begun, segment, held, ids_held = begun + ids_held, segment + 1, [], 0
        if held:
            yield closed()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    tied = F.xxhash64("text")  # parts the rows of one id, or of none
    ranges = docs.select("doc_id", "text", tied.alias("tied")).repartitionByRange(parts, "doc_id", "tied").sortWithinPartitions("doc_id", "tied", "text").drop("tied")
    ranges.mapInArrow(run, f"shard int, segment long, first_id long, n_ids long, doc_ids array<{kind}>, lengths array<int>, payload binary").write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids in all files before them; the sums have one row for each shard."""
    files = spark.read.parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = sums.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    return files.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first_id"))


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, and ids array<long>, or their ids_crc32 if digest; from the files alone."""
    segments = read_segments(spark, path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths = row.column("lengths").flatten().to_numpy()
                ids = unpack(row.column("payload")[0].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                first = row.column("start")[0].as_py()
                pieces = [ids[b - n : b] for b, n in zip(ends, lengths, strict=True)]
                last = pa.array([zlib.crc32(x.tobytes()) for x in pieces], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in pieces], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return segments.select("start", "doc_ids", "lengths", "payload").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def file_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
