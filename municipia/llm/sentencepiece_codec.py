"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a whitespace marker behind another character, so a merge never crosses the start of a marked
word: segmenting each distinct marked word once and joining the ids back by position gives the ids of the whole text.
``assert_chunkable`` checks that property of a model, and that it neither rewrites characters nor drops blanks.

Defined results: a null or empty text has no ids, the digest of the empty string and an empty decoded text; repeated rows
and null ids come back row by row; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from municipia.llm.shared import blocks, kept

MARK = "▁"
#: Distinct chunks that a worker keeps; beyond it the table is begun anew, which changes no result.
TABLE_SIZE = 500_000


@lru_cache(maxsize=2)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def assert_chunkable(model: str) -> None:
    """Raise ValueError if marked words of this model can't be segmented one by one."""
    sp = processor(model)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} has a whitespace marker behind another character")
    probe = "  a  ｆ\t b  "
    if sp.decode(sp.encode(probe, num_threads=1)) != probe:
        raise ValueError("the model normalises its input")


def marked_words(text: str) -> list[str]:
    """The text cut before each blank that follows another character, the marker that stands before every text left out.

    'a b  c ' gives 'a', 'b', ' c', '': each stands for itself behind one marker.
    """
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    words, pending = [], 0
    last = len(parts) - 1
    for i, part in enumerate(parts):
        if part or i == last:
            words.append(" " * pending + part)
            pending = 0
        else:
            pending += 1
    return words


class ChunkTable:
    """Of each distinct marked word: the number of its ids, the ids as text, and what they decode to."""

    def __init__(self, model: str, size: int = TABLE_SIZE):
        self.sp, self.size, self.rows = processor(model), size, {}

    def learn(self, texts: list[list[str]]) -> None:
        new = list(set(filterfalse(self.rows.__contains__, chain.from_iterable(texts))))
        if len(self.rows) + len(new) > self.size:
            self.rows.clear()
            new = list(set(chain.from_iterable(texts)))
        # a word that is empty stands for the marker alone, which the library adds only before a text
        ids = [x or [self.sp.piece_to_id(MARK)] for x in self.sp.encode(new, num_threads=1)]
        for word, mine, decoded in zip(new, ids, self.sp.decode(ids, num_threads=1), strict=True):
            self.rows[word] = (len(mine), str(mine)[1:-1].replace(" ", ""), decoded)

    def joined(self, words: list[str]) -> tuple[int, str, str]:
        """Number of ids, ids as text, decoded text, by position."""
        if not words:
            return 0, "", ""
        n, ids, decoded = zip(*map(self.rows.__getitem__, words), strict=True)
        return sum(n), ",".join(ids), " ".join(decoded)


def chunk_table(model: str) -> ChunkTable:
    """One table for all tasks of a worker: what a chunk's ids are depends on nothing else."""
    return kept(ChunkTable, model)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, decoded string: one row per input row."""
    assert_chunkable(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model)
        for block in blocks(batches, text_col):
            texts = [marked_words(t or "") for t in block.column(text_col).to_pylist()]
            chunks.learn(texts)
            found = [chunks.joined(words) for words in texts]
            ids = [[int(i) for i in x[1].split(",")] if x[0] else [] for x in found]
            decoded = [x[2] for x in found]
            yield pa.RecordBatch.from_arrays([block.column(id_col), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; ids never leave the task that made them."""
    assert_chunkable(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(model)
        for block in blocks(batches):
            texts = [marked_words(t or "") for t in block.column("text").to_pylist()]
            chunks.learn(texts)
            n, ids, decoded = [], [], []
            for words in texts:
                count, listed, text = chunks.joined(words)
                n.append(count)
                ids.append(hashlib.sha256(listed.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
