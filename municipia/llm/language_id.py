"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Every language has a probability for each letter piece of a public vocabulary. The probability of a marked word is the sum
over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. The piece
probabilities come from expectation-maximisation (forward-backward) on word counts of a sample: about ``SAMPLE_DOCS``
documents of each language, or ``SAMPLE_BYTES`` of text if that is less, taken by a hash of doc_id and text, so its size does
not grow with the table. Every language that occurs is learnt; the model has a column for each. Scoring covers all words of
all texts; a task scores each distinct word once. A letter is a character of category L.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when there is nothing to learn from;
equal scores go to the language first in alphabetical order; repeated rows and null ids are scored row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from municipia.llm.sentencepiece_codec import MARK, processor
from municipia.llm.shared import blocks, kept

#: The bounds of the training sample: documents and bytes of text expected of each language.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 20_000_000
#: A run of more letters is cut into parts of so many, each scored in turn.
PART = 24
ROUNDS, FLOOR, SHARED = 4, 1e-9, 0.02
#: Distinct words that a task keeps, and numbers for them; beyond either the table is begun anew, which changes no result.
TABLE_SIZE, TABLE_NUMBERS = 200_000, 8_000_000
#: Numbers of a step of the forward algorithm: words times languages.
STEP_NUMBERS = 100_000
UNKNOWN = "und"



def _numeral(c: str) -> bool:
    """A word character of ``re`` that is neither a letter nor a decimal digit."""
    return c.isnumeric() and not (c.isalpha() or c.isdecimal())


#: Those of the first plane, as a class that ``re`` looks up at once, and any character beyond that plane.
NUMERALS, BEYOND = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if _numeral(c)) + "]"), re.compile("[\U00010000-\U0010ffff]")
LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def marked_parts(text: str | None) -> list[str]:
    """The runs of letters in lower case, behind the marker, long ones in parts."""
    text = (text or "").lower()
    if NUMERALS.search(text) or BEYOND.search(text):
        text = "".join(" " if _numeral(c) else c for c in text)
    found = LETTERS.findall(text)
    return [w if len(w) <= PART else w[i : i + PART] for w in found for i in (range(0, len(w), PART) if len(w) > PART else (0,))]


def _codes(words: list[str]) -> np.ndarray:
    """Code points behind the marker, one row a word, 0 beyond its end."""
    width = max(map(len, words)) + 1
    raw = np.frombuffer("".join((MARK + w).ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4")
    return raw.reshape(len(words), width).astype(np.uint64)


class Pieces:
    """The letter pieces of a vocabulary, found by a hash of their code points."""

    def __init__(self, model: str):
        sp = processor(model)
        strings = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
        self.strings = sorted({s for s in strings if s == s.lower() and (s == MARK or LETTERS.fullmatch(s.removeprefix(MARK)) and not any(map(_numeral, s))) and len(s) <= PART})
        self.longest = max(map(len, self.strings))
        keys = self._hashes(self.strings)
        bits = 14
        while True:  # buckets of four; more of them until none overflows
            place = (keys >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            rank = np.arange(len(order)) - np.searchsorted(place[order], place[order])
            if rank.max() < 4:
                break
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.keys, self.ids = np.zeros((1 << bits, 4), np.uint64), np.full((1 << bits, 4), -1, np.int32)
        self.keys[place[order], rank], self.ids[place[order], rank] = keys[order], order

    @staticmethod
    def _hashes(strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), np.uint64)
        for i, s in enumerate(strings):
            h = 0
            for c in s:
                h = (h * int(BASE) + ord(c)) & (2**64 - 1)
            out[i] = h
        return out * SPREAD

    def find(self, hashes: np.ndarray) -> np.ndarray:
        keys = hashes * SPREAD
        place = (keys >> self.shift).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        for k in range(4):
            hit = self.keys[place, k] == keys
            out[hit] = self.ids[place[hit], k]
        return out

    def ends(self, codes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each end e: [(start, piece of codes[:, start:e] or -1 for each word)], nearest start first."""
        n, width = codes.shape
        running: list[np.ndarray] = []  # hash of codes[:, s:e] by s
        for e in range(1, width + 1):
            c = codes[:, e - 1]
            running = [h * BASE + c for h in running] + [c.copy()]
            if len(running) > self.longest:
                running = running[-self.longest :]
            first = e - len(running)
            found = self.find(np.concatenate(running)).reshape(len(running), n)
            yield e, [(first + k, found[k]) for k in reversed(range(len(running)))]


@lru_cache(maxsize=1)
def pieces_of(vocabulary: str) -> Pieces:
    return Pieces(vocabulary)


@dataclass(eq=False)
class Model:
    langs: list[str]
    #: piece x language; the row behind the last piece holds the probability of a character that no piece has.
    p: np.ndarray
    vocabulary: str

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Model) and (self.langs, self.vocabulary) == (other.langs, other.vocabulary) and np.array_equal(self.p, other.p)

    def __hash__(self) -> int:
        return hash((self.vocabulary, *self.langs))


def forward(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each marked word, summed over its segmentations, for each column of p."""
    out = np.empty((len(words), p.shape[1]))
    lengths = np.array([len(w) + 1 for w in words])
    for n in np.unique(lengths):
        mine = np.flatnonzero(lengths == n)
        codes = _codes([words[i] for i in mine])
        alpha = [np.ones((len(mine), p.shape[1]))]
        for e, starts in pieces.ends(codes):
            total = np.zeros((len(mine), p.shape[1]))
            for s, ids in starts:
                if e - s == 1:
                    total += alpha[s] * p[ids]  # -1: the row of unknown characters
                else:
                    hit = np.flatnonzero(ids >= 0)
                    total[hit] += alpha[s][hit] * p[ids[hit]]
            alpha.append(total)
        out[mine] = np.log(alpha[-1])
    return out


def expected(pieces: Pieces, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (last: unknown characters) over all segmentations of words that occur counts times."""
    out = np.zeros(len(p))
    lengths = np.array([len(w) + 1 for w in words])
    for n in np.unique(lengths):
        mine = np.flatnonzero(lengths == n)
        spans = list(pieces.ends(_codes([words[i] for i in mine])))
        alpha = np.zeros((n + 1, len(mine)))
        beta = np.zeros((n + 1, len(mine)))
        alpha[0] = beta[n] = 1
        use = lambda s, e, ids: np.where((ids >= 0) | (e - s == 1), p[ids], 0.0)
        for e, starts in spans:
            for s, ids in starts:
                alpha[e] += alpha[s] * use(s, e, ids)
        for e, starts in reversed(spans):
            for s, ids in starts:
                beta[s] += beta[e] * use(s, e, ids)
        for e, starts in spans:
            for s, ids in starts:
                share = alpha[s] * use(s, e, ids) * beta[e] / alpha[n] * counts[mine]
                out += np.bincount(np.where(ids < 0, len(p) - 1, ids), share, len(p))
    return out


def fit_counts(counts: dict[str, Counter], vocabulary: str, rounds: int = ROUNDS) -> Model:
    """The model from word counts by language."""
    pieces = pieces_of(vocabulary)
    langs = sorted(counts)
    n = len(pieces.strings) + 1
    p = np.full((n, max(1, len(langs))), FLOOR)
    for k, lang in enumerate(langs):
        words = list(counts[lang])
        times = np.array([counts[lang][w] for w in words], float)
        column = np.full(n, 1 / n)
        for _ in range(rounds):
            uses = expected(pieces, column, words, times) if words else np.zeros(n)
            column = np.maximum(uses / max(uses.sum(), 1), FLOOR)
        p[:, k] = column
    p = (1 - SHARED) * p + SHARED * p.mean(axis=1, keepdims=True)
    return Model(langs, p, vocabulary)


class WordScores:
    """Of each distinct word, its log-probability by language; begun anew beyond ``size`` words."""

    def __init__(self, model: Model, size: int = TABLE_SIZE):
        langs = max(1, len(model.langs))
        self.model, self.size, self.pieces = model, max(64, min(size, TABLE_NUMBERS // langs)), pieces_of(model.vocabulary)
        self.step = max(64, min(10_000, STEP_NUMBERS // langs))
        self.place: dict[str, int] = {}
        self.rows = np.zeros((min(self.size, 1024), len(model.langs)))

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """Log-probability of each text by language; so many words at once as the table holds."""
        total = np.zeros((len(texts), len(self.model.langs)))
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, words in enumerate(texts):
            for at in range(0, len(words), self.size):
                part = words[at : at + self.size]
                if n + len(part) > self.size:
                    self._add(total, held)
                    held, n = [], 0
                held.append((i, part))
                n += len(part)
        self._add(total, held)
        return total

    def _add(self, total: np.ndarray, parts: list[tuple[int, list[str]]]) -> None:
        new = list({w for _, words in parts for w in words} - self.place.keys())
        if len(self.place) + len(new) > self.size:
            self.place.clear()
            new = list({w for _, words in parts for w in words})
        first = len(self.place)
        self.place |= {w: first + i for i, w in enumerate(new)}
        if len(self.place) > len(self.rows):
            grown = min(self.size, max(len(self.place), 2 * len(self.rows)))
            self.rows = np.concatenate([self.rows, np.zeros((grown - len(self.rows), self.rows.shape[1]), self.rows.dtype)])
        for i in range(0, len(new), self.step):
            some = new[i : i + self.step]
            self.rows[first + i : first + i + len(some)] = forward(self.pieces, self.model.p, some)
        for i, words in parts:
            total[i] += self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0)


# --- Spark ----------------------------------------------------------------------------------------------------------


def fit(labelled: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """From the text and non-null lang of labelled (doc_id, text, lang); only a sample's word counts reach the driver."""
    spark, rows = labelled.sparkSession, labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    shares = [(r.lang, min(1.0, sample_docs / r.n, sample_bytes / max(1, r.bytes or 0))) for r in sizes]
    # a row for each language: far smaller than the model, which has a column for each
    shared = F.broadcast(spark.createDataFrame(shares, "lang string, share double"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("language")), F.lit(1 << 20)) < F.col("share") * (1 << 20)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(marked_parts(text))
        for lang, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    counted = rows.join(shared, "lang").where(drawn).select("lang", "text").mapInArrow(words, "lang string, word string, n long")
    table = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {lang: Counter() for lang, _ in shares}
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    return fit_counts(counts, vocabulary)


def word_scores(model: Model) -> WordScores:
    """One table for all tasks of a worker that score by the same model."""
    return kept(WordScores, model)


def told(scores: WordScores, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """lang_pred and score (posterior of lang_pred, all languages alike before) of each text, from it alone."""
    langs = np.array([*scores.model.langs, UNKNOWN], object)
    words = [marked_parts(t) for t in texts]
    some = np.array([bool(w) for w in words], bool) & bool(scores.model.langs)
    best, score = np.full(len(words), len(langs) - 1), np.zeros(len(words))
    if some.any():
        total = scores.score(words)
        best = np.where(some, total.argmax(axis=1), best)
        score = np.where(some, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
    return langs[best], score


def predict(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The columns in keep, lang_pred and score, of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(*keep, F.col("text").alias("__text"))
    names = [c for c in held.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = word_scores(shared.value)
        for block in blocks(batches, "__text", 1_000_000):
            lang, score = told(scores, block.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = held.select(*names).schema
    for name, kind in (("lang_pred", "string"), ("score", "double")):
        schema = schema.add(name, kind)
    return held.mapInArrow(run, schema)


def remainder(docs: DataFrame, k: int) -> Column:
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % k


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is told with a score of least or more; learnt from docs' own lang.
    Rows pass through a task once, a block of texts at a time, and only those that stay go back."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(remainder(docs, 3) != 1), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = word_scores(shared.value)
        for block in blocks(batches, "text", 1_000_000):
            lang, score = told(scores, block.column("text").to_pylist())
            yield block.filter(pa.array((lang != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def language_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents with crc32(doc_id) mod 3 = 1 are held out from learning."""
    held_out = remainder(docs, 3) == 1
    model = fit(docs.where(~held_out), vocabulary)
    return predict(docs, model, F.col("doc_id"), held_out.alias("held_out"))
