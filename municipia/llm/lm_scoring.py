"""Cross-entropy difference: how much likelier a text is under a target model than under a background model.

Both models are trigram models over the tokens of a public byte-level tokenizer, so that every script, case and digit counts,
with the same interpolation of all orders. The counts come from every whole text and grow with the corpus:

1. Every text is encoded once (only texts that may be in the target are shuffled for it, which a bitmap of its ids tells); spans of about ``SPAN`` tokens, which are whole documents, are written, a row for each.
2. Each span's n-grams are counted and dealt to buckets by their context; a bucket adds up the counts of its n-grams over
   all spans. The number of buckets follows the number of tokens, so neither a span nor a bucket outgrows a task.
3. The sums go back to their spans, in the spans' own order of codes, and meet the documents there.

An n-gram's code is exact: a bijection of its first two ids of 16 bits each, then the third. So the n-grams of one context
stand together in one bucket, and are sent as the context and the list of tokens that follow it. The driver holds two numbers.

A document's loss under a model is its mean negative log-probability a token, the end of the text being one more token to be
told; ``score`` is target loss less background loss, so lower is nearer to the target. A model that tells a document never
holds the document's own counts: they are taken from the background's, and from the target's if it is a target document, so
a score tells likeness to the others and not what is in the target. Other documents of the same text do count.

Defined results: a null or empty text has n_tokens 0 and null losses; without target documents the target model is that of
no counts (all tokens alike); repeated rows and null ids are scored row by row; several labels of a document make it a
target if one of them does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from municipia.llm.shared import blocks, let_go, possible, written
from municipia.llm.token_files import ENCODED_BYTES, tokenizer, word_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Weights of the orders of tokens from none (all tokens alike) to three; an order whose context was never met is that below it.
TOKEN_MIX = (0.01, 0.14, 0.25, 0.6)
#: A span is closed once it has so many tokens and ends of texts.
SPAN = 1 << 20
#: Bits of the least number of buckets, and the tokens of the corpus for each bucket where that makes more of them.
BUCKET_BITS, BUCKET = 8, 1 << 22
TOKEN_BITS, PAIR_BITS = 16, 32


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed block, byte by byte of all numbers of an array; ``unpacked`` gives them again."""
    heads, planes = [], []
    for values in arrays:
        width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
        heads += [len(values), width]
        planes.append(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel())
    body = np.concatenate(planes)
    return np.array([len(arrays), len(body), *heads], "<u4").tobytes() + pa.Codec("zstd", 1).compress(body.tobytes(), asbytes=True)


def unpacked(block: bytes) -> list[np.ndarray]:
    count, size = np.frombuffer(block, "<u4", 2).tolist()
    heads = np.frombuffer(block, "<u4", 2 * count, 8).tolist()
    body = np.frombuffer(pa.Codec("zstd").decompress(block[8 + 8 * count :], size, asbytes=True), np.uint8)
    out, at = [], 0
    for n, width in zip(heads[::2], heads[1::2], strict=True):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = body[at : at + n * width].reshape(width, n).T
        out.append(wide.view("<u8").ravel().astype(np.int64))
        at += n * width
    return out


def mixed(pairs: np.ndarray) -> np.ndarray:
    """A bijection of numbers of 32 bits whose high bits depend on all bits."""
    mask, half = np.uint64((1 << PAIR_BITS) - 1), np.uint64(PAIR_BITS // 2)
    h = pairs.astype(np.uint64)
    for factor in (0x9E3779B1, 0x85EBCA77):
        h = (h * np.uint64(factor)) & mask
        h ^= h >> half
    return h.astype(np.int64)


def encoded_spans(docs: DataFrame, tokenizer_path: str, span_tokens: int) -> DataFrame:
    """span, doc_ids, target, lengths, ids (16 bits each, from 1 on, compressed), n_target and n_background (tokens and ends of
    texts) of docs (doc_id, text, target)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, span = word_table(tokenizer_path), TaskContext.get().partitionId() << 32
        docs_held, ids, held = [], [], 0

        def closed() -> pa.RecordBatch:
            names, targets, lengths = (pa.concat_arrays(x) for x in zip(*docs_held, strict=True))
            n, own = lengths.to_numpy(), targets.to_numpy(zero_copy_only=False).astype(bool)
            told = n + (n > 0)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), x) for x in (names, targets, lengths)]
            numbers = [pa.array([x], pa.int64()) for x in (int(told[own].sum()), int(told.sum()))]
            row = [pa.array([span], pa.int64()), *lists, pa.array([packed(np.concatenate(ids))], pa.binary()), *numbers]
            return pa.RecordBatch.from_arrays(row, names=["span", "doc_ids", "target", "lengths", "ids", "n_target", "n_background"])

        for block in blocks(batches, limit=ENCODED_BYTES):
            found, lengths = words.encode_column(block.column("text"))
            found, ends, start = (found + 1).astype(np.uint16), np.cumsum(lengths), 0
            closing = np.cumsum(lengths + 1)
            while start < len(lengths):  # whole documents until the span has its tokens
                passed = int(closing[start - 1]) if start else 0
                upto = min(len(lengths), 1 + int(np.searchsorted(closing, span_tokens - held + passed)))
                docs_held.append((block.column("doc_id").slice(start, upto - start), block.column("target").slice(start, upto - start), pa.array(lengths[start:upto])))
                ids.append(found[(ends[start - 1] if start else 0) : ends[upto - 1]])
                held, start = held + int(closing[upto - 1]) - passed, upto
                if held >= span_tokens:
                    yield closed()
                    span, docs_held, ids, held = span + 1, [], [], 0
        if docs_held:
            yield closed()

    return docs.select("doc_id", "text", "target").mapInArrow(run, f"span long, doc_ids array<{kind}>, target array<boolean>, lengths array<long>, ids binary, n_target long, n_background long")


def token_grams(ids: np.ndarray, lengths: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the one token and of the two (rows of the first), and of the three (the second) that end at each token and at
    the end of each text. Both sides of a text are ``edge``; a text without tokens has no codes. ids: of all texts, one after
    another. A code of three is that of its first two, and then the last token."""
    lengths = lengths[lengths > 0]
    starts = np.cumsum(lengths + 3) - lengths - 3
    s = np.full(len(ids) + 3 * len(lengths), edge, np.int64)
    inside = np.ones(len(s), bool)
    inside[starts] = inside[starts + 1] = False
    told = inside.copy()
    told[starts + lengths + 2] = False
    s[told] = ids
    two = np.zeros(len(s), np.int64)
    two[1:] = mixed((s[:-1] << TOKEN_BITS) + s[1:])
    three = np.zeros(len(s), np.int64)
    three[1:] = (two[:-1] << TOKEN_BITS) + s[1:]
    return np.stack([mixed(s), two])[:, inside], three[inside]


def counted(codes: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, ascending, how often each occurs where ``mine`` holds, and how often in all."""
    found, n = np.unique(codes, return_counts=True)
    own, n_own = np.unique(codes[mine], return_counts=True)
    n_target = np.zeros(len(found), np.int64)
    n_target[np.searchsorted(found, own)] = n_own
    return found, n_target, n


def first_codes(lengths: np.ndarray) -> np.ndarray:
    """Place of each text's first code."""
    told = lengths[lengths > 0] + 1
    return np.cumsum(told) - told


def ranked(codes: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Each code's place among the distinct codes, ascending, and their number. Codes have so many bits.

    Code and position are sorted as one number where 63 bits hold them."""
    at_bits = int(len(codes)).bit_length()
    if not len(codes) or bits + at_bits > 63:
        found, place = np.unique(codes, return_inverse=True)
        return place, len(found)
    both = (codes << at_bits) | np.arange(len(codes))
    both.sort()
    at = both & ((1 << at_bits) - 1)
    both >>= at_bits
    fresh = np.empty(len(both), bool)
    fresh[0] = False
    np.not_equal(both[1:], both[:-1], out=fresh[1:])
    place = np.empty(len(codes), np.int64)
    place[at] = np.cumsum(fresh, out=both)
    return place, int(both[-1]) + 1


def listed_pairs(codes: np.ndarray, three: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All codes of one and two tokens, and for each text that of the two edges before it, which no token ends."""
    return np.concatenate([codes.ravel(), three[first] >> TOKEN_BITS])


def token_counts(spans: DataFrame, edge: int, bits: int) -> DataFrame:
    """bucket, span, grams, n of every span. grams: the codes of one and two tokens, ascending, as steps; to each the number of
    codes of three that start with it; the last tokens of those. n: counts of the first in the target and in all, counts of
    the latter likewise. Ascending buckets hold ascending codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for row in batch.select(["span", "target", "lengths", "ids"]).to_pylist():
                lengths = np.array(row["lengths"])
                codes, three = token_grams(unpacked(row["ids"])[0], lengths, edge)
                mine = np.repeat(np.array(row["target"], bool), lengths + (lengths > 0))
                first = first_codes(lengths)
                pairs, *of_pairs = counted(listed_pairs(codes, three, first), np.concatenate([mine, mine, mine[first]]))
                threes, *of_threes = counted(three, mine)
                heads = np.searchsorted(threes, np.append(pairs, 1 << PAIR_BITS) << TOKEN_BITS)
                buckets = pairs >> (PAIR_BITS - bits)
                cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(pairs)] if len(pairs) else [0]
                grams, n = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    x, y = heads[a], heads[b]
                    grams.append(packed(np.diff(pairs[a:b], prepend=0), np.diff(heads[a : b + 1]), threes[x:y] & ((1 << TOKEN_BITS) - 1)))
                    n.append(packed(*(c[a:b] for c in of_pairs), *(c[x:y] for c in of_threes)))
                yield pa.RecordBatch.from_arrays([pa.array(buckets[cuts[:-1]], pa.int64()), pa.array([row["span"]] * len(grams), pa.int64()), pa.array(grams, pa.binary()), pa.array(n, pa.binary())], names=["bucket", "span", "grams", "n"])

    return spans.select("span", "target", "lengths", "ids").mapInArrow(run, "bucket long, span long, grams binary, n binary")


def added_up(counts: DataFrame) -> DataFrame:
    """bucket, span, n: as ``token_counts``, each n-gram with its counts over all spans. A bucket has one row of each span."""

    def sums(codes: list[np.ndarray], counts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        _, place = np.unique(np.concatenate(codes), return_inverse=True)
        ends = np.cumsum([len(c) for c in codes])[:-1]
        return [np.split(np.bincount(place, np.concatenate(n)).astype(np.int64)[place], ends) for n in counts]

    def run(rows: pa.Table) -> pa.Table:
        let_go()
        pairs, threes = [], []
        for steps, follow, last in map(unpacked, rows.column("grams").to_pylist()):
            pairs.append(np.cumsum(steps))
            threes.append((np.repeat(pairs[-1], follow) << TOKEN_BITS) + last)
        n = list(zip(*map(unpacked, rows.column("n").to_pylist()), strict=True))
        together = [*sums(pairs, n[:2]), *sums(threes, n[2:])]
        return pa.table([rows.column("bucket"), rows.column("span"), pa.array([packed(*x) for x in zip(*together, strict=True)], pa.binary())], names=["bucket", "span", "n"])

    return counts.groupBy("bucket").applyInArrow(run, "bucket long, span long, n binary")


def own_counts(place: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often the code at each place stands in the document of that place. n: how often it occurs in all documents.

    Document, code and place are sorted as one number where 63 bits hold them."""
    out = np.ones(len(place), np.int64)
    several = np.flatnonzero(n > 1)
    if not len(several):
        return out
    at_bits, code_bits = int(len(place)).bit_length(), int(place.max()).bit_length()
    if at_bits + code_bits + int(doc[-1]).bit_length() > 63:
        _, at, often = np.unique(doc[several] * (1 + int(place.max())) + place[several], return_inverse=True, return_counts=True)
        out[several] = often[at]
        return out
    packed = np.sort((((doc[several] << code_bits) | place[several]) << at_bits) | several)
    keys = packed >> at_bits
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    often = np.diff(first, append=len(keys))
    out[packed & ((1 << at_bits) - 1)] = np.repeat(often, often)
    return out


def token_probabilities(n: np.ndarray, first: np.ndarray, last: np.ndarray, total: np.ndarray, tokens: int) -> np.ndarray:
    """Probability of each token, all orders mixed. n: counts of the n-grams of each order that end at it (see ``token_grams``);
    first, last: places of each text's first code and last, whose count is that of all ends and hence of all starts; total: the
    number of tokens that its model holds."""
    before = np.zeros((2, n.shape[1]), np.int64)
    before[:, 1:] = n[:2, :-1]
    before[:, first] = n[0, last]
    p = np.full(n.shape[1], 1 / tokens)
    out = TOKEN_MIX[0] * p
    for weight, share, of in zip(TOKEN_MIX[1:], n, (total, *before), strict=True):
        p = np.where(of > 0, share / np.maximum(of, 1), p)
        out += weight * p
    return out


def loss_difference(docs: DataFrame, target: DataFrame, tokenizer_path: str = TOKENIZER, span_tokens: int = SPAN) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score. target: the doc_id of the documents to be like."""
    edge = 1 + max(tokenizer(tokenizer_path).get_vocab(with_added_tokens=True).values()) + 1
    if edge >= 1 << 16:
        raise ValueError("the tokenizer's ids do not fit in 16 bits")
    ids = written(target.where("doc_id is not null").select("doc_id").distinct())
    some = possible(docs.select("doc_id", "text"), "doc_id", ids)
    told_apart = some.where("maybe").join(ids.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
    marked = told_apart.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")).union(some.where("not maybe").select("doc_id", "text", F.lit(False)))
    spans = written(encoded_spans(marked, tokenizer_path, span_tokens))
    names = ["n_target", "n_background"]
    totals = [n or 0 for n in spans.agg(*[F.sum(c) for c in names]).first()]
    summed = added_up(token_counts(spans, edge, max(BUCKET_BITS, (totals[1] // BUCKET).bit_length())))
    none = np.zeros(0, np.int64)

    def run(held: pa.Table, known: pa.Table) -> pa.Table:
        let_go()
        row = held.select(["lengths", "ids", "target"]).to_pylist()[0]
        lengths = np.array(row["lengths"])
        told = lengths + (lengths > 0)
        doc = np.repeat(np.arange(len(told)), told)
        mine = np.array(row["target"], bool)[doc]
        ends = np.cumsum(told)
        codes, three = token_grams(unpacked(row["ids"])[0], lengths, edge)
        first, size = first_codes(lengths), codes.shape[1]
        pairs, n_pairs = ranked(listed_pairs(codes, three, first), PAIR_BITS)
        last = three & ((1 << TOKEN_BITS) - 1)
        del codes, three
        places = [pairs[:size], pairs[size : 2 * size]]
        context = np.zeros(size, np.int64)  # places of pairs are in the order of their codes, so these give that of threes
        context[1:] = places[1][:-1]
        context[first] = pairs[2 * size :]
        places.append(ranked((context << TOKEN_BITS) | last, TOKEN_BITS + n_pairs.bit_length())[0])
        del context, last
        parts = [unpacked(x) for x in known.sort_by("bucket").column("n").to_pylist()]
        losses: list[np.ndarray] = [none] * len(totals)
        own = none
        for k in reversed(range(len(totals))):  # the background first: its counts are those of all documents
            of_pairs, of_threes = (np.concatenate([none, *(x[k + at] for x in parts)]) for at in (0, 2))
            n = np.stack([of_pairs[places[0]], of_pairs[places[1]], of_threes[places[2]]])
            if k == len(totals) - 1:
                own = np.stack([own_counts(at, doc, of) for at, of in zip(places, n, strict=True)])
                n -= own
                own *= mine
                whose = 1
            else:
                n -= own
                whose = mine
            p = token_probabilities(n, first, ends[told > 0] - 1, totals[k] - told[doc] * whose, edge)
            sums = np.concatenate([[0.0], np.cumsum(-np.log(p))])
            losses[k] = (sums[ends] - sums[ends - told]) / np.maximum(told, 1)
        columns = [pa.array(x, pa.float64(), mask=lengths == 0) for x in (*losses, losses[0] - losses[1])]
        return pa.table([held.column("doc_ids").combine_chunks().flatten(), pa.array(lengths), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    together = spans.select("span", "doc_ids", "target", "lengths", "ids").groupBy("span").cogroup(summed.groupBy("span"))
    return together.applyInArrow(run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
