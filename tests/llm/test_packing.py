import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from municipia.llm import packing
from municipia.llm.queries import WORD_MODEL

TEXTS = ["Don't STOP  me now, it's 12345 o'clock!", "<|endoftext|>", "a<|startoftext|>b c.", " lead\ttab \n\n line ", "é ́x ΣΣ İ", "", None, "日本語 テキスト です。", "x" * 3000, "word " * 5000, " a\u0085b​c  "]


def test_words_give_the_librarys_ids():
    library, rng = Tokenizer.from_file(WORD_MODEL), random.Random(2)
    letters = "abcXYZ'sté́ßΣ12 .,!?-  \n\t ​日🙂"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for table in (packing.SpacedWords(WORD_MODEL), packing.SpacedWords(WORD_MODEL, words=50, size=500)):
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            ids, counts = table.encode_column(pa.array(some, pa.string()))
            got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == [library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_lower_case_is_the_librarys_within_the_class_that_is_put_so():
    import pyarrow.compute as pc

    cased = pa.array([chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000])
    cased = cased.filter(pc.match_substring_regex(cased, packing.CASED))
    assert len(cased) > 20_000 and pc.utf8_lower(cased).to_pylist() == [c.lower() for c in cased.to_pylist()]
    library = Tokenizer.from_file(WORD_MODEL)
    both = [[library.encode(f"x{c}", add_special_tokens=False).ids for c in column.to_pylist()[:1000]] for column in (cased, pc.utf8_lower(cased))]
    assert both[0] == both[1]


@pytest.mark.parametrize("seed", range(4))
def test_least_squares_meets_the_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    histogram = rng.integers(0, 50, 65)
    histogram[0] = 0
    columns = packing.combinations(histogram)
    assert all(t * a + b == 64 and t + (b > 0) <= packing.DEPTH for t, a, b in columns) and len(set(columns)) == len(columns)
    x = packing.least_squares(columns, histogram, 20_000)
    a = np.zeros((65, len(columns)))
    for i, (t, length, rest) in enumerate(columns):
        a[length, i] += t
        if rest:
            a[rest, i] += 1
    gradient = a.T @ (a @ x - histogram)
    assert (x >= 0).all() and gradient.min() > -0.05 and np.abs(gradient * x).max() < 0.5


def check(rows, docs, window, library):
    """Each id lies in exactly one piece; sequences are gapless and full, or a power of two."""
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, mine in by_doc.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return by_sequence


def test_each_id_lies_in_one_piece_and_nothing_is_padded(spark, awkward, no_docs):
    library, rng = Tokenizer.from_file(WORD_MODEL), random.Random(4)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["one", "two", "Donaudampfschiff", "3"]) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    docs += [(1000 + i, "the same text of nine words that many share") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for window in (2048, 64):
        rows = packing.pack(frame, WORD_MODEL, window=window).collect()
        found = check(rows, docs, window, library)
        whole = {r.doc_id for r in rows if r.length == r.doc_tokens}
        assert window == 2048 or len(whole) > 0.6 * len([d for d, t in docs if len((t or "").split()) < 40])
        held = {r.sequence_id: r for r in packing.sequences(frame, WORD_MODEL, window=window).collect()}
        assert held.keys() == found.keys()
        assert all(len(held[s].ids) == sum(r.length for r in mine) for s, mine in found.items())
    assert packing.pack(no_docs, WORD_MODEL).collect() == []
    rows = packing.pack(awkward, WORD_MODEL).collect()  # null and repeated ids
    totals = {}
    for r in rows:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    want = {}
    for r in awkward.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert totals == want
