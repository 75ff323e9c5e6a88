import math
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from municipia.llm import lm_scoring, shared


def brute(rows, good):
    """(n_tokens, target loss, background loss) of each text by counting, for each text anew, in all others."""
    library = Tokenizer.from_file(lm_scoring.TOKENIZER)
    library_size = max(library.get_vocab().values()) + 2
    texts = [(i, ["^", "^", *library.encode(t, add_special_tokens=False).ids, "^"]) for i, t in rows if t]
    out = {}
    for i, s in texts:
        losses = []
        for others in ([x for j, x in texts if j in good and j != i], [x for j, x in texts if j != i]):
            n, of = Counter(), Counter()
            for x in others:
                for k in range(2, len(x)):
                    for order in (1, 2, 3):
                        n[tuple(x[k - order + 1 : k + 1])] += 1
                        of[tuple(x[k - order + 1 : k])] += order > 1
                    of[()] += 1
            total = 0.0
            for k in range(2, len(s)):
                p = 1 / library_size
                mixed = lm_scoring.TOKEN_MIX[0] * p
                for order in (1, 2, 3):
                    context = tuple(s[k - order + 1 : k])
                    p = n[(*context, s[k])] / of[context] if of[context] else p
                    mixed += lm_scoring.TOKEN_MIX[order] * p
                total -= math.log(mixed)
            losses.append(total / (len(s) - 2))
        out[i] = (len(s) - 3, *losses)
    return out


ROWS = [(1, "мама мыла раму и пела"), (2, "папа ждал маму у реки"), (3, "мама мыла окна"), (4, "日本語 です"), (5, "中国語 です"), (6, "Word word 12 34"), (7, "word Word 56 78"), (8, ""), (9, None), (10, "мама " * 50)]


@pytest.mark.parametrize("span", [lm_scoring.SPAN, 10])
def test_token_losses_against_brute_force(spark, span):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    good = spark.createDataFrame([(1,), (4,), (6,)], "doc_id long")
    want = brute(ROWS, {1, 4, 6})
    got = {r["doc_id"]: r for r in lm_scoring.loss_difference(docs, good, span_tokens=span).collect()}
    assert len(got) == len(ROWS) and got[8]["score"] is None and got[9]["n_tokens"] == 0
    for i, (n, a, b) in want.items():
        assert (got[i]["n_tokens"], got[i]["target_loss"], got[i]["background_loss"]) == (n, pytest.approx(a), pytest.approx(b))


def test_words_count_in_every_script(spark):
    """Texts whose words have the same lengths but are others, in letters outside a-z, in digits and in case: of each kind some
    are named as target, and one of either kind is told."""
    kinds = [("мама мыла раму", "папа ждал реку"), ("12 34", "98 76"), ("Ab cD", "aB Cd")]
    rows = [(100 * k + 10 * side + i, f"{text} {text}") for k, pair in enumerate(kinds) for side, text in enumerate(pair) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(100 * k + i,) for k in range(3) for i in range(3)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.loss_difference(docs, good).collect()}
    assert all(got[100 * k + 3] < got[100 * k + 13] for k in range(3))


def test_the_score_does_not_tell_who_is_in_the_target(spark):
    """Texts of random words, half of them named as target: nothing parts the halves."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(120)], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 120, 2)], "doc_id long")
    scores = {r.doc_id: r.score for r in lm_scoring.loss_difference(docs, good).collect()}
    means = [sum(scores[i] for i in range(k, 120, 2)) / 60 for k in (0, 1)]
    spread = (sum((x - sum(means) / 2) ** 2 for x in scores.values()) / 120) ** 0.5
    assert abs(means[0] - means[1]) < spread


def test_a_text_like_the_target_scores_lower(spark):
    rng = random.Random(2)
    one, two = (["".join(rng.choices(s, k=5)) for _ in range(80)] for s in ("abcde", "vwxyz"))
    docs = spark.createDataFrame([(i, " ".join(rng.choices((one, two)[i % 2], k=50))) for i in range(80)], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    scores = {r.doc_id: r.score for r in lm_scoring.loss_difference(docs, good).collect()}
    assert max(scores[i] for i in range(0, 80, 2)) < min(scores[i] for i in range(1, 80, 2))


def test_tasks_that_count_hold_no_table_of_words(monkeypatch):
    """What a worker keeps for encoding goes before it counts: both together passed the memory of an executor."""

    class Spans:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(shared, "_kept", {})
    shared.kept(list, (1, 2))
    assert list(lm_scoring.token_counts(Spans(), 9, 8)(iter([]))) == [] and not shared._kept


@pytest.mark.parametrize("bits", [4, 32, 62])
def test_places_among_distinct_codes(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 5000):
        codes = rng.integers(0, 1 << bits, n)
        codes[n // 2 :] = codes[: n - n // 2]
        found, place = np.unique(codes, return_inverse=True)
        got, count = lm_scoring.ranked(codes, bits)
        assert got.tolist() == place.tolist() and count == len(found)
