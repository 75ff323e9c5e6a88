import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from municipia.llm import language_id, lm_scoring, quality_ranking, quality_rules

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def sentences(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(1)
    en = [w + end for w in ("the", "thing", "water", "house", "and", "with") for end in ("", "s", "er", "ing", "ly", "ness", "ful", "able", "ed", "ish")]
    fr = [w + end for w in ("le", "maison", "été", "chose", "et", "leur") for end in ("", "s", "ment", "eur", "tion", "age", "ette", "eux", "ique", "ée")]
    rows = [(i, t, "en", None, 1) for i, t in enumerate(sentences(rng, en, 60))] + [(100 + i, t, "fr", None, 1) for i, t in enumerate(sentences(rng, fr, 60))]
    bad = [(200 + i, "\n".join("BUY!! *** $$$ NOW!! |||" for _ in range(20)), "en", None, 1) for i in range(40)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int")
    return docs, labels


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(VOCABULARY)
    place = {s: i for i, s in enumerate(pieces.strings)}
    p = np.random.default_rng(0).random((len(pieces.strings) + 1, 2))

    def brute(w, k):
        if not w:
            return 1.0
        return sum((p[place[w[:n]], k] if w[:n] in place else p[-1, k] if n == 1 else 0) * brute(w[n:], k) for n in range(1, len(w) + 1))

    words = ["the", "été", "a", "жx", "maison"]
    got = language_id.forward(pieces, p, words)
    for i, w in enumerate(words):
        for k in (0, 1):
            assert got[i, k] == pytest.approx(math.log(brute(language_id.MARK + w, k)))
    uses = language_id.expected(pieces, p[:, 0], words, np.ones(len(words)))
    assert uses.sum() >= len(words)


def test_language_held_out(marked):
    got = language_id.language_report(marked[0], VOCABULARY)
    rows = got.join(marked[0].select("doc_id", "lang", "text"), "doc_id").where("doc_id < 200").collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows} == {True, False}


def test_language_of_awkward_rows(awkward, no_docs):
    rows = language_id.language_report(awkward, VOCABULARY).collect()
    assert len(rows) == awkward.count()
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert told[100] == told[101] == told[102] == ("und", 0.0) and told[107][0] != "und"
    kept = language_id.keep_identified(awkward, VOCABULARY)
    assert kept.columns == awkward.columns and {100, 101, 102}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language_id.language_report(no_docs, VOCABULARY).count() == 0


def test_nothing_to_learn_a_language_from(awkward):
    rows = language_id.language_report(awkward.withColumn("lang", F.lit(None).cast("string")), VOCABULARY).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_quality_ranking_held_out(marked):
    docs, labels = marked
    got = {r["doc_id"]: r for r in quality_ranking.quality_scores(docs, labels).collect()}
    assert all(got[i]["predicted"] == (i < 200) and 0 <= got[i]["score"] <= 1 for i in got if got[i]["held_out"])
    assert sum(r["held_out"] for r in got.values()) > 10


def test_quality_of_awkward_rows(awkward, no_docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_ranking.quality_scores(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    one = quality_ranking.quality_scores(awkward, labels.where("quality = 1")).collect()
    assert {(r["score"], r["predicted"]) for r in one} == {(0.5, 1)}
    assert quality_ranking.quality_scores(no_docs, labels).count() == 0


def test_every_labelled_row_and_every_pair_counts(spark):
    """The weights are the least of the loss over all pairs of all labelled rows, the threshold a quantile of all worths."""
    rng = np.random.default_rng(4)
    good = rng.random(700) < 0.7
    x = rng.normal(size=(700, len(quality_ranking.FEATURES))) + 0.4 * good[:, None] * rng.random(len(quality_ranking.FEATURES))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    ranking = quality_ranking.fit(table, labels)
    assert ranking.mean == pytest.approx(x.mean(axis=0).tolist()) and ranking.scale == pytest.approx(x.std(axis=0).tolist())
    z, w = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -4, 4), np.array(ranking.weights)
    d = (z[good][:, None] - z[~good]).reshape(-1, z.shape[1])
    slope = d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - quality_ranking.RIDGE * w
    assert np.abs(slope).max() < 1e-7
    worths = np.sort(z @ w)
    bad = int((~good).sum())
    assert ranking.threshold == pytest.approx((worths[bad - 1] + worths[bad]) / 2)


def test_threshold_among_rows_of_one_worth(spark):
    for values in ([1.0] * 9, [0.0, 1.0, 1.0, 1.0, 2.0], [0.1, 0.1 + 1e-16, 0.1 + 2e-16, 1e9], [3.0, -7.0, 5.0]):
        worths = spark.createDataFrame([(v,) for v in values], "worth double")
        for place in range(1, len(values)):
            assert quality_ranking.placed(worths, place) == tuple(sorted(values)[place - 1 : place + 1])


def test_lm_models_are_probabilities_and_prefer_the_target(marked, awkward, no_docs):
    docs, labels = marked
    got = {r["doc_id"]: r["score"] for r in lm_scoring.loss_difference(docs, labels.where("quality = 1")).collect()}
    assert max(s for i, s in got.items() if i < 200) < min(s for i, s in got.items() if i >= 200)
    rows = lm_scoring.loss_difference(awkward, labels).collect()
    assert len(rows) == awkward.count() and [r["score"] for r in rows if r["doc_id"] in (100, 101)] == [None, None]
    assert lm_scoring.loss_difference(no_docs, labels).count() == 0


def counted(t):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    t = t or ""
    w, seen, dup = word.findall(t), set(), 0
    for line in t.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_rule_counts_against_brute_force(awkward, no_docs):
    rows = quality_rules.quality_report(awkward).collect()
    texts = Counter((r["doc_id"], counted(r["text"])) for r in awkward.collect())
    assert Counter((r["doc_id"], tuple(r[c] for c in quality_rules.COUNTS)) for r in rows) == texts
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_report(no_docs).count() == 0


def test_rules_keep_good_and_drop_bad(marked):
    kept = {r["doc_id"] for r in quality_rules.keep_good(marked[0]).collect()}
    assert kept == set(range(60)) | set(range(100, 160))


def test_accuracies_are_found_again():
    rng = random.Random(0)
    names = ["a", "b", "c", "d"]
    patterns = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        patterns[tuple((1 if good else -1) * (1 if rng.random() < 0.9 else -1) if rng.random() < 0.7 else 0 for _ in names)] += 1
    model = quality_rules.estimate([(dict(zip(names, v, strict=True)), n) for v, n in patterns.items()], names)
    assert model.prior == pytest.approx(0.8, abs=0.05)
    bad, good = model.votes["a"]
    assert good[1] == pytest.approx(0.63, abs=0.05) and bad[-1] == pytest.approx(0.63, abs=0.08)


def test_numerals_are_no_letters(marked):
    docs = marked[0].sparkSession.createDataFrame([(7, "½ ² ③ Ⅷ 12 _", None), (8, "ª", None)], "doc_id long, text string, lang string")
    got = language_id.language_report(marked[0].select("doc_id", "text", "lang").unionByName(docs), VOCABULARY).where("lang_pred = 'und'")
    assert [tuple(r)[2:] for r in got.where("doc_id = 7").collect()] == [("und", 0.0)]
    assert got.where("doc_id = 8").count() == 0
    assert language_id.marked_parts("a½b²c Ⅷx 中") == ["a", "b", "c", "x", "中"]


def test_predictions_are_those_of_all_segmentations(spark):
    """Predictions of the whole operator against a sum over every segmentation, language by language."""
    rng = random.Random(11)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "tion", "oi"]}
    text = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(6))
    docs = spark.createDataFrame([(i, text(lang), lang, lang) for i in range(60) for lang in [rng.choice(list(syllables))]], "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs.where(language_id.remainder(docs, 3) != 1), VOCABULARY)
    strings = {s: i for i, s in enumerate(language_id.pieces_of(VOCABULARY).strings)}

    def total(word, k):
        if not word:
            return 1.0
        cuts = range(1, len(word) + 1)
        return sum(model.p[strings.get(word[:n], -1), k] * total(word[n:], k) for n in cuts if n == 1 or word[:n] in strings)

    for r, d in zip(language_id.language_report(docs, VOCABULARY).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        logs = np.array([sum(math.log(total(language_id.MARK + w, k)) for w in d.text.split()) for k in range(3)])
        odds = np.exp(logs - logs.max())
        assert r.lang_pred == model.langs[int(logs.argmax())] and r.score == pytest.approx(1 / odds.sum())
        assert not r.held_out or r.lang_pred == d.lang


def test_more_languages_than_any_cap(spark):
    langs = [f"l{i:04d}" for i in range(600)]
    docs = spark.createDataFrame([(i, f"{chr(0x4e00 + i)} {chr(0x4e00 + i)}{chr(0x5e00 + i)}", lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, VOCABULARY, sample_docs=5)
    assert model.langs == langs
    scores = language_id.WordScores(model, size=70)
    assert scores.size == 70 and scores.score([["a"] * 1000, []]).shape == (2, 600)


def test_sample_takes_rows_of_one_id_apart(spark):
    docs = spark.createDataFrame([(None, f"wort{i}", "de") for i in range(2000)], "doc_id long, text string, lang string").selectExpr("doc_id", "translate(text, '0123456789', 'abcdefghij') AS text", "lang")
    seen = {}
    fit_counts = language_id.fit_counts
    try:
        language_id.fit_counts = lambda counts, vocabulary: seen.update(counts)
        language_id.fit(docs, VOCABULARY, sample_docs=200)
        assert 120 < len(seen["de"]) < 280
        language_id.fit(docs, VOCABULARY, sample_bytes=700)
        assert 40 < len(seen["de"]) < 160
    finally:
        language_id.fit_counts = fit_counts
