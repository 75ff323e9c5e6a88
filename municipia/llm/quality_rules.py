"""Quality rules as weak supervision: rules vote or abstain, and a posterior replaces all-must-pass filtering.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the counts of vote
patterns (at most 3 to the number of rules, whatever the number of documents) estimates how often each rule votes either
way on good and on bad documents; the posterior probability that a document is good then decides. Everything on rows is a
DataFrame expression; the estimate itself is arithmetic on the pattern counts.

Defined results: a null text has no words, lines or symbols (all counts 0, base_failed true, kept false), as has an empty
one; an empty table yields no rows and the rules' starting accuracies; repeated rows and ids are judged row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from municipia.llm.shared import written

#: The base rules' bounds.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_AT = 0.5

#: Frequent function words of the four languages, as they stand in running text.
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on are be this by from at or "
    "le la les des et une un est que qui dans pour par sur pas "
    "der die das und den von zu mit sich ist nicht ein eine auf für "
    "el los las que en una por con para del se su al"
).split()


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas would otherwise hold its expression, not its result."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^ \t-\r]"))


def _covered(hashes: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more; hashes by position, windows of three words."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, e, j: F.coalesce(F.get(p, j)["h"] == e["h"], F.lit(False))
    twice = let(placed, lambda p: F.sort_array(F.transform(F.filter(p, lambda e, j: same(p, e, j - 1) | same(p, e, j + 1)), lambda e: e["i"])))
    widths = let(twice, lambda at: F.transform(at, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - i, F.lit(3)))))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included."""

    def counted(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))

    return let(words, counted)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """The columns in keep, the counts of COUNTS and those that only the rules read."""
    held = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"), words_of(text).alias("__words"), lines_of(text).alias("__lines"))
    return held.select(
        *[c for c in held.columns if not c.startswith("__")],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").alias("n_lines"),
        F.size(F.filter("__lines", lambda line: line.rlike(r"[.?!][\"')\]]*[ \t-\r]*$"))).alias("n_closed_lines"),
        F.regexp_count("__text", F.lit("[A-Z]")).alias("n_upper"),
        F.regexp_count("__text", F.lit("[a-z]")).alias("n_lower"),
        F.regexp_count("__text", F.lit("[0-9]")).alias("n_digits"),
        F.regexp_count("__text", F.lit("!!")).alias("n_shouts"),
        F.size(F.filter("__words", lambda w: w.isin(FUNCTION_WORDS + [x.capitalize() for x in FUNCTION_WORDS]))).alias("n_function_words"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote, from the columns of counts(); a document without words gets no vote but the first's."""
    n = F.col("n_words")
    share = lambda x: F.col(x) / F.greatest(n, F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    some = n > 0
    return {
        "length": _vote(n >= 100, n < 20),
        "symbols": _vote(some & (share("n_symbols") < 0.05), share("n_symbols") > 0.3),
        "repeats": _vote(some & (share("n_repeat_words") < 0.15), share("n_repeat_words") > 0.4),
        "lines": _vote((F.col("n_lines") >= 3) & (F.col("n_dup_lines") / lines < 0.1), F.col("n_dup_lines") / lines > 0.3),
        "case": _vote(some & (F.col("n_upper") / letters < 0.2), some & (F.col("n_upper") / letters > 0.4)),
        "word_length": _vote(some & mean.between(3, 11), some & ~mean.between(2.5, 13)),
        "closing": _vote(F.col("n_closed_lines") / lines >= 0.7, some & (F.col("n_closed_lines") / lines < 0.2)),
        "function_words": _vote(share("n_function_words") > 0.08, some & (share("n_function_words") < 0.02)),
        "digits": _vote(some & (F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)) < 0.05), F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)) > 0.2),
        "shouting": _vote(some & (share("n_shouts") < 0.02), share("n_shouts") > 0.2),
    }


@dataclass(frozen=True)
class Accuracies:
    """prior: share of good documents. votes[rule][y][v]: probability that the rule votes v (-1, 0, 1) if y (0 bad, 1 good)."""

    prior: float
    votes: dict[str, tuple[dict[int, float], dict[int, float]]]

    def weight(self, rule: str, vote: int) -> float:
        """Log-likelihood ratio of a vote. An abstention says nothing, and no vote counts against its own meaning."""
        if vote == 0:
            return 0.0
        bad, good = self.votes[rule]
        ratio = math.log(good[vote] / bad[vote])
        return max(ratio, 0.0) if vote > 0 else min(ratio, 0.0)

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in self.votes:
            v = F.col(f"vote_{rule}")
            odds = odds + F.when(v == 1, self.weight(rule, 1)).when(v == -1, self.weight(rule, -1)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def starting(names: list[str]) -> Accuracies:
    """Rules see one fault each: a bad document passes most of them, but a good one seldom gets a bad vote."""
    return Accuracies(0.9, {r: ({-1: 0.2, 0: 0.25, 1: 0.55}, {-1: 0.01, 0: 0.29, 1: 0.7}) for r in names})


def estimate(patterns: list[tuple[dict[str, int], int]], names: list[str], rounds: int = 50, smoothing: float = 1.0) -> Accuracies:
    """Expectation-maximisation over (votes by rule, number of documents)."""
    model = starting(names)
    if not patterns:
        return model
    for _ in range(rounds):
        mass = [smoothing, smoothing]
        tables = {r: ({v: smoothing for v in (-1, 0, 1)}, {v: smoothing for v in (-1, 0, 1)}) for r in names}
        for votes, n in patterns:
            odds = math.log(model.prior / (1 - model.prior)) + sum(model.weight(r, votes[r]) for r in names)
            good = n / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            mass[0] += n - good
            mass[1] += good
            for r in names:
                tables[r][0][votes[r]] += n - good
                tables[r][1][votes[r]] += good
        held = min(0.99, max(0.01, mass[1] / sum(mass)))
        model = Accuracies(held, {r: tuple({v: x / sum(t.values()) for v, x in t.items()} for t in tables[r]) for r in names})
    return model


def voted(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """counts() with a column vote_<rule> for each rule and base_failed."""
    found = counts(docs, keep, text)
    return found.withColumns({f"vote_{r}": v for r, v in rules().items()} | {"base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))})


def fitted(votes: DataFrame) -> Accuracies:
    """The accuracies from all rows of voted(); the driver gets one row for each pattern of votes."""
    names = list(rules())
    patterns = votes.groupBy([f"vote_{r}" for r in names]).count().collect()
    return estimate([({r: p[f"vote_{r}"] for r in names}, p["count"]) for p in patterns], names)


def judged(votes: DataFrame) -> DataFrame:
    """votes with quality (posterior) and kept; votes should be a written table, as it is read twice."""
    quality = fitted(votes).posterior()
    return votes.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality and the votes, of every whole text."""
    found = written(voted(docs, [F.col("doc_id")], F.col("text")))
    return judged(found).select("doc_id", *COUNTS, "base_failed", "kept", "quality", *[f"vote_{r}" for r in rules()])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns, whatever those are named."""
    found = written(voted(docs, [F.struct("*").alias("doc")], F.col("text")))
    return judged(found).where("kept").select("doc.*")
