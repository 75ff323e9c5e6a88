"""Document quality by Bradley-Terry ranking: preference pairs, a logistic loss on feature differences, a score quantile.

A pair prefers a labelled good document to a labelled bad one; the chance that it does so is the logistic function of the
difference of their worths, and worth is linear in features of the text. Every good training document is paired with every
bad one. The threshold is the quantile of the worths of all training documents at the share of bad ones among them, and the
score puts it at ``CUT``.

Features of every whole text are computed and written once (some two hundred bytes a document). A step of Newton's method
reads the labelled rows once, without listing pairs: what a pair adds depends on the difference of two worths alone and is
smooth in it, so each row is dealt to the ``POINTS`` Chebyshev points of its cell of worths, by its place between them, and
pairs of points, weighed by what they hold, give the sums over all pairs, to about 1e-11 of them. The driver gets sums by
cell, as many as the range of worths asks for and however many rows there are.

Defined results: a null text counts as empty and gets the score of its (zero) features; labels that are null are left out,
a document with several labels is one training row for each; without both kinds of labels every score is 0.5; repeated rows
and null ids are scored row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from municipia.llm.language_id import remainder
from municipia.llm.shared import blocks, written
from municipia.llm.words import hashes, shingles

CUT = 0.3
RIDGE = 1e-3
#: Width of a cell of worths and its points; steps of Newton's method at most.
CELL, POINTS, STEPS = 1.0, 10, 40
NODES = np.cos((2 * np.arange(POINTS) + 1) * np.pi / (2 * POINTS))

#: Kinds of bytes.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\r\v\f", "line": b"\n", "bar": b"|", "symbol": b"#*$%&<>=~^_@\\/{}[]+", "stop": b".", "comma": b",;:", "shout": b"!?"}
FEATURES = ("log_words", "word_bytes", "upper", "digit", "bar", "symbol", "stop", "comma", "shout", "line", "other", "distinct", "twins", "repeats", "short")


def _kinds() -> np.ndarray:
    out = np.full(256, len(KINDS), np.int64)
    for k, members in enumerate(KINDS.values()):
        out[list(members)] = k
    return out


KIND_OF = _kinds()


def features(text: str | None, words: np.ndarray) -> list[float]:
    """FEATURES of a text with these word hashes."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    count = dict(zip((*KINDS, "other"), np.bincount(KIND_OF[raw], minlength=len(KINDS) + 1).tolist(), strict=True))
    n = len(words)
    some = max(n, 1)
    letters = max(count["upper"] + count["lower"], 1)
    triples = max(n - 2, 1)
    inked = max(len(raw) - count["blank"] - count["line"], 1)
    return [
        math.log1p(n),
        min(inked / some, 30.0) if n else 0.0,
        count["upper"] / letters,
        count["digit"] / inked,
        *(min(count[k] / some, 3.0) for k in ("bar", "symbol", "stop", "comma", "shout", "line")),
        count["other"] / inked,
        len(np.unique(words)) / some if n else 0.0,
        float(np.count_nonzero(words[1:] == words[:-1])) / some if n else 0.0,
        1 - len(shingles(words, 3)) / triples if n >= 3 else 0.0,
        1.0 / (1 + n),
    ]


def featured(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns in keep and x array<double>."""
    held = docs.select(*keep, F.col("text").alias("__text"))
    names = [c for c in held.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            column = block.column("__text")
            x = [features(t, h) for t, h in zip(column.to_pylist(), hashes(column), strict=True)]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return held.mapInArrow(run, held.select(*names).schema.add("x", T.ArrayType(T.DoubleType())))


@dataclass(frozen=True)
class Ranking:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float

    def worth(self, x: Column) -> Column:
        total = F.lit(0.0)
        for i, w in enumerate(self.weights):
            z = (F.get(x, i) - self.mean[i]) / self.scale[i]
            total = total + w * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z))
        return total - self.threshold

    def score(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-(self.worth(x) + math.log(CUT / (1 - CUT)))))


def shares(at: np.ndarray) -> np.ndarray:
    """How much each of a cell's POINTS counts for places in -1 to 1: the polynomial through the points, by place."""
    steps = np.arange(POINTS)
    of_points = np.cos(steps * np.arccos(NODES)[:, None]) * np.where(steps, 2, 1) / POINTS
    return np.cos(steps * np.arccos(np.clip(at, -1, 1))[:, None]) @ of_points.T


def cell_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For rows (x, quality) of label 0 and of label 1: worths at the points of all cells that have rows, and the sum there of
    the products of any two of 1 and the features, each row dealt to the points of its cell by ``shares``."""
    width = len(weights) + 1
    left, right = np.triu_indices(width)
    middle = lambda cell: (np.asarray(cell) + 0.5) * CELL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            z = np.clip((batch.column("x").flatten().to_numpy().reshape(-1, len(weights)) - mean) / scale, -4, 4)
            worth, quality = z @ weights, batch.column("quality").to_numpy()
            cell = np.floor(worth / CELL).astype(np.int64)
            order = np.lexsort((cell, quality))
            keys = np.stack([quality[order], cell[order]])
            cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for mine in np.split(order, cuts) if len(order) else []:
                one = np.column_stack([np.ones(len(mine)), z[mine]])
                key = (int(quality[mine[0]]), int(cell[mine[0]]))
                held[key] = held.get(key, 0) + shares((worth[mine] - middle(key[1])) * 2 / CELL).T @ (one[:, left] * one[:, right])
        sums = [v.tobytes() for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int64()), pa.array(sums, pa.binary())], names=["quality", "cell", "sums"])

    def added(parts: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v) for v in parts.column("sums").to_pylist()], axis=0)
        return pa.table([parts.column("quality")[:1], parts.column("cell")[:1], pa.array([total.tobytes()], pa.binary())], names=["quality", "cell", "sums"])

    kind = "quality int, cell long, sums binary"
    found = rows.select("x", "quality").mapInArrow(run, kind).groupBy("quality", "cell").applyInArrow(added, kind).toArrow()
    places, products = [], []
    for label in (0, 1):
        mine = found.filter(pc.equal(found.column("quality"), label)).sort_by("cell")
        places.append((middle(mine.column("cell").to_numpy())[:, None] + NODES * CELL / 2).ravel())
        full = np.zeros((len(places[-1]), width, width))
        full[:, left, right] = np.concatenate([np.frombuffer(v).reshape(POINTS, -1) for v in mine.column("sums").to_pylist()])
        full[:, right, left] = full[:, left, right]
        products.append(full)
    return places, products


def pair_loss(places: list[np.ndarray], products: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs of a good row and a bad one, its descent and its curvature by the weights."""
    (bad_at, good_at), (bad, good) = places, products
    n_bad, x_bad = bad[:, 0, 0], bad[:, 0, 1:]
    loss, slope, bend = 0.0, np.zeros(x_bad.shape[1]), np.zeros((x_bad.shape[1],) * 2)
    for at in range(0, len(good_at), POINTS):  # the points of one cell against all others
        mine = slice(at, at + POINTS)
        n_good, x_good = good[mine, 0, 0], good[mine, 0, 1:]
        gap = good_at[mine, None] - bad_at
        missed = 1 / (1 + np.exp(np.clip(gap, -700, 700)))
        curve = missed * (1 - missed)
        loss += n_good @ np.logaddexp(0, -gap) @ n_bad
        slope += x_good.T @ (missed @ n_bad) - x_bad.T @ (missed.T @ n_good)
        across = x_good.T @ curve @ x_bad
        bend += np.tensordot(curve @ n_bad, good[mine, 1:, 1:], 1) + np.tensordot(curve.T @ n_good, bad[:, 1:, 1:], 1) - across - across.T
    pairs = n_bad.sum() * good[:, 0, 0].sum()
    return loss / pairs, slope / pairs, bend / pairs


def placed(worths: DataFrame, place: int) -> tuple[float, float]:
    """The worth at this place, counted from 1 in ascending order, and the one after it, by counts in ever narrower cells."""
    worth = F.col("worth")
    low, high = worths.agg(F.min(worth), F.max(worth)).first()
    before = 0
    while low < high:
        cell = F.least(F.floor((worth - low) / ((high - low) / 1000)), F.lit(999)).alias("cell")
        cells = worths.where(worth.between(low, high)).groupBy(cell).agg(F.count("*").alias("n"), F.min(worth).alias("low"), F.max(worth).alias("high"))
        for c in sorted(cells.collect(), key=lambda c: c["cell"]):
            if before + c["n"] >= place:
                low, high = c["low"], c["high"]
                break
            before += c["n"]
    upto, after = worths.agg(F.count_if(worth <= low), F.min(F.when(worth > low, worth))).first()
    return low, low if upto > place or after is None else after


def fit(table: DataFrame, labels: DataFrame) -> Ranking | None:
    """table: doc_id, x (written); labels: doc_id, quality. None without both kinds."""
    marked = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = written(table.select("doc_id", "x").join(marked, "doc_id").select("x", "quality"))
    kinds = range(len(FEATURES))
    told = rows.agg(F.count_if(F.expr("quality = 0")), F.count_if(F.expr("quality = 1")), *(of(F.get("x", i)) for of in (F.avg, F.stddev_pop) for i in kinds)).first()
    if not told[0] or not told[1]:
        return None
    mean, scale = np.array(told[2 : 2 + len(kinds)]), np.maximum(told[2 + len(kinds) :], 1e-6)
    weights, step, least = np.zeros(len(kinds)), np.zeros(len(kinds)), math.inf
    for _ in range(STEPS):  # Newton's method; a step that makes the loss larger is halved
        loss, slope, bend = pair_loss(*cell_sums(rows, mean, scale, weights))
        loss += RIDGE / 2 * float(weights @ weights)
        if loss > least + 1e-9:
            step = step / 2
            weights = weights - step
            continue
        least = loss
        step = np.linalg.solve(bend + RIDGE * np.eye(len(weights)), slope - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    ranking = Ranking(mean.tolist(), scale.tolist(), weights.tolist(), 0.0)
    # as many training rows lie below the threshold as are bad
    return replace(ranking, threshold=sum(placed(rows.select(ranking.worth(F.col("x")).alias("worth")), told[0])) / 2)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labels of documents with crc32(doc_id) mod 5 other than 0."""
    table = written(featured(docs, F.col("doc_id"), (remainder(docs, 5) == 0).alias("held_out")))
    ranking = fit(table.where(~F.col("held_out")), labels)
    score = ranking.score(F.col("x")) if ranking else F.lit(0.5)
    return table.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
