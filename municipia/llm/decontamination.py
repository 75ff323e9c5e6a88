"""Benchmark decontamination through a distributed positional inverted index, in DataFrame operations only.

The index stores a posting (document row, position, term) for every word of the training documents that some benchmark item
has, as a Parquet table. A search never asks for all lists of a phrase at once. It takes the two rarest terms of each window,
by their frequency in the whole index, moves each list by the term's place in the item, and intersects the two on
(document, item, diagonal), a diagonal being document position minus item position. What is left is compared word by word
with the item around those places; runs of equal words as long as a window are exact phrases. ``near_matches`` takes the same
rarest terms in any order within a given span.

Small tables are broadcast only where Spark finds them under its own threshold (they are written, so their size is known);
beyond it the same joins shuffle.

Defined results: a null or empty text has no words, hits or items and is not contaminated; rows of one doc_id are judged row
by row; an item without words has no window; a null item_id marks words but is not counted as an item; a window that several
items share counts for each; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from municipia.llm.shared import written

#: Words in a window, and the share of hit words (1 / 20) from which a document counts as contaminated.
WINDOW, SHARE = 13, 20
#: Everything in ASCII but digits and letters parts words.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), PARTS), "")


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, string.ascii_uppercase, string.ascii_lowercase)).otherwise(word)


def item_terms(items: DataFrame) -> DataFrame:
    """item (row number), item_id, length, place (from 0), term: every word of every item."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", split_words(F.col("text")).alias("words"))
    return rows.select("item", "item_id", F.size("words").alias("length"), F.posexplode("words").alias("place", "word")).select("item", "item_id", "length", "place", lower_ascii(F.col("word")).alias("term"))


def positional_index(docs: DataFrame, terms: DataFrame, *keep: Column) -> DataFrame:
    """row, keep, n_words, pos, tid: the postings of the terms (tid, term), written; pos 0 with tid 0 heads each row's."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), *keep, split_words(F.col("text")).alias("words"))
    held = [c for c in words.columns if c != "words"]
    placed = words.select(*held, F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    known = terms.select("tid", "term")
    return written(placed.withColumn("term", lower_ascii(F.col("word"))).join(known, "term").select(*held, "n_words", "pos", "tid"))


def vocabulary(items: DataFrame) -> DataFrame:
    """tid, term of the distinct terms of item_terms(), and tid 0 for the head of a row."""
    distinct = items.select("term").distinct()
    head = items.sparkSession.range(1).select(F.col("id").alias("tid"), F.lit("").alias("term"))
    return written(distinct.select((F.monotonically_increasing_id() + 1).alias("tid"), "term").union(head))


def rarest_pairs(items: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, a, b: the places of the two rarest terms of each window (b = a if a window has one word); items have tid."""
    often = index.where("tid > 0").groupBy("tid").agg(F.count("*").alias("often"))
    counted = written(items.join(often, "tid", "left").select("item", "length", "place", F.coalesce("often", F.lit(0)).alias("often")))
    first = F.explode(F.sequence(F.greatest(F.col("place") - window + 1, F.lit(0)), F.least(F.col("place"), F.greatest(F.col("length") - window, F.lit(0))))).alias("first")
    rank = F.row_number().over(Window.partitionBy("item", "first").orderBy("often", "place"))
    ranked = counted.select("item", "place", "often", first).withColumn("rank", rank).where("rank <= 2")
    pairs = ranked.groupBy("item", "first").agg(F.min(F.when(F.col("rank") == 1, F.col("place"))).alias("a"), F.min(F.when(F.col("rank") == 2, F.col("place"))).alias("b"))
    return pairs.select("item", "a", F.coalesce("b", "a").alias("b")).distinct()


def _lists(index: DataFrame, items: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """row, item, a, b, pos: the postings of the term at place a, or b, of each pair."""
    wanted = written(pairs.join(items.select("item", F.col("place").alias(side), "tid"), ["item", side]).select("tid", "item", "a", "b"))
    return index.select("row", "pos", "tid").join(wanted, "tid").select("row", "item", "a", "b", "pos")


def phrase_words(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, item, item_id, diagonal, place: the item words inside exact occurrences of windows. items: item_terms with tid."""
    pairs = written(rarest_pairs(items, index, window))
    on = ["row", "item", "a", "b", "diagonal"]
    left = _lists(index, items, pairs, "a").withColumn("diagonal", F.col("pos") - F.col("a")).select(on)
    right = _lists(index, items, pairs, "b").withColumn("diagonal", F.col("pos") - F.col("b")).select(on)
    both = written(left.join(right, on).distinct())

    around = F.explode(F.sequence(F.greatest(F.col("a") - window + 1, F.lit(0)), F.col("a") + window - 1))
    asked = both.select("row", "item", "diagonal", around.alias("place")).distinct()
    asked = asked.join(items.select("item", "item_id", "length", "place", "tid"), ["item", "place"]).withColumn("pos", F.col("diagonal") + F.col("place"))
    rows = written(both.select("row").distinct())
    held = index.select("row", "pos", "tid").join(rows, "row", "left_semi")
    equal = asked.join(held, ["row", "pos", "tid"])

    line = ["row", "item", "diagonal"]
    run = F.col("place") - F.row_number().over(Window.partitionBy(*line).orderBy("place"))
    size = F.count("*").over(Window.partitionBy(*line, "run"))
    return equal.withColumn("run", run).withColumn("size", size).where(F.col("size") >= F.least(F.col("length"), F.lit(window))).select(*line, "item_id", "place", "run")


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, item, item_id, place, pos, words: the longest exact phrases of a window or more."""
    found = phrase_words(index, items, window)
    return found.groupBy("row", "item", "diagonal", "run").agg(F.first("item_id").alias("item_id"), F.min("place").alias("place"), F.count("*").alias("words")).select("row", "item", "item_id", "place", (F.col("diagonal") + F.col("place")).alias("pos"), "words")


def near_matches(index: DataFrame, items: DataFrame, span: int = 2 * WINDOW, window: int = WINDOW) -> DataFrame:
    """row, item, a, b, pos_a, pos_b: the two rarest terms of a window at most span - 1 words apart, in either order.

    Positions are dealt to cells of span words, and each is compared with its own cell and the two beside it."""
    pairs = written(rarest_pairs(items, index, window))
    cell = F.floor(F.col("pos") / span)
    left = _lists(index, items, pairs, "a").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).withColumnRenamed("pos", "pos_a")
    right = _lists(index, items, pairs, "b").withColumn("cell", cell).withColumnRenamed("pos", "pos_b")
    met = left.join(right, ["row", "item", "a", "b", "cell"])
    return met.where(F.abs(F.col("pos_a") - F.col("pos_b")) < span).select("row", "item", "a", "b", "pos_a", "pos_b")


def searched(docs: DataFrame, benchmark: DataFrame, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """(index, items with tid) of these tables."""
    items = written(item_terms(benchmark))
    terms = vocabulary(items)
    return positional_index(docs, terms, *keep), written(items.join(terms, "term").drop("term"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs."""
    index, items = searched(docs, benchmark, F.col("doc_id"))
    heads = index.where("pos = 0").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    found = phrase_words(index, items, window).select("row", (F.col("diagonal") + F.col("place")).alias("pos"), "item_id")
    found = written(found.distinct())
    hit = found.groupBy("row").agg(F.countDistinct("pos").alias("n_hit"))
    named = found.where("item_id is not null").groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    judged = heads.join(hit.join(named, "row", "left"), "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return judged.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; docs are written once with their row numbers."""
    held = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("doc_id"), "text"))
    bad = contamination(held.select("doc_id", "text"), benchmark).where("contaminated").select("doc_id")
    return held.join(written(bad), "doc_id", "left_anti").select("doc.*")
