"""Street and place names: keys of a street reference, and names found in texts, for all communes at once."""

from __future__ import annotations

import difflib
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from municipia.functions import constants as K
from municipia.functions.text import norm, without_leading_zeros
from municipia.sources.tables import shuffled, written


def _types() -> Column:
    return F.create_map(*[F.lit(x) for pair in K.STREET_TYPES.items() for x in pair])


def canonical_type(words: Column) -> Column:
    """The words with a known street type at their head in its full form."""
    head = F.get(words, F.lit(0))
    return F.concat(F.array(F.coalesce(_types()[head], head)), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))


def name_words(name: Column) -> Column:
    return F.split(without_leading_zeros(norm(name)), " ")


def without_plurals(key: Column) -> Column:
    return F.regexp_replace(key, r"s\b", "")


def aliases(key: Column) -> Column:
    """The key, with years in two digits, and both without plural endings."""
    short = F.regexp_replace(key, r"\b(?:19|20)(\d{2})\b", "$1")
    return F.array_distinct(F.array(key, short, without_plurals(key), without_plurals(short)))


def street_keys(streets: DataFrame) -> DataFrame:
    """commune, key, name, turn from streets (commune, name, length, seen): longest street first, then the first seen; and short
    keys of type and last word where they name one street only and no full key has them. turn orders a commune's keys: full
    ones by the street that first had them, and short ones behind."""
    named = streets.withColumn("words", name_words(F.col("name")))
    full = named.select("commune", "name", "length", "seen", F.posexplode(aliases(F.array_join(canonical_type(F.col("words")), " "))).alias("pos", "key"))
    turn = lambda late, seen, pos: F.struct(F.lit(late).alias("late"), seen.cast("long").alias("seen"), pos.cast("int").alias("pos"))
    best = F.min_by("name", F.struct(-F.col("length"), "seen", "name"))
    full = full.groupBy("commune", "key").agg(best.alias("name"), F.min(turn(0, F.col("seen"), F.col("pos"))).alias("turn"))
    last = F.element_at("words", -1)
    long = named.where((F.size("words") >= 3) & _types()[F.get("words", F.lit(0))].isNotNull() & ~last.rlike(r"^\d+$"))
    short = long.select("commune", "name", "seen", F.concat_ws(" ", _types()[F.get("words", F.lit(0))], last).alias("key"))
    short = short.groupBy("commune", "key").agg(F.countDistinct("name").alias("names"), F.min("name").alias("name"), F.min(turn(1, F.col("seen"), F.lit(0))).alias("turn"))
    return full.unionByName(short.where("names = 1").drop("names").join(full, ["commune", "key"], "left_anti"))


def street_list(streets: DataFrame) -> DataFrame:
    return streets.select("commune", "name").distinct().orderBy("commune", "name")


def place_index(places: DataFrame, local: DataFrame) -> DataFrame:
    """commune, key, name, local, geometry, turn: the names of places in the order in which they are looked for.

    places: commune, name, geometry, seen (their order). local: commune, nom, alias array, osm_nom, geometry, and rank (their
    order) if known. Local names come first, the last of them and its last alias before all others, with the map's geometry
    if it has one; then the map's places. One that has a local place's name counts as local."""
    found = places.select("commune", F.col("name").alias("osm_nom"), F.col("geometry").alias("mapped"), "seen")
    found = found.groupBy("commune", "osm_nom").agg(F.max_by("mapped", "seen").alias("mapped"))
    rank = F.col("rank").cast("long") if "rank" in local.columns else F.lit(0).cast("long")
    names = F.concat(F.array("nom"), F.coalesce("alias", F.array().cast("array<string>")))
    own = local.join(found, ["commune", "osm_nom"], "left").select("commune", F.posexplode(names).alias("pos", "alias"), F.col("nom").alias("name"), F.coalesce("mapped", "geometry").alias("geometry"), rank.alias("rank"))
    key = lambda c: F.array_join(name_words(F.col(c)), " ")
    turn = lambda late, a, b: F.struct(F.lit(late).alias("late"), a.cast("long").alias("a"), b.cast("long").alias("b")).alias("turn")
    mapped = places.where("name is not null").join(local.select("commune", F.col("nom").alias("name"), F.lit(True).alias("known")).distinct(), ["commune", "name"], "left")
    return own.select("commune", key("alias").alias("key"), "name", F.lit(True).alias("local"), "geometry", turn(0, -F.col("rank"), -F.col("pos"))).unionByName(
        mapped.select("commune", key("name").alias("key"), "name", F.coalesce("known", F.lit(False)).alias("local"), "geometry", turn(1, F.col("seen"), F.lit(0)))
    )


def override_places(base: DataFrame, override: DataFrame) -> DataFrame:
    """Rows of the same (commune, nom) replaced, others added."""
    return base.join(override, ["commune", "nom"], "left_anti").unionByName(override)


def usable_references(ways: DataFrame, least: int = 20) -> DataFrame:
    """commune, ways: communes whose import has enough ways to replace the one in use."""
    return ways.groupBy("commune").agg(F.count("*").alias("ways")).where(F.col("ways") >= least)


def is_stale(refreshed: Column, today: Column, days: int = 30) -> Column:
    return F.datediff(today, refreshed) >= days


# --- names in texts ---------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    return F.filter(F.split(without_leading_zeros(norm(text)), " "), lambda w: w != "")


def _candidates(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """commune, doc, pos, n, type, cand: runs of words from each street type on, as long as the commune's longest key."""
    longest = keys.groupBy("commune").agg(F.max(F.size(F.split("key", " "))).alias("longest"))
    at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(*K.STREET_TYPES), i)))  # else each word would carry all words
    starts = texts.join(longest, "commune").select("commune", "doc", "longest", "words", F.explode(at).alias("pos"))
    lengths = F.sequence(F.lit(2), F.least(F.col("longest") + 1, F.size("words") - F.col("pos")))
    spread = starts.where(F.size("words") - F.col("pos") >= 2).select("commune", "doc", "pos", "words", F.explode(lengths).alias("n"))
    cand = without_leading_zeros(F.array_join(canonical_type(F.slice("words", F.col("pos") + 1, F.col("n"))), " "))
    return spread.select("commune", "doc", "pos", "n", cand.alias("cand")).withColumn("type", F.split("cand", " ")[0])


def exact_matches(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """commune, doc, pos, n, name, score: at each street type, the longest run of words that is a key."""
    variants = F.posexplode(F.array("cand", without_plurals(F.col("cand")))).alias("variant", "key")
    met = _candidates(texts, keys).select("commune", "doc", "pos", "n", variants).join(keys, ["commune", "key"])
    best = met.groupBy("commune", "doc", "pos").agg(F.max_by(F.struct("n", "name"), F.struct("n", -F.col("variant"))).alias("best"))
    return best.select("commune", "doc", "pos", "best.n", "best.name", F.lit(1.0).alias("score"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; a is the text's, b the key's."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def _gram_order(keys: DataFrame) -> dict[str, int]:
    """The pairs of neighbouring characters of all keys by how seldom they are; as many as the alphabet squared at most."""
    grams = keys.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - 1, F.lit(1))), lambda i: F.substring("key", i, F.lit(2)))).alias("gram"))
    return {r.gram: i for i, r in enumerate(grams.groupBy("gram").count().orderBy("count", "gram").collect())}


def rare_pairs(text: str, order: dict[str, int], least: float) -> list[int]:
    """Numbers of which any two texts that difflib finds alike by ``least`` (above 2/3) have one in common.

    A ratio of r over t characters in all matches m >= r * t / 2 of them, in t - 2 * m + 1 blocks at most, each of which holds one
    neighbouring pair less than characters: so 3 * m - t - 1 pairs or more are common, counted with their repeats. The two
    rarest common ones then lie in the rarest pairs of either text, as many as it has less that number, plus 2: any two of
    these make a number. Texts too short for two common pairs have one number for all."""
    n, seen, grams = len(text), {}, []
    for i in range(n - 1):
        g = text[i : i + 2]
        seen[g] = seen.get(g, 0) + 1
        grams.append((order.get(g, -1), g, seen[g]))
    shortest = math.ceil(n * least / (2 - least) - 1e-9)
    common = math.ceil((1.5 * least - 1) * (n + shortest) - 1 - 1e-9)
    number = lambda *x: xxhash.xxh64_intdigest(repr(x).encode()) - (1 << 63)
    rarest = sorted(grams)[: max(0, n - 1 - common + 2)]
    return [number(a, b) for a, b in itertools.combinations(rarest, 2)] + ([number("short")] if common < 2 else [])


def _posted(rows: DataFrame, column: str, order: dict[str, int], least: float) -> DataFrame:
    """rows, once for each of the numbers of column."""
    schema = StructType([*rows.schema.fields, StructField("numbers", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([rare_pairs(t, order, least) for t in batch.column(column).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "numbers"])

    return rows.mapInArrow(run, schema).withColumn("number", F.explode("numbers")).drop("numbers")


def fuzzy_candidates(runs: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """commune, cand, n, key: runs (commune, type, cand, n) and keys (commune, type, key, size) that may be alike by ``least``: of
    one type, a word more or less at most, of fit lengths, and with two rare pairs of characters in common."""
    order = _gram_order(keys)
    a = _posted(runs.select("commune", "type", "cand", "n"), "cand", order, least)
    b = _posted(keys.select("commune", "type", "key", "size"), "key", order, least)
    fit = (F.abs(F.col("size") - F.col("n")) <= 1) & (2 * F.least(F.length("cand"), F.length("key")) >= least * (F.length("cand") + F.length("key")))
    return a.join(b, ["commune", "type", "number"]).where(fit).select("commune", "cand", "n", "key").distinct()


def fuzzy_matches(texts: DataFrame, keys: DataFrame, exact: DataFrame, least: float = K.FUZZY_RATIO) -> DataFrame:
    """As exact_matches, where that found nothing: the longest run whose ratio to a key of its type reaches ``least``; of equal
    ratios the commune's first key.

    Distinct runs meet only the keys that may be alike (``fuzzy_candidates``)."""
    open_runs = written(_candidates(texts, keys).join(shuffled(exact), ["commune", "doc", "pos"], "left_anti"))
    runs = written(open_runs.select("commune", "type", "cand", "n").distinct())
    turn = F.col("turn") if "turn" in keys.columns else F.col("key")
    typed = written(keys.select("commune", "key", "name", F.split("key", " ")[0].alias("type"), F.size(F.split("key", " ")).alias("size"), turn.alias("turn")))
    met = fuzzy_candidates(runs, typed, least).withColumn("score", sequence_ratio("cand", "key")).where(F.col("score") >= least).join(typed.select("commune", "key", "name", "turn"), ["commune", "key"])
    best = met.groupBy("commune", "cand", "n").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), "turn", "key")).alias("best"))
    placed = open_runs.join(best, ["commune", "cand", "n"]).groupBy("commune", "doc", "pos").agg(F.max_by(F.struct("n", "best"), "n").alias("x"))
    return placed.select("commune", "doc", "pos", "x.n", F.col("x.best.name").alias("name"), F.col("x.best.score").alias("score"))


def without_overlaps(matches: Column) -> Column:
    """From matches array<struct<start, end, name, score>>, those that start where the last one kept has ended, in order."""
    none = F.filter(matches, lambda m: F.lit(False))
    free = lambda kept, m: (F.size(kept) == 0) | (m["start"] >= F.element_at(kept, -1)["end"])
    return F.aggregate(F.sort_array(matches), none, lambda kept, m: F.when(free(kept, m), F.concat(kept, F.array(m))).otherwise(kept))


def street_matches(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """commune, doc, matches for every text (commune, doc, words): exact first, then fuzzy, without overlaps."""
    keys = written(keys)
    exact = written(exact_matches(texts, keys))
    found = exact.unionByName(fuzzy_matches(texts, keys, exact))
    span = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"), "name", "score")
    lists = found.groupBy("commune", "doc").agg(F.collect_list(span).alias("matches"))
    joined = texts.join(shuffled(lists), ["commune", "doc"], "left")
    none = F.array().cast("array<struct<start:int,end:int,name:string,score:double>>")
    return joined.withColumn("matches", without_overlaps(F.coalesce("matches", none)))


def place_matches(texts: DataFrame, index: DataFrame, least: int = 6) -> DataFrame:
    """commune, doc, name, local, turn: places whose key of ``least`` characters or more stands in the text as whole words, and
    the first turn of such a key; an index without turns is in order of names."""
    turn = F.col("turn") if "turn" in index.columns else F.col("name")
    keys = index.where(F.length("key") >= least).select("commune", "key", "name", "local", F.size(F.split("key", " ")).alias("n"), turn.alias("turn"))
    sizes = keys.groupBy("commune").agg(F.collect_set("n").alias("sizes"))
    runs = texts.join(sizes, "commune").select("commune", "doc", "words", F.explode("sizes").alias("n")).where(F.size("words") >= F.col("n"))
    spread = runs.select("commune", "doc", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))).alias("key"))
    met = spread.join(keys, ["commune", "key"])
    return met.groupBy("commune", "doc", "name").agg(F.max("local").alias("local"), F.min("turn").alias("turn")).select("commune", "doc", "name", "local", "turn")
