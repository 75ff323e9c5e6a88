"""Tables that grow are joined by shuffles: what their files or their rows before an explode weigh tells little."""

import random
import re

from pyspark.sql import functions as F

from municipia.functions import classify
from municipia.functions import constants as K
from municipia.operators import geocode, locations, streets
from municipia.plans import extraction, queries, rendered

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_addresses_and_streets_are_not_broadcast(spark):
    """an address table that comes from an explode looks small; at 1 GB it filled the driver."""
    towns = spark.range(3).select(F.concat(F.lit("c"), F.col("id")).alias("commune"))
    addresses = towns.select("commune", F.lit("Rue H").alias("street"), F.explode(F.sequence(F.lit(1), F.lit(9), F.lit(2))).alias("number")).withColumns({"x": F.col("number") * 10.0, "y": F.lit(0.0)})
    wanted = towns.select("commune", F.lit("Rue H").alias("street"), F.lit(11).alias("num"))
    found = geocode.address_points(wanted, addresses)
    assert "Broadcast" not in plan(found)
    assert {r.found for r in found.collect()} == {9}
    parts = F.array(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(9.0).alias("x"), F.lit(9.0).alias("y"))))
    streets = towns.select("commune", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name")).withColumn("parts", parts)
    assert "Broadcast" not in plan(geocode.crossings(towns.select("commune", F.lit("a").alias("a"), F.lit("b").alias("b")), streets))


def test_streets_of_many_suppliers_cross(spark, tmp_path):
    """from the hundredth supplier on the streets ended before they met."""
    spark.range(260).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    rows = {(r.a, r.b): (r.x, r.y) for r in queries.crossings(spark, str(tmp_path)).collect()}
    assert rows == {(str(k), str(k + 1)): ((k + 1) * 10.0, k * 10.0) for k in range(0, 260, 2)}


def test_orders_are_spread_by_count(spark):
    """a small file was one task, whatever its texts cost to read."""
    assert rendered.base(spark, SF).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_acts_are_not_broadcast(spark, tmp_path):
    """where acts were located looked small, when pruned to a column or two, and went whole through the driver."""
    def held(name: str, ddl: str):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / name))
        return spark.read.schema(ddl).parquet(str(tmp_path / name))

    read = held("read", "commune string, id long, numero string, objet string, categorie string, impacts array<string>, particulier boolean, entreprise string, mesures_texte string, articles int, calendrier struct<debut:date,fin:date>")
    where = held("where", f"commune string, id long, localisations array<{locations.LOCATION}>, deviation array<string>, fault string, lieu_texte string")
    drawn = held("drawn", "commune string, id long, geojson string, qualite_geo string, centre array<double>, geocodage_incomplet boolean, fault string")
    shown = extraction.published(read, where, drawn).select("id", "deviation", "qualite_geo")
    assert "SortMergeJoin" in plan(shown) and "Broadcast" not in plan(shown)


def test_runs_of_words_meet_the_index_before_they_are_gathered(spark):
    """F5, F8: every run of words of every text was shuffled, before the few that name a place were chosen."""
    texts = spark.createDataFrame([("c", 1, ["au", "parc", "vert", "parc", "vert"])], "commune string, doc long, words array<string>")
    index = spark.createDataFrame([("c", "parc vert", "Parc Vert", False)], "commune string, key string, name string, local boolean")
    found = streets.place_matches(texts, index)
    assert [(r.doc, r.name) for r in found.collect()] == [(1, "Parc Vert")]
    aggregated = found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert aggregated == 2  # the communes' sizes, and what was found


def test_patterns_by_first_letter_match_the_same():
    """the words of a pattern were all tried at each letter of a text."""
    rng = random.Random(7)
    for pattern, _ in K.CATEGORY_PATTERNS.values():
        words = [w.replace(r"\b", "").replace("?", "").replace("[ -]", "-") for w in pattern.split("|")]
        parted = classify.by_first_letter(pattern)
        for _ in range(300):
            text = "".join(rng.choice([*words, " ", "a", "e ", w[:-1], "b", " gaz"]) for w in rng.choices(words, k=9))
            assert [m.span() for m in re.finditer(parted, text)] == [m.span() for m in re.finditer(pattern, text)]


def test_constructs_are_tried_where_they_may_begin():
    """every construct was tried at every word."""
    words = "du 3 au 9 rue a angle de rue a et rue b 12 bis rue b rue a entre rue b et rue c".split()
    matches = [{"name": words[i + 1].upper(), "start": i, "end": i + 2} for i, w in enumerate(words) if w == "rue"]
    tried = []
    reader = locations.Reader(words, matches)
    for construct, begins, _ in locations.CONSTRUCTS:
        def counted(i, of=construct):
            tried.append(i)
            return of(reader, i)

        whole, i = [], 0
        while i < len(reader.items):
            what, end = construct(reader, i) or (None, i + 1)
            whole += [(i, end, what)] if what is not None else []
            i = end
        assert list(reader.spans(counted, begins)) == whole
    assert len(tried) < 2 * len(reader.items)
