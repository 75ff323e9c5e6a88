"""Registered queries of the map reference whose lengths and areas SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from municipia.operators import geocode, locations
from municipia.plans import extraction
from municipia.plans.queries import STREETS, query, today
from municipia.plans.rendered import BASE, base, keys, table
from municipia.plans.rendered import streets as streets_of


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


@query("""WITH d AS (SELECT DISTINCT o_custkey AS c, o_orderdate::DATE - DATE '1995-01-01' AS d FROM orders), f AS (SELECT *, d - lag(d) OVER (PARTITION BY c ORDER BY d) = 1 AS follows FROM d)
  SELECT c::VARCHAR AS name, count(*)::DOUBLE AS length, count(*) FILTER (follows IS NOT TRUE)::INT AS parts FROM f GROUP BY c""")
def merged_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's day as a way of its customer's street, a metre long; ways of days that follow each other are one part."""
    o = table(spark, sf_dir, "orders")
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    ends = F.array(_point(d, F.lit(0)), _point(d + 1, F.lit(0)))
    coords = F.when(d % 2 == 0, ends).otherwise(F.reverse(ends))  # ways run either way
    ways = o.select((F.col("o_custkey") % 25).cast("string").alias("commune"), F.col("o_custkey").cast("string").alias("name"), coords.alias("coords")).distinct()
    return geocode.merged_streets(ways).select("name", "length", F.size("parts").alias("parts"))


@query(f"""WITH {BASE}, b AS (SELECT k, k % 1100 - 50 AS y FROM base) SELECT k, round(CASE WHEN y < -30 OR y > 1030 THEN 1400 WHEN y < 0 THEN 1000 + 2 * sqrt(900 - y * y) WHEN y > 1000 THEN 1000 + 2 * sqrt(900 - (y - 1000) * (y - 1000)) ELSE 1060 END::DOUBLE, 2) AS metres,
  1::INT AS parts FROM b""")
def clipped_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight street for each order across its commune's square boundary, given as four sides: what lies in it or within 30
    metres; the whole street where that is nothing."""
    corners = [(0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)]
    sides = F.array(*[F.array(_point(F.lit(a), F.lit(b)), _point(F.lit(c), F.lit(d))) for (a, b), (c, d) in zip(corners[:-1], corners[1:])])
    members = table(spark, sf_dir, "nation").select(F.col("n_name").alias("commune"), F.explode(sides).alias("coords"), F.lit("outer").alias("role"))
    y = F.col("k") % 1100 - 50
    streets = base(spark, sf_dir).select("commune", F.col("k").cast("string").alias("name"), F.array(F.array(_point(F.lit(-200), y), _point(F.lit(500), y), _point(F.lit(1200), y))).alias("parts"))
    kept = geocode.clipped(streets, geocode.boundary_rings(members))
    metres = F.aggregate(F.transform("parts", geocode.line_length), F.lit(0.0), lambda t, x: t + x)
    return kept.select(F.col("name").cast("long").alias("k"), F.round(metres, 2).alias("metres"), F.size("parts").alias("parts"))


# --- addresses through a cache -----------------------------------------------------------------------------------------


def _looked_up(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The orders' house numbers. By the number's rest mod 8: 1 is in the cache, 2 is cached as missing; of the others 3 has a
    candidate to be trusted beside one that isn't, 4 only one that isn't, 5 fails, and the rest have none."""
    wanted = base(spark, sf_dir).select("commune", "street", F.col("house").alias("num"))
    streets, n = wanted.select("commune", "street").distinct(), F.col("number")
    numbers = streets.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(103))))
    none = F.lit(None).cast("double")
    cache = numbers.where(n % 8 == 1).select("commune", "street", "number", (n * 10.0).alias("x"), F.lit(0.0).alias("y")).union(numbers.where(n % 8 == 2).select("commune", "street", "number", none, none))

    def answer(keys: DataFrame) -> DataFrame:
        row = lambda rest, street, score, house, failed: keys.where(rest).select("commune", "street", "number", street.alias("found_street"), F.lit(score).cast("double").alias("score"), house.cast("string").alias("housenumber"), (n * 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(failed).alias("failed"))
        own, nothing = F.col("street"), F.lit(None).cast("string")
        return row(n % 8 == 3, own, 0.9, n, False).union(row(n % 8 == 3, F.lit("Quai du Port"), 0.95, n, False)).union(row(n % 8 == 4, own, 0.4, n, False)).union(row(n % 8 == 5, nothing, None, nothing, True)).union(row((n % 8).isin(0, 6, 7), nothing, None, nothing, False))

    return geocode.look_up(wanted, cache, answer)


_TRIED = f"""WITH {BASE}, w AS (SELECT DISTINCT commune, street, house AS num FROM base), t AS (SELECT *, num + step AS number FROM (SELECT *, unnest([0, -2, 2, -4, 4, -6, 6]) AS step, unnest(range(7)) AS rank FROM w) WHERE num + step > 0),
  s AS (SELECT *, number % 8 IN (1, 3) AS hit, number % 8 = 5 AS lost FROM t), f AS (SELECT commune, street, num, min(rank) FILTER (hit) AS first FROM s GROUP BY ALL),
  c AS (SELECT s.* FROM s JOIN f USING (commune, street, num) WHERE first IS NULL OR rank <= first)"""


@query(f"{_TRIED} SELECT commune, street, num, max(number) FILTER (hit)::INT AS found, bool_or(lost) AS pending FROM c GROUP BY ALL")
def cached_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address that stands for each house number of an order, and whether its search came by one that failed."""
    wanted = base(spark, sf_dir).select("commune", "street", F.col("house").alias("num")).distinct()
    addresses, pending, _ = _looked_up(spark, sf_dir)
    found = geocode.address_points(wanted, addresses).select("commune", "street", "num", "found")
    late = pending.withColumn("late", F.lit(True))
    return wanted.join(found, ["commune", "street", "num"], "left").join(late, ["commune", "street", "num"], "left").select("commune", "street", "num", "found", F.coalesce("late", F.lit(False)).alias("pending"))


@query(f"{_TRIED} SELECT DISTINCT commune, street, number, CASE WHEN hit THEN number * 10 END::DOUBLE AS x FROM c WHERE NOT lost AND number % 8 NOT IN (1, 2)")
def cache_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses and new misses; failures are not kept."""
    return _looked_up(spark, sf_dir)[2].select("commune", "street", "number", "x")


# --- wordings of places -------------------------------------------------------------------------------------------------


@query(f"""WITH {STREETS}, s AS (SELECT commune, name AS a, seen, lead(name) OVER w AS b, lead(name, 2) OVER w AS c FROM streets WINDOW w AS (PARTITION BY commune ORDER BY seen))
  SELECT commune, seen, CASE seen % 3 WHEN 0 THEN a || ', entre ' || b || ' et ' || c WHEN 1 THEN 'de 12 ' || a || ' à 40 ' || b ELSE a END AS said FROM s WHERE c IS NOT NULL""")
def relocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free wording for each street and its next two: a stretch between two cross streets, one between two addresses of
    different streets, or a street without more; read and worded again."""
    order = Window.partitionBy("commune").orderBy("seen")
    s = streets_of(spark, sf_dir).select("commune", F.col("name").alias("a"), "seen", F.lead("name").over(order).alias("b"), F.lead("name", 2).over(order).alias("c")).where("c is not null")
    way = F.col("seen") % 3
    text = F.when(way == 0, F.concat(F.lit("Travaux "), "a", F.lit(", entre "), "b", F.lit(" et "), "c")).when(way == 1, F.concat(F.lit("Travaux du 12 "), "a", F.lit(" jusqu'au 40 "), "b")).otherwise(F.concat(F.lit("Travaux "), "a"))
    found = locations.relocate(s.select("commune", F.col("seen").alias("doc"), text.alias("text")), keys(spark, sf_dir))
    return found.select("commune", F.col("doc").alias("seen"), locations.location_text(F.col("locations")).alias("said"))


@query(f"""WITH {BASE} SELECT k, CASE WHEN kind = 4 THEN street ELSE '' END AS deviation FROM base""")
def deviation_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts of which one in five has an article that leads the traffic round by its street."""
    b, kind = base(spark, sf_dir), F.col("kind")
    more = F.when(kind == 4, F.concat(F.lit("\nArticle 2 : Une déviation sera mise en place par "), "street")).otherwise("")
    text = F.concat(F.lit("Arrêté temporaire N°: 1/2023\nObjet : Pose de benne\nLe Maire,\nARRÊTENT\nArticle 1 : Le samedi 4 juillet, le stationnement sera interdit"), more, F.lit("\nArticle dernier : recours\n"))
    acts = b.select("commune", F.col("k").alias("id"), text.alias("text"), F.lit(None).cast("date").alias("decided"))
    rows = extraction.decree_rows(acts, keys(spark, sf_dir), today())
    return rows.select(F.col("id").alias("k"), F.array_join("deviation", ",").alias("deviation"))
