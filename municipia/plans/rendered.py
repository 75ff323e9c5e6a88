"""Decree texts written out from the driver's tables, so that what is read from them is known.

Each order becomes a decree of its customer's nation (the commune); the street is named after a part. The extraction sees the
text alone; ``BASE`` states the same typed columns in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from municipia.functions import constants as K
from municipia.operators.geocode import PARTS
from municipia.operators.streets import street_keys
from municipia.plans.geocoding import Reference
from municipia.sources.tables import shuffled, spread

#: Days added to order dates, which puts them after 2000.
SHIFT = 9131
TODAY = "2023-06-15"
#: Nations, whose keys count from 0: the communes. A part is a street of the commune that its key leaves.
TOWNS = 25
TYPES = ("Rue", "Avenue", "Chemin", "Impasse")
SUBJECTS = ("Déménagement", "Vide-grenier", "Pose de benne", "Branchement gaz", "Réfection de chaussée")
KINDS = ("demenagement", "evenement", "chantier", "reseaux", "voirie")

_TITLE = "upper(left(split_part({0}, ' ', {1}), 1)) || substr(split_part({0}, ' ', {1}), 2)"
STREET = "(['Rue', 'Avenue', 'Chemin', 'Impasse'])[length({0}) % 4 + 1] || ' ' || " + _TITLE.format("{0}", 1) + " || ' ' || " + _TITLE.format("{0}", 2)
BASE = f"""
base AS (
  SELECT o_orderkey AS k, n_name AS commune, n_nationkey AS town, o_orderdate::DATE + {SHIFT} AS d0, o_orderdate::DATE + {SHIFT} + (o_orderkey % 40)::INT AS d1,
    (o_orderkey % 9998 + 1)::VARCHAR || '/' || year(o_orderdate::DATE + {SHIFT})::VARCHAR AS numero,
    (o_orderkey % 5)::INT AS kind, (o_orderkey % 97 + 1)::INT AS house, c_custkey, {STREET.format("p_name")} AS street
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) // {TOWNS} FROM part) * {TOWNS} + n_nationkey
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _street(p: F.Column) -> F.Column:
    return F.concat(F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.length(p) % 4 + 1), F.lit(" "), F.initcap(p))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed columns of BASE; an order's street is one of its commune's parts. Texts that cost much to read are made of few
    bytes, so the orders are spread by count, not by size."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    p = table(spark, sf_dir, "part").select("p_partkey", _street(F.col("p_name")).alias("street"))
    each = p.count() // TOWNS
    k, d0 = F.col("o_orderkey"), F.date_add(F.col("o_orderdate").cast("date"), SHIFT)
    lived = o.join(shuffled(c), o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    lived = spread(lived.select("o_orderkey", "o_orderdate", "c_custkey", "n_name", "n_nationkey", (k % each * TOWNS + F.col("n_nationkey")).alias("street_key")), "street_key")
    joined = lived.join(shuffled(p), F.col("street_key") == p.p_partkey)
    return joined.select(
        k.alias("k"), F.col("n_name").alias("commune"), F.col("n_nationkey").alias("town"), d0.alias("d0"), F.date_add(d0, (k % 40).cast("int")).alias("d1"),
        F.concat((k % 9998 + 1).cast("string"), F.lit("/"), F.year(d0).cast("string")).alias("numero"),
        (k % 5).cast("int").alias("kind"), (k % 97 + 1).cast("int").alias("house"), "c_custkey", "street",
    )


def _long(d: F.Column) -> F.Column:
    return F.concat_ws(" ", F.day(d).cast("string"), F.element_at(F.array(*[F.lit(m) for m in K.MONTH_NAMES]), F.month(d)), F.year(d).cast("string"))


def decrees(spark: SparkSession, sf_dir: str, house: F.Column | None = None) -> DataFrame:
    """commune, k, town, text, and nothing else of base(); house: another number, from the columns of base()."""
    b = base(spark, sf_dir)
    b = b if house is None else b.withColumn("house", house)
    what = F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), F.col("kind") + 1)
    place = F.concat_ws(" ", F.col("house").cast("string"), "street")
    asked = F.when(F.col("kind") == 0, "Monsieur Jean Dupont").otherwise(F.concat(F.lit("l'entreprise SARL Batir "), F.col("c_custkey").cast("string")))
    text = F.concat(
        F.lit("Arrêté temporaire N°: "), "numero", F.lit("\nObjet : "), what, F.lit(" - "), place,
        F.lit("\nLe Maire,\nVU le code de la route\nCONSIDÉRANT la demande formulée par "), asked, F.lit(", pour des travaux\nARRÊTENT\nArticle 1 : Du "),
        _long(F.col("d0")), F.lit(" au "), _long(F.col("d1")), F.lit(" de 8h à 17h30, la circulation sera interdite au droit du "), place,
        F.lit("\nArticle 2 : Le stationnement sera interdit"), F.when(F.col("kind") >= 3, " sur le trottoir").otherwise(""),
        F.when(F.col("kind") == 4, F.lit("\nArticle 3 : Une déviation sera mise en place")).otherwise(""),
        F.lit("\nArticle dernier : recours\nÀ Ville, le "), F.date_format(F.date_sub("d0", 10), "d/M/yyyy"), F.lit("\n"),
    )
    return b.select("commune", "k", "town", text.alias("text"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commune, name, length, seen: the parts of each commune by name."""
    p = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % TOWNS).alias("town"), _street(F.col("p_name")).alias("name")).agg(F.min("p_partkey").alias("seen"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("commune"), F.col("n_nationkey").cast("long").alias("town"))
    return n.join(p, "town").select("commune", "name", (F.lit(100.0) + F.col("seen")).alias("length"), "seen")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return street_keys(streets(spark, sf_dir))


def reference(spark: SparkSession, sf_dir: str) -> Reference:
    """The same streets on a map, a kilometre long and ten metres apart; one house number in four has an address on them."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s, y = streets(spark, sf_dir), F.col("seen") * 10
    known = s.select("commune", F.col("name").alias("street"), y.cast("double").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(97), F.lit(4))).alias("number"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("commune"), F.lit(0.0).alias("lon0"), F.lit(0.0).alias("lat0"))
    return Reference(
        s.select("commune", "name", F.array(F.array(at(F.lit(0), y), at(F.lit(1000), y))).alias("parts")),
        known.withColumn("x", F.col("number") * 10.0),
        spark.createDataFrame([], f"commune string, name string, type string, parts {PARTS}"),
        n,
    )


PLACES = (("Parc de Loisirs", True), ("Stade Municipal", False), ("Parking", False))


def place_decrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commune, k, text, decided: unsigned acts that name a local place, another one, one too general to tell, or none by their
    key; one in three has no date of decision either."""
    k = F.col("k")
    where = F.element_at(F.array(*[F.lit(f" sur le {n}") for n, _ in PLACES], F.lit("")), (k % 4).cast("int") + 1)
    text = F.concat(F.lit("Arrêté temporaire N°: "), "numero", F.lit("\nObjet : Déménagement\nLe Maire,\nVU le code de la route\nARRÊTENT\nArticle 1 : Le samedi 4 juillet, le stationnement sera interdit"), where, F.lit("\nArticle dernier : recours\n"))
    return base(spark, sf_dir).select("commune", "k", text.alias("text"), F.when(k % 3 != 0, F.col("d0")).alias("decided"))


def place_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commune, key, name, local: the same places in every commune."""
    names = F.explode(F.array(*[F.struct(F.lit(n.lower()).alias("key"), F.lit(n).alias("name"), F.lit(own).alias("local")) for n, own in PLACES]))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("commune"), names.alias("p")).select("commune", "p.*")


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base() as a decree table: one row in nine has no dates, one in seven no end; statuses and impacts by key."""
    k = F.col("k")
    impacts = F.when(k % 3 == 0, F.array(F.lit("stationnement"), F.lit("route_barree"))).when(k % 3 == 1, F.array(F.lit("trottoir"))).otherwise(F.array(F.lit("deviation")))
    return base(spark, sf_dir).select(
        "commune", "k", k.cast("string").alias("id"), "numero", F.element_at(F.array(*[F.lit(x) for x in KINDS]), F.col("kind") + 1).alias("categorie"), impacts.alias("impacts"),
        F.when(k % 9 != 0, F.col("d0")).alias("date_debut"), F.when((k % 9 != 0) & (k % 7 != 0), F.col("d1")).alias("date_fin"),
        F.element_at(F.array(*[F.lit(s) for s in K.STATUSES]), (k % 3).cast("int") + 1).alias("statut"),
        F.concat_ws(" ", F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), F.col("kind") + 1), "street").alias("titre"), F.col("street").alias("lieu"),
        F.concat(F.lit("Batir "), F.col("c_custkey").cast("string")).alias("intervenant"), F.array("street").alias("deviation"), "house", "street",
        F.date_sub("d0", 12).alias("date_publication"),
    )


PERIODS = BASE + """,
periods AS (
  SELECT commune, k, k::VARCHAR AS id, numero, (['demenagement', 'evenement', 'chantier', 'reseaux', 'voirie'])[kind + 1] AS categorie,
    CASE k % 3 WHEN 0 THEN ['stationnement', 'route_barree'] WHEN 1 THEN ['trottoir'] ELSE ['deviation'] END AS impacts,
    CASE WHEN k % 9 <> 0 THEN d0 END AS date_debut, CASE WHEN k % 9 <> 0 AND k % 7 <> 0 THEN d1 END AS date_fin,
    (['publie', 'a_verifier', 'masque'])[k % 3 + 1] AS statut,
    (['Déménagement', 'Vide-grenier', 'Pose de benne', 'Branchement gaz', 'Réfection de chaussée'])[kind + 1] || ' ' || street AS titre,
    street AS lieu, 'Batir ' || c_custkey::VARCHAR AS intervenant, house, street, d0 - 12 AS date_publication
  FROM base
)"""
