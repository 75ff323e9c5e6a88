from datetime import date

import pytest
from pyspark.sql import functions as F

from municipia.functions import calendar_fr, classify, fields, text


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


DECREE = """Page : 1
Arrêté temporaire N° : 042/26
Objet : Branchement gaz -- 61 Rue Haute  Voie Métropole
Le Maire,
VU le code
CONSIDERANT la demande formulée par l'entreprise Dupré TP, pour des travaux
ARRÊTENT
Article 1er : Du 5 au 9 octobre 2026, la circulation piétonne sera interdite, vitesse limitée à 30 km/h
Article 2 : Le stationnement sera interdit
Article 3 : Une déviation par la Rue Basse sera mise en place
Article 4 : Le non-respect sera puni
Article dernier : recours
À Ville, le 31/2/2026
"""


def test_normalising(spark):
    assert column(spark, ["Éà  l'Œuvre_N°08", None, ""], text.norm) == ["ea l uvre n 08", None, ""]
    assert column(spark, ["rue du 08 mai 007"], text.without_leading_zeros) == ["rue du 8 mai 7"]
    assert column(spark, [" a\n\tb c "], text.one_line) == ["a b c"]


def test_clean_ocr(spark):
    assert column(spark, ["le 1” septembre", "inter-\nvention", "a—b", "x y"], text.clean_ocr) == ["le 1er septembre", "intervention", "a-b", "x y"]


def test_postal_addresses_are_dropped_but_places_stay(spark):
    got = column(spark, ["demande du 24 rue Louis Blanc; 75010 Paris ici", "au droit du 53 Avenue Haute - 69960 VILLE", "M. X demeurant 3 rue A 69000 Lyon"], text.remove_postal_addresses)
    assert "Blanc" in got[0]  # "du" right before it makes it a place
    assert "53 Avenue Haute" in got[1]
    assert "69000" not in got[2]


def test_fields(spark):
    df = spark.createDataFrame([(DECREE,)], "t string").withColumn("t", text.clean_ocr(F.col("t"))).withColumn("a", fields.articles(F.col("t")))
    df = df.withColumn("m", fields.measure_articles(F.col("a")))
    scope = fields.request_scope(F.col("t"), F.col("a"), F.col("m"))
    r = df.select(
        fields.decree_number(F.col("t")), fields.subject(F.col("t")), fields.signature_date(F.col("t"), "Ville"), F.size("a"), F.size("m"),
        F.size(fields.deviation_articles(F.col("a"))), fields.contractor(scope, F.lit("Ville")), F.col("a")[4]["head"],
    ).first()
    assert tuple(r) == ("42/2026", "Branchement gaz -- 61 Rue Haute", None, 5, 2, 1, "Dupré TP", "dernier")


def test_titles(spark):
    f = lambda category, place, private: lambda c: fields.title(c, F.lit(category), F.lit(place), F.lit(private))
    assert column(spark, ["echafaudage -- 68 av. X", "a" * 100 + " " + "b" * 80, None], f("chantier", "Rue A", False)) == ["Echafaudage – 68 av. X", "A" + "a" * 99 + "…", "Échafaudage, benne, nacelle – Rue A"]
    assert column(spark, ["x"], f("voirie", None, True)) == ["Travaux de voirie"]


def test_categories_and_impacts(spark):
    df = spark.createDataFrame([("Déménagement", "benne"), ("Réfection de tranchée gaz", ""), ("", "rien"), ("", "gaz vogue")], "o string, a string")
    assert [r[0] for r in df.select(classify.category(F.col("o"), F.col("a"))).collect()] == ["demenagement", "voirie", "autre", "evenement"]
    texts = ["La circulation piétonne sera interdite", "la circulation des véhicules sera interdite", "alternat par feux", "", "places de stationnement réservées"]
    assert column(spark, texts, classify.impacts) == [["trottoir"], ["route_barree"], ["circulation_alternee"], [], ["stationnement"]]


@pytest.mark.parametrize(
    "said, ref, start, end, mode",
    [
        ("Du jeudi 7 mai à 14h au dimanche 10 mai, etc.", "2026-05-01", date(2026, 5, 7), date(2026, 5, 10), "plage"),
        ("le lundi 4 janvier", "2026-12-20", date(2027, 1, 4), date(2027, 1, 4), "jours"),
        ("à partir du 14 septembre 2026, pour une durée des travaux estimée à 1 mois", "2026-09-01", date(2026, 9, 14), date(2026, 10, 14), "plage"),
        ("le 31/01/26, durée estimée à un mois", "2026-01-20", date(2026, 1, 31), date(2026, 2, 28), "plage"),
        ("le 2 octobre de 17h à 20h et le 3 octobre", "2026-09-01", date(2026, 10, 2), date(2026, 10, 3), "jours"),
        ("le 29 février, ou jamais", "2026-02-01", None, None, "plage"),
        ("le 9 octobre 1999", "2026-02-01", None, None, "plage"),
        ("", "2026-02-01", None, None, "plage"),
    ],
)
def test_calendars(spark, said, ref, start, end, mode):
    df = spark.createDataFrame([(said, ref)], "t string, r string")
    c = df.select(calendar_fr.calendar(F.col("t"), F.col("r").cast("date")).alias("c")).first()["c"]
    assert (c["debut"], c["fin"], c["mode"]) == (start, end, mode)


def test_hours(spark):
    assert column(spark, ["de 7h à 17h30, entre 9 h et 10h, de 7h à 17h30, à partir de 6 heures, hors week-end du lundi au vendredi"], calendar_fr.find_hours) == [["7h00–17h30", "9h00–10h00", "à partir de 6h00", "du lundi au vendredi", "hors week-end"]]
