"""List, search, count and export queries over the decree table, against an explicit day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from municipia.functions import classify
from municipia.functions import constants as K
from municipia.functions.text import matches_all_words
from municipia.sources.tables import written


def last_day(start: Column, end: Column) -> Column:
    return F.coalesce(end, start)


def state(start: Column, end: Column, today: Column) -> Column:
    return F.when(start.isNull(), "inconnu").when(last_day(start, end) < today, "termine").when(start > today, "a_venir").otherwise("en_cours")


def current(decrees: DataFrame, today: Column) -> DataFrame:
    """Published decrees that have not ended, by start, those without one first."""
    return decrees.where((F.col("statut") == "publie") & (F.col("date_fin").isNull() | (F.col("date_fin") >= today))).orderBy(F.asc_nulls_first("date_debut"), "id")


def in_period(start: Column, end: Column, today: Column, period: str, history: bool) -> Column:
    """period: tous, en_cours, 7j or 30j; rows without a start pass the last two."""
    ended = F.coalesce(last_day(start, end) < today, F.lit(False))
    shown = ~ended | F.lit(history and period == "tous")
    if period == "en_cours":
        return shown & F.coalesce(start <= today, F.lit(False))
    if period in ("7j", "30j"):
        return shown & (start.isNull() | (F.datediff(start, today) <= int(period[:-1])))
    return shown


def filtered(decrees: DataFrame, today: Column, period: str = "tous", history: bool = False, categories: tuple = (), impacts: tuple = (), query: str = "") -> DataFrame:
    keep = in_period(F.col("date_debut"), F.col("date_fin"), today, period, history)
    if categories:
        keep = keep & F.col("categorie").isin(*categories)
    if impacts:
        keep = keep & F.arrays_overlap("impacts", F.array(*[F.lit(i) for i in impacts]))
    if query.strip():
        keep = keep & matches_all_words(F.concat_ws(" ", "titre", "lieu", "intervenant", "numero", F.array_join("deviation", " ")), query)
    return decrees.where(keep)


def _month_name(d: Column, names: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(d))


def bucket(start: Column, end: Column, today: Column) -> Column:
    """The list's heading; weeks begin on Monday."""
    ahead, week = F.datediff(start, today), F.lit(7) - F.weekday(today)
    month = F.concat(F.initcap(_month_name(start, K.MONTH_NAMES)), F.lit(" "), F.year(start).cast("string"))
    return (
        F.when(start.isNull(), "Dates à préciser")
        .when(last_day(start, end) < today, "Terminés")
        .when(start <= today, "En cours")
        .when(ahead < week, "Cette semaine")
        .when(ahead < week + 7, "Semaine prochaine")
        .otherwise(month)
    )


def list_order(start: Column, end: Column, today: Column) -> Column:
    """Live decrees by start and end, undated last of them, then ended ones from the latest."""
    day = lambda d: F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))
    backwards = F.lpad((F.lit(99999999) - F.coalesce(F.date_format(end, "yyyyMMdd"), F.lit("0")).cast("int")).cast("string"), 8, "0")
    ended = F.coalesce(last_day(start, end) < today, F.lit(False))
    return F.when(ended, F.concat(F.lit("z"), backwards)).otherwise(F.concat(F.lit("a"), F.when(start.isNull(), "9").otherwise(day(start)), day(end)))


def bucket_counts(decrees: DataFrame, today: Column) -> DataFrame:
    return decrees.groupBy(bucket(F.col("date_debut"), F.col("date_fin"), today).alias("bucket")).agg(F.count("*").alias("n"))


def progress(start: Column, end: Column, today: Column) -> Column:
    """struct<total, day, percent, left, ahead>: where today stands in a period."""
    last = last_day(start, end)
    total, day = F.datediff(last, start) + 1, F.datediff(today, start) + 1
    live = (start <= today) & (last >= today)
    percent = F.when(last < today, 100).when(start > today, 0).otherwise(F.greatest(F.lit(4), F.floor(100 * day / total + 0.5).cast("int")))
    return F.struct(total.alias("total"), F.when(live, day).alias("day"), percent.alias("percent"), F.when(live, F.datediff(last, today)).alias("left"), F.when(start > today, F.datediff(start, today)).alias("ahead"))


def _short(d: Column) -> Column:
    return F.concat(F.day(d).cast("string"), F.lit(" "), _month_name(d, K.MONTH_SHORT))


#: Week days as labels show them.
DAYS_SHORT = ("lun.", "mar.", "mer.", "jeu.", "ven.", "sam.", "dim.")
DAYS_LONG = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def _weekday(d: Column, names: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(d) + 1)


def period_label(start: Column, end: Column, days: Column, today: Column) -> Column:
    last, text = last_day(start, end), lambda c: c.cast("string")
    x, y = F.get(days, F.lit(0)), F.get(days, F.lit(1))
    two = F.when(F.month(x) == F.month(y), F.concat(text(F.day(x)), F.lit(" et "), _short(y))).otherwise(F.concat(_short(x), F.lit(" et "), _short(y)))
    same = (F.month(start) == F.month(last)) & (F.year(start) == F.year(last))
    year = F.when(F.year(last) != F.year(today), F.concat(F.lit(" "), text(F.year(last)))).otherwise("")
    return (
        F.when(start.isNull(), "Dates à préciser")
        .when(F.size(days) == 2, two)
        .when(F.size(days) > 2, F.concat(text(F.size(days)), F.lit(" jours à partir du "), _short(start)))
        .when(start == last, F.concat(_weekday(start, DAYS_SHORT), F.lit(" "), _short(start)))
        .otherwise(F.concat(F.when(same, text(F.day(start))).otherwise(_short(start)), F.lit(" → "), _short(last), year))
    )


def long_date(d: Column) -> Column:
    return F.concat_ws(" ", _weekday(d, DAYS_LONG), F.day(d).cast("string"), _month_name(d, K.MONTH_NAMES), F.year(d).cast("string"))


def period_text(start: Column, end: Column, days: Column) -> Column:
    return (
        F.when(start.isNull(), "Dates à préciser")
        .when(F.size(days) > 1, F.array_join(F.transform(days, long_date), " et "))
        .when(last_day(start, end) == start, F.concat(F.lit("Le "), long_date(start)))
        .otherwise(F.concat(F.lit("Du "), long_date(start), F.lit(" au "), long_date(end)))
    )


def state_label(start: Column, end: Column, today: Column) -> Column:
    d = F.datediff(start, today)
    return F.when(start.isNull(), "").when(last_day(start, end) < today, "Terminé").when(start <= today, "En cours").when(d == 1, "Demain").otherwise(F.concat(F.lit("Dans "), d.cast("string"), F.lit(" j")))


def state_text(start: Column, end: Column, today: Column) -> Column:
    last, ahead = last_day(start, end), F.datediff(start, today)
    live = F.when(last == today, "En cours, dernier jour aujourd'hui").otherwise(F.concat(F.lit("En cours jusqu'au "), F.regexp_replace(_short(last), r"\.", "")))
    return F.when(start.isNull(), "Dates à préciser").when(last < today, "Terminé").when(start <= today, live).when(ahead == 1, "Commence demain").otherwise(F.concat(F.lit("Commence dans "), ahead.cast("string"), F.lit(" jours")))


def short_hours(hours: Column) -> Column:
    return F.transform(hours, lambda h: F.regexp_replace(h, r"(\d{1,2})h00\b", "$1h"))


def hours_per_day(days: Column, hours: Column) -> Column:
    """array<struct<day, hours>> of separate days, with their hours where there is one for each."""
    each = (F.size(days) > 1) & (F.size(days) == F.size(hours))
    return F.when(F.size(days) > 1, F.transform(days, lambda d, i: F.struct(d.alias("day"), F.when(each, F.get(short_hours(hours), i)).alias("hours"))))


def hour_notes(days: Column, hours: Column, remarks: Column) -> Column:
    """What is said beside the days; "hors week-end" goes without saying where the week days are named."""
    shown = (F.size(days) > 1) & (F.size(days) == F.size(hours))
    notes = short_hours(F.concat(F.when(shown, F.array().cast("array<string>")).otherwise(hours), remarks))
    return F.when(F.array_contains(notes, "du lundi au vendredi"), F.array_remove(notes, "hors week-end")).otherwise(notes)


PUBLIC = ("id", "numero", "titre", "categorie", "impacts", "date_debut", "date_fin", "jours", "horaires", "remarques", "lieu", "intervenant", "deviation", "note", "centre", "geojson", "etat", "pdf_url", "date_publication")
ADMIN = ("statut", "motif_verification", "qualite_geo", "modifie_manuellement", "erreur", "objet_registre", "maj_le")


def public_view(decrees: DataFrame, today: Column) -> DataFrame:
    """The fields that may be shown to everyone; never the document's text or the registry's subject."""
    c = F.col("calendrier")
    full = decrees.withColumns({"jours": c["jours"], "horaires": c["horaires"], "remarques": c["remarques"], "etat": state(F.col("date_debut"), F.col("date_fin"), today)})
    return full.select("commune", *PUBLIC)


def admin_view(decrees: DataFrame, today: Column) -> DataFrame:
    """The public fields but the drawing, and the seven of the review queue."""
    c = F.col("calendrier")
    full = decrees.withColumns({"jours": c["jours"], "horaires": c["horaires"], "remarques": c["remarques"], "etat": state(F.col("date_debut"), F.col("date_fin"), today)})
    return full.select("commune", *[f for f in PUBLIC if f != "geojson"], *ADMIN)


def admin_list(decrees: DataFrame, status: str | None = None) -> DataFrame:
    return (decrees.where(F.col("statut") == status) if status else decrees).orderBy(F.desc_nulls_last("date_publication"), F.desc_nulls_last("numero"))


def admin_search(decrees: DataFrame, query: str) -> DataFrame:
    return decrees.where(F.lower(F.concat_ws(" ", "numero", "titre", "lieu", "objet_registre")).contains(query.lower()))


def status_counts(decrees: DataFrame) -> DataFrame:
    return decrees.groupBy("statut").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows (without repeats in group and order) with ``place``, their number from 0 within the group in ascending order.

    Rows are dealt to ranges of (group, order) and numbered within their range; the rows of the group in ranges before come on
    top. So a group of any size is spread over as many tasks as it has ranges."""
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(ranges, group, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(group, "__range").agg(F.count("*").alias("n"))
    before = counts.select(group, "__range", (F.sum("n").over(Window.partitionBy(group).orderBy("__range")) - F.col("n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)) - 1
    met = dealt.withColumn("__within", within).join(before, [group, "__range"])
    return met.withColumn("place", F.col("__before") + F.col("__within")).drop("__range", "__before", "__within")


def map_layer(rows: DataFrame) -> DataFrame:
    """commune, fid, id, role, colour, geometry: a row for each drawn geometry of decrees (id, impacts, features array of
    struct<role, geometry>), numbered in list order within the commune."""
    spread = rows.select("commune", "id", "order_key", classify.line_colour(F.col("impacts")).alias("colour"), F.posexplode("features").alias("k", "f"))
    return numbered(spread, "commune", "order_key", "id", "k").select("commune", F.col("place").alias("fid"), "id", F.coalesce("f.role", F.lit("impact")).alias("role"), "colour", F.col("f.geometry").alias("geometry"))
