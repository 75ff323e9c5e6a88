"""Registered queries of the decree library, each with DuckDB SQL of its own where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from municipia.functions import calendar_fr, classify, fields, text
from municipia.functions import constants as K
from municipia.operators import geocode, locations, streets, sync
from municipia.plans import extraction, geocoding, rendered, views
from municipia.plans.rendered import BASE, PERIODS, TODAY, table
from municipia.sources import osm, registry
from municipia.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
today = lambda: F.lit(TODAY).cast("date")
DAY = f"DATE '{TODAY}'"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.decrees(spark, sf_dir).select("commune", F.col("k").alias("id"), "text", F.lit(None).cast("date").alias("decided"))


# --- texts ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS norm_md5,
  length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line_length FROM documents""")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.norm(F.col("text"))).alias("norm_md5"), F.length(text.one_line(F.col("text"))).cast("long").alias("line_length"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'thing') AND contains(lower(strip_accents(text)), 'released')""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.matches_all_words(F.col("text"), "Thing RELEASED")).select("doc_id")


@query(f"WITH {BASE} SELECT k, 'Demande de un particulierpour le ' || house || ' ' || street AS shown FROM base")
def anonymize_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rendered.base(spark, sf_dir)
    raw = F.concat(F.lit("Demande de Madame Anne  Martin-"), F.lit("Petit pour  le "), F.col("house").cast("string"), F.lit(" "), "street")
    return b.select("k", text.anonymize(raw).alias("shown"))


@query(f"WITH {BASE} SELECT k, 'au droit du ' || house || ' ' || street || ' - 69960 Ville travaux' AS kept, 'travaux' AS dropped FROM base")
def strip_postal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rendered.base(spark, sf_dir)
    address = F.concat(F.col("house").cast("string"), F.lit(" "), "street", F.lit(" - 69960 Ville"))
    kept = F.concat(F.lit("au droit du "), address, F.lit(" travaux"))
    dropped = F.concat(address, F.lit(" ; travaux"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(text.remove_postal_addresses(c), " ; ", " "), " +", " "))
    return b.select("k", clean(kept).alias("kept"), clean(dropped).alias("dropped"))


@query(f"""WITH {BASE} SELECT k, numero, d0 - 10 AS signed, (['Déménagement', 'Vide-grenier', 'Pose de benne', 'Branchement gaz', 'Réfection de chaussée'])[kind + 1] || ' - ' || house || ' ' || street AS objet,
  CASE WHEN kind > 0 THEN 'Batir ' || c_custkey END AS entreprise, kind = 0 AS particulier FROM base""")
def decree_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = extraction.read_fields(_texts(spark, sf_dir), today())
    return read.select(F.col("id").alias("k"), "numero", F.col("date_signature").alias("signed"), "objet", "entreprise", "particulier")


@query(f"WITH {BASE} SELECT k, CASE WHEN kind = 4 THEN 4 ELSE 3 END AS articles, 2 AS measures, (kind = 4)::INT AS deviations, 'Le stationnement sera interdit' || CASE WHEN kind >= 3 THEN ' sur le trottoir' ELSE '' END AS second FROM base")
def split_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rendered.decrees(spark, sf_dir).withColumn("found", fields.articles(text.clean_ocr(F.col("text"))))
    m = d.withColumn("measures", fields.measure_articles(F.col("found")))
    return m.select("k", F.size("found").alias("articles"), F.size("measures").alias("measures"), F.size(fields.deviation_articles(F.col("found"))).alias("deviations"), F.get("measures", F.lit(1)).alias("second"))


@query(f"WITH {BASE} SELECT k, (['demenagement', 'evenement', 'chantier', 'reseaux', 'voirie'])[kind + 1] AS category, 'route_barree,stationnement' || CASE WHEN kind >= 3 THEN ',trottoir' ELSE '' END || CASE WHEN kind = 4 THEN ',deviation' ELSE '' END AS impacts, 'route_barree' AS main, '#ff3b30' AS colour FROM base")
def classify_decrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = extraction.read_fields(_texts(spark, sf_dir), today()).select(F.col("id").alias("k"), F.col("categorie").alias("category"), F.col("impacts").alias("found"))
    return read.select("k", "category", F.array_join("found", ",").alias("impacts"), classify.main_impact(F.col("found")).alias("main"), classify.line_colour(F.col("found")).alias("colour"))


# --- calendar ---------------------------------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT k, d0 AS debut, d1 AS fin, CASE WHEN d0 = d1 THEN 'jours' ELSE 'plage' END AS mode, '8h00–17h30' AS horaires FROM base")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = extraction.read_fields(_texts(spark, sf_dir), today())
    c = F.col("calendrier")
    return read.select(F.col("id").alias("k"), c["debut"].alias("debut"), c["fin"].alias("fin"), c["mode"].alias("mode"), F.array_join(c["horaires"], ",").alias("horaires"))


@query(f"""WITH {BASE} SELECT k, CASE WHEN k % 3 = 0 THEN least(d0, d0 + 3) ELSE d0 END AS debut,
  CASE k % 3 WHEN 0 THEN d0 + 3 WHEN 1 THEN d0 + 13 ELSE make_date(year(d0 + INTERVAL 1 MONTH)::INT, month(d0 + INTERVAL 1 MONTH)::INT, least(day(d0), 28)::INT) END AS fin,
  CASE k % 3 WHEN 0 THEN 2 ELSE 0 END AS jours, CASE k % 3 WHEN 1 THEN 'durée estimée à 2 semaines' WHEN 2 THEN 'durée estimée à un mois' ELSE '' END AS remarque FROM base""")
def calendar_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days apart without a year, weeks and a month ahead."""
    b = rendered.base(spark, sf_dir)
    short = lambda d: F.concat_ws(" ", F.day(d).cast("string"), F.element_at(F.array(*[F.lit(m) for m in K.MONTH_NAMES]), F.month(d)))
    said = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("le "), short(F.col("d0")), F.lit(" de 8h à 9h et le "), F.date_format(F.date_add("d0", 3), "dd/MM"), F.lit(" de 8h à 9h")))
        .when(F.col("k") % 3 == 1, F.concat(F.lit("à partir du "), F.date_format("d0", "dd/MM/yy"), F.lit(" pour une durée estimée à 2 semaines")))
        .otherwise(F.concat(F.lit("à partir du "), F.date_format("d0", "d/M/yyyy"), F.lit(" pour une durée estimée à un mois")))
    )
    c = F.col("c")
    return b.select("k", calendar_fr.calendar(said, F.date_sub("d0", 10)).alias("c")).select("k", c["debut"].alias("debut"), c["fin"].alias("fin"), F.size(c["jours"]).alias("jours"), F.array_join(c["remarques"], ",").alias("remarque"))


@query(f"""WITH {PERIODS} SELECT k, CASE WHEN date_debut IS NULL THEN 'inconnu' WHEN coalesce(date_fin, date_debut) < {DAY} THEN 'termine' WHEN date_debut > {DAY} THEN 'a_venir' ELSE 'en_cours' END AS etat,
  CASE WHEN date_debut IS NULL THEN '' WHEN coalesce(date_fin, date_debut) < {DAY} THEN 'Terminé' WHEN date_debut <= {DAY} THEN 'En cours' WHEN date_debut - {DAY} = 1 THEN 'Demain' ELSE 'Dans ' || (date_debut - {DAY}) || ' j' END AS label FROM periods""")
def decree_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("date_debut"), F.col("date_fin")
    return rendered.periods(spark, sf_dir).select("k", views.state(a, b, today()).alias("etat"), views.state_label(a, b, today()).alias("label"))


@query(f"WITH {PERIODS} SELECT k, date_debut FROM periods WHERE statut = 'publie' AND (date_fin IS NULL OR date_fin >= {DAY})")
def current_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.current(rendered.periods(spark, sf_dir), today()).select("k", "date_debut")


@query(f"""WITH {PERIODS}, b AS (SELECT CASE WHEN date_debut IS NULL THEN 'Dates à préciser' WHEN coalesce(date_fin, date_debut) < {DAY} THEN 'Terminés' WHEN date_debut <= {DAY} THEN 'En cours'
  WHEN date_debut - {DAY} < 4 THEN 'Cette semaine' WHEN date_debut - {DAY} < 11 THEN 'Semaine prochaine'
  ELSE (['Janvier','Février','Mars','Avril','Mai','Juin','Juillet','Août','Septembre','Octobre','Novembre','Décembre'])[month(date_debut)] || ' ' || year(date_debut) END AS bucket FROM periods)
  SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def list_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bucket_counts(rendered.periods(spark, sf_dir), today())


@query(f"""WITH {PERIODS}, live AS (SELECT *, coalesce(coalesce(date_fin, date_debut) < {DAY}, false) AS ended FROM periods)
  SELECT k, 'en_cours' AS period FROM live WHERE NOT ended AND date_debut <= {DAY} UNION ALL
  SELECT k, '7j' FROM live WHERE NOT ended AND (date_debut IS NULL OR date_debut - {DAY} <= 7) UNION ALL
  SELECT k, '30j' FROM live WHERE NOT ended AND (date_debut IS NULL OR date_debut - {DAY} <= 30) UNION ALL SELECT k, 'tous' FROM live""")
def period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rendered.periods(spark, sf_dir)
    parts = [views.filtered(p, today(), period, history=period == "tous").select("k", F.lit(period).alias("period")) for period in ("en_cours", "7j", "30j", "tous")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""WITH {PERIODS}, x AS (SELECT *, coalesce(date_fin, date_debut) AS fin FROM periods WHERE date_debut IS NOT NULL)
  SELECT k, (fin - date_debut + 1)::INT AS total, CASE WHEN fin < {DAY} THEN 100 WHEN date_debut > {DAY} THEN 0 ELSE greatest(4, floor(100.0 * ({DAY} - date_debut + 1) / (fin - date_debut + 1) + 0.5)::INT) END AS percent,
  CASE WHEN date_debut <= {DAY} AND fin >= {DAY} THEN fin - {DAY} END AS "left" FROM x""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rendered.periods(spark, sf_dir).where("date_debut is not null").withColumn("p", views.progress(F.col("date_debut"), F.col("date_fin"), today()))
    return p.select("k", "p.total", "p.percent", "p.left")


_SHORT = "(['janv.','févr.','mars','avr.','mai','juin','juil.','août','sept.','oct.','nov.','déc.'])"


@query(f"""WITH {PERIODS}, x AS (SELECT *, coalesce(date_fin, date_debut) AS fin FROM periods)
  SELECT k, CASE WHEN date_debut IS NULL THEN 'Dates à préciser' WHEN date_debut = fin THEN (['lun.','mar.','mer.','jeu.','ven.','sam.','dim.'])[isodow(date_debut)] || ' ' || day(date_debut) || ' ' || {_SHORT}[month(date_debut)]
  ELSE CASE WHEN month(date_debut) = month(fin) AND year(date_debut) = year(fin) THEN day(date_debut)::VARCHAR ELSE day(date_debut) || ' ' || {_SHORT}[month(date_debut)] END || ' → ' || day(fin) || ' ' || {_SHORT}[month(fin)] || CASE WHEN year(fin) <> 2023 THEN ' ' || year(fin) ELSE '' END END AS label FROM x""")
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rendered.periods(spark, sf_dir)
    return p.select("k", views.period_label(F.col("date_debut"), F.col("date_fin"), F.array().cast("array<date>"), today()).alias("label"))


# --- the whole extraction ---------------------------------------------------------------------------------------------


@query(f"""WITH {BASE} SELECT k, commune, house || ' ' || street AS lieu, (['Déménagement', 'Vide-grenier', 'Pose de benne', 'Branchement gaz', 'Réfection de chaussée'])[kind + 1] || ' – ' || house || ' ' || street AS titre,
  'publie' AS statut, '' AS motif, CASE WHEN kind = 0 THEN 'Particulier' ELSE 'Batir ' || c_custkey END AS intervenant, d0 AS date_debut, d1 AS date_fin FROM base""")
def decree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.decree_rows(_texts(spark, sf_dir), rendered.keys(spark, sf_dir), today())
    return rows.select(F.col("id").alias("k"), "commune", "lieu", "titre", "statut", F.col("motif_verification").alias("motif"), "intervenant", "date_debut", "date_fin")


@query(f"""WITH {BASE} SELECT k, make_date(year(r) + (make_date(year(r), 7, 4) < r - 120)::INT, 7, 4) AS date_debut, CASE k % 4 WHEN 0 THEN 'Parc de Loisirs' WHEN 1 THEN 'Stade Municipal' END AS lieu,
  CASE WHEN k % 4 < 2 THEN 'publie' ELSE 'a_verifier' END AS statut, CASE WHEN k % 4 < 2 THEN '' ELSE 'localisation absente' END AS motif,
  CASE WHEN k % 4 < 2 THEN '' ELSE 'Lieu non identifié' END AS avertissements, 'Le samedi 4 juillet, le stationnement sera interdit' || ([' sur le Parc de Loisirs', ' sur le Stade Municipal', ' sur le Parking', ''])[k % 4 + 1] AS mesures
  FROM (SELECT *, CASE WHEN k % 3 = 0 THEN DATE '{rendered.TODAY}' ELSE d0 END AS r FROM base)""")
def undated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned acts: the year comes from the decision or today; a place alone locates them, or nothing does."""
    texts = rendered.place_decrees(spark, sf_dir).withColumnRenamed("k", "id")
    rows = extraction.decree_rows(texts, rendered.keys(spark, sf_dir), today(), index=rendered.place_index(spark, sf_dir))
    return rows.select(F.col("id").alias("k"), "date_debut", "lieu", "statut", F.col("motif_verification").alias("motif"), F.array_join("avertissements", ",").alias("avertissements"), F.col("mesures_texte").alias("mesures"))


@query(f"""WITH {BASE}, p AS (SELECT k, unnest(['Zone Alpha', 'Parc Zebre', 'Aire Basse', 'Parc Yack', 'Villefort', 'Mairie']) AS name, unnest(range(6)) AS seen FROM base),
  named AS (SELECT k, list(name ORDER BY seen) FILTER (seen < 4 AND (k + seen) % 5 <> 0) AS names FROM p GROUP BY k)
  SELECT k, CASE WHEN k % 6 = 0 THEN 'Grand Clos ; Petit Clos' WHEN k % 6 = 1 THEN 'Petit Clos' ELSE array_to_string(names[1:3], ' ; ') END AS lieu FROM named""")
def place_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts that name up to four of the map's places, the town itself and a place too general to tell, in an order of their
    own: the first three of the map's order stand; a local place, told by name or alias, stands before all."""
    k, names = F.col("k"), ["Zone Alpha", "Parc Zebre", "Aire Basse", "Parc Yack"]
    told = F.array_join(F.array_compact(F.array(*[F.when((k + i) % 5 != 0, n) for i, n in reversed(list(enumerate(names)))], F.lit("Villefort"), F.lit("Mairie"))), ", ")
    own = F.when(k % 6 == 0, " au Petit Clos et au Clos du Haut").when(k % 6 == 1, " au Petit Clos").otherwise("")
    text = F.concat(F.lit("Arrêté temporaire N°: 1/2023\nObjet : Déménagement\nLe Maire,\nARRÊTENT\nArticle 1 : Le samedi 4 juillet, le stationnement sera interdit à "), told, own, F.lit("\nArticle dernier : recours\n"))
    acts = rendered.base(spark, sf_dir).select("commune", k.alias("id"), text.alias("text"), F.lit(None).cast("date").alias("decided"))
    towns = table(spark, sf_dir, "nation").select(F.col("n_name").alias("commune"))
    places = towns.select("commune", F.posexplode(F.array(*[F.lit(n) for n in (*names, "Villefort", "Mairie")])).alias("seen", "name")).withColumn("geometry", F.lit(None).cast("string"))
    clos = F.array(F.struct(F.lit("Petit Clos").alias("nom"), F.array().cast("array<string>").alias("alias"), F.lit(0).alias("rank")), F.struct(F.lit("Grand Clos").alias("nom"), F.array(F.lit("Clos du Haut")).alias("alias"), F.lit(1).alias("rank")))
    local = towns.select("commune", F.explode(clos).alias("c")).select("commune", "c.*", F.lit("").alias("osm_nom"), F.lit(None).cast("string").alias("geometry"))
    rows = extraction.decree_rows(acts, rendered.keys(spark, sf_dir), today(), town="Villefort", index=streets.place_index(places, local))
    return rows.select(F.col("id").alias("k"), "lieu")


@query(f"""WITH {PERIODS} SELECT k, concat_ws(' ; ', CASE WHEN date_debut IS NULL THEN 'dates non identifiées' END, CASE WHEN house % 4 = 0 THEN 'localisation absente' WHEN house % 4 = 1 THEN 'localisation approximative' END,
  CASE WHEN date_fin - date_debut > 35 THEN NULL END) AS motif, CASE WHEN date_debut IS NULL OR house % 4 < 2 THEN 'a_verifier' ELSE 'publie' END AS statut FROM periods""")
def publication_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rendered.periods(spark, sf_dir)
    quality = F.element_at(F.array(*[F.lit(q) for q in K.QUALITIES]), (F.col("house") % 4).cast("int") + 1)
    reasons = classify.review_reasons(F.col("date_debut"), F.coalesce("date_fin", "date_debut"), F.col("impacts"), quality, F.col("numero"))
    return p.select("k", reasons.alias("motif"), classify.status(reasons).alias("statut"))


# --- registry and sync ------------------------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as listing entries: one in four is no decree, one in six has its paper among the annexes, one in five is
    listed twice, the second time renamed."""
    b = rendered.base(spark, sf_dir)
    k = F.col("k")
    paper = lambda host: F.struct(F.concat(F.lit(f"https://{host}/"), k.cast("string"), F.lit("/paper.pdf")).alias("url"), F.lit("application/pdf").alias("mimeType"), F.lit("paper.pdf").alias("filename"), (k * 7).cast("string").alias("size"))
    image = F.struct(F.lit("https://x/y/z.png").alias("url"), F.lit("image/png").alias("mimeType"), F.lit("z.png").alias("filename"), F.lit("1").alias("size"))
    entry = lambda twice: F.struct(
        F.concat(F.when(k % 4 == 0, " AR ").otherwise(" at "), (k % 1000).cast("string"), F.lit(" / 26")).alias("numero"), F.concat(F.lit("Objet  "), k.cast("string"), F.lit(twice)).alias("objet"),
        F.date_format("d0", "yyyy-MM-dd").alias("dateDecision"), F.date_format(F.date_add("d0", 2), "yyyy-MM-dd'T'00:00:00").alias("datePublication"),
        F.when(k % 6 == 0, image).otherwise(paper("a.example")).alias("documentPrincipal"), F.when(k % 6 == 0, F.array(image, paper("b.example"))).alias("annexes"),
    )
    one = b.select("commune", F.lit("p1").alias("page"), k.cast("int").alias("place"), entry("").alias("acte"))
    two = b.where(k % 5 == 0).select("commune", F.lit("p2").alias("page"), k.cast("int").alias("place"), entry(" bis").alias("acte"))
    return one.unionByName(two)


@query(f"""WITH {BASE} SELECT commune, k::VARCHAR AS id, 'at ' || (k % 1000) || ' / 26' AS numero, d0 + 2 AS published, 'https://' || CASE WHEN k % 6 = 0 THEN 'b' ELSE 'a' END || '.example/' || k || '/paper.pdf' AS pdf_url,
  'at ' || (k % 1000) || ' / 26|Objet ' || k || CASE WHEN k % 5 = 0 THEN ' bis' ELSE '' END || '|' || d0 || '|paper.pdf|' || (k * 7) AS signature FROM base WHERE k % 4 <> 0 AND year(d0 + 2) >= 2022""")
def registry_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = registry.select_decrees(_listing(spark, sf_dir), 2022)
    signature = registry.fingerprint(*[F.col(c) for c in ("numero", "objet", "date_decision", "pdf_url", "pdf_taille")])
    return acts.select("commune", "id", "numero", F.col("date_publication").alias("published"), "pdf_url", signature.alias("signature"))


@query("""WITH p AS (SELECT conv_id AS act_id, turn, length(trim(text)) >= 80 AS own, CASE WHEN length(trim(text)) >= 80 THEN text ELSE 'ocr ' || text END AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)
  SELECT act_id, md5(string_agg(page, chr(10) || chr(12) || chr(10) ORDER BY rank)) AS text_md5, CASE WHEN bool_and(own) THEN 'natif' WHEN bool_or(own) THEN 'mixte' ELSE 'ocr' END AS method FROM p WHERE rank <= 12 GROUP BY act_id""")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pages = c.select(F.lit("c").alias("commune"), F.col("conv_id").alias("act_id"), F.col("turn").alias("page_no"), F.col("text").alias("native_text"), F.concat(F.lit("ocr "), "text").alias("ocr_text"))
    return registry.document_texts(pages).select("act_id", F.md5("text").alias("text_md5"), "method")


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A decree table and a later listing: what vanished, came back, changed, failed or is new follows from the key."""
    b = rendered.base(spark, sf_dir)
    k, text_k = F.col("k"), F.col("k").cast("string")
    suivi = F.struct(
        F.when(k % 17 != 0, F.concat(F.lit("s"), text_k)).alias("signature"), F.when(k % 13 == 0, F.lit("2023-01-01").cast("date")).alias("retire_le"),
        F.when(k % 13 == 0, "publie").alias("statut_avant"), F.when(k % 13 == 0, "").alias("motif_avant"),
    )
    known = b.where(k % 11 != 0).select(
        "commune", text_k.alias("id"), "numero", F.col("d0").alias("date_decision"), F.col("d0").alias("date_publication"),
        F.when(k % 13 == 0, "masque").otherwise("publie").alias("statut"), F.when(k % 13 == 0, f"{sync.WITHDRAWN} (constaté le 01/01/2023)").otherwise("").alias("motif_verification"),
        (k % 2 == 0).alias("modifie_manuellement"), F.when(k % 19 == 0, "x").otherwise("").alias("erreur"), (k % 5).cast("int").alias("tentatives"), suivi.alias("suivi_registre"), (k % 23 == 0).alias("geocodage_incomplet"),
    )
    gone = (F.col("town") % 3 != 0) & (k % 29 == 0) | (F.col("town") % 3 == 0) & (k % 2 == 0)
    acts = b.where(~gone).select("commune", text_k.alias("id"), "numero", F.concat(F.lit("objet "), text_k).alias("objet"), F.concat(F.lit("s"), text_k, F.when(k % 31 == 0, "'").otherwise("")).alias("signature"))
    return known, acts


SNAPSHOT = BASE + f""",
met AS (SELECT *, k % 11 <> 0 AS known, NOT ((town % 3 <> 0 AND k % 29 = 0) OR (town % 3 = 0 AND k % 2 = 0)) AS listed, k % 13 = 0 AS withdrawn,
  year(d0) >= 2021 AND {DAY} - d0 < 900 AS tracked FROM base),
counted AS (SELECT *, known AND NOT listed AND NOT withdrawn AND tracked AS missing FROM met WHERE known OR listed),
limits AS (SELECT commune, count(*) FILTER (known) AS n, count(*) FILTER (listed) AS l, count(*) FILTER (missing) AS m FROM counted GROUP BY commune),
classed AS (SELECT c.*, CASE WHEN listed AND (NOT known OR (k % 19 = 0 AND k % 5 < 3)) THEN 'todo' WHEN missing AND (l = 0 OR m > greatest(5, n // 5)) THEN 'ignored' WHEN missing THEN 'disappeared'
  WHEN NOT listed THEN 'absent' WHEN withdrawn THEN 'back' WHEN k % 17 <> 0 AND k % 31 = 0 THEN 'modified' WHEN k % 17 = 0 THEN 'baseline' ELSE 'same' END AS outcome
  FROM counted c JOIN limits USING (commune))"""


@query(f"WITH {SNAPSHOT} SELECT commune, k::VARCHAR AS id, outcome FROM classed")
def sync_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.classify(*_snapshot(spark, sf_dir), today(), 2021).select("commune", "id", "outcome")


@query(f"WITH {SNAPSHOT} SELECT commune, outcome, count(*) AS n FROM classed GROUP BY ALL")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.run_summary(sync.classify(*_snapshot(spark, sf_dir), today(), 2021))


@query(f"""WITH {SNAPSHOT} SELECT commune, k::VARCHAR AS id,
  CASE WHEN outcome = 'disappeared' THEN 'masque' WHEN outcome = 'back' THEN 'publie' WHEN withdrawn THEN 'masque' ELSE 'publie' END AS statut,
  CASE WHEN outcome = 'disappeared' THEN 'Retiré du registre officiel (constaté le 15/06/2023)' WHEN outcome = 'back' THEN '' WHEN withdrawn THEN 'Retiré du registre officiel (constaté le 01/01/2023)' ELSE '' END AS motif,
  CASE WHEN k % 17 <> 0 THEN 's' || k WHEN outcome IN ('back', 'baseline') THEN 's' || k || CASE WHEN k % 31 = 0 THEN '''' ELSE '' END END AS signature,
  CASE WHEN outcome = 'disappeared' THEN {DAY} WHEN withdrawn AND outcome <> 'back' THEN DATE '2023-01-01' END AS retire_le FROM classed WHERE known""")
def sync_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = sync.track(sync.classify(*_snapshot(spark, sf_dir), today(), 2021), today())
    return after.select("commune", "id", "statut", F.col("motif_verification").alias("motif"), "suivi_registre.signature", "suivi_registre.retire_le")


@query(f"WITH {SNAPSHOT} SELECT commune, k::VARCHAR AS id, outcome = 'modified' OR (outcome = 'back' AND k % 17 <> 0 AND k % 31 = 0) AS changed FROM classed WHERE outcome IN ('todo', 'modified') OR (outcome = 'back' AND k % 17 <> 0 AND k % 31 = 0)")
def sync_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.to_process(sync.classify(*_snapshot(spark, sf_dir), today(), 2021)).select("commune", "id", "changed")


@query(f"WITH {BASE} SELECT commune, k::VARCHAR AS id FROM base WHERE k % 11 <> 0 AND k % 23 = 0 AND k % 2 <> 0 AND k % 13 <> 0")
def geocode_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.geocode_retries(_snapshot(spark, sf_dir)[0])


@query(f"WITH {BASE} SELECT commune, count(*) AS n FROM base WHERE k % 11 <> 0 AND k % 2 <> 0 GROUP BY commune")
def reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.reprocessable(_snapshot(spark, sf_dir)[0]).groupBy("commune").agg(F.count("*").alias("n"))


@query(f"""WITH {BASE} SELECT commune, k::VARCHAR AS id, numero, CASE WHEN k % 37 = 0 THEN 'panne' WHEN k % 11 <> 0 AND k % 19 = 0 THEN 'x' WHEN k % 11 <> 0 THEN '' END AS erreur,
  CASE WHEN k % 11 <> 0 THEN (k % 5)::INT ELSE 0 END + (k % 37 = 0)::INT AS tentatives FROM base WHERE k % 11 <> 0 OR k % 37 = 0""")
def sync_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = rendered.base(spark, sf_dir).where("k % 37 = 0").select("commune", F.col("k").cast("string").alias("id"), "numero", F.lit("").alias("objet"), F.lit("panne").alias("message"))
    return sync.with_errors(_snapshot(spark, sf_dir)[0], bad).select("commune", "id", "numero", "erreur", "tentatives")


@query(f"""WITH {BASE} SELECT commune, k::VARCHAR AS id, CASE WHEN k % 3 = 0 THEN 'nouveau' ELSE numero END AS numero, CASE WHEN k % 3 = 0 THEN k::INT END AS rang FROM base WHERE k % 2 = 0 OR k % 3 = 0""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rendered.base(spark, sf_dir).select("commune", F.col("k").cast("string").alias("id"), "numero", "k")
    new = b.where("k % 3 = 0").select("commune", "id", F.lit("nouveau").alias("numero"), F.col("k").cast("int").alias("rang"))
    return sync.upsert(b.where("k % 2 = 0").drop("k"), new)


@query(f"""WITH {PERIODS} SELECT k, CASE WHEN k % 10 IN (0, 3) THEN 'voirie' ELSE categorie END AS categorie, CASE WHEN k % 10 = 3 THEN 'masque' ELSE statut END AS statut,
  CASE WHEN k % 10 IN (0, 3) THEN true ELSE false END AS manual FROM periods""")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten rows the first gets a new kind, the second an unknown one, the third an end before its start, the fourth a kind
    and a status; the second and third edits are refused."""
    decrees, edits = _edits(spark, sf_dir)
    after, _ = sync.apply_edits(decrees, edits)
    return after.select("k", "categorie", "statut", F.col("modifie_manuellement").alias("manual"))


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = rendered.periods(spark, sf_dir).withColumns({"note": F.lit(""), "motif_verification": F.lit(""), "modifie_manuellement": F.lit(False)})
    r = F.col("k") % 10
    given = F.when(r == 0, F.array(F.lit("categorie"))).when(r == 1, F.array(F.lit("categorie"))).when(r == 2, F.array(F.lit("date_debut"), F.lit("date_fin"))).otherwise(F.array(F.lit("categorie"), F.lit("statut")))
    e = d.where(r < 4).select(
        "commune", "id", given.alias("set_fields"), "titre", F.when(r == 1, "inconnue").otherwise("voirie").alias("categorie"), F.lit("2023-02-01").cast("date").alias("date_debut"),
        F.lit("2023-01-01").cast("date").alias("date_fin"), "lieu", "intervenant", "note", F.lit("masque").alias("statut"), "impacts",
    )
    return d, e


@query(f"WITH {BASE} SELECT commune, k::VARCHAR AS id, CASE k % 10 WHEN 1 THEN 'Catégorie inconnue' ELSE 'La date de fin précède la date de début' END AS reason FROM base WHERE k % 10 IN (1, 2)")
def rejected_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.apply_edits(*_edits(spark, sf_dir))[1]


@query("""WITH runs AS (SELECT 'u' || user_id % 7 AS commune, ts AS debut, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY commune ORDER BY debut DESC) AS rank FROM runs) SELECT commune, event_id, rank FROM r WHERE rank <= 15""")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("commune"), F.col("ts").alias("debut"), "event_id")
    return sync.last_runs(log).select("commune", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT 'u' || user_id % 7 AS commune, max(ts) AS fin, epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(date_trunc('second', max(ts))) > 72000 AS stale FROM events GROUP BY 1""")
def sync_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("commune"), F.col("ts").alias("debut"), F.col("ts").alias("fin"))
    return sync.last_finished(log, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("commune", "fin", "stale")


@query("""WITH k AS (SELECT DISTINCT user_id AS key FROM events), c AS (SELECT DISTINCT user_id AS key, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id / 10.0 END AS lon FROM events WHERE user_id % 2 = 0)
  SELECT k.key::VARCHAR AS key, CASE WHEN k.key % 2 = 0 THEN c.lon WHEN k.key % 3 = 0 THEN 1.5 END::DOUBLE AS lon, NOT (k.key % 2 = 0 OR k.key % 3 = 0) AS pending FROM k LEFT JOIN c ON k.key = c.key""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select(F.lit("c").alias("commune"), F.col("user_id").cast("string").alias("key"), "user_id").distinct()
    cache = u.where("user_id % 2 = 0").select("commune", "key", F.when(F.col("user_id") % 4 != 0, F.col("user_id") / 10).alias("lon"), F.lit(None).cast("double").alias("lat"))
    fresh = u.where("user_id % 3 = 0").select("commune", "key", F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat"), F.lit(False).alias("failed"))
    answers, _ = geocode.read_through(u.select("commune", "key"), cache, fresh)
    return answers.select("key", "lon", "pending")


# --- streets and places -----------------------------------------------------------------------------------------------

STREETS = f"""streets AS (SELECT n_name AS commune, n_nationkey AS town, {rendered.STREET.format("p_name")} AS name, min(p_partkey) AS seen FROM nation JOIN part ON p_partkey % {rendered.TOWNS} = n_nationkey GROUP BY ALL),
words AS (SELECT *, lower(name) AS key, lower(split_part(name, ' ', 1)) || ' ' || lower(split_part(name, ' ', 3)) AS short FROM streets)"""


@query(f"""WITH {STREETS}, f AS (SELECT DISTINCT commune, name, unnest([key, regexp_replace(key, 's\\b', '', 'g')]) AS key FROM words), s AS (SELECT commune, short AS key, min(name) AS name FROM words GROUP BY ALL HAVING count(DISTINCT name) = 1)
  SELECT commune, key, name FROM f UNION ALL SELECT commune, key, name FROM s WHERE (commune, key) NOT IN (SELECT (commune, key) FROM f)""")
def street_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.keys(spark, sf_dir).select("commune", "key", "name")


@query(f"WITH {STREETS} SELECT commune, name FROM streets")
def street_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.street_list(rendered.streets(spark, sf_dir))


def _street_texts(spark: SparkSession, sf_dir: str, typo: bool) -> DataFrame:
    """"le long de <street> puis ..." of every order; typo: one letter of the last word left out."""
    name = F.regexp_replace("street", "(.)(.)$", "$2") if typo else F.col("street")
    return rendered.base(spark, sf_dir).select("commune", F.col("k").alias("doc"), "street", streets.tokens(F.concat(F.lit("le long de "), name, F.lit(" des deux côtés"))).alias("words"))


@query(f"WITH {BASE} SELECT k AS doc, street AS name, 3 AS pos, 3 AS n FROM base")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streets.exact_matches(_street_texts(spark, sf_dir, False), rendered.keys(spark, sf_dir)).select("doc", "name", "pos", "n")


@query()
def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets with a letter left out; difflib's ratio has no SQL, the tests hold it against brute force."""
    texts, keys = _street_texts(spark, sf_dir, True), rendered.keys(spark, sf_dir)
    return streets.fuzzy_matches(texts, keys, streets.exact_matches(texts, keys)).select("doc", "name", "pos", "n", F.round("score", 6).alias("score"))


@query(f"""WITH {BASE} SELECT k, CASE k % 5 WHEN 0 THEN 'du ' || house || ' au ' || (house + 10) || ' ' || street WHEN 1 THEN house || ' ' || street WHEN 2 THEN street WHEN 3 THEN street || ', entre Rue Croix Verte et le ' || house || ' ' || street
  ELSE 'angle de ' || street || ' et Rue Croix Verte' END AS lieu, CASE k % 5 WHEN 0 THEN 'segment' WHEN 1 THEN 'point' WHEN 2 THEN 'street' WHEN 3 THEN 'segment' ELSE 'point' END AS kind FROM base""")
def extract_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pattern of the grammar written out, read, and worded again."""
    b = rendered.base(spark, sf_dir)
    house, k = F.col("house").cast("string"), F.col("k") % 5
    cross = "Rue Croix Verte"
    said = (
        F.when(k == 0, F.concat(F.lit("du "), house, F.lit(" au "), (F.col("house") + 10).cast("string"), F.lit(" "), "street"))
        .when(k == 1, F.concat(F.lit("au droit du "), house, F.lit(" "), "street"))
        .when(k == 2, F.concat(F.lit("la circulation, "), "street", F.lit(", sera interdite")))
        .when(k == 3, F.concat("street", F.lit(f", entre la {cross} et le "), house, F.lit(" "), "street"))
        .otherwise(F.concat(F.lit("à l'angle de "), "street", F.lit(f" et de la {cross}")))
    )
    known = rendered.streets(spark, sf_dir)
    extra = known.select("commune").distinct().select("commune", F.lit(cross).alias("name"), F.lit(1.0).alias("length"), F.lit(10_000).cast("long").alias("seen"))
    keys = written(streets.street_keys(known.unionByName(extra)))
    found = locations.relocate(written(b.select("commune", F.col("k").alias("doc"), said.alias("text"))), keys)
    return found.select(F.col("doc").alias("k"), locations.location_text(F.col("locations")).alias("lieu"), F.get("locations", F.lit(0))["kind"].alias("kind"))


@query("""SELECT doc_id, name FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents), (VALUES ('MIT License'), ('Apache License'), ('rights reserved')) AS p(name)
  WHERE contains(t, ' ' || lower(name) || ' ')""")
def find_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several words, looked for in every document."""
    index = spark.createDataFrame([("c", n.lower(), n, False) for n in ("MIT License", "Apache License", "rights reserved")], "commune string, key string, name string, local boolean")
    texts = table(spark, sf_dir, "documents").select(F.lit("c").alias("commune"), F.col("doc_id").alias("doc"), streets.tokens(F.col("text")).alias("words"))
    return streets.place_matches(texts, index).select(F.col("doc").alias("doc_id"), "name")


@query(f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS r, p_name FROM part) SELECT id, CASE r WHEN 0 THEN 'way' WHEN 1 THEN 'place' WHEN 2 THEN 'place' END AS target, CASE r WHEN 0 THEN 'residential' WHEN 1 THEN 'amenity' WHEN 2 THEN 'square' END AS kind FROM p WHERE r < 3""")
def route_osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as map ways: a named road, a car park without name, a pedestrian square, an unnamed road."""
    r = F.col("p_partkey") % 4
    tags = F.when(r == 0, F.create_map(F.lit("highway"), F.lit("residential"), F.lit("name"), F.col("p_name"))).when(r == 1, F.create_map(F.lit("amenity"), F.lit("parking"))).when(r == 2, F.create_map(F.lit("highway"), F.lit("pedestrian"), F.lit("name"), F.col("p_name"))).otherwise(F.create_map(F.lit("highway"), F.lit("service")))
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    ring = F.array(at(0, 0), at(0, 1), at(1, 1), at(0, 0))
    raw = table(spark, sf_dir, "part").select(F.lit("c").alias("commune"), F.col("p_partkey").alias("id"), tags.alias("tags"), F.when(r == 0, F.array(at(0, 0), at(1, 1))).otherwise(ring).alias("coords"))
    ways, places = osm.route_ways(raw)
    return ways.select("id", F.lit("way").alias("target"), F.col("highway").alias("kind")).union(places.select(F.substring("id", 2, 20).cast("long"), F.lit("place"), "kind"))


# --- geometry ---------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_nationkey AS commune, c_custkey % 50 AS street, (c_custkey // 50 * 2 + 1)::INT AS number, c_custkey AS x FROM customer WHERE c_custkey % 3 <> 0),
  w AS (SELECT DISTINCT c_nationkey AS commune, c_custkey % 50 AS street, (c_custkey // 50 * 2 + 1)::INT AS num FROM customer),
  j AS (SELECT w.*, a.x, a.number, list_position([0, -2, 2, -4, 4, -6, 6], a.number - w.num) AS rank FROM w JOIN a ON a.commune = w.commune AND a.street = w.street AND abs(a.number - w.num) <= 6)
  SELECT commune, street, num, arg_min(number, rank) AS found FROM j WHERE rank IS NOT NULL AND number > 0 GROUP BY ALL""")
def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("commune"), (F.col("c_custkey") % 50).alias("street"), (F.floor(F.col("c_custkey") / 50) * 2 + 1).cast("int").alias("number"), "c_custkey")
    known = c.where("c_custkey % 3 <> 0").select("commune", "street", "number", F.col("c_custkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return geocode.address_points(c.select("commune", "street", F.col("number").alias("num")), known).select("commune", "street", "num", "found")


@query("""SELECT c_nationkey AS commune, c_custkey % 50 AS street, avg(c_custkey::DOUBLE) AS x FROM customer GROUP BY ALL""")
def address_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("commune"), (F.col("c_custkey") % 50).alias("street"), F.struct(F.col("c_custkey").cast("double").alias("x"), F.lit(0.0).alias("y")).alias("point"))
    return geocode.mean_point(p, "commune", "street").select("commune", "street", F.col("point.x").alias("x"))


def _grid(spark: SparkSession, sf_dir: str, crossed: bool = False) -> DataFrame:
    """A street along the x axis for each even supplier and one along the y axis for each odd one, 1000 metres long; crossed: as
    much longer as it takes to meet the next supplier's, however many there are."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    end = F.greatest(F.lit(1000), k * 10 + 20) if crossed else F.lit(1000)
    along = F.when(k % 2 == 0, F.array(at(F.lit(0), k * 10), at(F.lit(400), k * 10), at(end, k * 10))).otherwise(F.array(at(k * 10, F.lit(0)), at(k * 10, end)))
    return s.select(F.lit("c").alias("commune"), k.cast("string").alias("name"), k.alias("k"), F.array(along).alias("parts"))


@query("""SELECT a.s_suppkey::VARCHAR AS a, b.s_suppkey::VARCHAR AS b, (b.s_suppkey * 10)::DOUBLE AS x, (a.s_suppkey * 10)::DOUBLE AS y FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 2 = 0""")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir, crossed=True)
    pairs = g.where("k % 2 = 0").select("commune", F.col("name").alias("a"), (F.col("k") + 1).cast("string").alias("b"))
    found = geocode.crossings(pairs, g.select("commune", "name", "parts"))
    return found.select("a", "b", F.round("point.x", 2).alias("x"), F.round("point.y", 2).alias("y"))


@query("""SELECT s_suppkey::VARCHAR AS street, CASE WHEN s_suppkey % 2 = 0 THEN 300.0 ELSE 300.0 END::DOUBLE AS between, 50.0::DOUBLE AS around FROM supplier""")
def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    at = lambda d: F.when(F.col("k") % 2 == 0, F.struct(F.lit(d).alias("x"), (F.col("k") * 10.0 + 3).alias("y"))).otherwise(F.struct((F.col("k") * 10.0 + 3).alias("x"), F.lit(d).alias("y")))
    asked = g.select("commune", F.col("name").alias("street"), at(250.0).alias("p"), at(550.0).alias("q"), at(500.0).alias("point"), F.lit(25.0).alias("half"))
    known = g.select("commune", "name", "parts")
    one = geocode.stretches_between(asked.select("commune", "street", "p", "q"), known).select("street", F.round(geocode.line_length(F.col("line")), 2).alias("between"))
    two = geocode.stretches_around(asked.select("commune", "street", "point", "half"), known).select("street", F.round(geocode.line_length(F.col("line")), 2).alias("around"))
    return one.join(two, "street")


@query("""SELECT s_suppkey AS id, (s_suppkey // 2 * 2)::VARCHAR AS street, CASE WHEN s_suppkey % 2 = 0 THEN 4.0 ELSE 16.0 END::DOUBLE AS away FROM supplier""")
def common_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points beside each supplier's row of the even streets, which lie 20 metres apart."""
    g = _grid(spark, sf_dir).where("k % 2 = 0")
    k = F.col("s_suppkey")
    y = F.floor(k / 2) * 20 + F.when(k % 2 == 0, 2.0).otherwise(8.0)
    at = lambda x: F.struct(F.lit(x).alias("x"), y.cast("double").alias("y"))
    asked = table(spark, sf_dir, "supplier").select(F.lit("c").alias("commune"), k.alias("id"), at(1500.0 - 1400).alias("p"), at(700.0).alias("q"))
    return geocode.common_streets(asked, g.select("commune", "name", "parts")).select("id", "street", F.round("away", 2).alias("away"))


@query("""SELECT s_nationkey AS town, min(s_acctbal) AS west, max(s_acctbal) AS east, min(s_suppkey)::DOUBLE AS south, max(s_suppkey)::DOUBLE AS north FROM supplier GROUP BY 1""")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("town"), F.array(F.struct(F.col("s_acctbal").alias("lon"), F.col("s_suppkey").cast("double").alias("lat"))).alias("line"))
    return geocode.bounds(s, "town").select("town", "west", "east", "south", "north")


@query()
def merged_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' places in time as ways of their customer's street, joined end to end; tested against brute force."""
    o = table(spark, sf_dir, "orders")
    d = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    at = lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    ways = o.select((F.col("o_custkey") % 25).cast("string").alias("commune"), F.col("o_custkey").cast("string").alias("name"), F.array(at(d), at(d + 1)).alias("coords")).distinct()
    merged = geocode.merged_streets(ways)
    icons = geocode.icon_positions(merged.select("commune", "name", F.size("parts").alias("parts"), "length", F.col("parts").alias("lines"), F.array().cast(geocode.PARTS).alias("polygons")))
    return icons.select("commune", "name", "parts", "length", "icon")


@query(f"""WITH {PERIODS} SELECT k, CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'approx' ELSE 'street' END AS quality FROM periods""")
def locate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    told = F.when(k == 2, F.array(F.lit("precise"), F.lit("street"))).otherwise(F.array(F.lit("precise"), F.lit("none")))
    return rendered.periods(spark, sf_dir).select("k", geocode.worst_quality(told, k == 1).alias("quality"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 90 > 50 THEN 'GeoJSON invalide' WHEN c_custkey % 7 = 0 AND c_custkey % 90 > 0 THEN 'Type de géométrie non pris en charge' END AS error, CASE WHEN abs(c_acctbal) > 180 THEN 'Coordonnées invalides' END AS place FROM customer""")
def validate_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 7 == 0, "GeometryCollection").otherwise("Point")
    types = F.array_repeat(kind, (F.col("c_custkey") % 90).cast("int"))
    return c.select("c_custkey", geocode.geojson_error(types, types).alias("error"), geocode.lonlat_error(F.col("c_acctbal"), F.lit(45.0)).alias("place"))


@query(f"""WITH {PERIODS}, f AS (SELECT commune, id, k, unnest([0, 1]) AS n, impacts FROM periods)
  SELECT commune, row_number() OVER (PARTITION BY commune ORDER BY k, id, n) - 1 AS fid, id, CASE n WHEN 0 THEN 'impact' ELSE 'deviation' END AS role,
  CASE WHEN list_contains(impacts, 'route_barree') THEN '#ff3b30' WHEN list_contains(impacts, 'trottoir') THEN '#af52de' ELSE '#8e8e93' END AS colour FROM f""")
def map_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rendered.periods(spark, sf_dir)
    shape = lambda role: F.struct(F.lit(role).cast("string").alias("role"), F.lit("{}").alias("geometry"))
    rows = p.select("commune", "id", "impacts", F.col("k").alias("order_key"), F.array(shape(None), shape("deviation")).alias("features"))
    return views.map_layer(rows).select("commune", F.col("fid").cast("long").alias("fid"), "id", "role", "colour")


@query(f"""WITH {BASE} SELECT commune, k::VARCHAR AS doc, '{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"role":"impact"}},"geometry":{{"type":"Point","coordinates":[' || house || ',1]}}}},{{"type":"Feature","properties":{{"role":"deviation","name":"' || street || '"}},"geometry":{{"type":"Point","coordinates":[0,0]}}}}]}}' AS geojson FROM base""")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = rendered.base(spark, sf_dir)
    impact = F.struct(F.lit("impact").alias("role"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("["), F.col("house").cast("string"), F.lit(",1]")).alias("coordinates"))
    way = F.struct(F.lit("deviation").alias("role"), F.lit(0).alias("place"), F.col("street").alias("name"), F.lit("[0,0]").alias("coordinates"))
    rows = b.select("commune", F.col("k").cast("string").alias("doc"), F.explode(F.array(way, impact)).alias("f")).select("commune", "doc", "f.*", F.lit("Point").alias("type"))
    return geocode.features(rows)


@query("""SELECT o_custkey % 25 AS town, round(CASE WHEN o_custkey % 25 % 2 = 0 THEN 4 ELSE avg(o_orderkey % 360 + 0.5::DOUBLE) END, 4)::DOUBLE AS lon, round(CASE WHEN o_custkey % 25 % 2 = 0 THEN o_custkey % 25 + 1 ELSE avg((o_orderkey % 90)::DOUBLE) END, 4)::DOUBLE AS lat FROM orders GROUP BY 1, o_custkey % 25""")
def map_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways of 25 towns; every other town has a boundary of two squares side by side, eight wide with the gap."""
    k, town = F.col("o_orderkey"), F.col("o_custkey") % 25
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ways = table(spark, sf_dir, "orders").select(town.alias("commune"), F.array(at(k % 360, k % 90), at(k % 360 + 1, k % 90)).alias("coords"))
    high = (F.col("commune") + 1) * 2
    ring = lambda a, b: F.array(at(F.lit(a), F.lit(0)), at(F.lit(a), high), at(F.lit(b), high), at(F.lit(b), F.lit(0)), at(F.lit(a), F.lit(0)))
    members = ways.select("commune").distinct().where("commune % 2 = 0").select("commune", F.lit("outer").alias("role"), F.explode(F.array(ring(0, 3), ring(5, 8))).alias("coords"))
    found = geocode.map_centres(ways, geocode.boundary_rings(members))
    return found.select(F.col("commune").alias("town"), F.round("lon0", 4).alias("lon"), F.round("lat0", 4).alias("lat"))


_SPOTS = """o AS (SELECT o_orderkey AS k, (o_orderkey % 17)::INT AS way, (o_orderkey % 35 * 2 + 1)::INT AS h FROM orders), a AS (SELECT *, 10 * h + 2 AS x FROM o),
  b AS (SELECT *, CASE WHEN abs(x - 100) < 10 THEN 50 ELSE abs(x - 100) END AS part, CASE WHEN way = 16 THEN x + 10 ELSE x END AS m FROM a)"""


def _spots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, geocoding.Reference]:
    """Each order an act that names one location of a kind by its key, in the town of a supplier: Rue H from west to east, Rue V
    and Rue W across it, Rue P apart from them; Rue Q is in the addresses only."""
    k = F.col("o_orderkey")
    h = (k % 35 * 2 + 1).cast("int")
    text = lambda c: c.cast("string") if isinstance(c, F.Column) else F.lit(c).cast("string")

    def anchor(kind: str, num=None, num2=None, street=None, both: tuple[str, str] | None = None) -> F.Column:
        two = F.array(*[F.lit(s) for s in both]) if both else F.lit(None)
        return F.struct(F.lit(kind).alias("type"), text(num).alias("num"), text(num2).alias("num2"), text(street).alias("street"), two.cast("array<string>").alias("streets")).cast(locations.ANCHOR)

    def spot(kind: str, street=None, name=None, anchor=None, start=None, end=None) -> F.Column:
        of = lambda a: F.lit(None).cast(locations.ANCHOR) if a is None else a
        return F.struct(F.lit(kind).alias("kind"), text(street).alias("street"), text(name).alias("name"), of(anchor).alias("anchor"), of(start).alias("from"), of(end).alias("to")).cast(locations.LOCATION)

    house, nowhere = anchor("address", h, None, "Rue H"), anchor("address", 900, None, "Rue P")
    v, w = anchor("intersection", both=("Rue H", "Rue V")), anchor("intersection", both=("Rue H", "Rue W"))
    street, unknown = spot("street", "Rue H"), spot("place", None, "Gymnase")
    ways = [
        [street], [spot("place", None, "Parc")], [unknown], [spot("point", anchor=house)], [spot("point", anchor=anchor("address", h, None, "Rue P"))], [spot("point", anchor=v)],
        [spot("point", anchor=anchor("intersection", both=("Rue H", "Rue P")))], [spot("segment", "Rue H", None, None, house, anchor("address", h + 8, None, "Rue H"))], [spot("segment", "Rue H", None, None, house, v)],
        [spot("segment", None, None, None, house, anchor("address", 5, None, "Rue V"))], [spot("segment", "Rue H", None, None, house, nowhere)], [spot("segment", "Rue P", None, None, nowhere, nowhere)],
        [street, unknown], [], [spot("point", anchor=anchor("address", 7, None, "Rue Q"))], [spot("segment", "Rue H", None, None, v, w)], [spot("point", anchor=anchor("address", h, h + 2, "Rue H"))],
    ]
    found = F.lit(None).cast(f"array<{locations.LOCATION}>")
    for n, named in enumerate(ways):
        found = F.when(k % len(ways) == n, F.array(*named).cast(f"array<{locations.LOCATION}>")).otherwise(found)
    s = table(spark, sf_dir, "supplier")
    town = F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("commune")
    acts = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (k % s.count()).cast("string")).alias("commune"), k.alias("id"), found.alias("localisations"), F.when(k % 17 == 12, F.array(F.lit("Rue V"), F.lit("Rue X"))).alias("deviation"))
    line = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    rows = [("Rue H", line((0, 0), (400, 0), (1000, 0))), ("Rue V", line((100, -200), (100, 200))), ("Rue W", line((600, -200), (600, 200))), ("Rue P", line((0, 5000), (300, 5000)))]
    shapes = lambda rows: s.select(town, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.array(p).alias("parts")) for name, p in rows])).alias("r")).select("commune", "r.*")
    places = shapes([("Parc", line((0, 0), (0, 100), (100, 100), (100, 0), (0, 0)))]).select("commune", "name", F.lit("Polygon").alias("type"), "parts")
    on = lambda street, number, x, y: F.struct(F.lit(street).alias("street"), number.cast("int").alias("number"), x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    known = F.concat(F.transform(F.sequence(F.lit(1), F.lit(79), F.lit(2)), lambda i: on("Rue H", i, i * 10 + 2, 5)), F.array(on("Rue V", F.lit(5), F.lit(103), 50), on("Rue Q", F.lit(7), F.lit(1), 9)))
    pending = s.select(town, F.lit("Rue P").alias("street"), F.lit(900).alias("num"))
    return acts, geocoding.Reference(shapes(rows), s.select(town, F.explode(known).alias("a")).select("commune", "a.*"), places, s.select(town, F.lit(4.5).alias("lon0"), F.lit(45.5).alias("lat0")), pending)


@query(f"""WITH {_SPOTS} SELECT k, CASE way WHEN 0 THEN 'street' WHEN 2 THEN 'none' WHEN 4 THEN 'approx' WHEN 6 THEN 'none' WHEN 10 THEN 'approx' WHEN 11 THEN 'approx' WHEN 12 THEN 'approx' WHEN 13 THEN 'none' ELSE 'precise' END AS quality,
  (CASE WHEN way IN (2, 6, 13) THEN 0 WHEN way IN (5, 9) THEN 2 ELSE 1 END)::BIGINT AS impacts, (way = 12)::BIGINT AS deviations,
  (CASE way WHEN 0 THEN 1000 WHEN 3 THEN m + 25 - greatest(0, m - 25) WHEN 4 THEN 300 WHEN 5 THEN 120 WHEN 7 THEN 80 WHEN 8 THEN part WHEN 9 THEN part + 50 WHEN 10 THEN m + 40 - greatest(0, m - 40) WHEN 11 THEN 300 WHEN 12 THEN 1000 WHEN 15 THEN 500 WHEN 16 THEN m + 25 - greatest(0, m - 25) ELSE 0 END)::DOUBLE AS metres,
  way IN (10, 11) AS waits, way NOT IN (2, 6, 13) AS centred FROM b""")
def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung of the ladder, read back from the GeoJSON: how well, how many features, how many metres of lines."""
    acts, reference = _spots(spark, sf_dir)
    out = geocoding.geocoded(acts, reference)
    shape = "features array<struct<properties:struct<role:string>,geometry:struct<type:string,coordinates:string>>>"
    held = out.withColumn("f", F.from_json("geojson", shape)["features"])
    role = lambda r: F.size(F.filter("f", lambda f: f["properties"]["role"] == r)).cast("long")
    lines = F.transform(F.filter("f", lambda f: (f["properties"]["role"] == "impact") & (f["geometry"]["type"] == "LineString")), lambda f: F.from_json(f["geometry"]["coordinates"], "array<array<double>>"))
    metres = F.transform(lines, lambda line: geocode.line_length(F.transform(line, lambda p: geocode.to_metres(p[0], p[1], F.lit(4.5), F.lit(45.5)))))
    return held.select(F.col("id").alias("k"), F.col("qualite_geo").alias("quality"), role("impact").alias("impacts"), role("deviation").alias("deviations"), F.round(F.aggregate(metres, F.lit(0.0), lambda t, x: t + x), 2).alias("metres"), F.col("geocodage_incomplet").alias("waits"), F.col("centre").isNotNull().alias("centred"))


@query(f"""WITH {BASE}, {STREETS}, d AS (SELECT k, house, seen, CASE house % 4 WHEN 1 THEN house WHEN 3 THEN house - 2 END AS num FROM base b JOIN streets s ON s.commune = b.commune AND s.name = b.street)
  SELECT k, CASE WHEN num IS NULL THEN 'approx' ELSE 'precise' END AS qualite_geo, CASE WHEN num IS NULL THEN 'a_verifier' ELSE 'publie' END AS statut, CASE WHEN num IS NULL THEN 'localisation approximative' ELSE '' END AS motif,
  round((CASE WHEN num IS NULL THEN 500 WHEN num = 1 THEN 17.5 ELSE 10 * num END)::DOUBLE / 111320, 6) AS lon, round((10 * seen)::DOUBLE / 110540, 6) AS lat FROM d""")
def geocoded_decrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to drawn acts: an address publishes the act, a street without one leaves it to be checked."""
    rows = extraction.decree_rows(_texts(spark, sf_dir), rendered.keys(spark, sf_dir), today(), reference=rendered.reference(spark, sf_dir))
    return rows.select(F.col("id").alias("k"), "qualite_geo", "statut", F.col("motif_verification").alias("motif"), F.col("centre")[0].alias("lon"), F.col("centre")[1].alias("lat"))


# --- table queries ----------------------------------------------------------------------------------------------------


@query(f"WITH {PERIODS} SELECT statut, count(*) AS n FROM periods GROUP BY statut")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.status_counts(rendered.periods(spark, sf_dir))


@query(f"WITH {PERIODS} SELECT k, date_publication, numero FROM periods WHERE statut = 'a_verifier'")
def admin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.admin_list(rendered.periods(spark, sf_dir), "a_verifier").select("k", "date_publication", "numero")


@query(f"WITH {PERIODS} SELECT k, numero FROM periods WHERE contains(lower(concat_ws(' ', numero, titre, lieu, '')), 'benne rue')")
def admin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.admin_search(rendered.periods(spark, sf_dir).withColumn("objet_registre", F.lit("")), "Benne Rue").select("k", "numero")


@query(f"""WITH {PERIODS} SELECT k FROM periods WHERE categorie IN ('voirie', 'reseaux') AND list_has_any(impacts, ['trottoir', 'vitesse']) AND contains(lower(strip_accents(titre || ' ' || lieu || ' ' || intervenant || ' ' || numero || ' ' || street)), 'refection')""")
def filter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.filtered(rendered.periods(spark, sf_dir), today(), "tous", True, ("voirie", "reseaux"), ("trottoir", "vitesse"), "Réfection").select("k")


@query(f"WITH {PERIODS} SELECT k, titre FROM periods WHERE id = '1234'")
def decree_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.periods(spark, sf_dir).where("id = '1234'").select("k", "titre")


@query(f"""WITH {PERIODS} SELECT categorie, CASE categorie WHEN 'demenagement' THEN 'Déménagement' WHEN 'evenement' THEN 'Événement, manifestation' WHEN 'chantier' THEN 'Échafaudage, benne, nacelle' WHEN 'reseaux' THEN 'Travaux de réseaux' ELSE 'Travaux de voirie' END AS label, count(*) AS n FROM periods GROUP BY ALL""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.periods(spark, sf_dir).groupBy("categorie").agg(F.count("*").alias("n")).withColumn("label", fields.category_label(F.col("categorie")))


# --- incremental run --------------------------------------------------------------------------------------------------


@query(f"""WITH {BASE}, m AS (SELECT *, k % 7 <> 0 AS known, k % 29 <> 0 AS listed, year(d0) >= 2021 AND {DAY} - d0 < 900 AS tracked FROM base WHERE k % 7 <> 0 OR k % 29 <> 0),
  l AS (SELECT commune, count(*) FILTER (known) AS n, count(*) FILTER (known AND NOT listed AND tracked) AS missing FROM m GROUP BY commune)
  SELECT commune, k::VARCHAR AS id, CASE WHEN known AND NOT listed AND tracked AND missing <= greatest(5, n // 5) THEN 'masque' ELSE 'publie' END AS statut,
  's' || k || CASE WHEN k % 31 = 0 AND listed THEN '''' ELSE '' END AS signature FROM m JOIN l USING (commune)""")
def sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the orders, a run after each: the second lacks some acts, has others changed and new ones."""
    import uuid

    from municipia.sources.tables import shared_dir
    from municipia.streaming import sync_stream as stream

    b, k = rendered.base(spark, sf_dir), F.col("k")
    act = lambda mark, day: b.select("commune", k.cast("string").alias("id"), "numero", F.lit("").alias("objet"), F.col("d0").alias("date_decision"), F.col("d0").alias("date_publication"), F.concat(F.lit("s"), k.cast("string"), mark).alias("signature"), F.lit(day).cast("date").alias("seen_on"), "k")
    folder = f"{shared_dir(spark)}/sync-{uuid.uuid4().hex}"
    act(F.lit(""), "2023-06-01").where("k % 7 <> 0").drop("k").write.mode("append").parquet(f"{folder}/in")
    stream.run_available(spark, f"{folder}/in", f"{folder}/decrees", 2021)
    act(F.when(k % 31 == 0, "'").otherwise(""), TODAY).where("k % 29 <> 0").drop("k").write.mode("append").parquet(f"{folder}/in")
    after = stream.run_available(spark, f"{folder}/in", f"{folder}/decrees", 2021)
    return after.select("commune", "id", "statut", "suivi_registre.signature")


# --- single rules, over every order --------------------------------------------------------------------------------------


@query(f"""WITH {BASE} SELECT k, 'Le 1er septembre, n° ' || k || ' - voie " ' || street || ' " : stationnement interdit à 8 h' AS cleaned FROM base""")
def ocr_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text recogniser writes amiss: the first of a month, dashes, quotes, a word cut at a line's end, hard blanks."""
    b = rendered.base(spark, sf_dir)
    said = F.concat(F.lit("Le 1” septembre, n° "), F.col("k").cast("string"), F.lit(" — voie « "), "street", F.lit(" » : stationne-\nment interdit à 8 h"))
    return b.select("k", text.clean_ocr(said).alias("cleaned"))


@query(f"WITH {BASE} SELECT k, house || ' rue du ' || k || ' mai 100' AS plain FROM base")
def leading_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("00"), F.col("house").cast("string"), F.lit(" rue du 0"), F.col("k").cast("string"), F.lit(" mai 100"))
    return rendered.base(spark, sf_dir).select("k", text.without_leading_zeros(said).alias("plain"))


@query(f"""WITH {BASE} SELECT k, CASE WHEN d BETWEEN d0 - 400 AND d0 + 2920 THEN d END AS found FROM (SELECT *, make_date(year(d0) - 6 + 5 * (k % 4)::INT, 3, 3) AS d FROM base)""")
def plausible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years too far from the reference date are none of the act's."""
    b = rendered.base(spark, sf_dir)
    said = F.concat(F.lit("le 3 mars "), (F.year("d0") - 6 + 5 * (F.col("k") % 4)).cast("string"), F.lit(" au soir"))
    return b.select("k", F.get(calendar_fr.find_dates(said, F.col("d0")), F.lit(0))["d"].alias("found"))


@query(f"""WITH {PERIODS}, o AS (SELECT *, coalesce(coalesce(date_fin, date_debut) < {DAY}, false) AS ended FROM periods)
  SELECT commune, k, row_number() OVER (PARTITION BY commune ORDER BY ended, CASE WHEN ended THEN date_fin END DESC NULLS LAST, NOT ended AND date_debut IS NULL, CASE WHEN NOT ended THEN date_debut END, CASE WHEN NOT ended THEN date_fin END NULLS FIRST, k) AS place FROM o""")
def list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the public list: live acts by their days, then ended ones from the latest."""
    p = rendered.periods(spark, sf_dir).withColumn("key", views.list_order(F.col("date_debut"), F.col("date_fin"), today()))
    return p.select("commune", "k", F.row_number().over(Window.partitionBy("commune").orderBy("key", "k")).alias("place"))


@query(f"""WITH {BASE} SELECT k, CASE WHEN k % 3 = 0 THEN strftime(d0, '%Y-%m-%d') || ' 8h–12h,' || strftime(d0 + 1, '%Y-%m-%d') || ' 9h30–' || (k % 8 + 10) || 'h' WHEN k % 3 = 1 THEN strftime(d0, '%Y-%m-%d') || ',' || strftime(d0 + 1, '%Y-%m-%d') END AS days,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '8h–12h,du lundi au vendredi' ELSE '8h–12h,9h30–' || (k % 8 + 10) || 'h' END AS notes FROM base""")
def hours_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours beside each day where there are as many, else beside all of them."""
    b, k = rendered.base(spark, sf_dir), F.col("k")
    late = F.concat(F.lit("9h30–"), (k % 8 + 10).cast("string"), F.lit("h00"))
    days = F.when(k % 3 < 2, F.array("d0", F.date_add("d0", 1))).otherwise(F.array("d0"))
    hours = F.when(k % 3 == 1, F.array(F.lit("8h00–12h00"))).otherwise(F.array(F.lit("8h00–12h00"), late))
    remarks = F.when(k % 3 == 1, F.array(F.lit("du lundi au vendredi"), F.lit("hors week-end"))).otherwise(F.array().cast("array<string>"))
    shown = F.array_join(F.transform(views.hours_per_day(days, hours), lambda x: F.concat_ws(" ", F.date_format(x["day"], "yyyy-MM-dd"), x["hours"])), ",")
    return b.select("k", shown.alias("days"), F.array_join(views.hour_notes(days, hours, remarks), ",").alias("notes"))


@query("SELECT n_name AS commune, count(*) AS ways FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) >= 60")
def usable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return streets.usable_references(c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("commune")), 60)


@query("""SELECT p_partkey % 25 AS commune, p_partkey::VARCHAR AS nom, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE 'shipped' END AS source FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def override_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places shipped for every even part, and own ones for every third: own ones replace or are added."""
    k = F.col("p_partkey")
    named = lambda every, source: table(spark, sf_dir, "part").where(k % every == 0).select((k % 25).alias("commune"), k.cast("string").alias("nom"), F.lit(source).alias("source"))
    return streets.override_places(named(2, "shipped"), named(3, "own"))


@query(f"WITH {BASE} SELECT k, (['b,c', 'a,c', 'a,c', 'a,b', 'a,b'])[k % 5 + 1] AS kept FROM base")
def without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a at 0-3, b at k % 5 and the next, and c at 4-6, those that start where the last one kept has ended."""
    span = lambda a, b, name: F.struct(F.lit(a).cast("int").alias("start") if isinstance(a, int) else a.alias("start"), F.lit(b).cast("int").alias("end") if isinstance(b, int) else b.alias("end"), F.lit(name).alias("name"), F.lit(1.0).alias("score"))
    s = (F.col("k") % 5).cast("int")
    kept = streets.without_overlaps(F.array(span(4, 6, "c"), span(s, s + 2, "b"), span(0, 3, "a")))
    return rendered.base(spark, sf_dir).select("k", F.array_join(F.transform(kept, lambda m: m["name"]), ",").alias("kept"))
