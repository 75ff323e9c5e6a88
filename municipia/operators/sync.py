"""Keeping the decree table in step with registry snapshots, for all communes in one run.

``decrees`` has commune, id, numero, date_decision, date_publication, statut, motif_verification, modifie_manuellement,
erreur, tentatives and suivi_registre (schemas.TRACKING); ``acts`` is schemas.ACTS with signature. One full outer join by
(commune, id) tells every row's class; the document texts stay out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from municipia.functions import constants as K

WITHDRAWN = "Retiré du registre officiel"
CHANGED = "Arrêté modifié au registre officiel : vérifier les corrections manuelles (dates, rues, tracé) par rapport au nouveau document"
FAILED = "Erreur de traitement automatique"


def tracked(published: Column, decided: Column, start_year: int, today: Column) -> Column:
    """Whether an act is recent enough for its disappearance to count as a withdrawal."""
    d = F.coalesce(published, decided)
    return F.coalesce((F.year(d) >= start_year) & (F.datediff(today, d) < K.TRACKED_DAYS), F.lit(False))


def _failed(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}erreur"), F.lit("")) != ""


def classify(decrees: DataFrame, acts: DataFrame, today: Column, start_year: int) -> DataFrame:
    """decrees' columns, act (struct, null without one), outcome: todo, disappeared, ignored, back, modified, baseline, same,
    or absent (gone, but not tracked or withdrawn already). back_modified tells a returned act that has changed."""
    held = decrees.withColumn("known", F.lit(True))
    met = held.join(acts.select("commune", "id", F.struct("*").alias("act")), ["commune", "id"], "full")
    suivi, known, listed = F.col("suivi_registre"), F.col("known").isNotNull(), F.col("act").isNotNull()
    withdrawn = suivi["retire_le"].isNotNull()
    missing = known & ~listed & ~withdrawn & tracked(F.col("date_publication"), F.col("date_decision"), start_year, today)
    counts = met.groupBy("commune").agg(F.count("known").alias("rows"), F.count("act").alias("listed"), F.count_if(missing).alias("missing"))
    met = met.join(counts, "commune")
    guard = (F.col("listed") == 0) | (F.col("missing") > F.greatest(F.lit(K.GUARD_LEAST), F.floor(F.col("rows") / K.GUARD_SHARE)))
    todo = listed & (~known | (_failed() & (F.col("tentatives") < K.MAX_ATTEMPTS)))
    changed = suivi["signature"].isNotNull() & (suivi["signature"] != "") & (suivi["signature"] != F.col("act.signature"))
    outcome = (
        F.when(todo, "todo")
        .when(missing & guard, "ignored")
        .when(missing, "disappeared")
        .when(~listed, "absent")
        .when(withdrawn, "back")
        .when(changed, "modified")
        .when(F.coalesce(suivi["signature"], F.lit("")) == "", "baseline")
        .otherwise("same")
    )
    return met.withColumn("outcome", outcome).withColumn("back_modified", (F.col("outcome") == "back") & F.coalesce(changed, F.lit(False))).drop("known", "rows", "listed", "missing")


def track(classed: DataFrame, today: Column, recomputed: DataFrame | None = None) -> DataFrame:
    """The rows of the table after tracking: withdrawn acts are hidden, returned ones restored, fingerprints taken.

    recomputed (commune, id, statut, motif_verification): what a new calculation gives for rows that return unedited."""
    s, manual = F.col("suivi_registre"), F.coalesce("modifie_manuellement", F.lit(False))
    out = classed.where("outcome <> 'todo' or statut is not null")
    if recomputed is not None:
        out = out.join(recomputed.select("commune", "id", F.col("statut").alias("new_statut"), F.col("motif_verification").alias("new_motif")), ["commune", "id"], "left")
    else:
        out = out.withColumns({"new_statut": F.lit(None).cast("string"), "new_motif": F.lit(None).cast("string")})
    gone, back = F.col("outcome") == "disappeared", F.col("outcome") == "back"
    free = back & ~manual & ~_failed()
    restore = back & ~free & (F.col("statut") == "masque") & F.startswith(F.coalesce("motif_verification", F.lit("")), F.lit(WITHDRAWN))
    reason = F.concat(F.lit(f"{WITHDRAWN} (constaté le "), F.date_format(today, "dd/MM/yyyy"), F.lit(")"))
    nothing = F.lit(None).cast("string")
    signature = F.when((F.col("outcome").isin("back", "baseline")) & (F.coalesce(s["signature"], F.lit("")) == ""), F.col("act.signature")).otherwise(s["signature"])
    suivi = F.struct(
        signature.alias("signature"),
        F.when(gone, today).when(back, F.lit(None).cast("date")).otherwise(s["retire_le"]).alias("retire_le"),
        F.when(gone, F.col("statut")).when(back, nothing).otherwise(s["statut_avant"]).alias("statut_avant"),
        F.when(gone, F.col("motif_verification")).when(back, nothing).otherwise(s["motif_avant"]).alias("motif_avant"),
    )
    statut = F.when(gone, "masque").when(free, F.coalesce("new_statut", s["statut_avant"], F.lit("a_verifier"))).when(restore, F.coalesce(s["statut_avant"], F.lit("a_verifier"))).otherwise(F.col("statut"))
    motif = F.when(gone, reason).when(free, F.coalesce("new_motif", s["motif_avant"], F.lit(""))).when(restore, F.coalesce(s["motif_avant"], F.lit(""))).otherwise(F.col("motif_verification"))
    return out.withColumns({"suivi_registre": suivi, "statut": statut, "motif_verification": motif}).drop("new_statut", "new_motif")


def to_process(classed: DataFrame) -> DataFrame:
    """commune, id, act, changed: acts to read anew, unknown or failed ones and those that changed."""
    changed = (F.col("outcome") == "modified") | F.col("back_modified")
    return classed.where((F.col("outcome") == "todo") | changed).select("commune", "id", "act", changed.alias("changed"))


def ingest_status(manual: Column, changed: Column, old_status: Column, old_reason: Column, withdrawn: Column, status: Column, reason: Column) -> tuple[Column, Column]:
    """(status, reason) of a row read anew: edits by hand stay, and are to be checked if the act changed and isn't hidden."""
    check = changed & manual & (old_status != "masque")
    kept = manual | withdrawn
    return (
        F.when(check, "a_verifier").when(kept, old_status).otherwise(status),
        F.when(check, CHANGED).when(kept, old_reason).otherwise(reason),
    )


def with_errors(decrees: DataFrame, errors: DataFrame) -> DataFrame:
    """The table with errors (commune, id, numero, objet, message) noted: attempts counted, unknown acts added."""
    met = decrees.join(errors.select("commune", "id", F.col("numero").alias("e_numero"), F.col("message")), ["commune", "id"], "full")
    bad = F.col("message").isNotNull()
    return met.withColumns({
        "numero": F.coalesce("numero", "e_numero"),
        "erreur": F.when(bad, F.substring("message", 1, 2000)).otherwise(F.col("erreur")),
        "tentatives": F.coalesce("tentatives", F.lit(0)) + F.when(bad, 1).otherwise(0),
        "statut": F.coalesce("statut", F.lit("a_verifier")),
        "motif_verification": F.when(bad, FAILED).otherwise(F.col("motif_verification")),
    }).drop("e_numero", "message")


def geocode_retries(decrees: DataFrame) -> DataFrame:
    """commune, id of rows whose geocoding was cut short, neither edited nor withdrawn."""
    return decrees.where("geocodage_incomplet and not coalesce(modifie_manuellement, false) and suivi_registre.retire_le is null").select("commune", "id")


def reprocessable(decrees: DataFrame, force: bool = False) -> DataFrame:
    """Rows to compute anew: those not edited, or all with their edit mark dropped."""
    return decrees.withColumn("modifie_manuellement", F.lit(False)) if force else decrees.where(~F.coalesce("modifie_manuellement", F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows of the same (commune, id) replaced whole and others added; the columns of both, null where absent."""
    return table.join(rows.select("commune", "id"), ["commune", "id"], "left_anti").unionByName(rows, allowMissingColumns=True)


EDITABLE = ("titre", "categorie", "date_debut", "date_fin", "lieu", "intervenant", "note", "statut")


def apply_edits(decrees: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table after edits, rejected: commune, id, reason).

    edits: commune, id, set_fields array<string>, and the columns of EDITABLE with impacts; only fields in set_fields apply. A
    row without a decree, of an unknown kind, impact or status, or whose end precedes its start is rejected whole."""
    fields = (*EDITABLE, "impacts")
    new = edits.select("commune", "id", "set_fields", F.struct(*fields).alias("new"))
    met = decrees.withColumn("known", F.lit(True)).join(new, ["commune", "id"], "full")
    given = lambda f: F.coalesce(F.array_contains("set_fields", f), F.lit(False))
    after = {f: F.when(given(f), F.col(f"new.{f}")).otherwise(F.col(f)) for f in fields}
    known = lambda c, values: c.isin(*values)
    allowed = F.array(*[F.lit(i) for i in K.IMPACTS])
    error = (
        F.when(F.col("known").isNull(), "Arrêté inconnu")
        .when(given("categorie") & ~F.coalesce(known(F.col("new.categorie"), K.CATEGORIES), F.lit(False)), "Catégorie inconnue")
        .when(given("impacts") & (F.size(F.array_except(F.col("new.impacts"), allowed)) > 0), "Mesure inconnue")
        .when(given("statut") & ~F.coalesce(known(F.col("new.statut"), K.STATUSES), F.lit(False)), "Statut inconnu")
        .when(after["date_fin"] < after["date_debut"], "La date de fin précède la date de début")
    )
    met = met.withColumn("reason", F.when(F.col("new").isNotNull(), error))
    ok = F.col("new").isNotNull() & F.col("reason").isNull()
    touched = ok & (F.size("set_fields") > 0)
    changes = {f: F.when(ok, after[f]).otherwise(F.col(f)) for f in fields}
    changes["motif_verification"] = F.when(ok & given("statut") & (F.col("new.statut") == "publie"), "").otherwise(F.col("motif_verification"))
    changes["modifie_manuellement"] = F.when(touched, True).otherwise(F.col("modifie_manuellement"))
    rejected = met.where("reason is not null").select("commune", "id", "reason")
    return met.where("known").withColumns(changes).drop("known", "new", "set_fields", "reason"), rejected


def run_summary(classed: DataFrame) -> DataFrame:
    """commune, outcome, n."""
    return classed.groupBy("commune", "outcome").agg(F.count("*").alias("n"))


def journal_row(summary: DataFrame, started: Column, ended: Column, trigger: str) -> DataFrame:
    """One row for each commune: start, end, trigger, counts, and a message that names what happened."""
    words = {"todo": "à traiter", "disappeared": "retiré(s) du registre, masqué(s)", "ignored": "absent(s) du registre ignoré(s) (réponse incomplète ?)", "back": "réapparu(s) au registre", "modified": "modifié(s) au registre, retraité(s)"}
    counts = summary.groupBy("commune").agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(o) for o in words])
    said = F.array_join(F.array_compact(F.array(*[F.when(F.col(o) > 0, F.concat(F.col(o).cast("string"), F.lit(f" {w}"))) for o, w in words.items()])), " | ")
    return counts.select("commune", started.alias("debut"), ended.alias("fin"), F.lit(trigger).alias("declencheur"), F.col("todo").alias("nouveaux"), said.alias("message"))


def last_runs(log: DataFrame, k: int = 15) -> DataFrame:
    """The k last runs of each commune, newest first."""
    rank = F.row_number().over(Window.partitionBy("commune").orderBy(F.desc("debut")))
    return log.withColumn("rank", rank).where(F.col("rank") <= k)


def last_finished(log: DataFrame, now: Column, stale_hours: int = 20) -> DataFrame:
    """commune, fin of the last finished run, and whether none has begun lately."""
    return log.groupBy("commune").agg(F.max("fin").alias("fin"), F.max("debut").alias("debut")).withColumn("stale", F.unix_timestamp(now) - F.unix_timestamp("debut") > stale_hours * 3600)
