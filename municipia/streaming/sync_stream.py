"""The tracking of the registry as an incremental run: the listing snapshot that has arrived is one batch against the table.

The table is kept in versions (``sources.versions``): a batch reads and writes the buckets of the communes that arrived, under
its own number, so a batch that is run again after a failure gives the same table. ``decree_sync`` reads and draws acts as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from municipia import schemas
from municipia.operators import sync
from municipia.sources.versions import VersionedTable

STATE = f"commune string, id string, numero string, date_decision date, date_publication date, statut string, motif_verification string, modifie_manuellement boolean, erreur string, tentatives int, suivi_registre {schemas.TRACKING}"
SNAPSHOT = "commune string, id string, numero string, objet string, date_decision date, date_publication date, signature string, seen_on date"


def ingest_as_published(acts: DataFrame) -> DataFrame:
    """Rows for acts (commune, id, act, changed) whose text isn't read here: published as listed."""
    a = F.col("act")
    return acts.select("commune", "id", a["numero"].alias("numero"), a["date_decision"].alias("date_decision"), a["date_publication"].alias("date_publication"), F.lit("publie").alias("statut"), F.lit("").alias("motif_verification"), a["signature"].alias("signature"), "changed")


def next_state(state: DataFrame, acts: DataFrame, start_year: int, ingest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table after a snapshot (SNAPSHOT); of several that arrived together the one last seen counts."""
    # an empty snapshot has no day: then nothing disappears, as the guard ignores it
    today = F.lit(acts.agg(F.max("seen_on")).first()[0]).cast("date")
    acts = acts.where(F.col("seen_on") == today)
    classed = sync.classify(state, acts.drop("seen_on"), today, start_year)
    tracked = sync.track(classed.where("statut is not null"), today).select(*StructType.fromDDL(STATE).fieldNames())
    new = ingest(sync.to_process(classed)).select("commune", "id", *[F.col(c).alias(f"new_{c}") for c in ("numero", "date_decision", "date_publication", "statut", "motif_verification", "signature", "changed")])
    met = tracked.join(new, ["commune", "id"], "full")
    read, s = F.col("new_signature").isNotNull(), F.col("suivi_registre")
    manual, withdrawn = F.coalesce("modifie_manuellement", F.lit(False)), s["retire_le"].isNotNull()
    statut, motif = sync.ingest_status(manual, F.coalesce("new_changed", F.lit(False)), F.col("statut"), F.col("motif_verification"), withdrawn, F.col("new_statut"), F.col("new_motif_verification"))
    suivi = F.struct(F.when(read, F.col("new_signature")).otherwise(s["signature"]).alias("signature"), s["retire_le"].alias("retire_le"), s["statut_avant"].alias("statut_avant"), s["motif_avant"].alias("motif_avant"))
    pick = lambda c: F.when(read, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return met.select(
        "commune", "id", pick("numero"), pick("date_decision"), pick("date_publication"),
        F.when(read, statut).otherwise(F.col("statut")).alias("statut"), F.when(read, motif).otherwise(F.col("motif_verification")).alias("motif_verification"),
        manual.alias("modifie_manuellement"), F.when(read, "").otherwise(F.col("erreur")).alias("erreur"),
        (F.coalesce("tentatives", F.lit(0)) + F.when(read, 1).otherwise(0)).alias("tentatives"), suivi.alias("suivi_registre"),
    )


def run_available(spark: SparkSession, snapshots: str, folder: str, start_year: int, ingest: Callable[[DataFrame], DataFrame] = ingest_as_published) -> DataFrame:
    """Work off the snapshot files (Parquet) that have arrived since the last run, as one batch; returns the table."""
    source = spark.readStream.schema(SNAPSHOT).parquet(snapshots)
    table = VersionedTable(spark, folder, STATE)

    def step(acts: DataFrame, batch: int) -> None:
        touched = table.touched(acts)
        if not touched:  # an empty snapshot says nothing
            return
        before = max((v for v in table.versions() if v < batch), default=None)
        held = table.read(before, touched) if before is not None else spark.createDataFrame([], STATE)
        arrived = acts.select("commune").distinct()
        after = next_state(held.join(arrived, "commune", "left_semi"), acts, start_year, ingest)
        table.commit(batch, after.unionByName(held.join(arrived, "commune", "left_anti")), touched)

    source.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return table.read()
