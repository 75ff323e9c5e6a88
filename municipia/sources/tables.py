"""Tables written to the shared folder of spark.checkpoint.dir, so that later steps read files and not a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder; where none is set, a temporary one of our own if all runs in this process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="municipia-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shuffled(df: DataFrame) -> DataFrame:
    """df, joined by a shuffle and never sent whole to the driver and every worker. The planner takes a table for small by the
    bytes of its files, or by its rows before arrays are spread, and either tells little of the rows that are to be held."""
    return df.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns to as many tasks as a shuffle has, a few for each core at least, whatever few bytes its rows have."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *columns)


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
