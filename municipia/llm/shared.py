"""Tables written to the shared checkpoint folder, Arrow batches cut to a bounded size, and what a worker keeps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds in working arrays at once; a longer text is held alone.
BLOCK_BYTES = 2_000_000
#: Bits of the largest bitmap of keys: 16 MB are broadcast, however many keys there are.
MARKS = 1 << 27


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one if all runs in this process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="municipia-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, or in a folder of ``Scratch``: later steps read files, not the lineage."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one query that go once their readers have been written themselves."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        return written(df, self.folder)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def possible(rows: DataFrame, column: str, keys: DataFrame, most: int = MARKS) -> DataFrame:
    """rows and ``maybe``: false only where the value of column is none of keys, a written table of distinct values of that
    name. A bitmap of hashed keys tells, so the answer costs no shuffle of rows; with more keys than bits it is always yes."""
    slots = min(most, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(column), F.lit(slots)) + 1
    at = F.bitmap_bit_position(slot)
    bits = keys.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    held = rows.withColumns({"__bucket": F.bitmap_bucket_number(slot), "__at": at}).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    maybe = F.col(column).isNotNull() & F.coalesce(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))
    return held.withColumn("maybe", maybe).drop("__bucket", "__at", "__bits")


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose value of column is in keys, as for ``possible``; few others are shuffled."""
    return possible(rows, column, keys).where("maybe").drop("maybe").join(keys, column, "left_semi")


_kept: dict[tuple, Any] = {}


def kept(make: Callable[..., Any], *args: Any) -> Any:
    """make(*args), kept by this worker for later tasks until it is asked for something else: one table at a time."""
    if (make, *args) not in _kept:
        _kept.clear()
        _kept[make, *args] = make(*args)
    return _kept[make, *args]


def let_go() -> None:
    """Frees what this worker keeps, for tasks that need none of it."""
    _kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about ``limit`` bytes of text; a null text counts as empty."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < len(lengths):
            yield batch.slice(start)
