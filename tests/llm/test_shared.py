import pytest
from pyspark.sql import functions as F

from municipia.llm.shared import Scratch, among, kept, possible, written


@pytest.mark.parametrize("most", [1 << 15, 1 << 27])
def test_rows_among_keys(spark, most):
    """No row with a key is lost, whatever the bitmap's size; few others pass a large one; null is no key."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), F.lit("x").alias("maybe_not"))
    keys = written(spark.range(0, 20_000, 50).select(F.col("id").alias("k")))
    want = {i for i in range(0, 20_000, 50) if i % 7}
    told = possible(rows, "k", keys, most).where("maybe")
    assert want <= {r["k"] for r in told.collect()} and told.count() < 3 * len(want)
    assert {r["k"] for r in among(rows, "k", keys).collect()} == want
    assert among(rows, "k", written(keys.limit(0))).count() == 0 and among(rows.limit(0), "k", keys).count() == 0


def test_scratch_tables_go(spark):
    scratch = Scratch(spark)
    held = scratch.written(spark.range(5))
    assert held.count() == 5
    scratch.clear()
    with pytest.raises(Exception):
        spark.read.parquet(scratch.folder)


def test_a_worker_keeps_one_table():
    a, b = kept(dict, (("a", 1),)), kept(dict, (("a", 1),))
    assert a is b and kept(dict, (("b", 1),)) is not a and kept(dict, (("a", 1),)) is not a
