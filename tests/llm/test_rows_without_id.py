from municipia.llm import jaccard_join


def test_a_row_without_id_ahead_of_its_copy(spark):
    """The copy with an id still links to a near copy that another task holds."""
    base = [f"w{i}" for i in range(200)]
    near = [*base[:-2], "x", "y"]
    rows = [(None, " ".join(base)), (5, " ".join(base)), (1, " ".join(near)), (2, "some other words that nothing else here holds")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert [[r["doc_id"] for r in part] for part in docs.rdd.glom().collect()] == [[None, 5], [1, 2]]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {(None, None), (5, 1), (1, 1), (2, 2)}
    assert {r["doc_id"] for r in jaccard_join.keep_first(docs).collect()} == {None, 1, 2}
