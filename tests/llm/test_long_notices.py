from municipia.llm import license_scan


def test_long_pieces_of_few_distinct_bigrams(spark):
    """Repeated, padded and boxed notices of more than 1,860 characters, and one of more than 3,000."""
    notice = license_scan.TEMPLATES["Apache-2.0-warranty"]
    boxed = "\n".join(f"* {part:<900} *" for part in (notice[:100], notice[100:200], notice[200:]))
    docs = spark.createDataFrame([(1, "All rights reserved. " * 100), (2, notice.replace(" ", " " * 60)), (3, "Before.\n\n" + boxed + "\n\nbehind"), (4, "word " * 1000)], "doc_id long, text string")
    got = {(r["doc_id"], r["template"]) for r in license_scan.licenses(docs).collect()}
    assert {(1, "all-rights-reserved"), (2, "Apache-2.0-warranty")} <= got and {i for i, _ in got} <= {1, 2, 3}
    assert (3, "Apache-2.0-warranty") in got
