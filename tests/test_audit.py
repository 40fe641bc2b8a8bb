"""Two runs whose texts differ late."""

from lexvane.plans import catalogue


def test_audit_compares_whole_texts(spark):
    schema = f"doc_id long, n_raw_tokens long, {catalogue.TEXT} string"
    a = spark.createDataFrame([(1, 51, "w " * 50 + "a"), (1, 52, "w " * 51 + "a"), (2, 51, "v " * 51)], schema)
    b = spark.createDataFrame([(1, 51, "w " * 50 + "b"), (1, 52, "w " * 51 + "a"), (3, 51, "v " * 51)], schema)
    row = catalogue.audit_runs(a, b).first()
    assert (row["shared"], row["only_a"], row["only_b"], row["text_mismatches"]) == (2, 1, 1, 1)
