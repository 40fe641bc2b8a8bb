"""More sites than vectors."""

from lexvane.plans import catalogue


def test_every_site_has_a_vector(spark, tmp_path):
    spark.createDataFrame([(i, "sum of the that x") for i in range(7)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10,), (20,), (30,)], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalogue.q_zip_join(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["site"], r["vec_id"]) for r in rows] == [(i, 2, [10, 20, 30][i % 3]) for i in range(7)]
