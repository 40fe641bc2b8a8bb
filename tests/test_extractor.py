"""Extractors on empty, long and many texts."""

import time

import numpy as np
from pyspark.sql import functions as F

from lexvane.operators import plugins


def _made():
    def lengths(texts):  # within a function, so that workers get it by value
        return [(list(range(len(t))), np.array([[ord(c), i] for i, c in enumerate(t)], float).reshape(len(t), 2)) for t in texts]

    return lengths


lengths = _made()


def test_empty_and_long_texts(spark):
    rows = [("a", "xyz"), ("b", ""), (None, "q"), ("c", "w" * 250_001), ("d", "é")]
    got = plugins.apply_extractor(spark.createDataFrame(rows, "k string, text string").coalesce(1), lengths, 2, key="k")
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "int", "array<float>"]
    few = sorted(map(tuple, got.filter("k is null or k <> 'c'").collect()), key=repr)
    assert few == sorted([(k, i, [float(ord(c)), float(i)]) for k, t in rows if k != "c" for i, c in enumerate(t)], key=repr)
    long = got.filter("k = 'c'").agg(F.count("*"), F.count_distinct("position"), F.max("position"), F.min(F.get("vector", F.lit(1)) == F.col("position"))).first()
    assert tuple(long) == (250_001, 250_001, 250_000, True)


def test_many_texts_take_no_table_each(spark):
    df = spark.range(0, 60_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plugins.apply_extractor(df.limit(10), lengths, 2).collect()
    start = time.monotonic()
    assert plugins.apply_extractor(df, lengths, 2).count() == 60_000
    assert time.monotonic() - start < 8
