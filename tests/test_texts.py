"""Prefix texts that are cut behind the joins: the same as base_rows(), and not moved by a shuffle."""

import pytest

import __spark_entry__ as entry
from lexvane.operators import sampling
from lexvane.plans import recipes as r


def test_texts_are_those_of_the_base(spark, small):
    docs = r.table(spark, small, "documents").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " " * 70)], "doc_id long, text string"), allowMissingColumns=True)
    base = sampling.base_rows(docs).drop("activation_layer")
    late = sampling.with_texts(sampling.base_keys(docs), docs)
    assert sorted(map(tuple, late.select(*base.columns).collect())) == sorted(map(tuple, base.collect()))
    assert late.filter("doc_id = -3").count() == 10


@pytest.mark.parametrize("name", ["q_build_ar", "q_reuse_join"])
def test_no_join_moves_a_prefix(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" in plan and plan.rindex("substring_index") < plan.index("Join")
