"""The dataset job: gates, records, few features and resumed runs; rows appended to a grown table; ranks of groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexvane.operators import ranks, sampling, splits
from lexvane.plans import pipeline
from lexvane.plans import recipes as r
from lexvane.sources import chunks, registry, tables


def test_job_records_and_resumes(spark, small, tmp_path):
    cfg = pipeline.resolve_config({"preset": "small", "output": f"file://{tmp_path}/job", "resume": True, "raw_completions": True})
    docs = r.table(spark, small, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, "<analysis>\n1. one\n</analysis>").otherwise("<analysis>\n1. one\n- two\n</analysis>")
    provider = lambda rows: rows.withColumn(r.EXPLANATION, text)
    vectors = lambda rows: r.with_vectors(rows, spark, small)
    at = pipeline.run_pipeline(spark, cfg, docs, vectors, None, provider, ["base", "split", "explain", "build"])
    kept = spark.read.parquet(at["explain"])
    assert kept.filter("bucket <> 'rl' and doc_id % 5 = 0").count() == 0 and kept.filter(f"{r.EXPLANATION} = 'one\n\ntwo'").count() > 0
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "job").rglob("*.parquet")}
    pipeline.run_pipeline(spark, cfg, docs, vectors, None, provider)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "job").rglob("*.parquet")}
    assert all(after[f] == t for f, t in before.items()) and any("shuffle" in str(f) for f in after.keys() - before.keys())
    record = registry.load_meta(spark, at["registry"], "rl_base_run")
    assert record["row_count"] == spark.read.parquet(f"{at['build']}/rl").count() and record["parent_datasets"] == ["base_run__rl_raw"]
    assert registry.load_meta(spark, at["registry"], "rl_base_run__shuf42")["parent_datasets"] == ["rl_base_run"]


def test_job_gate(spark, small, tmp_path):
    cfg = pipeline.resolve_config({"output": f"file://{tmp_path}/job"})
    spark.createDataFrame([(1, None, "av", "x\n\ny")], f"doc_id long, n_raw_tokens long, bucket string, {r.EXPLANATION} string").write.parquet(f"{tmp_path}/job/explain")
    with pytest.raises(ValueError, match="keyed"):
        pipeline.run_pipeline(spark, cfg, None, lambda rows: rows, stages=["build"])


def rows_of(spark, path):
    return sorted(map(repr, spark.read.parquet(path).collect()))


def test_job_that_dies_after_each_step(spark, small, tmp_path):
    """Killed once after each step of each table, and resumed each time: equal tables, one record each, each chunk asked for once."""
    docs = r.table(spark, small, "documents").filter("doc_id < 14")
    vectors = lambda rows: r.with_vectors(rows, spark, small)
    (log := tmp_path / "log").mkdir()

    def complete(prompts):
        import uuid

        (log / uuid.uuid4().hex).write_text(prompts[0])
        return [f"<analysis>\n1. {p[9:29]}\n- two\n</analysis>" for p in prompts]

    cfg = pipeline.resolve_config({"preset": "probe", "resume": True, "raw_completions": True, "chunk_rows": 10, "d_model": 64})
    whole = pipeline.run_pipeline(spark, cfg | {"output": f"file://{tmp_path}/whole"}, docs, vectors, None, complete=complete)
    asked = Counter(p.read_text() for p in log.iterdir())
    died = []

    def after(step, name):
        if (step, name) not in died:
            died.append((step, name))
            raise KeyboardInterrupt

    runs = 0
    while runs < 100:
        runs += 1
        try:
            at = pipeline.run_pipeline(spark, cfg | {"output": f"file://{tmp_path}/dying"}, docs, vectors, None, complete=complete, after=after)
            break
        except KeyboardInterrupt:
            continue
    assert runs == len(died) + 1 == 4 * 10 + 1
    for name in ("base", "split", "explain", *[f"{s}/{t}" for s in ("build", "shuffle") for t in ("av_sft", "ar_sft", "rl")]):
        assert rows_of(spark, f"{tmp_path}/dying/{name}") == rows_of(spark, f"{tmp_path}/whole/{name}")
    both = [spark.read.parquet(f"{x['registry']}/registry") for x in (at, whole)]
    assert sorted(map(repr, both[0].collect())) == sorted(map(repr, both[1].collect())) and both[0].count() == 12
    assert {k: n - asked[k] for k, n in Counter(p.read_text() for p in log.iterdir()).items()} == asked
    up = registry.lineage(both[0], "av_sft_base_run__shuf42").orderBy("depth").collect()
    assert [x["ancestor"] for x in up] == ["av_sft_base_run", "base_run__av_raw__explained", "base_run__av_raw", "base_run"]
    with pytest.raises(ValueError, match="complete already"):
        pipeline.run_pipeline(spark, cfg | {"output": f"file://{tmp_path}/whole", "resume": False}, docs, vectors, stages=["base"])


def test_rows_that_vectors_lose_are_told(spark, small, tmp_path):
    cfg = pipeline.resolve_config({"preset": "probe", "output": f"file://{tmp_path}/job", "resume": True})
    docs = r.table(spark, small, "documents").filter("doc_id < 12")
    some = lambda rows: r.with_vectors(rows, spark, small).filter("n_raw_tokens % 5 <> 0")
    with pytest.raises(ValueError, match="rows, not"):
        pipeline.run_pipeline(spark, cfg, docs, some, None, r.prior)


def test_append_to_a_grown_table(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    assert chunks.resume_append(spark.range(75), out, "id", 10) == 75
    assert chunks.resume_append(spark.range(100), out, "id", 10) == 25
    rows = chunks.finished(spark, out)
    assert rows.count() == 100 and sorted(rows.groupBy("chunk_id").count().collect()) == [(i, 10) for i in range(10)]


def test_draws(spark):
    """Distinct, in range, all where there are few, and each position about as often."""
    rows = spark.range(4000).select("id", (F.col("id") % 14).alias("n"))
    got = rows.select("n", sampling.draw(F.col("n"), 5, 1, F.col("id")).alias("d")).collect()
    assert all(len(set(x["d"])) == len(x["d"]) == min(x["n"], 5) and all(0 <= p < x["n"] for p in x["d"]) for x in got)
    often = Counter(p for x in got if x["n"] == 13 for p in x["d"])
    assert min(often.values()) > 0.6 * 5 / 13 * sum(x["n"] == 13 for x in got)


def test_special_tokens_are_not_drawn(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "s", "c"] * 5) for i in range(30)], "doc_id long, tok array<string>")
    got = sampling.sample_positions(docs, F.col("tok"), 6, 3, ["s"]).select("doc_id", "position").collect()
    assert len(got) == len(set(map(tuple, got))) == 180 and all(x["position"] >= 3 and x["position"] % 4 != 2 for x in got)


@pytest.mark.parametrize("falling", [False, True])
def test_group_ranks(spark, falling):
    rows = [(g, None if i % 17 == 5 else float((i * i) % 23), i) for g in ("a", "a", "b", None) for i in range(60)]
    rows = [(g, v, k) for k, (g, v, _) in enumerate(rows)] + [("c", 1.0, 999)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    order = [F.desc_nulls_last("v") if falling else F.asc_nulls_last("v"), F.col("k")]
    got = {x["k"]: (x["rank"], x["_n"]) for x in ranks.group_rank(df, ["g"], "v", order, falling).collect()}
    for g in ("a", "b", "c", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, (-1 if falling else 1) * (x[1] or 0.0), x[2]))
        assert [got[x[2]] for x in mine] == [(i, len(mine)) for i in range(1, len(mine) + 1)]
    assert ranks.group_rank(df.limit(0), ["g"], "v", order, falling).count() == 0


@pytest.mark.parametrize("falling", [False, True])
def test_parts_of_groups_are_even(spark, falling):
    """An outlier, and a value that a third of the rows share: the largest part stays below twice the mean."""
    v = F.when(F.col("id") == 5, -1e9).when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.hash("id"), F.lit(1_000_003)) / 7.0)
    df = spark.range(200_000).select(F.lit("a").alias("g"), v.alias("v"), "id")
    sizes = [x["count"] for x in ranks.cut_groups(df, ["g"], "v", ["id"], falling, 2_000).groupBy("_range").count().collect()]
    assert len(sizes) == 100 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = ranks.group_rank(df, ["g"], "v", [F.desc_nulls_last("v") if falling else F.asc_nulls_last("v"), "id"], falling, part=2_000)
    key = F.struct(F.when(F.lit(falling), -F.col("v")).otherwise(F.col("v")), "id")
    assert got.orderBy("rank").agg(F.max("rank"), F.count_distinct("rank"), F.max("_n")).first() == (200_000, 200_000, 200_000)
    later = got.select(key.alias("k"), (F.col("rank") + 1).alias("rank")).join(got.select(key.alias("next"), "rank"), "rank")
    assert later.filter("next < k").count() == 0


def test_group_percentiles(spark):
    """Equal to Spark's own exact percentiles: groups beyond a sketch's size, ties, an outlier, nulls, NaN, few rows."""
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    big = spark.range(60_000).select(F.lit("big").alias("g"), F.when(F.col("id") == 5, 1e300).otherwise(F.pmod(F.hash("id"), F.lit(1_000_003)) / 7).alias("v"))
    ties = spark.range(30_000).select(F.lit("ties").alias("g"), F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 7 == 0, 2.5).otherwise(-1.0).alias("v"))
    small = [("one", 3.0), ("two", 1.0), ("two", 2.0), ("nan", 1.0), ("nan", float("nan")), ("nan", 2.0), ("nan", float("nan")), ("nan", float("inf")), (None, 4.0), (None, None), (None, 8.0), ("none", None)]
    small += [("ten", float(i * i)) for i in range(10)]
    df = big.unionByName(ties).unionByName(spark.createDataFrame(small, "g string, v double"))
    want = {x["g"]: x["p"] for x in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).collect() if x["p"]}
    got = {x["g"]: x["p"] for x in ranks.group_percentiles(df, ["g"], "v", shares, "p").collect()}
    assert got.keys() == want.keys() == {"big", "ties", "one", "two", "nan", None, "ten"}
    assert {g: repr(p) for g, p in got.items()} == {g: repr(p) for g, p in want.items()}
    assert ranks.group_percentiles(df.limit(0), ["g"], "v", shares).count() == 0
    whole = ranks.with_percentiles(df.groupBy("g").count(), df, ["g"], "v", [0.5], "p").collect()
    assert {x["g"]: x["p"] for x in whole}["none"] is None and len(whole) == 8


def test_shards_in_order(spark):
    metas = spark.createDataFrame([(20, 10, "c"), (0, 5, "a"), (5, 15, "b")], "start long, length long, id string")
    assert [(m["shard"], m["id"]) for m in splits.order_shards(metas).collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_texts_are_stored_once(spark, small, tmp_path):
    """Later tables have keys alone, what is asked for still gets its text, and rows in order come by one shuffle."""
    docs, asked = r.table(spark, small, "documents").filter("doc_id < 30"), []

    def provider(rows):
        asked.append(rows.select("doc_id", "n_raw_tokens", r.TEXT).collect())
        return r.prior(rows)

    cfg = pipeline.resolve_config({"output": f"file://{tmp_path}/job"})
    at = pipeline.run_pipeline(spark, cfg, docs, lambda rows: r.with_vectors(rows, spark, small), r.caches, provider)
    assert r.TEXT in spark.read.parquet(at["base"]).columns
    assert not any(r.TEXT in spark.read.parquet(f"{tmp_path}/job/{t}").columns for t in ("split", "joined", "explain"))
    texts = {(x["doc_id"], x["n_raw_tokens"]): x[r.TEXT] for x in sampling.base_rows(docs).collect()}
    assert asked[0] and all(texts[x["doc_id"], x["n_raw_tokens"]] == x[r.TEXT] for x in asked[0])
    rows = spark.read.parquet(f"{at['build']}/rl")
    ranked = ranks.shuffle_rows(rows, 42, "rl", ["doc_id", "n_raw_tokens"], in_order=True)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning(_bucket" not in plan.split("BroadcastExchange")[0]
    found = [x["shuffle_rank"] for x in ranked.collect()]
    assert found == list(range(1, len(found) + 1))
    plain = ranks.shuffle_rows(rows, 42, "rl", ["doc_id", "n_raw_tokens"])
    assert sorted(map(repr, plain.select(*ranked.columns).collect())) == sorted(map(repr, ranked.collect()))
