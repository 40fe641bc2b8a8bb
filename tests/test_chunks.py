"""Chunks that commit one by one: failing, dying and growing runs; calls that are counted; transient errors."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexvane.operators import plugins
from lexvane.sources import chunks


def counted(folder, fail=None, die=None):
    """A provider that leaves a file for each call, and fails, or takes its process down, on a chunk that holds some prompt."""

    def run(prompts):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompts[0])
        if fail in prompts:
            raise RuntimeError("broken")
        if die in prompts:
            os._exit(1)
        return [f"<{p}>" for p in prompts]

    return run


def calls(folder):
    return Counter(p.read_text() for p in folder.iterdir())


@pytest.fixture
def rows(spark):
    return spark.range(100).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))


def test_failure_keeps_all_other_chunks(spark, rows, tmp_path):
    (log := tmp_path / "log").mkdir()
    at = f"file://{tmp_path}/out"
    with pytest.raises(chunks.ChunksFailed, match="1 chunks failed: chunk 9: RuntimeError: broken"):
        plugins.complete_chunks(rows, counted(log, fail="p95"), at, "id", chunk=10)
    assert chunks.finished(spark, at).count() == 90 and sum(calls(log).values()) == 10
    done = plugins.complete_chunks(rows, counted(log), at, "id", chunk=10)
    assert sorted((r["id"], r["chunk_id"], r["completion"]) for r in done.collect()) == [(i, i // 10, f"<p{i}>") for i in range(100)]
    assert calls(log) == {f"p{10 * i}": 2 if i == 9 else 1 for i in range(10)}
    plugins.complete_chunks(rows, counted(log), at, "id", chunk=10)
    assert sum(calls(log).values()) == 11 and not [f for f in os.listdir(tmp_path / "out") if "todo" in f]


def test_a_process_that_dies_takes_its_own_chunk_only(spark, rows, tmp_path):
    """Two chunks at a time: the run ends with the wave of the chunk that dies; what is there is whole, and is never asked for again."""
    (log := tmp_path / "log").mkdir()
    at = f"file://{tmp_path}/out"
    with pytest.raises(Exception, match="abort|crashed|exited"):
        plugins.complete_chunks(rows, counted(log, die="p75"), at, "id", chunk=10, at_once=2)
    first = chunks.finished(spark, at)
    sizes = {r["chunk_id"]: r["count"] for r in first.groupBy("chunk_id").count().collect()}
    assert set(sizes.values()) == {10} and set(range(6)) <= sizes.keys() <= set(range(7)) and 7 not in sizes
    done = plugins.complete_chunks(rows, counted(log), at, "id", chunk=10, at_once=2)
    assert sorted(r["id"] for r in done.collect()) == list(range(100))
    assert all(calls(log)[f"p{10 * c}"] == 1 for c in range(6))


def test_an_unfinished_attempt_is_never_seen(spark, rows, tmp_path):
    """What a killed task leaves lies under _temporary, which no reader takes."""
    at = f"file://{tmp_path}/out"
    chunks.resume_append(rows.filter("id < 50"), at, "id", 10)
    left = tmp_path / "out/_temporary/0/_temporary/attempt_1"
    left.mkdir(parents=True)
    some = next((tmp_path / "out").glob("*.parquet"))
    (left / some.name).write_bytes(some.read_bytes()[:100])
    assert chunks.finished(spark, at).count() == 50
    assert chunks.resume_append(rows, at, "id", 10) == 50 and chunks.finished(spark, at).count() == 100


def test_keys_of_several_columns(spark, tmp_path):
    """Long turns, null keys, and keys that repeat."""
    data = [(c, t) for c in (None, 1, 2) for t in (0, 1, 999, 1000, 1001)] + [(3, None)]
    df = spark.createDataFrame(data, "conv_id long, turn long")
    at = f"file://{tmp_path}/out"
    assert chunks.resume_append(df.filter("turn < 1000"), at, ["conv_id", "turn"], 4) == 9
    assert chunks.resume_append(df, at, ["conv_id", "turn"], 4) == 7 and chunks.resume_append(df, at, ["conv_id", "turn"], 4) == 0
    assert sorted(map(repr, chunks.finished(spark, at).select("conv_id", "turn").collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(ValueError, match="several rows"):
        chunks.resume_append(df.unionByName(df), at, ["conv_id", "turn"], 4)
    assert chunks.resume_append(df.limit(0), f"file://{tmp_path}/none", ["conv_id", "turn"], 4) == 0


def test_chunks_of_a_job_have_tasks_of_their_own(spark, rows, tmp_path):
    at = f"file://{tmp_path}/out"
    chunks.resume_append(rows, at, "id", 7)
    by_file = spark.read.parquet(at).groupBy(F.input_file_name()).agg(F.count_distinct("chunk_id").alias("k")).collect()
    assert len(by_file) == 15 and {r["k"] for r in by_file} == {1}


def most_tasks(spark, group):
    """Tasks of the largest stage that ran in a job group."""
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds]
    return max(s.numCompletedTasks for s in stages if s)


def test_only_chunks_that_are_to_be_done_have_tasks(spark, rows, tmp_path):
    (log := tmp_path / "log").mkdir()
    at = f"file://{tmp_path}/out"
    with pytest.raises(chunks.ChunksFailed, match="chunk 39: RuntimeError"):
        plugins.complete_chunks(rows.filter("id < 80"), counted(log, fail="p78"), at, "id", chunk=2)
    spark.sparkContext.setJobGroup("again", "a run for one chunk of forty")
    try:
        done = plugins.complete_chunks(rows.filter("id < 80"), counted(log), at, "id", chunk=2).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["id"] for r in done) == list(range(80)) and most_tasks(spark, "again") <= 4


def test_a_chunk_that_fails_writes_nothing(spark, rows, tmp_path):
    """All chunks fail, the first too; the table that they leave is empty, and a later run fills it."""
    (log := tmp_path / "log").mkdir()
    at = f"file://{tmp_path}/out"

    def none(prompts):
        raise RuntimeError("away")

    with pytest.raises(chunks.ChunksFailed, match="10 chunks failed: chunk 0: RuntimeError: away; chunk 1: "):
        plugins.complete_chunks(rows, none, at, "id", chunk=10)
    left = chunks.finished(spark, at)
    assert left is None or left.count() == 0
    done = plugins.complete_chunks(rows, counted(log), at, "id", chunk=10)
    assert sorted((r["id"], r["chunk_id"], r["completion"]) for r in done.collect()) == [(i, i // 10, f"<p{i}>") for i in range(100)]
    assert set(calls(log).values()) == {1} and "_error" not in spark.read.parquet(at).columns


def test_small_files_are_read_together(spark, rows, tmp_path):
    at = f"file://{tmp_path}/out"
    chunks.resume_append(rows, at, "id", 2)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        assert spark.read.parquet(at).rdd.getNumPartitions() == 50 and chunks.finished(spark, at).rdd.getNumPartitions() == 4
        assert sorted(r["id"] for r in chunks.finished(spark, at).collect()) == list(range(100))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_workers_freeze_what_they_have_imported(spark, rows, tmp_path):
    def run(prompts):
        import gc

        return [str(gc.get_freeze_count()) for _ in prompts]

    done = plugins.complete_chunks(rows, run, f"file://{tmp_path}/out", "id", chunk=10)
    assert all(int(r["completion"]) > 0 for r in done.collect())


def test_wrong_number_of_results(spark, rows, tmp_path):
    with pytest.raises(chunks.ChunksFailed, match="9 results for 10 rows"):
        plugins.complete_chunks(rows, lambda p: p[1:], f"file://{tmp_path}/out", "id", chunk=10)


def test_side_by_side():
    import threading

    met, tries = threading.Barrier(4, timeout=10), Counter()

    def one(prompt):
        tries[prompt] += 1
        if prompt == "gone" or prompt == "late" and tries[prompt] < 3:
            raise TimeoutError
        if prompt == "bad":
            raise KeyError(prompt)
        if prompt.startswith("meet"):
            met.wait()
        return prompt.upper()

    run = plugins.side_by_side(one, 8, (TimeoutError,), tries=3)
    assert run(["meet1", "meet2", "late", "meet3", "gone", "meet4"]) == ["MEET1", "MEET2", "LATE", "MEET3", None, "MEET4"]
    assert tries["late"] == tries["gone"] == 3 and run([]) == []
    with pytest.raises(KeyError):
        run(["a", "bad", "b"])
    assert tries["bad"] == 1 and tries["b"] == 1
