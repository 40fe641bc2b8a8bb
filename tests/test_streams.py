"""Scored batches of a stream (a poisoned batch, restarts, the timer) and the sketches of its report."""

import time

import pytest
from pyspark.sql import functions as F

from lexvane.plans.stateful import rocksdb
from lexvane.streaming import scoring


@pytest.fixture
def feed(spark, tmp_path):
    """feed(ids) adds a file; run(..) takes all that is there, with one state; rows() is what came out."""

    class Feed:
        def add(self, ids):
            spark.createDataFrame([(i, float(i) if i % 4 else None) for i in ids], "id long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def start(self, score, on_error="mark", timeout_ms=3_600_000, **trigger):
            stream = spark.readStream.schema("id long, x double").parquet(f"{tmp_path}/in")
            out = scoring.micro_batch(stream, "id", 1, 10, timeout_ms, score, ["x"], on_error)
            return out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(**trigger).start()

        def run(self, score, on_error="mark", until=0, timeout_ms=3_600_000):
            """Runs until so many samples are out; a processing-time timer lets a stream of all that is there never end."""
            running, end = self.start(score, on_error, timeout_ms, processingTime="200 milliseconds"), time.monotonic() + 40
            try:
                while running.isActive and time.monotonic() < end and (running.lastProgress is None or running.lastProgress.batchId < 1 or self.count() < until):
                    time.sleep(0.3)
            finally:
                running.stop()
            if running.exception():
                raise running.exception()

        def rows(self):
            return {r["sample"]: r for r in spark.read.schema(scoring.BATCHED).parquet(f"{tmp_path}/out").collect()}

        def count(self):
            return spark.read.schema(scoring.BATCHED).parquet(f"{tmp_path}/out").count()

    with rocksdb(spark):
        yield Feed()


def _scores():
    """Inner functions, which go to workers by value."""

    def double(batch):
        return [2 * x for x in batch["x"]]

    def poisoned(batch):
        if (batch["sample"] == 13).any():
            raise RuntimeError("poison")
        return double(batch)

    def short(batch):
        return [1.0]

    return double, poisoned, short


double, poisoned, short = _scores()


def test_a_poisoned_batch_fails_alone(feed):
    feed.add(range(40))
    feed.run(poisoned, until=40)
    rows = feed.rows()
    assert len(rows) == feed.count() == 40
    bad = {i for i, r in rows.items() if r["status"] == "failed"}
    assert len(bad) == 10 and 13 in bad and len({rows[i]["batch"] for i in bad}) == 1 and {rows[i]["error"] for i in bad} == {"RuntimeError: poison"}
    for i in rows.keys() - bad:
        assert (rows[i]["status"], rows[i]["result"], rows[i]["error"]) == (("scored", 2.0 * i, None) if i % 4 else ("gave up", None, None))


def test_an_error_that_is_raised_loses_nothing(feed):
    feed.add(range(20))
    with pytest.raises(Exception, match="poison"):
        feed.run(poisoned, "raise", 20)
    feed.run(double, "raise", 20)
    assert feed.rows().keys() == set(range(20)) and feed.count() == 20


def test_pending_samples_outlive_a_restart(feed):
    feed.add(range(15))
    feed.run(double, until=10)
    assert feed.count() == 10
    feed.add(range(15, 20))
    feed.run(double, until=20)
    assert feed.rows().keys() == set(range(20)) and feed.count() == 20


def test_a_wrong_number_of_results_fails_the_batch(feed):
    feed.add(range(10))
    feed.run(short, until=10)
    assert {r["error"] for r in feed.rows().values()} == {"ValueError: 1 results for 10 samples"}


def test_the_timer_sends_what_is_left(feed):
    feed.add(range(3))
    feed.run(double, until=3, timeout_ms=300)
    assert {r["batch"] for r in feed.rows().values()} == {0} and feed.count() == 3


def test_sketches_are_small_and_near(spark):
    """A window's sketches take some 10 kB whatever its rows, and are within the stated errors."""
    sizes = []
    for n in (20_000, 1_000_000):
        rows = spark.range(n).select(F.pmod(F.hash("id"), F.lit(1_000_003)).cast("double").alias("v"), (F.col("id") % 5_000).alias("g"))
        one = rows.agg(F.kll_sketch_agg_double("v", scoring.SKETCH_K).alias("k"), F.hll_sketch_agg("g", scoring.GROUPS_LG).alias("h"))
        got = one.select(F.octet_length("k").alias("k"), F.octet_length("h").alias("h"), F.hll_sketch_estimate("h").alias("groups"), *[F.kll_sketch_get_quantile_double("k", F.lit(s)).alias(p) for p, s in scoring.SHARES.items()]).first()
        sizes.append(got["k"] + got["h"])
        assert abs(got["groups"] - 5_000) <= 150
        for p, s in scoring.SHARES.items():
            below = rows.filter(F.col("v") <= got[p]).count() / n
            assert abs(below - s) <= scoring.PERCENTILE_ERROR
    assert max(sizes) < 60_000 and sizes[1] < 1.5 * sizes[0]
