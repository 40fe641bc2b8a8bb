"""Streams of rollouts: stateless scoring, windowed reports with bounded state, count-or-timeout batches, resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexvane.functions.text import extract_tag
from lexvane.functions.vectors import pair_mse, reward
from lexvane.operators.gates import scorable


def score_stream(stream: DataFrame, scale: float | None, log_mode: bool = False, max_ctx: int = 512, tag: str = "explanation") -> DataFrame:
    """stream (response, status, critic_tokens, pred, gold) with explanation, scorable, mse and reward. No state."""
    rows = stream.withColumn("explanation", extract_tag(F.col("response"), tag))
    rows = scorable(rows, F.col("explanation"), F.col("critic_tokens"), max_ctx)
    rows = rows.withColumn("mse", F.when(F.col("scorable"), pair_mse(F.col("pred"), F.col("gold"), scale)))
    return rows.withColumn("reward", reward(F.col("mse"), F.col("final_status"), log_mode))


#: Size of the percentile sketch, and how far a percentile's share of rows may be off; size (log2) of the sketch of groups.
SKETCH_K, PERCENTILE_ERROR, GROUPS_LG = 1000, 0.005, 14
SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def report_stream(stream: DataFrame, time: str, reward_col: str, key: str, window: str = "1 day", watermark: str = "2 days", group: str | None = None) -> DataFrame:
    """(window_start, n, mean, std, min, max) of each event-time window; repeated keys within the watermark count once.

    group: with p10, p25, p50, p75, p90 and n_groups, from mergeable sketches, so that the state of a window is bounded whatever its rows: a
    percentile's share of rows is off by PERCENTILE_ERROR at most (exact up to SKETCH_K rows), the number of groups by 3 percent (99 %).
    """
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", watermark).dropDuplicatesWithinWatermark([key])
    sketches = [F.kll_sketch_agg_double(F.col(reward_col).cast("double"), SKETCH_K).alias("_kll"), F.hll_sketch_agg(group, GROUPS_LG).alias("_hll")] if group else []
    out = rows.groupBy(F.window("_t", window).alias("w")).agg(F.count("*").alias("n"), F.avg(reward_col).alias("mean"), F.stddev_pop(reward_col).alias("std"), F.min(reward_col).alias("min"), F.max(reward_col).alias("max"), *sketches)
    told = [*[F.kll_sketch_get_quantile_double("_kll", F.lit(s)).alias(p) for p, s in SHARES.items()], F.hll_sketch_estimate("_hll").alias("n_groups")] if group else []
    return out.select(F.col("w.start").alias("window_start"), "n", "mean", "std", "min", "max", *told)


BATCHED = "shard long, batch long, sample long, status string, result double, error string"


def _plain(column: pd.Series) -> list:
    """Values with None for what is missing."""
    return column.astype(object).where(column.notna(), None).tolist()


class _Batcher(StatefulProcessor):
    """Keeps pending samples of a key; a batch leaves at n samples, or timeout after the first of them, and is scored on its way out."""

    def __init__(self, n: int, timeout_ms: int, fields: str, score: Callable[[pd.DataFrame], list] | None, on_error: str):
        self.n, self.timeout_ms, self.fields, self.score, self.on_error = n, timeout_ms, fields, score, on_error
        self.names = [f.strip().split(" ")[0].strip("`") for f in fields.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.fields)
        self.number = handle.getValueState("number", "batch long")

    def _scored(self, rows: list[tuple]) -> tuple[list, list, str | None]:
        """(statuses, results, error): a sample without a result is given up alone; a batch that raises fails as a whole."""
        if self.score is None:
            return ["batched"] * len(rows), [None] * len(rows), None
        try:
            found = list(self.score(pd.DataFrame(rows, columns=self.names)))
            if len(found) != len(rows):
                raise ValueError(f"{len(found)} results for {len(rows)} samples")
        except Exception as error:
            if self.on_error == "raise":
                raise
            return ["failed"] * len(rows), [None] * len(rows), f"{type(error).__name__}: {error}"
        lost = [x is None or x != x for x in found]
        return ["gave up" if x else "scored" for x in lost], [None if x else float(r) for x, r in zip(lost, found, strict=True)], None

    def _emit(self, key, batches: list[list[tuple]]) -> pd.DataFrame:
        """The rows of batches, numbered on; their number is read and kept once for all of them."""
        first = self.number.get()[0] if self.number.exists() else 0
        self.number.update((first + len(batches),))
        rows = [r for b in batches for r in b]
        number = [first + i for i, b in enumerate(batches) for _ in b]
        status, result, error = [], [], []
        for b in batches:
            told, found, wrong = self._scored(b)
            status += told
            result += found
            error += [wrong] * len(b)
        return pd.DataFrame({"shard": key[0], "batch": number, "sample": [int(r[0]) for r in rows], "status": status, "result": pd.Series(result, dtype="float64"), "error": pd.Series(error, dtype=object)})

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.pending.get()] if self.pending.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        had = bool(waiting)
        for pdf in rows:
            waiting += list(zip(*[_plain(pdf[c]) for c in self.names], strict=True))
            if full := len(waiting) // self.n * self.n:
                yield self._emit(key, [waiting[i : i + self.n] for i in range(0, full, self.n)])
                waiting, had = waiting[full:], False
        for t in list(self.handle.listTimers()) if not had else []:
            self.handle.deleteTimer(t)
        if waiting:
            self.pending.put(waiting)
            if not had:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        elif self.pending.exists():
            self.pending.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        self.pending.clear()
        if waiting:
            yield self._emit(key, [waiting])

    def close(self) -> None:
        pass


def micro_batch(stream: DataFrame, sample: str, shards: int = 4, n: int = 16, timeout_ms: int = 5_000, score: Callable[[pd.DataFrame], list] | None = None, columns: list[str] | None = None, on_error: str = "mark") -> DataFrame:
    """(shard, batch, sample, status, result, error): each sample in one batch of at most n, which leaves when it is full or timeout_ms old.

    score is called with each batch (sample and columns) and gives a number for each sample, or null for one that it gives up. If it
    raises, the batch's samples are marked failed, with the error, and others go on (on_error "mark"), or the stream ends ("raise"); then
    the batch is tried again after a restart. Each sample comes out once; score may be called again for a batch whose micro-batch
    of the stream is run again. Pending samples are state by shard, so they survive a restart. Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    fields = ", ".join(["sample long", *[f"`{c}` {kinds[c]}" for c in columns or []]])
    rows = stream.select(F.pmod(F.col(sample), F.lit(shards)).cast("long").alias("shard"), F.col(sample).cast("long").alias("sample"), *(columns or []))
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Batcher(n, timeout_ms, fields, score, on_error), outputStructType=BATCHED, outputMode="append", timeMode="ProcessingTime")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there now to Parquet, and remember how far: the next call with this checkpoint goes on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def resume_stream(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """run_available() that has to go on from saved state; without it, an error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise ValueError(f"{checkpoint} holds no saved state")
    run_available(stream, path, checkpoint)
