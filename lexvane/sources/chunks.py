"""Appends that survive: a table grows by chunks of rows, each of which is worked on in a task of its own and counts once its file is there.

A task writes one file and moves it into the table when it ends (the file committer's second algorithm, one rename a file), so a
chunk is there whole or not at all. Of attempts that run side by side, Spark lets one commit. What stops a run (an error, a lost
executor, a killed driver) takes the chunks that were being worked on at that moment, never those that are done.

Small chunks make many tasks, so a task is kept cheap: only chunks that are still to be done get one, a chunk that raises writes nothing
(its error goes to the driver by an accumulator), and what a Python worker has imported isn't searched for garbage after each of them.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark import Accumulator, AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.operators.ranks import group_rank

#: Most chunks, and so tasks, of one job.
WAVE = 20_000
CHUNK = "chunk_id"
#: Files and bytes of finished chunks that a task reads, about: a chunk's file is far smaller than a split.
READ_FILES, READ_BYTES = 64, 32 << 20


class ChunksFailed(RuntimeError):
    """Some chunks raised; all others are in the table. A further run takes the failed ones only."""


def number_chunks(df: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """df with chunk_id: consecutive groups of chunk_rows rows in the order of keys (nulls of the first last), which tell rows apart."""
    ranked = group_rank(df, [], keys[0], [F.asc_nulls_last(keys[0]), *keys[1:]], name="_rank")
    return ranked.withColumn(CHUNK, F.expr(f"(_rank - 1) div {chunk_rows}")).drop("_rank", "_n")


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all finished chunks; None without any."""
    if not _files(spark, path):
        return None
    fs, at = _hadoop(spark, path)
    held = fs.getContentSummary(at)
    tasks = max(math.ceil(held.getFileCount() / READ_FILES), math.ceil(held.getLength() / READ_BYTES), spark.sparkContext.defaultParallelism)
    return spark.read.parquet(path).coalesce(tasks)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _files(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(at))


class _Told(AccumulatorParam):
    """{chunk: (its rows, its error)}; a task that is run twice tells the same."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:
        value1.update(value2)
        return value1


_frozen = False


def _freeze() -> None:
    """Once a worker: after each task, Spark collects garbage among all that its modules hold; from now on, only among what came since."""
    global _frozen
    if not _frozen:
        gc.collect()
        gc.freeze()
        _frozen = True


def _worked(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], added: str, failed: Accumulator[dict]) -> DataFrame:
    """rows with what work adds to a chunk; none of a chunk that raises, which is told in failed."""
    names = [*rows.columns, *[a.strip().split(" ")[0].strip("`") for a in added.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _freeze()
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        chunk = pd.concat(held, ignore_index=True)
        try:
            out = work(chunk)
            if len(out) != len(chunk):
                raise ValueError(f"{len(out)} results for {len(chunk)} rows")
            out = out[names]
        except Exception as error:  # the others go on; the caller gets it when they have ended
            failed.add({int(chunk[CHUNK].iloc[0]): (len(chunk), f"{type(error).__name__}: {error}")})
            return
        yield out

    return rows.mapInPandas(run, f"{_fields(rows)}, {added}")


def resume_append(df: DataFrame, path: str, keys: str | list[str], chunk_rows: int, work: Callable[[pd.DataFrame], pd.DataFrame] | None = None, added: str = "", at_once: int | None = None) -> int:
    """Append the rows that path doesn't hold yet, in chunks of chunk_rows in the order of keys; the number of rows written.

    work: is called with each chunk that is not there yet, once, and gives it back with the columns of `added` (as "name type, ..");
    a chunk that raises is left out, and all errors are raised as ChunksFailed when the others are done. A task that is lost with its
    executor is run again, and work with it. at_once: most chunks that are worked on at a time. keys have to tell rows apart (an
    error otherwise); null is a value as any other. If the table has grown at its end, the last chunk gets its rest.
    """
    spark, keys = df.sparkSession, [keys] if isinstance(keys, str) else keys
    if twice := df.groupBy(*keys).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"several rows have the key {tuple(twice[0])[:-1]}")
    todo, done = number_chunks(df, keys, chunk_rows), finished(spark, path)
    if done is not None:
        have = done.select(*[F.col(k).alias(f"_have_{k}") for k in keys])
        todo = todo.join(have, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_have_{k}")) for k in keys]), "left_anti")
    wave = min(at_once or WAVE, WAVE)
    staged = f"{path}/_todo_{uuid.uuid4().hex}"  # readers of the table don't see it
    todo.withColumn("_wave", F.expr(f"{CHUNK} div {wave}")).write.partitionBy("_wave").parquet(staged)
    waves = spark.read.schema(f"{_fields(todo)}, _wave long").parquet(staged)
    before = 0 if done is None else done.count()
    failed = spark.sparkContext.accumulator({}, _Told())
    try:
        counts = waves.groupBy("_wave").agg(F.count("*").alias("rows"), F.count_distinct(CHUNK).alias("chunks")).orderBy("_wave").collect()
        for w in counts:
            own = waves.filter(F.col("_wave") == w["_wave"]).drop("_wave")
            places = own.agg(F.array_sort(F.collect_set(CHUNK)).alias("_all")).select(F.posexplode("_all").alias("_place", "_chunk"))
            rows = own.join(F.broadcast(places), F.col(CHUNK) == F.col("_chunk")).repartitionById(w["chunks"], F.col("_place"))
            rows = rows.select(*todo.columns).sortWithinPartitions(*keys)
            rows = _worked(rows, work, added, failed) if work else rows
            rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 0).parquet(path)
    finally:
        fs, at = _hadoop(spark, staged)
        fs.delete(at, True)
    now, bad = finished(spark, path), failed.value
    written = (0 if now is None else now.count()) - before
    if bad:
        told = "; ".join(f"chunk {c}: {bad[c][1]}" for c in sorted(bad)[:10])
        raise ChunksFailed(f"{len(bad)} chunks failed: {told}")
    if written != (asked := sum(w["rows"] for w in counts)):
        raise RuntimeError(f"{written} rows of {asked} were written to {path}")
    return written


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
