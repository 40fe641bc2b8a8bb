"""Helpers that several operators share: whitespace words, size-checked broadcasts and scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane import share_code

#: The six ASCII white-space characters, as a character set for translate and trim.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: Column) -> Column:
    """Words of a text as array<string>: runs without ASCII white space; null or blank texts have none.

    Splits at one plain character, which is several times as fast as at a pattern.
    """
    plain = F.coalesce(text, F.lit(""))
    for other in SPACES[1:]:
        plain = F.replace(plain, F.lit(other), F.lit(" "))
    plain = F.trim(plain)
    parts = F.split(plain, " ")
    return F.when(plain == "", F.array().cast("array<string>")).when(F.contains(plain, F.lit("  ")), F.filter(parts, lambda w: w != "")).otherwise(parts)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; otherwise as it is, for a shuffled join.

    The check reads one row more than the bound at most. The result of a join is the same in both cases.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_hot(rows: DataFrame, side: DataFrame, key: str, spread: Column, max_rows: int, salts: int = 32) -> DataFrame:
    """rows left join side, which has one row a key, where one key may hold a large share of rows.

    A side of at most max_rows rows is broadcast. Beyond that, each row of side is there once for each salt, and the rows of a
    key are dealt by a hash of spread, so that no task gets them all; rows without a key take no part in the shuffle.
    """
    if side.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(side), key, "left")
    wide = side.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("join_salt"))
    dealt = rows.filter(F.col(key).isNotNull()).withColumn("join_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(wide, [key, "join_salt"], "left").drop("join_salt").unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, empty: Callable[[], None]) -> None:
    """Called by an operator's task in a Python worker that remembers things in `owner`: empties what other operators remember.

    Workers serve one stage after another, so without this the memories of all stages of a pipeline would add up. What the
    earlier operators freed goes back to the system, as Arrow's pool and the C library would keep it.
    """
    others = [n for n in _held if n != owner]
    for name in others:
        _held.pop(name)()
    _held[owner] = empty
    if others:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)


_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary folder where that is unset (local mode alone)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexvane-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/lexvane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that materialise() returned and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        _delete(spark, path)
