"""Scans and sinks over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only these columns are read."""
    return spark.read.parquet(path).select(*columns)


def corpus_scan(spark: SparkSession, path: str, corpus: str, split: str, start: int, length: int, text_col: str, ordinal_col: str) -> DataFrame:
    """(doc_id, ordinal, text) of ordinals start <= o < start + length; the filter reaches the scan. doc_id is corpus:split:ordinal.

    Ordinals are absolute, so slices can be merged. A slice beyond the end is an error.
    """
    rows = spark.read.parquet(path)
    last = rows.agg(F.max(ordinal_col)).first()[0]
    if last is None or start + length - 1 > last:
        raise ValueError(f"the slice ends at {start + length - 1}, the corpus at {last}")
    part = rows.filter((F.col(ordinal_col) >= start) & (F.col(ordinal_col) < start + length))
    return part.select(F.concat_ws(":", F.lit(corpus), F.lit(split), F.col(ordinal_col).cast("string")).alias("doc_id"), F.col(ordinal_col).alias("ordinal"), F.col(text_col).alias("text"))


def write_table(df: DataFrame, path: str, max_records: int = 65_536, partition_by: list[str] | None = None) -> None:
    """Files, and row groups within them, of max_records rows at most, so no reader meets a huge list buffer. Zstandard finds the prefixes of a text in each other."""
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", max_records).option("parquet.block.row.count.limit", max_records)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_split(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    """All buckets in one pass, one folder each."""
    write_table(df, path, partition_by=[bucket])


def rollout_scan(spark: SparkSession, path: str, steps: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """A rollout table, partitioned by step: only these steps' folders are read."""
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("step").isin(steps)) if steps is not None else rows
    return rows.select(*columns) if columns else rows


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has ended."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def row_groups(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, row groups, rows of the largest group) of a written table, told by the files' footers alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, sizes = spark.read.parquet(path).inputFiles(), []
    for file in files:
        at = jvm.org.apache.hadoop.fs.Path(file)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
        try:
            sizes += [g.getRowCount() for g in reader.getRowGroups()]
        finally:
            reader.close()
    return len(files), len(sizes), max(sizes, default=0)


def check_row_groups(spark: SparkSession, path: str, most: int = 65_536) -> None:
    """An error if a row group of the table has more than `most` rows."""
    if (largest := row_groups(spark, path)[2]) > most:
        raise ValueError(f"{path} has a row group of {largest} rows; {most} are allowed")
