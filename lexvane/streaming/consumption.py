"""What a run of training has drawn: positions over endless epochs, kept in tables, with groups that come back dealt again first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Consumption:
    """Positions that have been drawn and given back, under one folder; a restart goes on from there.

    A draw counts once its table is committed; a run that dies before has drawn nothing. At a time, one run draws.
    """

    def __init__(self, spark: SparkSession, path: str, must_exist: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        if must_exist and self._table("drawn") is None:
            raise ValueError(f"{path} holds no saved state")

    def _table(self, name: str) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema("pos long").parquet(f"{self.path}/{name}")

    def _uses(self) -> DataFrame:
        """(pos, drawn, returned): how often each position was drawn, and came back."""
        out = self.spark.createDataFrame([], "pos long, drawn int, returned int")
        for name, one in (("drawn", (1, 0)), ("returned", (0, 1))):
            if (rows := self._table(name)) is not None:
                out = out.unionByName(rows.select("pos", F.lit(one[0]).alias("drawn"), F.lit(one[1]).alias("returned")))
        return out.groupBy("pos").agg(F.sum("drawn").alias("drawn"), F.sum("returned").alias("returned"))

    def outstanding(self) -> DataFrame:
        """(pos) of what came back and has not been drawn again."""
        return self._uses().filter("drawn = returned").select("pos")

    def offset(self) -> int:
        """The first position that was never drawn."""
        rows = self._table("drawn")
        last = rows.agg(F.max("pos")).first()[0] if rows is not None else None
        return 0 if last is None else last + 1

    def draw(self, n: int) -> DataFrame:
        """(pos) of the next n positions: those that came back, in their order, then new ones. They are drawn when this returns."""
        back, start = self.outstanding().orderBy("pos").limit(n), self.offset()
        k = back.count()
        now = [r["pos"] for r in back.collect()] if k else []  # n at most, a batch
        rows = self.spark.range(start, start + n - k).select(F.col("id").alias("pos"))
        if now:
            rows = self.spark.createDataFrame([(p,) for p in now], "pos long").unionByName(rows)
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/drawn")
        return rows

    def give_back(self, positions: DataFrame) -> None:
        """Positions that were drawn but not used; what isn't out at the moment can't come back (an error, and nothing does)."""
        back = positions.select("pos")
        out = self._uses().filter("drawn > returned").select("pos")
        wrong = back.join(out, "pos", "left_anti").agg(F.min("pos")).first()[0]
        twice = back.groupBy("pos").count().filter("count > 1").agg(F.min("pos")).first()[0]
        if wrong is not None or twice is not None:
            raise ValueError(f"position {wrong if wrong is not None else twice} isn't drawn, or comes back twice")
        back.coalesce(1).write.mode("append").parquet(f"{self.path}/returned")
