"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Published idea: vertical (dimension by dimension) search with pruning bounds: de Vries, Mamoulis, Nes, Kersten: Efficient k-NN
Search on Vertically Decomposed Data (SIGMOD 2002); Kuffo, Krippner, Boncz: PDX (SIGMOD 2025).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.llm import blocks
from lexvane.llm.blocks import LEAST, MOST, against_all, as_float, clamped, in_blocks, place, spread  # noqa: F401
from lexvane.llm.common import materialise, table

TOP = 10
#: Dimensions that are added between two looks at the bounds.
STEP = 8
#: Most queries of a block, which is sent to all tasks, and most candidates of a cell, which a task holds at a time.
QUERY_BLOCK, CANDIDATE_BLOCK = blocks.QUERY_BLOCK, blocks.CANDIDATE_BLOCK
EXACT = float(1 << 53)


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component x, as whole numbers in array<double>; null if the vector is null or has a null component or one that is not finite (or whose product is not)."""
    product = lambda x: x.cast("double") * scale
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(product(x)) != float("inf")))
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  # larger doubles are whole numbers
    return F.when(vector.isNotNull() & fit, F.transform(vector, lambda x: whole(product(x))))


class Cell:
    """Candidates in vertical layout: a row for each dimension, a column for each candidate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.columns = rows, ids, vectors.T.copy()
        with np.errstate(over="ignore"):
            mass = np.cumsum((self.columns**2)[::-1], axis=0)[::-1]
        self.mass = np.sqrt(np.vstack([mass[::STEP], np.zeros((1, len(ids)))]))

    def _exact(self, query: np.ndarray, live: np.ndarray) -> np.ndarray:
        whole = [int(x) for x in query]
        return np.array([sum(a * int(b) for a, b in zip(whole, self.columns[:, c], strict=True)) for c in live], dtype=object)

    def search(self, row: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates but the query's own row: a block of dimensions at a time, without those whose bound is too low.

        The rest of a score is at most the product of the norms of what remains of both vectors (Cauchy-Schwarz). floor is a
        score that k other candidates reach; it rises with the k candidates that lead after each block. Whole numbers under
        2**53 are exact in floating point; for larger ones, survivors are scored anew in whole numbers of any size.
        """
        live = np.flatnonzero(self.rows != row)
        part = np.zeros(len(live))
        with np.errstate(over="ignore", invalid="ignore"):
            mass = np.sqrt(np.append(np.cumsum((query**2)[::-1])[::-1][::STEP], 0.0))
            largest = mass[0] * self.mass[0][live].max() if len(live) else 0.0
        small = largest < EXACT / 4  # no sum of products can leave what is exact
        slack = 1.0 if small else 1e-9 * largest + 1.0  # far more than what rounding can take from a bound
        if largest < 1e300:
            for b in range(ceil(len(query) / STEP)):
                dims = slice(b * STEP, (b + 1) * STEP)
                part = part + query[dims] @ self.columns[dims][:, live]
                if len(live) > k:
                    lead = live[np.argpartition(-part, k - 1)[:k]]
                    floor = max(floor, (query @ self.columns[:, lead]).min())
                rest = mass[b + 1] * self.mass[b + 1][live]
                keep = part + rest * (1 + 1e-9) + slack >= floor
                if not keep.all():
                    live, part = live[keep], part[keep]
        if not small:
            part = self._exact(query, live)
        order = sorted(range(len(live)), key=lambda i: (-part[i], self.ids[live[i]]))[:k] if len(live) <= 4 * k or not small else np.lexsort((self.ids[live], -part))[:k]
        return self.ids[live][order], part[order]


def _search(k: int):
    """A task's search: each query of a block goes through the cells of candidates one after the other; its k best so far are the score to beat in the next."""

    def run(asked: list, cells: Iterator) -> Iterator[tuple]:
        queries = [(a["row"], np.asarray(a["v"], np.float64)) for a in asked]
        found: dict[int, list] = {row: [] for row, _ in queries}
        for columns, whole in cells:
            cell = Cell(columns["row"], columns["id"], whole)
            for row, query in (x for x in queries if len(x[1]) == whole.shape[1]):
                kept = found[row]
                ids, scores = cell.search(row, query, k, as_float(kept[-1][0]) if len(kept) == k else -np.inf)
                found[row] = sorted(kept + [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        out = [(row, i, clamped(s), place(s)) for row, kept in found.items() for s, i in kept]
        yield tuple(zip(*out, strict=True)) if out else ((), (), (), ())

    return run


FOUND = "row long, id long, score long, place string"


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = 1024) -> DataFrame:
    """(query_id, rank, key, score): each query's k best other rows by inner product of quantised vectors; ties go to the smaller key.

    All queries meet all rows: a block of queries of bounded size is sent to all tasks, which read the candidates' file as a stream and
    keep the k best of each query, so no candidate is shuffled. Rows with a null key, a null vector or a null or
    non-finite component take no part. Rows that repeat a key are queries and candidates of their own. Vectors of another
    length than a query's are no candidates for it. Queries without candidates give no rows. Scores rank exactly, whatever finite
    doubles the vectors hold; those that a long can't hold come back as the least or greatest long. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), quantised(F.col(vector), scale).alias("v"))
    whole = whole.filter("id is not null and v is not null").withColumn("d", F.size("v")).filter("d > 0")
    rows = materialise(spread(whole, vectors.count()), "vectors")
    candidates, best = rows.select("row", "id", "v", "d"), spark.createDataFrame([], FOUND)
    for block in in_blocks(rows.filter("is_query").select("row", "v", "d"), QUERY_BLOCK):
        best = best.unionByName(materialise(against_all(candidates, block, _search(k), FOUND, CANDIDATE_BLOCK), "best"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("place"), "id"))
    found = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.join(rows.filter("is_query").select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", F.col("id").alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
with v as (select row_number() over () as r, vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.r, a.vec_id as query_id, b.vec_id, cast(list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)]) as bigint) as score
           from v a join v b on a.vec_id % 100 = 0 and a.r <> b.r),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""
