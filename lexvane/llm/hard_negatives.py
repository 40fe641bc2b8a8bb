"""Hard negatives: rows of another label that score just below an anchor's positives, found by coordinate pruning.

Published method: Teflioudi, Gemulla, Mykytiuk: LEMP, Fast Retrieval of Large Entries in a Matrix Product (SIGMOD 2015). Candidates are
cut into buckets of similar length; a bucket keeps a sorted list of each coordinate of its normalised vectors. For an anchor and a
score to reach, each of the anchor's focus coordinates (the largest ones) has a feasible range of values; only candidates that lie
in the range of every focus coordinate are scored, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.llm.blocks import against_all, as_float, clamped, in_blocks, number, place, spread
from lexvane.llm.common import materialise, table
from lexvane.llm.topk import EXACT, quantised

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Percent of the positive's score that a negative's has to reach, and may reach.
FROM, TO = 30, 90
#: Coordinates that an anchor looks at; the shortest vector of a bucket, as a share of its longest; least rows of a bucket.
FOCUS, SHRINK, LEAST_ROWS = 8, 0.9, 64


class Bucket:
    """Candidates of similar length: unit vectors, and for each coordinate their places in rising order and the values in that order."""

    def __init__(self, whole: np.ndarray, lengths: np.ndarray, at: np.ndarray):
        self.whole, self.at, self.longest = whole, at, lengths.max()
        self.listed = None
        if 0 < self.longest < np.inf:
            unit = whole / np.where(lengths > 0, lengths, 1.0)[:, None]
            self.listed = np.argsort(unit, axis=0, kind="stable").T.copy()
            self.values = np.take_along_axis(unit.T, self.listed, axis=1)

    def reach(self, query: np.ndarray, length: float, least: float) -> np.ndarray:
        """Places of candidates that may score least or more; all, where nothing can be told.

        Such a candidate's cosine is least / (length * longest) at the least, so its angle to the anchor is some `wide` at most, and
        its angle to a coordinate axis differs from the anchor's by no more than that.
        """
        everything = np.arange(len(self.whole))
        bound = length * self.longest
        if self.listed is None or not 0 < least < np.inf or not 0 < bound < np.inf:
            return everything if least <= 0 or bound > 0 else everything[:0]
        if least > bound * (1 + 1e-9) + 1:
            return everything[:0]
        wide = np.arccos(np.clip(least / bound - 1e-9, -1.0, 1.0)) + 1e-7
        unit = query / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle = np.arccos(np.clip(unit[focus], -1.0, 1.0))
        low, high = np.cos(np.minimum(np.pi, angle + wide)) - 1e-9, np.cos(np.maximum(0.0, angle - wide)) + 1e-9
        seen, needed = np.zeros(len(everything), np.int16), 0
        for f, a, b in zip(focus, low, high, strict=True):
            start, end = np.searchsorted(self.values[f], a, "left"), np.searchsorted(self.values[f], b, "right")
            if end - start < len(everything):
                seen[self.listed[f, start:end]] += 1
                needed += 1
        return np.flatnonzero(seen == needed) if needed else everything


class Lists:
    """The candidates of a cell, in buckets of falling length."""

    def __init__(self, columns: dict[str, np.ndarray], whole: np.ndarray):
        self.ids, self.rows = columns["id"], columns["row"]
        self.names, self.labels = np.unique(columns["label"].astype(str), return_inverse=True)
        with np.errstate(over="ignore"):
            lengths = np.sqrt((whole**2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        cuts, start = [], 0
        for i in range(1, len(order) + 1):
            if i == len(order) or i - start >= LEAST_ROWS and lengths[order[i]] < SHRINK * lengths[order[start]]:
                cuts.append(order[start:i])
                start = i
        self.buckets = [Bucket(whole[c], lengths[c], c) for c in cuts]

    def code(self, label: str) -> int:
        """The number of a label in this cell; -1 for one that it doesn't have."""
        k = int(np.searchsorted(self.names, label))
        return k if k < len(self.names) and self.names[k] == label else -1


def scores(query: np.ndarray, length: float, bucket: Bucket, some: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products: doubles hold them if no sum of products can leave 2**53, else in whole numbers of any size."""
    if length * bucket.longest < EXACT / 4:
        return (bucket.whole[some] @ query).astype(np.int64)
    ask = [int(x) for x in query]
    return np.array([sum(a * int(b) for a, b in zip(ask, bucket.whole[c], strict=True)) for c in some] + [None], dtype=object)[:-1]


def best(found: list[tuple[int, int]], new: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k first of (score, id), highest score first, ties by smaller id."""
    return sorted(found + new, key=lambda x: (-x[0], x[1]))[:k]


def leading(values: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k first."""
    if len(values) > k and values.dtype != object:
        edge = np.partition(values, len(values) - k)[len(values) - k]
        keep = values >= edge
        values, ids = values[keep], ids[keep]
    return best([], [(int(s), int(i)) for s, i in zip(values, ids, strict=True)], k)


def _lengths(query: np.ndarray) -> float:
    with np.errstate(over="ignore"):
        return float(np.sqrt((query**2).sum()))


def find_positives(anchors: list, candidates: Iterator) -> Iterator[tuple]:
    """(row, id, score, place): each anchor's POSITIVES best rows of its label among a task's candidates."""
    found: dict[int, list] = {a["row"]: [] for a in anchors}
    asked = [(a["row"], a["label"], np.asarray(a["v"], np.float64)) for a in anchors]
    for columns, whole in candidates:
        lists = Lists(columns, whole)
        for row, label, query in (x for x in asked if len(x[2]) == whole.shape[1]):
            code, length = lists.code(label), _lengths(query)
            for bucket in lists.buckets if code >= 0 else []:
                least = found[row][-1][0] if len(found[row]) == POSITIVES else None
                some = bucket.reach(query, length, -np.inf if least is None else as_float(least))
                some = some[(lists.labels[bucket.at[some]] == code) & (lists.rows[bucket.at[some]] != row)]
                if len(some):
                    found[row] = best(found[row], leading(scores(query, length, bucket, some), lists.ids[bucket.at[some]], POSITIVES), POSITIVES)
    out = [(row, i, clamped(s), place(s)) for row, kept in found.items() for s, i in kept]
    yield tuple(zip(*out, strict=True)) if out else ((), (), (), ())


def find_negatives(anchors: list, candidates: Iterator) -> Iterator[tuple]:
    """(row, turn, id, score, place): for each positive (turn) of an anchor, the NEGATIVES best rows of other labels within its range.

    anchors have marks: (turn, place of the positive's score). A candidate is looked at if it can reach the least score that any of
    them still asks for: the lower end of its range, or its last find so far.
    """
    asked, found, ends = [], {}, {}
    for a in anchors:
        asked.append((a["row"], a["label"], np.asarray(a["v"], np.float64), [m["turn"] for m in a["marks"]]))
        for m in a["marks"]:
            score = number(m["place"])
            ends[a["row"], m["turn"]] = (-(-FROM * score // 100), TO * score // 100)
            found[a["row"], m["turn"]] = []
    for columns, whole in candidates:
        lists = Lists(columns, whole)
        for row, label, query, turns in (x for x in asked if len(x[2]) == whole.shape[1]):
            code, length = lists.code(label), _lengths(query)
            turns = [t for t in turns if ends[row, t][0] <= ends[row, t][1]]
            for bucket in lists.buckets if turns else []:
                asks = {t: max(ends[row, t][0], found[row, t][-1][0]) if len(found[row, t]) == NEGATIVES else ends[row, t][0] for t in turns}
                some = bucket.reach(query, length, as_float(min(asks.values())))
                some = some[lists.labels[bucket.at[some]] != code]
                if not len(some):
                    continue
                values, ids = scores(query, length, bucket, some), lists.ids[bucket.at[some]]
                for t in turns:
                    fit = ((values >= asks[t]) & (values <= ends[row, t][1])).astype(bool)
                    if fit.any():
                        found[row, t] = best(found[row, t], leading(values[fit], ids[fit], NEGATIVES), NEGATIVES)
    out = [(row, t, i, clamped(s), place(s)) for (row, t), kept in found.items() for s, i in kept]
    yield tuple(zip(*out, strict=True)) if out else ((), (), (), (), ())


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


FOUND = "row long, id long, score long, place string"
MINED = "row long, turn int, id long, score long, place string"


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Positives are an anchor's first POSITIVES other rows of its label, by falling inner product of quantised vectors, then key;
    negatives the first NEGATIVES rows of other labels whose score is FROM to TO percent of the positive's. So a positive of a
    negative score has none. Rows with a null key, label or vector, or a component that is null or not finite, take no part; rows
    that repeat a key are rows of their own; vectors of another width than an anchor's are not compared with it. Scores that a long
    can't hold come back as the least or greatest long, but count by their exact value. Without anchors the result is empty.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), quantised(F.col(vector), scale).alias("v"))
    whole = whole.filter("id is not null and label is not null and v is not null").withColumn("d", F.size("v")).filter("d > 0")
    rows = materialise(spread(whole, vectors.count()), "candidates")
    anchors = rows.filter("asks").select("row", "id", "label", "v", "d")
    candidates = rows.select("row", "id", "label", "v", "d")
    first = _union([materialise(against_all(candidates, block, find_positives, FOUND), "positives") for block in in_blocks(anchors)], spark, FOUND)
    turn = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("place"), "id"))
    positives = materialise(first.withColumn("turn", turn).filter(F.col("turn") <= POSITIVES), "positives")
    marks = positives.groupBy("row").agg(F.collect_list(F.struct("turn", "place")).alias("marks"))
    marked = materialise(anchors.join(marks, "row"), "anchors")
    mined = _union([materialise(against_all(candidates, block, find_negatives, MINED), "negatives") for block in in_blocks(marked)], spark, MINED)
    rank = F.row_number().over(Window.partitionBy("row", "turn").orderBy(F.desc("place"), "id"))
    kept = mined.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES).select("row", "turn", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = positives.select("row", "turn", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return known.join(kept, ["row", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


ORACLE = f"""
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as q from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.r, a.vec_id as anchor_id, b.vec_id as id, b.r as o, a.label = b.label as same, cast(list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)]) as bigint) as score
           from v a join v b on a.vec_id % 100 = 0 and a.r <> b.r and len(a.q) = len(b.q)),
positives as (select * from (select *, row_number() over (partition by r order by score desc, id, o) as turn from scored where same) where turn <= {POSITIVES}),
fit as (select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score, row_number() over (partition by p.r, p.turn order by n.score desc, n.id, n.o) as rank
        from positives p join scored n on p.r = n.r and not n.same and {FROM} * p.score <= 100 * n.score and 100 * n.score <= {TO} * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from fit where rank <= {NEGATIVES}
"""
