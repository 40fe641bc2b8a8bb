"""Histogram gradient-boosted trees over statistics of a text, scored from flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexvane.llm.bpe import groups
from lexvane.llm.common import claim, table

#: Labelled rows that a model is fitted on, at most: those of least hash.
SAMPLE = 20_000
BINS, ROUNDS, DEPTH, RATE, L2, LEAST_WEIGHT = 64, 60, 4, 0.2, 1.0, 2.0

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&<>=+~^_@\\/", "pipe": b"|", "stop": b".,;:", "shout": b"!?", "line": b"\n", "space": b" \t\r\x0b\x0c", "wide": bytes(range(0x80, 0x100))}
FEATURES = ["log_bytes", "log_words", "word_bytes", *(f"{c}_share" for c in _CLASSES), "distinct_words", "same_as_last", "distinct_lines", "longest_word"]
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _k] = 1.0


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each text (UTF-8); a null text counts as empty, an empty one gives zeros, a long one counts whole."""
    out = np.zeros((len(texts), len(FEATURES)))
    counts = np.zeros((len(texts), 256))
    for i, t in enumerate(texts):
        if not t:
            continue
        counts[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        words = t.split()
        n = max(1, len(words))
        lines = [x for x in t.split(b"\n") if x]
        rest = len(FEATURES) - 4
        out[i, rest:] = len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, words), default=0))
        out[i, 1] = len(words)
    size = counts.sum(axis=1)
    shares = counts @ _MEMBER / np.maximum(size, 1)[:, None]
    out[:, 2] = size / np.maximum(out[:, 1], 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(out[:, 1])
    out[:, 3 : 3 + len(_CLASSES)] = shares
    return out


@dataclass
class Trees:
    """Complete trees of one depth as arrays: feature and threshold of each inner node (tree by tree), value of each leaf."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows go down a tree together."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, level by level: gradient histograms of all nodes and features, the best split of each node.

    Without rows the score is 0.5 for all; with one label only, it is near that label for all.
    """
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = (y.sum() + 0.5) / (len(y) + 1)
    total = np.full(len(y), np.log(share / (1 - share)))
    trees = Trees(float(np.log(share / (1 - share))), np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, leaves)))
    if len(np.unique(y)) < 2:
        return trees
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)  # bin > b: x > cuts[b]
    features, thresholds, values = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                place = (at - first) * BINS + binned[:, f]
                gl, hl = (np.bincount(place, w, n * BINS).reshape(n, BINS).cumsum(axis=1) for w in (g, h))
                gs, hs = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                gain = np.where((hl >= LEAST_WEIGHT) & (hs - hl >= LEAST_WEIGHT), gain, 0)[:, : len(cut)]
                b = gain.argmax(axis=1)
                better = gain[np.arange(n), b] > best
                best = np.where(better, gain[np.arange(n), b], best)
                feature[first : first + n] = np.where(better, f, feature[first : first + n])
                threshold[first : first + n] = np.where(better, cut[b], threshold[first : first + n])
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    trees.feature, trees.threshold, trees.value = np.array(features), np.array(thresholds), np.array(values)
    return trees


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x array<double>): statistics of each row's text; no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in groups(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(list(statistics(texts[start:stop])), pa.list_(pa.float64()))], [key, "x"])

    return docs.select(key, F.col(text).cast("string").cast("binary")).mapInArrow(run, f"`{key}` {kind}, x array<double>")


def fold(key: str):
    """crc32(key as text) mod 3; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from the texts of at most `sample` labelled documents outside fold 1: those of least key hash.

    Null keys and labels count for nothing; of several labels of a document the least counts, of several texts one. Without
    labelled rows, the score is 0.5 for all. Columns but key, text and label are not read.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 1)).groupBy(key).agg(F.min(label).alias("y"))
    chosen = F.broadcast(marked.orderBy(F.xxhash64(key), key).limit(sample).select(F.col(key).alias("id"), "y"))
    known = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(chosen, "id")
    rows = text_statistics(known, "id", "text").groupBy("id").agg(F.max("x").alias("x")).join(chosen, "id").orderBy("id").select("x", "y").collect()  # at most `sample` rows
    return boost(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["y"]) for r in rows]))


def score(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (default: the key), score double from 0 to 1, predicted int; a row for each row, no shuffle.

    A null text counts as empty; repeated rows each come back with the same score, and a text of any length counts whole. A score
    of exactly 0.5 is predicted 1. An empty table gives an empty one; columns but keep and text are not read.
    """
    names = [key] if keep is None else keep
    schema = T.StructType([*docs.select(*names).schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("classifier", lambda: None)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start, stop in groups(texts):
                p = trees.score(statistics(texts[start:stop]))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.select(*names, F.col(text).cast("string").cast("binary").alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that a model from the labelled part of the whole corpus takes for good; repeated rows all stay or all go."""
    trees = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct("*").alias("_row"))  # whole rows, so that no column name can clash
    return score(rows, trees, keep=["_row"]).filter("predicted = 1").select("_row.*")
