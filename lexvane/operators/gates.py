"""Filters and gates. A gate is one small aggregate; what breaks it raises, and never drops rows silently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.operators.ranks import with_percentiles

CJK = "[぀-ヿ㐀-鿿]"


def drop_failed(df: DataFrame, column: str) -> DataFrame:
    """Rows with a completion."""
    return df.filter(F.col(column).isNotNull())


def failure_counts(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, rows); kept rows have no reason."""
    return df.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def scorable(df: DataFrame, explanation: Column, critic_tokens: Column, max_ctx: int = 512) -> DataFrame:
    """df with final_status and scorable: truncated counts as failed, and so do a missing explanation and too long a critic prompt."""
    status = F.when(F.col("status") == "TRUNCATED", "FAILED").otherwise(F.col("status"))
    good = (status == "COMPLETED") & explanation.isNotNull() & (critic_tokens <= max_ctx)
    return df.withColumn("final_status", F.when(good, "COMPLETED").otherwise("FAILED")).withColumn("scorable", F.coalesce(good, F.lit(False)))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))


def violations(df: DataFrame, predicates: dict[str, Column], key: str) -> DataFrame:
    """(check, bad_rows, sample_key): rows that miss a predicate (null: missed), and the least key among them. One pass."""
    bad = {n: ~F.coalesce(p, F.lit(False)) for n, p in predicates.items()}
    one = df.agg(*[F.struct(F.lit(n).alias("check"), F.count_if(b).alias("bad_rows"), F.min(F.when(b, F.col(key))).alias("sample_key")).alias(n) for n, b in bad.items()])
    return one.select(F.explode(F.array(*bad)).alias("v")).select("v.*")


def gate_rows(df: DataFrame, predicates: dict[str, Column], key: str) -> DataFrame:
    """df itself, if every row keeps every predicate."""
    found = [r for r in violations(df, predicates, key).collect() if r["bad_rows"]]
    if found:
        raise ValueError("; ".join(f"{r['check']}: {r['bad_rows']} rows, such as {r['sample_key']}" for r in found))
    return df


def gate_table(df: DataFrame, meta: dict, stage: str, required: list[str], vector: str = "activation_vector") -> DataFrame:
    """df itself, if stage, norm, columns, width and row count agree with its record and it has rows."""
    wrong = []
    if meta["stage"] != stage:
        wrong.append(f"stage is {meta['stage']}, not {stage}")
    if meta.get("norm", "none") != "none":
        wrong.append(f"vectors are scaled ({meta['norm']})")
    if missing := [c for c in required if c not in df.columns]:
        wrong.append(f"columns {', '.join(missing)} are missing")
    if vector in df.columns:
        rows, low, high = df.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
        if rows and (low != meta["d_model"] or high != meta["d_model"]):
            wrong.append(f"vectors are {low} to {high} wide, not {meta['d_model']}")
    else:
        rows = df.count()
    if not rows or rows != meta["row_count"]:
        wrong.append(f"{rows} rows, the record says {meta['row_count']}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def check_contiguous(metas: DataFrame) -> DataFrame:
    """metas in the order of their slices, with expected_start and contiguous. A registry is small: one task sorts it."""
    before = F.lag(F.col("start") + F.col("length")).over(Window.orderBy("start"))
    return metas.withColumn("expected_start", before).withColumn("contiguous", F.col("expected_start").isNull() | (F.col("expected_start") == F.col("start")))


def flag_noisy(df: DataFrame, position: str, norm: str, layer: str, min_pos: int = 10, factor: float = 3.0) -> DataFrame:
    """df with noisy: an early position, or a norm over factor times its layer's median."""
    rows = with_percentiles(df, df, [layer], norm, [0.5], "_median")
    return rows.withColumn("noisy", (F.col(position) < min_pos) | (F.col(norm) > factor * F.get("_median", F.lit(0)))).drop("_median")


def cjk_rate(df: DataFrame, text: str, step: str) -> DataFrame:
    """(step, rows, cjk_rate): share of texts with Japanese or Chinese characters."""
    return df.groupBy(step).agg(F.count("*").alias("rows"), F.round(F.avg(F.when(F.col(text).rlike(CJK), 1.0).otherwise(0.0)), 6).alias("cjk_rate"))


def leak_scan(df: DataFrame, text: str, key: str, patterns: list[str], skip: list[str] | None = None) -> DataFrame:
    """(key, pattern): lower-cased patterns that a text contains, without the keys in skip. The patterns stand in the plan."""
    low = F.lower(F.col(text))
    hits = F.filter(F.array(*[F.lit(p.lower()) for p in patterns]), lambda p: F.contains(low, p))
    rows = df.filter(~F.col(key).cast("string").isin(skip)) if skip else df
    return rows.select(key, F.explode(hits).alias("pattern"))


#: Most bits of the Bloom filter of patterns that is sent to all tasks (64 a pattern and more up to there), and its hashes; characters of a text that are hashed at a time.
PATTERN_BITS, PATTERN_HASHES, PATTERN_CHARS = 1 << 28, 4, 1_000_000
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _windows(h: np.ndarray, g: int) -> np.ndarray:
    """Hashes of windows of 2 g characters from those of g characters."""
    return h[:-g] * np.uint64(pow(_BASE, g, 1 << 64)) + h[g:] if len(h) > g else h[:0]


def _hashes(text: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the text's windows of n characters), for rising lengths: from the hashes of their first and last g, g <= n < 2 g."""
    h, g = _points(text), 1
    for n in lengths:
        if n > len(text):
            return
        while 2 * g <= n:
            h, g = _windows(h, g), 2 * g
        x = (h[: len(text) - n + 1] * np.uint64(_MIX) ^ h[n - g :]) * np.uint64(_BASE) + np.uint64(n)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
        yield n, x ^ (x >> np.uint64(29))


def _places(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """Where the i-th bit of these hashes is."""
    return ((h + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def _candidates(text: str, lengths: list[int], held: np.ndarray, most: int) -> set[str]:
    """Windows that the filter holds; texts are hashed in pieces of `most` characters, which overlap by a pattern."""
    bits, found = len(held) * 8, set()
    for start in range(0, max(len(text), 1), most):
        piece = text[start : start + most + lengths[-1] - 1] if lengths else ""
        for n, h in _hashes(piece, lengths):
            at = None
            for i in range(PATTERN_HASHES):
                place = _places(h if at is None else h[at], i, bits)
                there = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                at = there if at is None else at[there]
            found.update(piece[i : i + n] for i in at.tolist())
    return found


def leak_patterns(df: DataFrame, text: str, key: str, patterns: DataFrame, column: str) -> DataFrame:
    """(key, pattern): which patterns of a table each lower-cased text contains, each once; any number of patterns in one pass over a text.

    All windows of a text that are as long as some pattern are looked up by their hashes (combined by doubling) in a Bloom filter of the patterns,
    bounded by PATTERN_BITS whatever they are; what it holds meets the patterns themselves in a join, so the filter decides how many windows
    go into the join, never the result. Work grows with the texts times the different lengths of patterns. Null and empty patterns are left
    out; texts that are null contain nothing.
    """
    few = patterns.select(F.lower(column).alias("pattern")).filter("pattern <> ''").distinct()
    sizes = few.groupBy(F.length("pattern").alias("n")).count().collect()  # a row for each length
    lengths, bits, most = sorted(r["n"] for r in sizes), 1 << 16, PATTERN_CHARS
    while bits < min(64 * sum(r["count"] for r in sizes), PATTERN_BITS):
        bits *= 2

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = np.array([x for p in pdf["pattern"] for _, found in _hashes(p, [len(p)]) for x in found], np.uint64)
            yield pd.DataFrame({"at": np.concatenate([_places(h, i, bits) for i in range(PATTERN_HASHES)])})

    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = few.mapInPandas(hashed, "at long").groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(bits // 64, "<i8")
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(table.view(np.uint8))  # little-endian: bit i is bit i & 7 of byte i >> 3

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for pdf in batches:
            keys, hits = [], []
            for k, t in zip(pdf[key], pdf["_text"], strict=True):
                found = _candidates(t, lengths, held, most)
                keys += [k] * len(found)
                hits += found
            yield pd.DataFrame({key: pd.Series(keys, dtype=object), "pattern": pd.Series(hits, dtype=object)})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.lower(text).alias("_text")).filter("_text is not null")
    return rows.mapInPandas(scan, f"`{key}` {kind}, pattern string").join(few, "pattern", "left_semi").select(key, "pattern")
