"""Aggregates: baselines, variance explained, reward reports, advantages, counters and parity."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.functions.text import display_text, extract_tag, source_label
from lexvane.functions.vectors import l2, normalize, pair_mse
from lexvane.operators.ranks import running_total, with_percentiles


def mean_baselines(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """One row: raw_variance and mean_norm, the errors of always answering the mean of the scaled vectors, plain and rescaled.

    Closed forms over one pass: for scaled vectors of mean square m and mean mu, raw = m - |mu|^2 / d, and with the rescaled
    mean, m + s^2 / d - 2 s |mu| / d. The sum of vectors is one array, whatever the rows.
    """
    scaled = df.select(normalize(F.col(vector), scale).alias("v")).filter("v is not null")
    sums = scaled.agg(Summarizer.mean(array_to_vector("v")).alias("mu"), F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"), F.first(F.size("v")).alias("d"))
    norm, d = l2(vector_to_array("mu")), F.col("d")
    return sums.select((F.col("square") / d - norm * norm / d).alias("raw_variance"), ((F.col("square") + scale**2 - 2 * scale * norm) / d).alias("mean_norm"))


def fve(df: DataFrame, pred: str, gold: str, scale: float) -> DataFrame:
    """One row: mse, raw_variance and fve = 1 - mse / raw_variance."""
    mse = df.agg(F.avg(pair_mse(F.col(pred), F.col(gold), scale)).alias("mse"))
    return mse.join(F.broadcast(mean_baselines(df, gold, scale).select("raw_variance"))).withColumn("fve", 1 - F.col("mse") / F.col("raw_variance"))


def batch_metrics(df: DataFrame, batch: str, pred: str, gold: str, scale: float) -> DataFrame:
    """(batch, n, loss_sum, pred_norm, gold_norm, fve); sums are divided by samples later. fve is against the batch's own mean."""
    d = F.size(gold)
    rows = df.select(batch, pair_mse(F.col(pred), F.col(gold), scale).alias("mse"), l2(F.col(pred)).alias("p"), l2(F.col(gold)).alias("g"), normalize(F.col(gold), scale).alias("v"), d.alias("d"))
    out = rows.groupBy(batch).agg(F.count("*").alias("n"), F.sum("mse").alias("loss_sum"), F.avg("p").alias("pred_norm"), F.avg("g").alias("gold_norm"), Summarizer.mean(array_to_vector("v")).alias("mu"), F.avg(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("sq"), F.first("d").alias("d"))
    norm = l2(vector_to_array("mu"))
    return out.select(batch, "n", "loss_sum", "pred_norm", "gold_norm", (1 - F.try_divide(F.col("loss_sum") / F.col("n"), (F.col("sq") - norm * norm) / F.col("d"))).alias("fve"))


def norm_profile(df: DataFrame, vector: str, layer: str) -> DataFrame:
    """(layer, n, mean_norm, p50, p99, scale): the scale is the next multiple of ten (of one, below ten) over the mean norm."""
    norms = df.select(layer, l2(F.col(vector)).alias("norm"))
    rows = with_percentiles(norms.groupBy(layer).agg(F.count("*").alias("n"), F.avg("norm").alias("mean_norm")), norms, [layer], "norm", [0.5, 0.99], "_p")
    rows = rows.select(layer, "n", "mean_norm", F.get("_p", F.lit(0)).alias("p50"), F.get("_p", F.lit(1)).alias("p99"))
    step = F.when(F.col("mean_norm") < 10, 1.0).otherwise(10.0)
    return rows.withColumn("scale", F.ceil(F.col("mean_norm") / step) * step)


def reward_report(df: DataFrame, step: str, reward: str, group: str) -> DataFrame:
    """(step, n, n_groups, group_size, mean, std, min, max, p10, p25, p50, p75, p90): population std, linear percentiles."""
    shares = [0.1, 0.25, 0.5, 0.75, 0.9]
    out = df.groupBy(step).agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.min(reward).alias("min"), F.max(reward).alias("max"))
    out = with_percentiles(out, df, [step], reward, shares, "_p").withColumn("group_size", F.col("n") / F.col("n_groups"))
    return out.select(step, "n", "n_groups", *[F.round(c, 6).alias(c) for c in ("group_size", "mean", "std", "min", "max")], *[F.round(F.get("_p", F.lit(i)), 6).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


def source_counts(df: DataFrame, step: str, doc_id: Column, rules: list[tuple[str, str]]) -> DataFrame:
    return df.groupBy(step, source_label(doc_id, rules).alias("source")).agg(F.count("*").alias("n"))


def report_rows(picked: DataFrame, doc_id: Column, response: Column, text: Column, rules: list[tuple[str, str]], vector: Column | None = None, n: int = 80, tag: str = "explanation") -> DataFrame:
    """Picked rows with source, explanation (lenient), shortened text and, for a vector, its norm."""
    out = picked.withColumns({"source": source_label(doc_id, rules), "explanation": extract_tag(response, tag, on_miss="raw"), "shown_text": display_text(text, n)})
    return out if vector is None else out.withColumn("norm", F.round(l2(vector), 6))


def group_advantage(df: DataFrame, group: list[str], reward: str, eps: float = 1e-6) -> DataFrame:
    """df with advantage = (reward - mean) / (population std + eps) of its group; a group of one gets 0."""
    w = Window.partitionBy(*group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + eps))


def length_drift(df: DataFrame, step: str, length: str, reward: str) -> DataFrame:
    """(step, n, mean_length, length_reward_corr)."""
    return df.groupBy(step).agg(F.count("*").alias("n"), F.round(F.avg(length), 6).alias("mean_length"), F.round(F.corr(F.col(length).cast("double"), reward), 6).alias("length_reward_corr"))


def stage_counters(df: DataFrame, bucket: str, doc: str = "doc_id") -> DataFrame:
    """(bucket, docs, rows)."""
    return df.groupBy(bucket).agg(F.count_distinct(doc).alias("docs"), F.count("*").alias("rows"))


def pick_marker(df: DataFrame, text: str, low: int = 0x3200, high: int = 0x33FF) -> DataFrame:
    """(code_point, hits) of the rarest character of a range in the corpus; the lowest code point of equally rare ones."""
    inside = f"[{chr(low)}-{chr(high)}]"
    found = df.filter(F.col(text).rlike(inside)).select(F.explode(F.expr(f"regexp_extract_all({text}, '({inside})', 1)")).alias("c")).groupBy(F.ascii("c").cast("long").alias("_cp")).count()
    points = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "code_point")
    return points.join(found, points.code_point == found["_cp"], "left").select("code_point", F.coalesce("count", F.lit(0)).alias("hits")).orderBy("hits", "code_point").limit(1)


def packed_last_index(df: DataFrame, ordinal: str, length: str) -> DataFrame:
    """df with last_index: the place of its last token in the stream of all sequences in order."""
    return running_total(df, ordinal, length, "_end").withColumn("last_index", F.col("_end") - 1).drop("_end")


def parity(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float, least: int = 1) -> DataFrame:
    """One row: n, max_gap = max |a / b - 1|, ok: within the tolerance, on `least` rows or more."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    out = both.agg(F.count("*").alias("n"), F.max(F.abs(F.try_divide(F.col("_a"), F.col("_b")) - 1)).alias("max_gap"))
    return out.withColumn("ok", F.coalesce((F.col("n") >= least) & (F.col("max_gap") <= tolerance), F.lit(False)))
