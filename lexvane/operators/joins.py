"""Joins: explanation caches, reuse of earlier runs, routing, ordered zips and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.functions.text import extract_tag, text_key, unwrap
from lexvane.operators.ranks import group_rank

TEXT, EXPLANATION = "detokenized_text_truncated", "api_explanation"


def union_caches(caches: list[DataFrame], ordinal: str | None = None) -> DataFrame:
    """(text_key, explanation): one row for each text; a later source wins, within a source the later row (by ordinal; else the greater text)."""
    rows = None
    for source, cache in enumerate(caches):
        row = F.col(ordinal) if ordinal else F.lit(0)
        part = cache.filter(F.col(EXPLANATION).isNotNull()).select(text_key(F.col(TEXT)).alias("text_key"), F.col(EXPLANATION), F.lit(source).alias("_s"), row.cast("long").alias("_r"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no caches")
    return rows.groupBy("text_key").agg(F.max(F.struct("_s", "_r", EXPLANATION))[EXPLANATION].alias(EXPLANATION))


def cache_join(df: DataFrame, caches: list[DataFrame], ordinal: str | None = None, key: str | None = None) -> DataFrame:
    """df with the cached explanation of its text; null is a miss. The cache has one row a text before the join.

    key: df's column with text_key() of the text, where df holds no texts.
    """
    cache = union_caches(caches, ordinal).withColumnRenamed("text_key", "_key")
    return df.withColumn("_k", F.col(key) if key else text_key(F.col(TEXT))).join(cache, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def cache_misses(df: DataFrame, caches: list[DataFrame]) -> DataFrame:
    """Rows whose text no cache holds."""
    cache = union_caches(caches).select(F.col("text_key").alias("_key"))
    return df.withColumn("_k", text_key(F.col(TEXT))).join(cache, F.col("_k") == F.col("_key"), "left_anti").drop("_k")


def store_cache(caches: list[DataFrame], name: str, path: str, buckets: int, ordinal: str | None = None) -> None:
    """union_caches() as the catalog's table `name` at path, in buckets of its key, so that no later join moves it."""
    rows = union_caches(caches, ordinal).repartition(buckets, "text_key")
    rows.write.bucketBy(buckets, "text_key").sortBy("text_key").option("path", path).saveAsTable(name)


def stored_cache_join(df: DataFrame, name: str) -> DataFrame:
    """cache_join() with a stored cache: only df's rows are shuffled, to the cache's buckets."""
    cache = df.sparkSession.table(name).withColumnRenamed("text_key", "_key")
    return df.withColumn("_k", text_key(F.col(TEXT))).join(cache, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def store_prior(prior: DataFrame, name: str, path: str, buckets: int, template: str | None = None, tag: str = "explanation", ordinal: str | None = None) -> None:
    """The explanations of an earlier run by (doc_id, n_raw_tokens), as a bucketed table for stored_reuse_join()."""
    rows = _known(prior, template, tag, ordinal).repartition(buckets, *KEY)
    rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)


def stored_reuse_join(raw: DataFrame, name: str, min_frac: float = 0.95) -> DataFrame:
    """reuse_join() with a stored earlier run, whose buckets stay where they are."""
    return _reused(raw, raw.sparkSession.table(name), min_frac)


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row: rows, unique_texts, duplicate_rows."""
    return cache.groupBy(text_key(F.col(TEXT)).alias("k")).count().agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("unique_texts")).withColumn("duplicate_rows", F.col("rows") - F.col("unique_texts"))


def recover_cache(av: DataFrame | None, ar: DataFrame | None, template: str, tag: str = "explanation") -> DataFrame:
    """(text, explanation) from final tables: av has tagged responses, ar has prompts made of template."""
    parts = []
    if av is not None:
        parts.append(av.select(TEXT, extract_tag(F.col("response"), tag).alias(EXPLANATION)))
    if ar is not None:
        parts.append(ar.select(TEXT, unwrap(F.col("prompt"), template, "explanation").alias(EXPLANATION)))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    bad, rows = out.agg(F.count_if(F.col(EXPLANATION).isNull() | (F.col(EXPLANATION) == "")), F.count("*")).first()
    if bad:
        raise ValueError(f"{bad} of {rows} rows don't fit their template")
    return out


def reuse_join(raw: DataFrame, prior: DataFrame, min_frac: float = 0.95, template: str | None = None, tag: str = "explanation", ordinal: str | None = None) -> DataFrame:
    """raw rows that an earlier run explained, by (doc_id, n_raw_tokens); too few matches, or none at all, are an error.

    prior is an av table (with response), an ar table (with prompt, made of template) or has api_explanation; its last row
    of a key wins. The share is counted on keys, before the wide rows meet.
    """
    return _reused(raw, _known(prior, template, tag, ordinal), min_frac)


KEY = ["doc_id", "n_raw_tokens"]


def _known(prior: DataFrame, template: str | None, tag: str, ordinal: str | None) -> DataFrame:
    """(doc_id, n_raw_tokens, explanation) of an earlier run, one row a key."""
    if "response" in prior.columns:
        text = extract_tag(F.col("response"), tag)
    elif EXPLANATION in prior.columns:
        text = F.col(EXPLANATION)
    else:
        text = unwrap(F.col("prompt"), template, "explanation")
    row = F.col(ordinal).cast("long") if ordinal else F.lit(0).cast("long")
    rows = prior.select(*KEY, text.alias(EXPLANATION), row.alias("_r")).filter(F.col(EXPLANATION).isNotNull())
    return rows.groupBy(*KEY).agg(F.max(F.struct("_r", EXPLANATION))[EXPLANATION].alias(EXPLANATION))


def _reused(raw: DataFrame, known: DataFrame, min_frac: float) -> DataFrame:
    total, hits = raw.select(*KEY).join(known.select(*KEY, F.lit(1).alias("_hit")), KEY, "left").agg(F.count("*"), F.count("_hit")).first()
    if not total or hits < min_frac * total:
        raise ValueError(f"{hits} of {total} rows match the earlier run; {min_frac:.0%} are needed")
    return raw.join(known, KEY)


def route(df: DataFrame, buckets: DataFrame, key: str = "doc_id", max_broadcast: int = 1_000_000) -> DataFrame:
    """df with the bucket of its key; the key set is broadcast if it is small, else both sides are shuffled."""
    small = buckets.limit(max_broadcast + 1).count() <= max_broadcast
    return df.join(F.broadcast(buckets) if small else buckets, key)


def zip_join(left: DataFrame, right: DataFrame, order_left: str | list[str], order_right: str | list[str]) -> DataFrame:
    """The i-th row of left, in the order of one or more columns (no nulls), with the i-th of right; unequal counts are an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows can't be paired with {b}")

    def ranked(rows: DataFrame, order: str | list[str]) -> DataFrame:
        order = [order] if isinstance(order, str) else order
        return group_rank(rows, [], order[0], order, name="_rank").drop("_n")

    return ranked(left, order_left).join(ranked(right, order_right), "_rank").drop("_rank")


def scatter_back(samples: DataFrame, results: DataFrame, index: str, value: str, default: float) -> DataFrame:
    """samples with the value that came back for their index; the default for those without."""
    return samples.join(results.select(index, value), index, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def audit(a: DataFrame, b: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row: shared, only_a, only_b, text_mismatches, overlap_pct (of the keys of a). Keys are unique on each side."""
    both = a.select(*keys, F.col(text).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*keys, F.col(text).alias("_b"), F.lit(1).alias("_in_b")), keys, "full_outer")
    shared = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    out = both.agg(F.count_if(shared).alias("shared"), F.count_if(F.col("_in_b").isNull()).alias("only_a"), F.count_if(F.col("_in_a").isNull()).alias("only_b"), F.count_if(shared & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("text_mismatches"))
    return out.withColumn("overlap_pct", F.round(F.try_divide(100.0 * F.col("shared"), F.col("shared") + F.col("only_a")), 4))


def baseline_gap(real: DataFrame, shuffled: DataFrame, step: str, metric: str) -> DataFrame:
    """(step, real, shuffled, gap) of two metric tables."""
    return real.select(step, F.col(metric).alias("real")).join(shuffled.select(step, F.col(metric).alias("shuffled")), step).withColumn("gap", F.round(F.col("shuffled") - F.col("real"), 6))
