"""Splits by document, unions of shards, and the three kinds of training tables."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.functions.text import render, user_prompt, wrap_tag
from lexvane.operators.joins import EXPLANATION, TEXT
from lexvane.operators.ranks import hash_rank

VECTOR = "activation_vector"
PROVENANCE = ["n_raw_tokens", "activation_layer", "doc_id"]


def distinct_docs(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    return df.select(doc).distinct()


def _buckets(docs: DataFrame, n: int, fractions: tuple[float, float, float], seed: int, doc: str) -> DataFrame:
    first, second = (floor(n * float(f)) for f in fractions[:2])
    rank = F.col("rank")
    return hash_rank(docs, seed, [doc]).select(doc, F.when(rank <= first, "av").when(rank <= first + second, "ar").otherwise("rl").alias("bucket"))


def _check_fractions(fractions: tuple[float, float, float]) -> None:
    if min(fractions) < 0 or abs(sum(fractions) - 1) > 1e-6:
        raise ValueError(f"fractions have to be 0 or more and sum up to 1: {fractions}")


def document_buckets(df: DataFrame, fractions: tuple[float, float, float], seed: int, doc: str = "doc_id") -> DataFrame:
    """(doc, bucket): of the distinct documents in seeded order, int(n * f1) are av, the next int(n * f2) ar, the rest rl."""
    _check_fractions(fractions)
    docs = distinct_docs(df, doc)
    return _buckets(docs, docs.count(), fractions, seed, doc)


def split_docs(df: DataFrame, fractions: tuple[float, float, float], seed: int, doc: str = "doc_id", documents: DataFrame | None = None, max_broadcast: int = 1_000_000) -> DataFrame:
    """df with its document's bucket: no document is in two.

    documents: a table of the same documents that costs less to read than df, if there is one. The number of documents, taken once,
    also tells whether their buckets are broadcast.
    """
    _check_fractions(fractions)
    docs = distinct_docs(df if documents is None else documents, doc)
    n = docs.count()
    buckets = _buckets(docs, n, fractions, seed, doc)
    return df.join(F.broadcast(buckets) if n <= max_broadcast else buckets, doc)


def check_split(df: DataFrame, documents: DataFrame, doc: str = "doc_id", bucket: str = "bucket") -> DataFrame:
    """One row: docs_in_two (has to be 0), docs_missing (of documents; has to be 0)."""
    per_doc = df.groupBy(doc).agg(F.count_distinct(bucket).alias("k"))
    whole = documents.select(doc).distinct().join(per_doc, doc, "left")
    return whole.agg(F.count_if(F.col("k") > 1).alias("docs_in_two"), F.count_if(F.col("k").isNull()).alias("docs_missing"))


def order_shards(metas: DataFrame) -> DataFrame:
    """Records of shards by the start of their slices, with shard, the place from 0; equal starts by length. A registry is small: one task sorts it."""
    return metas.withColumn("shard", F.row_number().over(Window.orderBy("start", "length")).cast("long") - 1).orderBy("shard")


def merge_shards(shards: list[DataFrame], metas: DataFrame) -> DataFrame:
    """Union of shards whose records agree, follow each other and count right; anything else is an error."""
    from lexvane.operators.gates import check_contiguous

    same = metas.agg(*[F.count_distinct(c).alias(c) for c in ("base_model", "layer_index", "d_model", "norm", "corpus", "positions_per_doc")]).first().asDict()
    if unlike := [c for c, n in same.items() if n > 1]:
        raise ValueError(f"shards differ in {', '.join(unlike)}")
    if bad := check_contiguous(metas).filter("not contiguous").count():
        raise ValueError(f"{bad} shards don't start where the one before ends")
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    told, there = metas.agg(F.sum("row_count")).first()[0], out.count()
    if told != there:
        raise ValueError(f"the shards have {there} rows, their records say {told}")
    return out


def merged_record(metas: DataFrame) -> DataFrame:
    """One row: the record of merged shards, as one run over the whole slice has it, with the shards' ids as parents (in the order of start)."""
    from lexvane.sources.registry import dataset_id

    one = lambda c: F.first(c).alias(c)  # noqa: E731  # merge_shards() has found them equal
    ids = dataset_id(F.col("base_model"), F.col("layer_index"), F.col("corpus"), F.col("start"), F.col("length"))
    parents = F.transform(F.array_sort(F.collect_list(F.struct("start", ids.alias("id")))), lambda p: p["id"]).alias("parent_datasets")
    same = ["base_model", "layer_index", "d_model", "norm", "corpus", "positions_per_doc"]
    whole = metas.agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("row_count").alias("row_count"), parents, *[one(c) for c in same])
    return whole.select(ids.alias("dataset_id"), "start", "length", "row_count", *same, "parent_datasets")


def build_stage(df: DataFrame, stage: str, actor_prompt: str | None = None, critic_template: str | None = None, keep_debug: bool = False, tag: str = "explanation") -> DataFrame:
    """av_sft, ar_sft or rl rows. A projection alone: the vector passes through untouched.

    actor_prompt is the content of the one user turn (its vector marker in place); critic_template holds {explanation}.
    """
    rest = [VECTOR, *PROVENANCE] + [TEXT] * keep_debug
    if stage == "ar_sft":
        return df.select(render(critic_template, "explanation", F.col(EXPLANATION)).alias("prompt"), *rest)
    prompt = user_prompt(F.lit(actor_prompt)).alias("prompt")
    if stage == "rl":
        return df.select(prompt, *rest)
    if stage == "av_sft":
        return df.select(prompt, wrap_tag(F.col(EXPLANATION), tag).alias("response"), *rest)
    raise ValueError(f"stage is av_sft, ar_sft or rl, not {stage}")
