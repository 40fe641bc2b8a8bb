"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexvane.llm import classifier, line_dedup, near_dup, packing, quality_rules
from lexvane.llm.common import materialise, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("quality_classifier", classifier.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash_near_dedup", near_dup.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL can't express hashed likelihoods, boosted trees, MinHash and byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, packed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
