"""Spark jobs that build, check and score datasets which pair vectors with short explanations."""

from pathlib import Path


def share_code(spark) -> None:
    """Let local Python workers import this package from where it lies; on a cluster, it comes with --py-files or is installed."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH", ""), root]))
