"""Seeded hash keys, on which every random order of this library rests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *keys: Column) -> Column:
    """Lower-case hex SHA-256 of the |-joined seed and keys: the same in every engine, whatever the partitions. A null key is a zero character, so it keeps its place."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("\0")) for k in keys]), 256)
