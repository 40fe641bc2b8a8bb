"""Functions on token and mask arrays. Positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_set(mask: Column) -> Column:
    """Position of the last 1; null if there is none."""
    at = F.array_position(F.reverse(mask), 1)
    return F.when(at > 0, F.size(mask) - at)


def marker_sites(ids: Column, marker, left, right) -> Column:
    """Positions, neither first nor last, that hold marker between left and right."""
    hit = lambda x, i: F.when((i > 0) & (x == marker) & (F.get(ids, i - 1) == left) & (F.get(ids, i + 1) == right), i)
    return F.filter(F.transform(ids, hit), lambda p: p.isNotNull())


def marker_neighbors(ids: Column, marker) -> Column:
    """struct(site, left, right) of the only place of marker; null unless there is one, and not at an edge."""
    sites = F.filter(F.transform(ids, lambda x, i: F.when(x == marker, i)), lambda p: p.isNotNull())
    site = F.get(sites, F.lit(0))
    inside = (F.size(sites) == 1) & (site > 0) & (site < F.size(ids) - 1)
    return F.when(inside, F.struct(site.alias("site"), F.get(ids, site - 1).alias("left"), F.get(ids, site + 1).alias("right")))


def stable_suffix(suffix: list) -> list:
    """A suffix without its first token, which may merge with what stands before; fewer than two tokens are an error."""
    if len(suffix) < 2:
        raise ValueError("a suffix needs two tokens at least")
    return suffix[1:]


def ends_with_tokens(tok: Column, suffix: list) -> Column:
    n = len(suffix)
    return (F.size(tok) >= n) & (F.slice(tok, F.greatest(F.size(tok) - n + 1, F.lit(1)), n) == F.array(*[F.lit(s) for s in suffix]))


def conversation_mask(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, tokens, mask, response_length): all turns in order; 1 on assistant tokens; the mask is cut to its last response_length places.

    A conversation is gathered into one row, as a training sample is.
    """
    rows = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "role", F.split("text", " ").alias("tok")))).alias("t"))
    mask = F.flatten(F.transform("t", lambda x: F.array_repeat(F.when(x["role"] == "assistant", 1).otherwise(0), F.size(x["tok"]))))
    rows = rows.select(conv, F.flatten(F.transform("t", lambda x: x["tok"])).alias("tokens"), mask.alias("all"))
    n = F.aggregate("all", F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("response_length", n)
    r = F.col("response_length")
    return rows.select(conv, "tokens", F.when(r > 0, F.slice("all", -r, r)).otherwise(F.array().cast("array<int>")).alias("mask"), "response_length")


def to_critic_rows(df: DataFrame, tok: str = "tok", gold: str = "gold") -> DataFrame:
    """Rows with critic tokens: tokens, total_length, response_length 0, gold, and the other columns."""
    rest = [c for c in df.columns if c not in (tok, gold)]
    kept = df.filter(F.col(tok).isNotNull() & (F.size(tok) > 0))
    return kept.select(*rest, F.col(tok).alias("tokens"), F.size(tok).alias("total_length"), F.lit(0).alias("response_length"), F.col(gold).alias("gold"))
