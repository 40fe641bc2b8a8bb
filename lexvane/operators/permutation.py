"""A keyed permutation of 0 .. n - 1 that can be asked for any place: orders of epochs that nobody has to rank.

Two numbers l < a and r < b with a * b >= n, of about the same size, change each other in turn by a keyed digest (a Feistel network on
mixed radices, as in Black and Rogaway, Ciphers with Arbitrary Finite Domains, CT-RSA 2002). A result of n or more is put in again until
one is below n; as a * b - n < a, that is rare, and it ends.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.operators.ranks import group_rank

ROUNDS, WALKS = 6, 64


def radices(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _digest(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10).cast("long")


def _once(x: Column, key: Column, a: int, b: int) -> Column:
    pair = F.struct((x % a).cast("long").alias("l"), F.floor(x / a).cast("long").alias("r"))

    def turn(s: Column, k: Column) -> Column:
        odd = k % 2 == 1
        moved = _digest(key, k, F.when(odd, s["r"]).otherwise(s["l"]))
        return F.struct(F.when(odd, (s["l"] + moved % a) % a).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise((s["r"] + moved % b) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turn, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: int, key: Column) -> Column:
    """Where the permutation of 0 .. n - 1 under key takes x, a whole number in it. Built-in expressions alone; no row knows of another."""
    a, b = radices(n)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _once(x, key, a, b), lambda v, _: F.when(v < n, v).otherwise(_once(v, key, a, b)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("no place below n was reached")).cast("long"))


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with ordinal, its place from 0 in the order of unique keys (without nulls): made once, for all epochs."""
    return group_rank(df, [], keys[0], list(keys), name="ordinal").withColumn("ordinal", F.col("ordinal") - 1).drop("_n")


def places(spark: SparkSession, start: int, end: int, n: int, seed: int) -> DataFrame:
    """(pos, epoch, ordinal) of the positions start <= pos < end over all epochs of n rows: epoch e has the permutation of key seed + e."""
    rows = spark.range(start, end).select(F.col("id").alias("pos"), F.expr(f"id div {max(n, 1)}").alias("epoch"))
    return rows.withColumn("ordinal", permuted(F.col("pos") % max(n, 1), n, F.col("epoch") + seed))


def draw(ordered: DataFrame, n: int, seed: int, start: int, end: int, max_broadcast: int = 1_000_000) -> DataFrame:
    """Rows of numbered() at the positions start .. end - 1, with pos and epoch: only these places are computed, and no row is shuffled for a
    batch of up to max_broadcast."""
    some = places(ordered.sparkSession, start, end, n, seed)
    return ordered.join(F.broadcast(some) if end - start <= max_broadcast else some, "ordinal")


def draw_batch(ordered: DataFrame, n: int, seed: int, batch: int, i: int) -> DataFrame:
    """The i-th batch (from 0) of an endless run of epochs."""
    return draw(ordered, n, seed, i * batch, (i + 1) * batch)


def permutation_sql(source: str, n: str, key: str, name: str) -> str:
    """The same in SQL (CTEs, the last called name): source has pos, x (a number below n) and whatever key is made of."""
    step = f"select *, x % a as l0, x // a as r0 from {name}_now"
    for k in range(1, ROUNDS + 1):
        other = f"r{k - 1}" if k % 2 else f"l{k - 1}"
        moved = f"cast('0x' || substr(md5(concat_ws('|', {key}, {k}, {other})), 1, 12) as bigint)"
        left, right = (f"(l{k - 1} + {moved} % a) % a", f"r{k - 1}") if k % 2 else (f"l{k - 1}", f"(r{k - 1} + {moved} % b) % b")
        step = f"select *, {left} as l{k}, {right} as r{k} from ({step})"
    body = step.replace(f"{name}_now", f"{name}_walk where again")
    first = step.replace(f"{name}_now", f"(select *, true as again from {name}_in)")
    keep = f"a, b, n, r{ROUNDS} * a + l{ROUNDS} as x, r{ROUNDS} * a + l{ROUNDS} >= n as again"
    return f"""{name}_in as (select s.*, {n} as n, cast(ceil(sqrt({n})) as bigint) as a, cast(({n} + cast(ceil(sqrt({n})) as bigint) - 1) // cast(ceil(sqrt({n})) as bigint) as bigint) as b from {source} s),
{name}_walk as (select pos, epoch, {keep} from ({first}) union all select pos, epoch, {keep} from ({body})),
{name} as (select pos, epoch, x as ordinal from {name}_walk where not again)"""
