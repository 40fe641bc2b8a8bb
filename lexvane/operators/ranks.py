"""Exact ranks without a window over the whole table, and what rests on them: shuffles, epochs, batches, shards."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.functions.keys import hash_key


def bucket_rank(df: DataFrame, bucket: Column, order: list, name: str = "rank", in_order: bool = False) -> DataFrame:
    """df with the rank (from 1) by (bucket, order): counts by bucket are summed up, rows are numbered within a bucket.

    bucket has to rise with the order and have few values; only its counts meet in one task and are sent to all. in_order: partitions
    are ranges of buckets, so they follow each other in the order of the rank, by the one shuffle that ranking takes.
    """
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy(*order)
    marked = marked.repartitionByRange("_bucket") if in_order else marked
    return marked.withColumn("_row", F.row_number().over(within)).join(F.broadcast(starts), "_bucket").withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_start")


#: Rows that a part of a group has, about; most parts of a table and of a group; sampled rows a part, from which its ends are taken.
PART_ROWS, TABLE_PARTS, GROUP_PARTS, PART_SAMPLE = 50_000, 10_000, 1_024, 64


def _lead(df: DataFrame, value: str, keys: list, falling: bool) -> Column:
    """A struct that rises with the order of group_rank(): nulls last, NaN above all numbers."""
    v, kind = F.col(value), df.schema[value].dataType.typeName()
    if kind in ("float", "double"):
        grade = F.when(v.isNull(), 2).when(F.isnan(v), 0 if falling else 1).otherwise(1 if falling else 0)
        number = F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(-v if falling else v)
    else:
        grade, number = F.when(v.isNull(), 1).otherwise(0), v
        if falling:
            number = F.bitwise_not(v) if kind in ("byte", "short", "integer", "long") else -v
    return F.struct(grade.alias("grade"), number.alias("number"), *[F.col(k) if isinstance(k, str) else k for k in keys])


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[f"_by_{c}"]) for c in by], F.lit(True))


def cut_groups(df: DataFrame, by: list[str], value: str, keys: list, falling: bool = False, part: int = PART_ROWS) -> DataFrame:
    """df with _range: groups of over `part` rows are cut into parts of about that many, which follow the order of value, then keys.

    The cuts come from a sample of each such group (sample sort), drawn by a hash of the row: 64 rows a part, so neither an outlier
    nor many equal values make a part large. At most 10,000 groups can be that large (else part grows with the table), and they have
    20,000 cuts at most, which are broadcast.
    """
    lead, named = _lead(df, value, keys, falling), {c: f"_by_{c}" for c in by}
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size")).withColumnsRenamed(named)
    most = F.greatest(F.lit(part), F.col("_total") / TABLE_PARTS)
    large = sizes.join(F.broadcast(sizes.agg(F.sum("_size").alias("_total")))).filter(F.col("_size") > most)
    large = large.select(*named.values(), "_size", F.least(F.lit(GROUP_PARTS), F.ceil(F.col("_size") / most)).cast("int").alias("_parts"))
    taken = F.pmod(F.xxhash64(lead, *by), F.lit(1 << 40)) < F.col("_parts") * PART_SAMPLE / F.col("_size") * float(1 << 40)
    sample = df.join(F.broadcast(large), _same(df, large, by)).filter(taken).groupBy(*named.values(), "_parts").agg(F.array_sort(F.collect_list(lead)).alias("_found"))
    cut = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.get("_found", F.floor(i * F.size("_found") / F.col("_parts")).cast("int")))
    step = F.ceil(F.sqrt("_parts")).cast("int")
    cuts = sample.select(*named.values(), cut.alias("_cuts"), step.alias("_step"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda x, i: (i + 1) % F.col("_step") == 0))
    marked = df.withColumn("_lead", lead)
    marked = marked.join(F.broadcast(cuts), _same(marked, cuts, by), "left")
    under = lambda some: F.size(F.filter(some, lambda x: x < F.col("_lead")))
    marked = marked.withColumn("_at", under("_coarse") * F.col("_step"))
    found = F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_at") + under(F.slice("_cuts", F.col("_at") + 1, F.col("_step"))))
    return marked.withColumn("_range", found.cast("long")).drop(*named.values(), "_cuts", "_step", "_coarse", "_at", "_lead")


def group_rank(df: DataFrame, by: list[str], value: str, order: list, falling: bool = False, name: str = "rank", part: int = PART_ROWS) -> DataFrame:
    """df with the rank (from 1) by order within each group of by, and _n, the group's rows.

    order is the column value (falling or not, nulls last), then rising columns. Large groups are cut at sampled rows; counts by group and
    part are summed up, and rows are numbered within a part, so no task holds a whole group.
    """
    marked = cut_groups(df, by, value, order[1:], falling, part)
    counts = marked.groupBy(*by, "_range").agg(F.count("*").alias("_k"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_by__range"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"), F.sum("_k").over(group).alias("_n"))
    rows = marked.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    rows = rows.join(starts, _same(rows, starts, [*by, "_range"]))
    return rows.withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop(*[f"_by_{c}" for c in by], "_by__range", "_range", "_row", "_start")


def group_percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], name: str = "percentiles", accuracy: int = 10_000) -> DataFrame:
    """(by, name): exact percentiles of value, interpolated linearly, in the order of shares; nulls are left out, NaN is the greatest.

    A sketch of each group brackets each percentile. Then all rows below and above a bracket are two counts, rows within it are
    counted by value, so a task sorts the values of a bracket (4 of 10,000 rows), never those of a group.
    """
    v, k = F.col("_v"), len(shares)
    sketched = F.nanvl(v, F.lit(float("inf")))  # the sketch leaves out NaN
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    margin = 2 / accuracy
    ends = [max(0.0, s - margin) for s in shares] + [min(1.0, s + margin) for s in shares]
    bounds = rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count("*").alias("_n"), F.percentile_approx(sketched, ends, accuracy).alias("_ends"))
    marked = rows.join(bounds, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]))
    side = lambda i: F.when(sketched < F.get("_ends", F.lit(i)), -1).when(sketched > F.get("_ends", F.lit(k + i)), 1).otherwise(0)
    marked = marked.select(*by, "_n", "_v", F.posexplode(F.array(*[side(i) for i in range(k)])).alias("_i", "_side"))
    counts = marked.groupBy(*by, "_n", "_i", "_side", F.when(F.col("_side") == 0, v).alias("_at")).agg(F.count("*").alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_i").orderBy("_side", "_at").rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("_n") - 1) * F.get(F.array(*[F.lit(float(s)) for s in shares]), F.col("_i"))
    counts = counts.withColumn("_to", upto).withColumn("_place", place)

    def at(rank: Column) -> Column:
        """The value of a rank, if it is told here: within the bracket, or next to it."""
        known = F.when(F.col("_side") == 0, F.col("_at")).when((F.col("_side") < 0) & (rank == F.col("_to")), F.col("_most")).when((F.col("_side") > 0) & (rank == F.col("_to") - F.col("_k") + 1), F.col("_least"))
        return F.max(F.when((rank > F.col("_to") - F.col("_k")) & (rank <= F.col("_to")), known))

    low, high = F.floor("_place"), F.ceil("_place")
    found = counts.groupBy(*by, "_i", "_place").agg(at(low + 1).alias("_low"), at(high + 1).alias("_high"))
    between = (high - F.col("_place")) * F.col("_low") + (F.col("_place") - low) * F.col("_high")
    lost = F.col("_low").isNull() | F.col("_high").isNull()
    exact = F.when(lost, F.raise_error(F.lit("a percentile is outside of its bracket")).cast("double")).when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between)
    return found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", exact.alias("p")))).alias(name)).withColumn(name, F.transform(name, lambda x: x["p"]))


def with_percentiles(groups: DataFrame, df: DataFrame, by: list[str], value: str, shares: list[float], name: str = "percentiles") -> DataFrame:
    """groups (a row for each group of df) with its percentiles; null for a group without values."""
    p = group_percentiles(df, by, value, shares, name).withColumnsRenamed({c: f"_by_{c}" for c in by})
    return groups.join(p, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]), "left").drop(*[f"_by_{c}" for c in by])


def hash_rank(df: DataFrame, seed, keys: list[str], name: str = "rank", in_order: bool = False) -> DataFrame:
    """df with its rank in the seeded order of keys, which have to be unique for a stable result. At most 65,536 buckets."""
    marked = df.withColumn("_h", hash_key(seed, *[F.col(k) for k in keys]))
    return bucket_rank(marked, F.substring("_h", 1, 4), ["_h", *keys], name, in_order).drop("_h")


def _width(df: DataFrame, ordinal: str) -> int:
    """Width of a bucket, so that a table has 65,536 buckets at most, however large it is."""
    low, high = df.agg(F.min(ordinal), F.max(ordinal)).first()
    return 1 if low is None else max(1, -(-(high - low + 1) // 65_536))


def ordinal_rank(df: DataFrame, ordinal: str, name: str = "rank", width: int | None = None) -> DataFrame:
    """df with its rank by a whole-number column; width: of a bucket (default: from the column's range)."""
    return bucket_rank(df, F.floor(F.col(ordinal) / (width or _width(df, ordinal))), [ordinal], name)


def running_total(df: DataFrame, ordinal: str, value: str, name: str, width: int | None = None) -> DataFrame:
    """df with the sum of value over all rows up to this one, by a whole-number column."""
    marked = df.withColumn("_bucket", F.floor(F.col(ordinal) / (width or _width(df, ordinal))))
    sums = marked.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_run", F.sum(value).over(within)).join(F.broadcast(starts), "_bucket").withColumn(name, F.col("_start") + F.col("_run")).drop("_bucket", "_run", "_start")


def chunk_id(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """df with chunk_id: consecutive groups of n rows."""
    return ordinal_rank(df, ordinal, "_rank").withColumn("chunk_id", F.expr(f"(_rank - 1) div {n}")).drop("_rank")


def shuffle_rows(df: DataFrame, seed: int, dataset_id: str, keys: list[str], in_order: bool = False) -> DataFrame:
    """df with shuffle_rank, a full permutation keyed on seed and dataset; write it sorted by that column (in_order: it is)."""
    rows = hash_rank(df, f"{seed}|{dataset_id}", keys, "shuffle_rank", in_order)
    return rows.sortWithinPartitions("shuffle_rank") if in_order else rows


def shuffle_vectors(df: DataFrame, seed: int, dataset_id: str, keys: list[str], vector: str) -> DataFrame:
    """df with the vectors permuted among the rows (null baseline); all else stays. The wide column is moved once."""
    anchors = hash_rank(df.drop(vector), f"{seed}|{dataset_id}|anchor", keys, "_rank")
    moved = hash_rank(df.select(*keys), f"{seed}|{dataset_id}|vector", keys, "_rank").select(*[F.col(k).alias(f"_{k}") for k in keys], "_rank")
    pairs = anchors.join(moved, "_rank").drop("_rank")
    vectors = df.select(*[F.col(k).alias(f"_{k}") for k in keys], vector)
    return pairs.join(vectors, [f"_{k}" for k in keys]).select(*df.columns, *[F.col(f"_{k}").alias(f"from_{k}") for k in keys])


def epoch_order(df: DataFrame, seed: int, epochs: int, keys: list[str]) -> DataFrame:
    """A row for each row and epoch: epoch, rank in the order of seed + epoch, and pos over all epochs, from 0."""
    one = lambda e: hash_rank(df, seed + e, keys).withColumn("epoch", F.lit(e))
    out = one(0)
    for e in range(1, epochs):
        out = out.unionByName(one(e))
    n = df.agg(F.count("*").alias("_n"))
    return out.join(F.broadcast(n)).withColumn("pos", F.col("epoch") * F.col("_n") + F.col("rank") - 1).drop("_n")


def draw_batches(ordered: DataFrame, batch: int, n_batches: int) -> DataFrame:
    """Rows of epoch_order() that the first n_batches batches draw, across epochs, with batch_id."""
    return ordered.filter(F.col("pos") < batch * n_batches).withColumn("batch_id", F.expr(f"pos div {batch}"))


def replicate(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """n rows for each prompt: group_index is its position, sample_index runs over all."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")).withColumn("group_index", F.col(pos)).withColumn("sample_index", F.col(pos) * n + F.col("_i")).drop("_i")


def assign_mod(df: DataFrame, m: int, ordinal: str) -> DataFrame:
    return df.withColumn("part", F.pmod(F.col(ordinal), F.lit(m)))


def merge_parts(df: DataFrame, m: int) -> DataFrame:
    """Fewer parts: the new part i takes the parts i, i + m, and so on."""
    return df.withColumn("part", F.pmod("part", F.lit(m)))


def truncate_balanced(df: DataFrame, part: str, micro: int, order: str) -> DataFrame:
    """As many rows of each part: the least part's count, cut to a multiple of micro; none left is an error. order is a number."""
    least = df.groupBy(part).count().agg(F.min("count")).first()[0] or 0
    keep = least // micro * micro
    if not keep:
        raise ValueError(f"the least part has {least} rows, fewer than {micro}")
    return group_rank(df, [part], order, [order], name="_rank").filter(F.col("_rank") <= keep).drop("_rank", "_n")
