"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.llm.common import broadcast_if_small, table

SHARDS = 40

def _draw(key: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on key and salt alone: 48 bits of a digest."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{salt}")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def rendezvous_shard(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the greatest score -weight / ln(draw): each takes a share of the keys in proportion to its weight.

    A score depends on key, shard and weight only. So one more shard takes records only into itself, one shard less gives
    away only its own, and a changed weight moves records only to or from that shard. Shards of weight 0 take none; a null key
    counts as an empty string. Ties go to the smaller shard.
    """
    return -_best(key, weights)["shard"]


def _best(key: Column, weights: dict[int, float]) -> Column:
    """struct(score, shard) of the winner; shard is negated, so that of equal scores the smaller shard's is greater."""
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("at least one shard needs a weight over 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    scored = [F.struct((F.lit(-float(w)) / F.log(_draw(key, str(s)))).alias("score"), F.lit(-s).alias("shard")) for s, w in live.items()]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def assign_shards(docs: DataFrame, key: str, weights: dict[int, float], column: str = "shard") -> DataFrame:
    """docs with the shard of each record; no shuffle. A column of that name is replaced."""
    return docs.withColumn(column, rendezvous_shard(F.col(key), weights))


def write_shards(docs: DataFrame, key: str, weights: dict[int, float], path: str, max_records: int = 1_000_000) -> None:
    """Write the records to one folder per shard, in files of max_records rows at most."""
    assign_shards(docs, key, weights).write.option("maxRecordsPerFile", max_records).partitionBy("shard").parquet(path)


def shard_manifest(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """A row for each record: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 16 (null: 16); text_crc32: of the UTF-8 bytes (null: as empty). slot numbers a
    shard's records from 0 without gaps, in an order that depends on the records alone. Equal records (same key and text)
    are counted before the shuffle and get consecutive slots; a null key is a key as any other. Other columns are not read.
    """
    weights = {s: 1.0 for s in range(shards)}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    order = ["k", "size", "text_crc32"]
    counted = narrow.groupBy(*order).agg(F.count("*").alias("n"))
    further = _best(F.col("k"), {shards: 1.0})  # one more shard takes what it wins against the best of all others
    placed = counted.withColumn("best", F.explode(F.array(_best(F.col("k"), weights)))).withColumn("shard", -F.col("best.shard")).withColumn("grown_shard", F.when(further > F.col("best"), F.lit(shards)).otherwise(F.col("shard")))
    # a shard's rows are numbered in the order of a digest, in parts by its first digits, so that no task holds a whole shard; how
    # many digits these are changes no slot
    placed = placed.withColumn("digest", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]).cast("binary"))).withColumn("part", F.substring("digest", 1, _digits(docs.count(), shards)))
    sizes = placed.groupBy("shard", "part").agg(F.sum("n").alias("in_part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("digest", *order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))
    numbered = placed.join(broadcast_if_small(starts, 1_000_000), ["shard", "part"]).withColumn("first", first)
    return numbered.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


def _digits(rows: int, shards: int, in_part: int = 50_000) -> int:
    """Hex digits that part a shard into parts of about in_part rows; two at least."""
    digits = 2
    while shards * 16**digits * in_part < rows:
        digits += 1
    return digits


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(table(spark, sf_dir, "documents"))


ORACLE = f"""
with crc_table as (select list(list_reduce(range(0, 8), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) order by i) as t from (select unnest(range(0, 256)) as i)),
bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
rows as (select doc_id, len(h) // 2 + 16 as size,
    xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) as text_crc32 from bytes, crc_table),
draws as (select *, s, -1 / ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || s), 1, 12) as bigint) + 0.5) / 281474976710656) as score from rows, (select unnest(range(0, {SHARDS} + 1)) as s)),
placed as (select doc_id, size, text_crc32, cast(arg_max(s, score) filter (s < {SHARDS}) as integer) as shard, cast(arg_max(s, score) as integer) as grown, count(*) // ({SHARDS} + 1) as n from draws group by 1, 2, 3)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by md5(concat_ws('|', doc_id, size, text_crc32)), doc_id, size, text_crc32) - 1 as slot,
    case when grown = {SHARDS} then grown else shard end as grown_shard from placed, unnest(range(0, n)) as u(k)
"""
