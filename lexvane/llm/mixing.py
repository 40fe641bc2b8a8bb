"""Mixing sources to target weights: a low-discrepancy schedule of slots, filled with shuffled blocks of equal numbers of words.

The schedule has 2**m slots. Slot i stands at the i-th van der Corput point (the bits of i, reversed, over 2**m), and the source whose
share of the cumulative weights holds that point gets the slot; so every run of slots is near the target weights. Over all 2**m slots
the points are all multiples of 2**-m, so a source's slots are a range of reversed numbers and no slot has to search for its source.
Slots are ranked within their source, and the r-th takes the r-th block of the source's shuffled documents, which are gone through
again where the target is larger than the source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexvane.llm.common import broadcast_if_small, join_hot, materialise, space_words, table

SEED, WEIGHTS, CAP = 11, (5, 2, 1), 3
#: Bits of the slots' number if there are as many words; words of a slot beyond that, to twice as many.
BITS, SLOT_WORDS = 16, 1024
#: Rows of a part of a source's shuffled documents, about.
PART_ROWS = 50_000


@dataclass
class Mix:
    """documents: a row for each row, with its place in its source's order (name, part, row) and its source's target; schedule: a row
    for each slot of a source; pieces: slot, place in the slot, key, epoch, first word of the document, and number of words."""

    documents: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(name, source_size, target, lo, hi) of each source of sized (name, source, size): words by weight, at most cap times its size.

    Sources by code point, null last, take the weights in turn. What a source can't hold is shared by the others by weight until
    none is above: sources fill up in the order of size by weight, so one running sum finds those that are full. lo, hi: the ends of
    its share of the cumulative targets. Sources are few against rows; one task sorts them.
    """
    one = sized.groupBy("name", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int"))
    one = one.withColumn("turn", turn).withColumn("weight", weight).withColumn("room", F.col("source_size") * float(cap))
    fullest = Window.orderBy(F.col("room") / F.col("weight"), "turn")
    full = F.coalesce(F.sum("room").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(fullest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    one = one.withColumn("level", (F.sum("source_size").over(everything).cast("double") - full) / still)
    one = one.withColumn("is_full", F.col("level") * F.col("weight") > F.col("room"))
    level = F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything)
    one = one.withColumn("target", F.when(F.col("is_full"), F.col("room")).otherwise(level * F.col("weight")))
    hi = F.sum("target").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("turn")), F.lit(0.0))).select("name", "source_size", "target", "lo", "hi")


def _bits(words: int) -> int:
    """m of the 2**m slots for a mix of so many words: at most one slot a word."""
    return max(0, min(words.bit_length() - 1, max(BITS, (words // SLOT_WORDS).bit_length() - 1)))


def _cut(words: Column, blocks: Column, i: Column) -> Column:
    """Where block i of equal blocks of so many words starts: the first ones have a word more."""
    return i * F.floor(words / blocks) + F.least(i, words % blocks)


def _block(words: Column, blocks: Column, at: Column) -> Column:
    """The block that a word is in."""
    size, more = F.floor(words / blocks), words % blocks
    return F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long")


def slot_schedule(targets: DataFrame, words: int) -> DataFrame:
    """(slot, name, rank, first_word, n_words): a source's slots in their order, and its words that each takes, counted through all epochs.

    targets has lo, hi and target. A source takes its target, rounded. One whose share is below a slot gets a part of the slot at
    its place. Slots are made and ranked in cells of about the square root of their number, so no task holds a source's slots.
    """
    m = _bits(words)
    n, wide = 1 << m, 1 << -(-m // 2)
    at = lambda c: F.least(F.ceil(F.col(c) / float(max(words, 1)) * float(n)), F.lit(n)).cast("long")
    shares = targets.withColumn("words", F.floor(F.col("target") + 0.5).cast("long")).filter("words > 0").withColumn("a", F.least(at("lo"), F.lit(n - 1))).withColumn("b", F.greatest(at("hi") - 1, F.col("a")))
    cells = shares.select("name", "words", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / wide), F.floor(F.col("b") / wide))).alias("cell")).repartition("name", "cell")
    points = cells.select("name", "words", (F.col("b") - F.col("a") + 1).alias("blocks"), F.explode(F.sequence(F.greatest("a", F.col("cell") * wide), F.least("b", F.col("cell") * wide + wide - 1))).alias("point"))
    slots = points.withColumn("slot", F.coalesce(F.conv(F.reverse(F.lpad(F.bin("point"), m, "0")), 2, 10).cast("long"), F.lit(0).cast("long"))).withColumn("cell", F.floor(F.col("slot") / wide))
    counts = slots.groupBy("name", "cell").agg(F.count("*").alias("k"))
    before = Window.partitionBy("name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("name", "cell", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("name", "cell").orderBy("slot")) - 1
    ranked = slots.join(starts, ["name", "cell"]).withColumn("rank", rank)
    first, end = (_cut(F.col("words"), F.col("blocks"), F.col("rank") + k) for k in (0, 1))
    return ranked.select("slot", "name", "rank", first.alias("first_word"), (end - first).alias("n_words"), "blocks").filter("n_words > 0")


def _digits(rows: int) -> int:
    """Hex digits that cut all rows into parts of about PART_ROWS; one at least."""
    digits = 1
    while 16**digits * PART_ROWS < rows:
        digits += 1
    return digits


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, cap: int = CAP, seed: int = SEED) -> Mix:
    """The mix of docs: their words, at the sources' weights, as many as there are.

    A null text or source counts as an empty text and as a source of its own (the last). A source's documents are shuffled by a
    seeded digest of their keys (null keys too); rows that repeat stand side by side. A document is taken cap times at most, and
    some epoch may end within it. The same rows give the same mix, in any partitions. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.size(space_words(F.col(text).cast("string"))).cast("long").alias("size"))
    sized = materialise(rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("k").cast("string")).cast("binary"))), "sized")
    total, n = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = materialise(source_targets(sized, weights, cap), "targets")
    schedule = materialise(slot_schedule(targets, total), "schedule")
    blocks = schedule.groupBy("name").agg(F.max("blocks").alias("blocks"))
    known = targets.join(blocks, "name", "left").select("name", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"), "blocks")

    parted = sized.withColumn("part", F.substring("h", 1, _digits(n)))
    sums = parted.groupBy("name", "part").agg(F.sum("size").alias("in_part"))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("name", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    order = Window.partitionBy("name", "part").orderBy("h", "k", "size")
    within = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parted.withColumn("row", F.row_number().over(order)).withColumn("within", within).join(broadcast_if_small(starts, 100_000), ["name", "part"])
    placed = placed.select("k", "name", "source", "part", "row", "size", (F.col("part_start") + F.col("within")).alias("start"))
    placed = materialise(join_hot(placed, known, "name", F.struct("part", "row"), 100_000), "placed")

    last = F.least(F.lit(cap - 1), F.floor((F.col("words") - 1 - F.col("start")) / F.col("source_size")))
    turns = placed.filter("size > 0 and start < words").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    turns = turns.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("to", F.least(F.col("from") + F.col("size"), "words"))
    touched = turns.withColumn("rank", F.explode(F.sequence(_block(F.col("words"), F.col("blocks"), F.col("from")), _block(F.col("words"), F.col("blocks"), F.col("to") - 1))))
    met = touched.drop("blocks").join(schedule, ["name", "rank"])
    a, b = F.greatest("from", "first_word"), F.least("to", F.col("first_word") + F.col("n_words"))
    pieces = met.select("slot", (a - F.col("first_word")).alias("place"), F.col("k").alias(key), "source", "epoch", (a - F.col("from")).alias("first"), (b - a).alias("n_words"), "name", "part", "row")
    return Mix(placed, schedule, pieces)


def slot_texts(docs: DataFrame, mixed: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(slot, text): the words of each slot, in its order. For keys that are unique; texts meet their pieces by key, and a slot's words are few."""
    words = docs.select(F.col(key).alias("k"), space_words(F.col(text)).alias("w"))
    parts = mixed.pieces.select(F.col(key).alias("k"), "slot", "name", "place", "first", "n_words").join(words, "k")
    some = parts.select("slot", F.struct("name", "place", F.array_join(F.slice("w", F.col("first").cast("int") + 1, F.col("n_words").cast("int")), " ").alias("t")).alias("p"))
    return some.groupBy("slot").agg(F.array_sort(F.collect_list("p")).alias("p")).select("slot", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def taken_words(mixed: Mix, key: str = "doc_id") -> DataFrame:
    """(key, size, source_size, target, taken) of every row: taken sums up its pieces in all slots."""
    at = ["name", "part", "row"]
    taken = mixed.pieces.groupBy(*at).agg(F.sum("n_words").alias("taken"))
    return mixed.documents.join(taken, at, "left").select(F.col("k").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(table(spark, sf_dir, "documents")))


ORACLE = f"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size, md5(concat_ws('|', '{SEED}', doc_id)) as h from documents),
one as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as turn from sized group by source),
two as (select *, case turn % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * {CAP}.0::double as room from one),
three as (select *, (cast(sum(source_size) over () as double) - coalesce(sum(room) over (order by room / weight, turn rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by room / weight, turn rows between current row and unbounded following) as level from two),
four as (select *, max(case when not level * weight > room then level end) over () as common from three),
targets as (select source, source_size, case when level * weight > room then room else common * weight end as target from four),
placed as (select s.*, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as words, coalesce(sum(size) over (partition by s.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
    from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(list_sum([greatest(0, least(e * source_size + start + size, words) - (e * source_size + start)) for e in range(0, {CAP})]) as bigint) as taken from placed
"""
