"""Addressed permutations, consumption with returns, intervals, lineage, row groups and pattern scans against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexvane.operators import gates, joins, permutation, sampling
from lexvane.sources import registry, tables
from lexvane.sources.scratch import written
from lexvane.streaming.consumption import Consumption


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000])
def test_every_epoch_is_a_permutation(spark, n):
    got = permutation.places(spark, 0, 3 * n, n, 7).collect()
    orders = [[r["ordinal"] for r in sorted(got, key=lambda r: r["pos"]) if r["epoch"] == e] for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 16 or orders[0] != orders[1] != orders[2] and orders[0] != list(range(n))
    assert [r["ordinal"] for r in permutation.places(spark, n, 2 * n, n, 7).orderBy("pos").collect()] == orders[1]


def test_places_are_spread(spark):
    """Neighbours at the start land far from each other: the mean place of each tenth is near the middle."""
    got = [r["ordinal"] for r in permutation.places(spark, 0, 10_000, 10_000, 3).orderBy("pos").collect()]
    assert all(abs(sum(got[i : i + 1000]) / 1000 - 5000) < 400 for i in range(0, 10_000, 1000))


def test_a_batch_moves_its_rows_alone(spark):
    rows = written(permutation.numbered(spark.range(500).select((F.col("id") * 3).alias("key")), ["key"]), "rows")
    batches = [permutation.draw_batch(rows, 500, 1, 64, i) for i in (0, 9)]
    assert [sorted(r["pos"] for r in b.collect()) for b in batches] == [list(range(64)), list(range(576, 640))]
    assert {r["epoch"] for r in batches[1].collect()} == {1}
    plan = batches[1]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_consumption(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    with pytest.raises(ValueError, match="no saved state"):
        Consumption(spark, at, must_exist=True)
    positions = lambda df: sorted(r["pos"] for r in df.collect())
    first = Consumption(spark, at)
    assert positions(first.draw(10)) == list(range(10))
    first.give_back(spark.createDataFrame([(7,), (3,)], "pos long"))
    again = Consumption(spark, at, must_exist=True)
    assert positions(again.outstanding()) == [3, 7] and positions(again.draw(4)) == [3, 7, 10, 11]
    again.give_back(spark.createDataFrame([(7,)], "pos long"))
    for wrong in ([(7,)], [(99,)], [(1,), (1,)]):
        with pytest.raises(ValueError, match="isn't drawn|comes back twice"):
            again.give_back(spark.createDataFrame(wrong, "pos long"))
    assert positions(Consumption(spark, at).draw(1)) == [7] and positions(Consumption(spark, at).draw(2)) == [12, 13]
    assert Consumption(spark, at).outstanding().count() == 0


def test_intervals(spark):
    random.seed(5)
    some = lambda n, most: [(i, s := random.randrange(500), s + random.randrange(most)) for i in range(n)]
    left, right = some(80, 90), some(60, 9)
    a, b = spark.createDataFrame(left, "i long, a long, b long"), spark.createDataFrame(right, "j long, c long, d long")
    want = sorted((i, j) for i, s, t in left for j, u, v in right if max(s, u) < min(t, v))
    for width in (1, 7, 1000):
        assert sorted(tuple(r) for r in sampling.interval_join(a, b, ("a", "b"), ("c", "d"), width).select("i", "j").collect()) == want


def test_windows_make_no_row_of_a_token(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = sampling.calibration_windows(docs, F.split("text", " "), 20, 64, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower() and "generate" in plan.lower()
    assert sampling.calibration_windows(docs.limit(0), F.split("text", " "), 3, 8, 42).collect() == []


def test_long_and_looping_lineage(spark):
    chain = spark.range(1000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("dataset_id"), F.array(F.concat(F.lit("d"), (F.col("id") + 1).cast("string"))).alias("parent_datasets"))
    start = time.monotonic()
    up = registry.lineage(chain, "d0")
    assert up.agg(F.count("*"), F.max("depth"), F.min("depth")).first() == (1000, 1000, 1)
    assert time.monotonic() - start < 90
    loop = spark.createDataFrame([("a", ["b"]), ("b", ["c", "x"]), ("c", ["a"]), ("x", [])], "dataset_id string, parent_datasets array<string>")
    with pytest.raises(ValueError, match="a is among its own ancestors"):
        registry.lineage(loop)
    with pytest.raises(ValueError, match="p is among its own ancestors"):
        registry.lineage(spark.createDataFrame([("a", ["p"]), ("p", ["q"]), ("q", ["p"])], "dataset_id string, parent_datasets array<string>"), "a")
    two = spark.createDataFrame([("a", ["b", "d"]), ("b", ["c"]), ("c", ["d"])], "dataset_id string, parent_datasets array<string>")
    assert {(r["ancestor"], r["depth"]) for r in registry.lineage(two, "a").collect()} == {("b", 1), ("c", 2), ("d", 1)}


def test_row_groups(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    tables.write_table(spark.range(0, 2500, 1, 1), at, 1000)
    files, groups, largest = tables.row_groups(spark, at)
    assert files == 3 and groups >= 3 and largest <= 1000
    spark.range(0, 2500, 1, 1).write.option("parquet.block.row.count.limit", 700).parquet(f"{at}2")
    assert tables.row_groups(spark, f"{at}2") == (1, 4, 700)
    tables.check_row_groups(spark, f"{at}2", 700)
    with pytest.raises(ValueError, match="700 rows; 699"):
        tables.check_row_groups(spark, f"{at}2", 699)


def test_many_patterns(spark, monkeypatch):
    random.seed(9)
    word = lambda: "".join(random.choice("abC") for _ in range(random.randint(1, 7)))
    patterns = [word() for _ in range(10_000)] + ["", None, "é", "zz"]
    texts = [(i, " ".join(word() for _ in range(40)) + "É" * (i % 2)) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame([(p,) for p in patterns], "p string")
    few = {p.lower() for p in patterns if p}
    want = sorted((i, p) for i, t in texts if t for p in few if p in t.lower())
    for most in (20_000_000, 500):
        monkeypatch.setattr(gates, "PATTERN_CHARS", most)
        assert sorted(tuple(r) for r in gates.leak_patterns(docs, "text", "id", table, "p").collect()) == want
    assert gates.leak_patterns(docs, "text", "id", table.limit(0), "p").collect() == []


def test_zip_of_several_columns(spark):
    left = spark.createDataFrame([(1, 2_000_000, "c"), (1, 5, "b"), (2, 0, "d"), (0, 9, "a")], "doc long, site long, x string")
    right = spark.createDataFrame([(i, y) for i, y in enumerate("abcd")], "k long, y string")
    assert {(r["x"], r["y"]) for r in joins.zip_join(left, right, ["doc", "site"], "k").collect()} == {(c, c) for c in "abcd"}


def test_stored_keys_stay(spark, tmp_path):
    """The cache's side of the join is a bucketed scan without an exchange, and the answers are those of cache_join()."""
    rows = spark.range(300).select(F.concat(F.lit("t"), (F.col("id") % 90).cast("string")).alias(joins.TEXT), "id")
    cache = rows.filter("id < 60").select(joins.TEXT, F.col("id").cast("string").alias(joins.EXPLANATION))
    name = f"cache_{random.getrandbits(60)}"
    joins.store_cache([cache], name, f"file://{tmp_path}/cache", 4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.stored_cache_join(rows, name)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        side = plan[plan.index("FileScan") - 400 : plan.index("Bucketed: true")]
        assert "Exchange" not in side[side.rindex("_key") :]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joins.cache_join(rows, [cache]).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql(f"drop table {name}")


def test_filter_of_patterns_is_bounded(spark, monkeypatch):
    """A task holds a filter of PATTERN_BITS at most, however many patterns there are; a full one lets more through, and results stay."""
    random.seed(11)
    word = lambda: "".join(random.choice("abCé") for _ in range(random.randint(1, 9)))
    patterns = {word().lower() for _ in range(3_000)} | {"𝄞x", "a" * 33}
    texts = [(i, " ".join(word() for _ in range(30)) + ("𝄞X" + "A" * 40) * (i % 3 == 0)) for i in range(40)]
    docs, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "p string")
    want = sorted((i, p) for i, t in texts for p in patterns if p in t.lower())
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: (sent.append(x.nbytes), send(self, x))[1])
    monkeypatch.setattr(gates, "PATTERN_CHARS", 7)
    for most in (1 << 16, 1 << 28):
        monkeypatch.setattr(gates, "PATTERN_BITS", most)
        assert sorted(tuple(r) for r in gates.leak_patterns(docs, "text", "id", table, "p").collect()) == want
    assert sent[0] == (1 << 16) // 8 < sent[1] <= 16 * len(patterns)
