"""Hard negatives against all pairs in whole numbers: ties, repeated keys, widths, large values, negative scores, blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexvane.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, anchor):
    fit = [(i, [int(np.floor(x * 256)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all()]
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    out = []
    for a, (i, v, y) in enumerate(fit):
        if anchor(i):
            score = lambda w: sum(p * q for p, q in zip(v, w, strict=True))  # noqa: B023, E731
            others = [(score(w), j, z) for b, (j, w, z) in enumerate(fit) if b != a and len(w) == len(v)]
            for s, j in sorted(((s, j) for s, j, z in others if z == y), key=lambda x: (-x[0], x[1]))[:5]:
                found = sorted(((n, k) for n, k, z in others if z != y and 30 * s <= 100 * n <= 90 * s), key=lambda x: (-x[0], x[1]))[:10]
                out += [(i, j, r, k, clip(s), clip(n)) for r, (n, k) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("peak", "shift"), [(1, 0.0), (1, 1.0), (1, -2.0), (1e9, 0.5), (1e40, 0.5), (1e200, 1.0)])
def test_mine(spark, peak, shift):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], int(y)) for i, (v, y) in enumerate(zip(rng.normal(size=(300, 12)) + shift, rng.integers(0, 4, 300), strict=True))]
    rows = [(i, [x * peak for x in v] if i % 4 == 0 else v, y) for i, v, y in rows]
    rows += [(400, rows[10][1], 1), (401, rows[10][1], 2), (402, rows[10][1], 1), rows[20], rows[21], (403, None, 1), (404, [1.0, None], 1), (405, [float("nan")], 1), (406, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(500 + i, [float(i % 5), 1.0], i % 2) for i in range(20)] + [(600, [], 1), (620, [0.0] * 12, 1)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(3).alias(c) for c in ("row", "id", "turn", "rank", "v", "d")])
    assert rows_of(hard.mine(df, F.col("vec_id") % 20 == 0)) == plain(rows, lambda i: i % 20 == 0)


def test_lengths_and_ranges_lose_nothing():
    """Buckets of many lengths: what a bucket leaves out can't reach the score, and something is left out."""
    rng = np.random.default_rng(6)
    whole = np.floor(rng.normal(size=(3000, 16)) * 256 * rng.lognormal(0, 1.0, 3000)[:, None] / 4)
    lists = hard.Lists({"id": np.arange(3000), "row": np.arange(3000), "label": np.array(["x"] * 3000, object)}, whole)
    assert len(lists.buckets) > 5 and sum(len(b.whole) for b in lists.buckets) == 3000
    looked = 0
    for q in whole[:60]:
        length, true = np.sqrt((q**2).sum()), whole @ q
        least = np.sort(true)[-20]
        kept = np.concatenate([b.at[b.reach(q, length, least)] for b in lists.buckets])
        looked += len(kept)
        assert set(np.flatnonzero(true >= least)) <= set(kept)
    assert looked < 60 * 3000 * 0.5


def test_blocks_and_ties(spark, monkeypatch):
    from lexvane.llm import blocks

    monkeypatch.setattr(blocks, "QUERY_BYTES", 200)
    rows = [(i, [0.5, 0.25 + i % 3 / 8] * 4, i % 2) for i in range(80)]
    got = rows_of(hard.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0))
    assert got == plain(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard.mine(none, F.lit(True)).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert hard.mine(one, F.lit(True)).collect() == [] and hard.mine(one, F.lit(False)).collect() == []
