"""The mix against a plain one: targets by repeated sharing, van der Corput slots, words taken in the shuffled order."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexvane.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def words(n):
    return None if n is None else " \n".join(f"w{i}" for i in range(n))


def plain_targets(sizes):
    """Share by weight; what is above 3 times a source's size is shared by the others again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left, free = {}, sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in above}
        free -= above
        left = sum(sizes.values()) - sum(full.values())
    return full


CASES = {
    "three": [(i, "abc"[i % 3], 10 + i) for i in range(60)],
    "small_first": [(i, "a" if i < 3 else "b" if i < 9 else "c", 5 + i % 4) for i in range(90)],
    "nulls": [(None if i % 9 == 1 else i // 2, [None, "", "x", "é", "z"][i % 5], [None, 0, 1, 7, 300][i % 5 * (i % 3) % 5]) for i in range(80)],
    "one_source": [(i, "s", i) for i in range(12)],
    "no_words": [(i, "ab"[i % 2], 0) for i in range(4)],
    "one_word": [(1, "a", 1), (2, "b", 0), (3, None, None)],
    "repeated": [(1, "a", 4)] * 5 + [(2, "b", 3)] * 2,
    "many": [(i, f"s{i // 2:03}", 1 + i % 5) for i in range(120)],
}


@pytest.mark.parametrize("name", CASES)
def test_mix(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(k, s, words(n)) for k, s, n in rows], SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("size", "name", "part", "k", "h", "rank", "slot")])
    mixed = mixing.mix(docs)
    got = mixing.taken_words(mixed).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n or 0
    targets, want = plain_targets(sizes), []
    for s in sizes:
        mine = sorted(((hashlib.md5("|".join(["11", *([str(k)] if k is not None else [])]).encode()).hexdigest(), k is not None, k or 0, n or 0) for k, x, n in rows if x == s))
        start, goal = 0, int(targets[s] + 0.5)
        for _, known, k, n in mine:
            taken = sum(max(0, min(e * sizes[s] + start + n, goal) - e * sizes[s] - start) for e in range(3))
            want.append((k if known else None, n, sizes[s], round(targets[s], 6), taken))
            start += n
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["taken"] <= 3 * r["size"] for r in got) and sum(r["taken"] for r in got) == pytest.approx(sum(sizes.values()), abs=len(sizes))
    # slots: as many as told, those of a source equal to a word, without gaps
    slots = mixed.schedule.collect()
    for s in {r["name"] for r in slots}:
        mine = sorted((r["rank"], r["slot"], r["first_word"], r["n_words"]) for r in slots if r["name"] == s)
        assert [r[0] for r in mine] == list(range(len(mine))) and [r[1] for r in mine] == sorted({r[1] for r in mine})
        assert max(r[3] for r in mine) - min(r[3] for r in mine) <= 1 and all(b[2] == a[2] + a[3] for a, b in zip(mine, mine[1:], strict=False))
    filled = Counter()
    for p in mixed.pieces.collect():
        filled[p["slot"], p["name"]] += p["n_words"]
    assert filled == {(r["slot"], r["name"]): r["n_words"] for r in slots}


def test_every_run_of_slots_is_near_the_weights(spark):
    """Slot i is the source whose share holds the i-th van der Corput point; prefixes differ from the shares by a few slots."""
    targets = spark.createDataFrame([("a", 5000.0, 0.0, 5000.0), ("b", 2000.0, 5000.0, 7000.0), ("c", 1192.0, 7000.0, 8192.0)], "name string, target double, lo double, hi double")
    got = sorted((r["slot"], r["name"]) for r in mixing.slot_schedule(targets, 8192).collect())
    point = lambda i: int(format(i, "013b")[::-1], 2) / 8192
    assert got == [(i, "a" if point(i) < 5000 / 8192 else "b" if point(i) < 7000 / 8192 else "c") for i in range(8192)]
    seen = Counter()
    for i, name in got:
        seen[name] += 1
        assert abs(seen["a"] - (i + 1) * 5000 / 8192) < 8


def test_texts_of_slots(spark):
    rows = [(i, "ab"[i % 2], " ".join(f"d{i}w{j}" for j in range(40 + i))) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs)
    texts = Counter(w for r in mixing.slot_texts(docs, mixed).collect() for w in r["text"].split(" "))
    by = Counter()
    for w, n in texts.items():
        by[int(w[1 : w.index("w")])] += n
    assert by == {r["doc_id"]: r["taken"] for r in mixing.taken_words(mixed).collect() if r["taken"]}
    assert set(texts) <= {w for _, _, t in rows for w in t.split(" ")} and max(texts.values()) <= 3


def test_empty_and_long(spark):
    assert mixing.taken_words(mixing.mix(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = [(1, "a", "word " * 900_000), (2, "b", "x y"), (3, "c", None)]
    got = {r["doc_id"]: r["taken"] for r in mixing.taken_words(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: 899_996, 2: 6, 3: 0}
