"""The manifest against a plain tree: sources of one row to more than a superblock, nulls, ties, repeated rows, tampering."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexvane.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """(root, siblings of each leaf from level to level)."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, p in enumerate(at):
            run = runs[p // 16]
            proofs[i].append((run[: p % 16], run[p % 16 + 1 :]))
            at[i] = p // 16
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], proofs


def plain(rows, tamper):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, own = [], {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf_of(r)))
        root, own[s] = tree([leaf_of(r) for r in by[s]])
        subs.append(root)
    root, tops = tree(subs)
    out = []
    for s, sub, top in zip(order, subs, tops, strict=True):
        for row, path in zip(by[s], own[s], strict=True):
            now = leaf_of((*row[:4], tamper(row[4])) if row[0] is not None and row[0] % 3 == 0 else row)
            for left, right in path + top:
                now = digest("".join([*left, now, *right]))
            proof = digest("".join(x for left, right in path + top for x in [*left, *right]))
            out.append((row[0], leaf_of(row), sub, root, proof, now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 1}, {None: 16, "": 17, "z": 1, "é": 2, "Z": 257}, {"hot": 4096 + 40, "b": 3, None: 1}, {f"s{i}": 1 + i % 3 for i in range(40)}], ids=["one", "lone", "mixed", "blocks", "many"])
def test_manifest(spark, sizes):
    rows = [(None if i % 50 == 49 else i // 2, s, "x" if i % 3 else None, i % 5, None if i % 7 == 3 else f"Text {i // 4} é") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("key", F.lit("k"))
    changed = {"text": F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))}
    got = [tuple(r) for r in merkle.manifest(docs, changed).collect()]
    assert sorted(got, key=repr) == plain(rows, lambda t: t and t.lower())


def test_empty(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_long_text(spark):
    rows = [(1, "s", "x", 9, "Long " * 900_000), (2, "s", "x", 9, "")]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), {"text": F.lower("text")}).orderBy("doc_id").collect()
    assert [r["leaf"] for r in got] == [leaf_of(r) for r in rows] and [r["verified"] for r in got] == [False, True]
