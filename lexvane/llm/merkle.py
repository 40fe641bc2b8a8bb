"""Merkle manifest of a dataset: a 16-ary hash tree for each source, a tree of their roots, and a checked inclusion proof for each row.

Trees are worked on in superblocks of 16**3 consecutive nodes. Upwards, a superblock is reduced to one node of three levels further up,
again and again until each tree has one. Downwards, the nodes of a superblock are cogrouped with the one row that holds the required
outer nodes (the siblings on the way from the superblock to the root), so that one task finishes the local reduction, joins the local
and the outer part of each proof and folds it. A task holds one superblock, however large a source is.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import materialise, table
from lexvane.operators.ranks import group_rank

#: Nodes of a run, which become one node; levels of a superblock.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value; so no two rows give the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """The leaf of a row: lower-case hex SHA-256 of its encoded fields, one after the other."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def joined(digests: list[str]) -> str:
    """The node above some nodes."""
    return sha256("".join(digests).encode()).hexdigest()


def reduction(digests: list[str], n: int) -> list[list[str]]:
    """The nodes of a superblock level by level, as far up as LEVELS, or as its tree of n nodes goes."""
    levels = [list(digests)]
    while len(levels) <= LEVELS and n > 1:
        below, n = levels[-1], -(-n // FAN)
        levels.append([joined(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's ancestors in their runs, from level to level."""
    left, right = [], []
    for nodes in levels[:-1]:
        start = at // FAN * FAN
        left.append("".join(nodes[start:at]))
        right.append("".join(nodes[at + 1 : start + FAN]))
        at //= FAN
    return left, right


def fold(digest: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in zip(left, right, strict=True):
        digest = joined([before, digest, after])
    return digest


NODE = "tree string, pos long, n long, digest string"
PATH = f"{NODE}, left array<string>, right array<string>, subroot string, root string"


def _up(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    n, levels = int(pdf.n.iloc[0]), reduction(list(pdf.digest), int(pdf.n.iloc[0]))
    return pd.DataFrame({"tree": [pdf.tree.iloc[0]], "pos": [int(pdf.pos.iloc[0]) // BLOCK], "n": [-(-n // BLOCK)], "digest": [levels[-1][0]]})


def _block() -> Column:
    return F.expr(f"pos div {BLOCK}").alias("block")


def towers(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, pos, n, digest) and what they become from superblock to superblock, up to one node for each tree (n = 1)."""
    out = [nodes]
    for _ in range(_rounds(nodes.agg(F.max("n")).first()[0])):
        below = out[-1]
        up = below.filter("n > 1").groupBy("tree", _block()).applyInPandas(_up, NODE)
        out.append(materialise(up.unionByName(below.filter("n = 1")), "merkle"))
    return out


def _rounds(n: int | None) -> int:
    rounds = 0
    while n and n > 1:
        n, rounds = -(-n // BLOCK), rounds + 1
    return rounds


def _down(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a superblock with their siblings up to the root: local ones first, then those of the superblock."""
    if nodes.empty:  # a lone node, whose way to the root is known
        return pd.DataFrame({c: [] for c in ("tree", "pos", "n", "digest", "left", "right", "subroot", "root")}, dtype=object)
    nodes, top = nodes.sort_values("pos"), outer.iloc[0]
    levels = reduction(list(nodes.digest), int(nodes.n.iloc[0]))
    own = [siblings(levels, i) for i in range(len(nodes))]
    add = lambda side, rest: [s[side] + list(rest) for s in own]
    return pd.DataFrame({"tree": nodes.tree, "pos": nodes.pos, "n": nodes.n, "digest": nodes.digest, "left": add(0, top.left), "right": add(1, top.right), "subroot": top.subroot, "root": top.root})


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of levels[0] with their siblings up to the root (PATH); top: the last level's nodes with theirs."""
    for nodes in reversed(levels[:-1]):
        many, lone = nodes.filter("n > 1"), nodes.filter("n = 1").select("tree")  # a lone node is its tree's root, which top has already
        paths = many.groupBy("tree", _block()).cogroup(top.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(_down, PATH)
        top = materialise(paths.unionByName(top.join(lone, "tree", "left_semi").select(*paths.columns)), "merkle")
    return top


PROOF = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _finish(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The leaves of a superblock: local reduction, proofs joined with the outer nodes, folded from the presented leaf."""
    rows, top = rows.sort_values("pos"), outer.iloc[0]
    levels = reduction(list(rows.leaf), int(rows.n.iloc[0]))
    proofs, folded = [], []
    for i, shown in enumerate(rows.presented):
        left, right = siblings(levels, i)
        left, right = left + list(top.left), right + list(top.right)
        proofs.append(joined([x for pair in zip(left, right, strict=True) for x in pair]))
        folded.append(fold(shown, left, right))
    out = rows.drop(columns=["tree", "pos", "n", "presented"])
    return out.assign(subroot=top.subroot, root=top.root, proof_sha256=proofs, folded_root=folded, verified=[f == top.root for f in folded])


def verify(rows: DataFrame) -> DataFrame:
    """rows (key, source, leaf, presented) with subroot, root, proof_sha256, folded_root, verified: is the presented leaf in the tree?

    Leaves of a source ascend by key (null last), equal keys by leaf, so rows that repeat are leaves of their own. A source of one
    row has that leaf as its root; sources ascend by their bytes, null first. Without rows the result is empty.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null: before all others
    leaves = materialise(rows.select("key", tree.alias("tree"), "leaf", "presented"), "leaves")
    ranked = group_rank(leaves, ["tree"], "key", [F.asc_nulls_last("key"), "leaf", "presented"])
    placed = materialise(ranked.select("key", "tree", "leaf", "presented", (F.col("rank") - 1).alias("pos"), F.col("_n").alias("n")), "placed")
    sources = towers(placed.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    subroots = group_rank(sources[-1].select("tree", "digest"), [], "tree", ["tree"])
    ordered = materialise(subroots.select(F.lit("").alias("tree"), (F.col("rank") - 1).alias("pos"), F.col("_n").alias("n"), "digest", F.col("tree").alias("source")), "subroots")
    whole = towers(ordered.drop("source"))
    ends = lambda nodes: nodes.select("*", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"))
    top = descend(whole, ends(whole[-1]).select("*", F.col("digest").alias("subroot"), F.col("digest").alias("root")))
    names = ordered.select("source", F.col("pos").alias("at"))
    outer = top.join(names, F.col("pos") == F.col("at")).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), "digest", "left", "right", F.col("digest").alias("subroot"), "root")
    above = descend(sources[1:], outer) if len(sources) > 1 else outer
    kind = rows.schema["key"].dataType.simpleString()
    return placed.groupBy("tree", _block()).cogroup(above.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(_finish, f"key {kind}, leaf string, {PROOF}")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, key: str = "doc_id", source: str = "source", fields: list[str] = FIELDS) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs, whose leaf covers the fields.

    tampered: changed values of some fields, as they are presented to be checked against the manifest of docs itself. Columns
    that are no field are not read; null keys, sources and fields are values of their own.
    """
    changed = tampered or {}
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), leaf([F.col(f) for f in fields]).alias("leaf"), leaf([changed.get(f, F.col(f)) for f in fields]).alias("presented"))
    return verify(rows).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), {"text": F.when(chosen, low).otherwise(F.col("text"))})


def _climb(levels: int, at: str, n: str, tree: str, nodes: str, rows: str) -> tuple[str, str]:
    """SQL of the levels of a forest above `nodes` (tree, p, n, h), and of `rows` with cur and proof taken up through them."""
    sql, last = "", rows
    for k in range(levels):
        many = f"({n} + {16**k - 1}) // {16**k} > 1"
        sql += f""",
{nodes}_run{k} as (select tree, p // 16 as q, list(h order by p) as hs from {nodes}{k} group by 1, 2),
{nodes}{k + 1} as (select tree, p // 16 as p, (n + 15) // 16 as n, case when n = 1 then min(h) else sha256(string_agg(h, '' order by p)) end as h from {nodes}{k} group by tree, p // 16, n),
{rows}_{k} as (select d.* exclude (cur, proof, i, q), case when {many} then sha256(array_to_string(hs[1:i], '') || cur || array_to_string(hs[i + 2:], '')) else cur end as cur,
    case when {many} then proof || array_to_string(hs[1:i], '') || array_to_string(hs[i + 2:], '') else proof end as proof
    from (select *, {at} // {16**k} % 16 as i, {at} // {16 ** (k + 1)} as q from {last}) d join {nodes}_run{k} r on d.{tree} = r.tree and d.q = r.q)"""
        last = f"{rows}_{k}"
    return sql, last


def _oracle() -> str:
    field = lambda c, text=None: f"coalesce(strlen({text or f'cast({c} as varchar)'}) || ':' || {text or f'cast({c} as varchar)'}, '-')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    up, rows = _climb(6, "p", "n", "tree", "node", "doc")
    further, last = _climb(3, "t", "tn", "all_sources", "top", "whole")
    return f"""
with crc_table as (select list(list_reduce(range(0, 8), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i) order by i) as t from (select unnest(range(0, 256)) as i)),
bytes as (select *, hex(encode(cast(doc_id as varchar))) as x from documents),
checked as (select *, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint)), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 5 = 0 as chosen from bytes, crc_table),
leaves as (select doc_id, coalesce('=' || source, '') as tree, sha256({head} || {field("text")}) as leaf, case when chosen then sha256({head} || {field("text", low)}) else sha256({head} || {field("text")}) end as cur from checked),
doc as (select *, '' as proof, row_number() over (partition by tree order by doc_id nulls last, leaf, cur) - 1 as p, count(*) over (partition by tree) as n from leaves),
node0 as (select tree, p, n, leaf as h from doc){up},
subroots as (select tree, h as subroot, row_number() over (order by tree) - 1 as t, count(*) over () as tn from node6),
whole as (select d.doc_id, d.leaf, s.subroot, s.t, s.tn, '' as all_sources, d.cur, d.proof from {rows} d join subroots s on d.tree = s.tree),
top0 as (select '' as tree, t as p, tn as n, subroot as h from subroots){further}
select doc_id, leaf, subroot, top3.h as root, sha256(proof) as proof_sha256, cur as folded_root, cur = top3.h as verified from {last}, top3
"""


ORACLE = _oracle()
