"""Near duplicates: MinHash signatures, banding, signature check, exact check on full shingle sets, connected components.

No link between different texts is lost for want of pairs: texts with equal shingle sets are one node. In a bucket of a
band, every member is first checked against two hubs (one row a member). Where a bucket then still holds members of more
than one component, all signatures across components are compared there, and a spanning forest of the likely links is
kept: it tells which components may belong together. Within such a cluster the full sets of all members meet, in blocks
of bounded bytes, and again only a spanning forest of the confirmed links leaves a task. In buckets of more than WIDE members
not all meet: there only members that share one of their rarest shingles are compared (prefix filter: of two sets at the
similarity or above, these always share one), so many unlike members that have met by a common passage cost rows in
proportion to their words. What can be missed is a pair that shares no bucket, at a similarity of 0.8 with a chance of
(1 - 0.8**7)**60 = 7e-7, or whose signatures agree in less than SIGNATURE_FLOOR, with one of about 4e-7 (5 standard errors).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.bpe import groups
from lexvane.llm.common import broadcast_if_small, claim, materialise, remove, table
from lexvane.llm.components import connected_components

BANDS, ROWS = 60, 7
#: A pair whose signatures agree in a smaller share of places goes on to no exact check; 0.8 is 5 standard errors higher.
SIGNATURE_FLOOR = 0.70
#: Members of a bucket outside its largest component, and members of all, that meet in one task; a bucket of over WIDE members meets by rare shingles.
BLOCK, WIDE = 1000, 8_000
#: Slots in which shingles are counted to tell rare ones from frequent ones: any order is right, this one makes small groups.
COUNT_BITS = 18
#: Bytes of shingle sets outside the largest component that meet twice as many bytes of all in one task.
SET_BYTES = 4_000_000
#: Copies of one shingle set from which on it is joined by a broadcast.
COPIES = 1000
MEMORY = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()
_draw = np.random.default_rng(20_011)
_FACTOR = (_draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * 2 + 1)[:, None]
_SHIFT = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_BAND_FACTOR = _draw.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_START = _draw.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words (A-Z lower-cased); of the whole, if it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    row = np.full(n, len(words) if len(words) < size else 0, np.uint64)
    for j in range(min(size, len(h))):
        row = row * _STEP + h[j : j + n]
    return np.unique(_mix(row))


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each universal hash x -> a * x + b (mod 2**32) over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        values = _FACTOR * x[None, k : k + 512]
        values += _SHIFT
        np.minimum(out, values.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n_shingles, set_key, bands, sig) for each row; no shuffle. Without words: 0, null, no bands, null."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dup", _words.clear)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in groups(texts):
                counts, keys, bands, sigs, ends = [], [], [], [], [0]
                for t in texts[start:stop]:
                    s = shingle_hashes(t, size)
                    counts.append(len(s))
                    if len(s):
                        m = minima(s)
                        keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                        bands.append(_mix((m.reshape(BANDS, ROWS) * _BAND_FACTOR).sum(axis=1, dtype=np.uint64) + _BAND_START))
                        sigs.append(m.astype(np.uint8).tobytes())
                    else:
                        keys.append(None)
                        sigs.append(None)
                    ends.append(ends[-1] + (BANDS if len(s) else 0))
                flat = np.concatenate(bands).view(np.int64) if bands else np.empty(0, np.int64)
                columns = [ids.slice(start, stop - start), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_key", "bands", "sig"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_shingles long, set_key binary, bands array<long>, sig binary")


def _shingle_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in groups(texts, 1_000_000):
                sets = [shingle_hashes(t, size) for t in texts[start:stop]]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "shingles"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, shingles array<long>")


def _rarest(docs: DataFrame, size: int, percent: int, seen: np.ndarray) -> DataFrame:
    """(id, low, high): the rarest shingles of each set of docs (id, text), by the counts of their slots, then by value.

    Two sets at the similarity share one of the smaller set's `low` and the other's `low` or `high`: their intersection is at
    least 2 * percent / (100 + percent) of the smaller set and percent of the larger one, and all sets have one order.
    """
    kind = docs.schema["id"].dataType.simpleString()
    shift = np.uint64(64 - COUNT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in groups(texts, 1_000_000):
                parts = ([], [])
                for t in texts[start:stop]:
                    s = shingle_hashes(t, size)
                    n = len(s)
                    s = s[np.lexsort((s, seen[s >> shift]))].view(np.int64)
                    low = n - -(-2 * percent * n // (100 + percent)) + 1 if n else 0
                    parts[0].append(s[:low])
                    parts[1].append(s[low : n - -(-percent * n // 100) + 1])
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, p)]).astype(np.int32)), pa.array(np.concatenate(p))) for p in parts]
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *lists], ["id", "low", "high"])

    rows = docs.select("id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, low array<long>, high array<long>")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures, row by row; 8-bit places also agree by chance."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, BANDS * ROWS)


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes allow the similarity and whose signatures agree enough."""
    side = lambda name: nodes.select(F.col("id").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n_shingles").alias(f"n_{name}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = _agreement(_matrix(batch.column(2).to_pylist()), _matrix(batch.column(3).to_pylist())) >= SIGNATURE_FLOOR
                yield batch.select(["a", "b"]).filter(pa.array(close))

    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, max_broadcast: int) -> DataFrame:
    """Pairs (src, dst) whose full shingle sets have the similarity; docs: (id, text)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialise(_shingle_sets(docs.join(broadcast_if_small(ids, max_broadcast), "id", "left_semi"), "id", "text", size), "sets")
    left, right = (sets.select(F.col("id").alias(n), F.col("shingles").alias(f"s_{n}")) for n in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with two members: the one that meets most others over all its buckets, and the first in a fixed random order."""
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    order = F.xxhash64("id")
    hubs = members.join(met, "id").groupBy("band").agg(F.max(F.struct("met", "id"))["id"].alias("hub_a"), F.min(F.struct(order.alias("o"), "id"))["id"].alias("hub_b"))
    rows = members.join(hubs, "band").select("id", F.explode(F.array("hub_a", "hub_b")).alias("hub")).filter(F.col("id") != F.col("hub"))
    return rows.select(*_ordered(F.col("id"), F.col("hub"))).distinct()


class _Groups:
    """Components of a cell's members, merged as links are found."""

    def __init__(self, components: np.ndarray):
        self.of = np.unique(components, return_inverse=True)[1]
        self.label = np.arange(self.of.max() + 1)

    def merge(self, own: int, roots: np.ndarray) -> None:
        self.label[np.isin(self.label, roots)] = own

    def one(self) -> bool:
        return bool((self.label == self.label[0]).all())


def _cells(placed: DataFrame, group: str, weight: str, narrow: int, wide: int) -> DataFrame:
    """(group, i, j, id, c, other) of groups that hold several components: blocks of members outside the largest against blocks of all.

    placed: (group, id, c, weight); a block has about `narrow` or `wide` of the weight.
    """
    sizes = placed.groupBy(group, "c").agg(F.sum(weight).alias("k"))
    mixed = sizes.groupBy(group).agg(F.max(F.struct("k", "c"))["c"].alias("most"), F.sum("k").alias("all"), F.max("k").alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = mixed.select(group, "most", F.ceil(F.col("all") / wide).alias("j_n"), F.ceil((F.col("all") - F.col("largest")) / narrow).alias("i_n"))
    rows = placed.join(mixed, group)
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    others = rows.filter("c != most").select(group, "id", "c", block("i_n").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_n") - 1)).alias("j"), F.lit(True).alias("other"))
    everyone = rows.select(group, "id", "c", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)).alias("i"), block("j_n").alias("j"), F.lit(False).alias("other"))
    return others.unionByName(everyone)


def _linked(pdf: pd.DataFrame, percent: int, confirm) -> pd.DataFrame:
    """A spanning forest (a, b) of a cell's links between components: of those whose signatures agree enough and that confirm lets through.

    confirm(x, hits) takes the place of a member and the places of likely partners in one component, the likeliest first,
    and returns one of them or None.
    """
    found_a, found_b = [], []
    first = np.flatnonzero(pdf.other.to_numpy())
    second = np.flatnonzero(~pdf.other.to_numpy())
    if len(first) and len(second):
        groups_, sigs, sizes, ids = _Groups(pdf.c.to_numpy()), _matrix(pdf.sig), pdf.n_shingles.to_numpy(), pdf.id.to_numpy()
        there, place = sigs[second], groups_.of[second]
        for x in first:
            if groups_.one():
                break
            own = groups_.label[groups_.of[x]]
            labels = groups_.label[place]
            near = np.flatnonzero((labels != own) & (100 * np.minimum(sizes[second], sizes[x]) >= percent * np.maximum(sizes[second], sizes[x])))
            agree = _agreement(there[near], sigs[x][None, :])
            near, agree = near[agree >= SIGNATURE_FLOOR], agree[agree >= SIGNATURE_FLOOR]
            near = near[np.argsort(-agree, kind="stable")]
            joined = []
            for root in np.unique(labels[near]):
                y = confirm(x, second[near[labels[near] == root]])
                if y is not None:
                    joined.append(root)
                    found_a.append(min(ids[x], ids[y]))
                    found_b.append(max(ids[x], ids[y]))
            groups_.merge(own, np.array(joined, dtype=groups_.label.dtype))
    return pd.DataFrame({"a": pd.Series(found_a, dtype=pdf.id.dtype), "b": pd.Series(found_b, dtype=pdf.id.dtype)})


def _rare_cells(wide: DataFrame, docs: DataFrame, size: int, percent: int, max_broadcast: int) -> DataFrame:
    """(pack, shingle, i, j, id, c, other) for members (id, c): those with the shingle among their low ones against those with it among low or high.

    A shingle without a low member, or all of whose members are in one component, has no cell. Rows grow with the words of
    members; a shingle is cut into more than one cell from BLOCK low members or WIDE members on. A pack has many small cells.
    """
    texts = docs.join(broadcast_if_small(wide.select("id"), max_broadcast), "id", "left_semi")
    slot = F.shiftrightunsigned("shingle", 64 - COUNT_BITS)
    counted = _shingle_sets(texts, "id", "text", size).select(F.explode("shingles").alias("shingle")).groupBy(slot.alias("slot")).count().toPandas()  # 2**COUNT_BITS at most
    seen = np.zeros(1 << COUNT_BITS, np.int64)
    seen[counted["slot"].to_numpy(np.int64)] = counted["count"]
    mark = lambda name: F.transform(name, lambda x: F.struct(x.alias("shingle"), F.lit(name == "low").alias("low")))
    found = _rarest(texts, size, percent, seen).join(wide, "id")
    rows = materialise(found.select("id", "c", F.explode(F.concat(mark("low"), mark("high"))).alias("at")).select("id", "c", "at.*").distinct(), "rare")
    sizes = rows.groupBy("shingle").agg(F.sum(F.col("low").cast("long")).alias("lows"), F.count("*").alias("all"), F.min("c").alias("first"), F.max("c").alias("last"))
    cut = sizes.filter("lows > 0 and first < last").select("shingle", F.ceil(F.col("lows") / BLOCK).alias("i_n"), F.ceil(F.col("all") / WIDE).alias("j_n"))
    packs = rows.count() // WIDE + 1
    dealt = rows.join(cut, "shingle").withColumn("pack", F.pmod(F.xxhash64("shingle"), F.lit(packs)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    ones = dealt.filter("low").select("pack", "shingle", block("i_n").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_n") - 1)).alias("j"), "id", "c", F.lit(True).alias("other"))
    everyone = dealt.select("pack", "shingle", F.explode(F.sequence(F.lit(0), F.col("i_n") - 1)).alias("i"), block("j_n").alias("j"), "id", "c", F.lit(False).alias("other"))
    return materialise(ones.unionByName(everyone), "rare_cells")


def _likely_links(members: DataFrame, components: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, max_broadcast: int) -> DataFrame:
    """Links (src, dst) that join, through signatures alone, all components of a bucket whose members may be linked."""
    kind = members.schema["id"].dataType.simpleString()
    placed = members.filter("n > 2").join(components, members.id == components.node, "left").select("id", "band", "n", F.coalesce("component", "id").alias("c"), F.lit(1).alias("one"))
    signs = nodes.select("id", "sig", "n_shingles")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return _linked(pdf, percent, lambda x, hits: hits[0])

    def compare_each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compare(part.reset_index(drop=True)) for _, part in pdf.groupby("shingle")], ignore_index=True)

    cells = _cells(placed.filter(F.col("n") <= WIDE), "band", "one", BLOCK, WIDE).join(signs, "id")
    links = cells.groupBy("band", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")
    if not members.filter(F.col("n") > WIDE).isEmpty():
        large = placed.filter(F.col("n") > WIDE)
        mixed = large.groupBy("band").agg(F.min("c").alias("first"), F.max("c").alias("last")).filter("first < last")
        wide = materialise(large.join(mixed, "band", "left_semi").select("id", "c").distinct(), "wide")
        if not wide.isEmpty():
            rare = _rare_cells(wide, docs, size, percent, max_broadcast).join(signs, "id")
            links = links.unionByName(rare.groupBy("pack", "i", "j").applyInPandas(compare_each, f"a {kind}, b {kind}"))
    return links.distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _sure_links(clusters: DataFrame, components: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, max_broadcast: int) -> DataFrame:
    """Links (src, dst), confirmed on full sets, that join all components of a cluster (node, component) which links join."""
    kind = nodes.schema["id"].dataType.simpleString()
    now = components.select(F.col("node").alias("id"), F.col("component").alias("c"))
    placed = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(now, "id", "left").withColumn("c", F.coalesce("c", "id"))
    several = placed.groupBy("cluster").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("cluster")
    sized = nodes.groupBy("id").agg(F.max("n_shingles").alias("n_max"))
    placed = materialise(placed.join(several, "cluster", "left_semi").join(sized, "id").select("cluster", "id", "c", (8 * F.col("n_max") + 500).alias("bytes")), "clusters")
    ids = placed.select("id").distinct()
    sets = materialise(_shingle_sets(docs.join(broadcast_if_small(ids, max_broadcast), "id", "left_semi"), "id", "text", size), "sets")
    cells = _cells(placed, "cluster", "bytes", SET_BYTES, 2 * SET_BYTES).join(nodes.select("id", "sig", "n_shingles"), "id").join(sets, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets_ = [s.view(np.uint64) for s in pdf.shingles]  # sorted as such

        def confirm(x: int, hits: np.ndarray):
            for k in range(0, len(hits), 64):  # the likeliest first
                some = hits[k : k + 64]
                lengths = np.array([len(sets_[y]) for y in some])
                flat = np.concatenate([sets_[y] for y in some])
                mine = sets_[x]
                inside = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                both = np.add.reduceat(inside.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                good = np.flatnonzero(100 * both >= percent * (lengths + len(sets_[x]) - both))
                if len(good):
                    return some[good[0]]
            return None

        return _linked(pdf, percent, confirm)

    return cells.groupBy("cluster", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}").distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _names(known: DataFrame, max_broadcast: int) -> DataFrame:
    """(id, set_key, rep), distinct: rep is the least id with that set. Sets of many copies meet their rows by a broadcast, if that is small."""
    sets = materialise(known.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "sets")
    rows, many = known.select("id", "set_key"), broadcast_if_small(sets.filter(F.col("n") > COPIES).select("set_key", "rep"), max_broadcast)
    rest = rows.join(many, "set_key", "left_anti").join(sets.filter(F.col("n") <= COPIES).select("set_key", "rep"), "set_key", "left")
    return rows.join(many, "set_key").unionByName(rest).select("id", "set_key", F.coalesce("rep", "id").alias("rep")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, max_broadcast: int = 500_000) -> DataFrame:
    """A row for each row of docs: key, n_shingles, component_id, kept.

    Two documents are linked if their sets of `size`-word shingles have 100 * intersection >= percent * union; component_id is
    the least key that links reach, itself included, and kept marks it. A text with fewer words is one shingle; a null text or
    one without words has none and is linked with nothing. Rows that repeat a key are one node with the links of all its
    texts, and each comes back. A row with a null key comes back with a null component and kept, and links nothing. Shingles
    are compared by 64-bit hashes. A text of any length is shingled as a whole; an empty table gives an empty one. Other
    columns are not read.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = materialise(signatures(docs, "id", "text", size), "signatures")
    known = found.filter("set_key is not null and id is not null")
    named = materialise(_names(known, max_broadcast), "names")
    copies = named.filter("id <> rep").select("id", "set_key")
    nodes = known.join(broadcast_if_small(copies, max_broadcast), ["id", "set_key"], "left_anti")
    bands = nodes.select("id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(bands.join(shared, "band").select("id", "band", "n"), "members")
    near = materialise(nodes.select("id", "sig", "n_shingles").join(members.select("id").distinct(), "id", "left_semi"), "nodes")
    pairs = materialise(_alike(_hub_pairs(members), near, percent), "pairs")
    first = _confirm(pairs, docs, size, percent, max_broadcast)
    twice = named.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    again = named.join(twice, "id").select(F.col("rep").alias("src"), F.col("low").alias("dst"))
    components = materialise(connected_components(first.unionByName(again)), "components")
    remove(pairs)
    likely = materialise(_likely_links(members, components, near, docs, size, percent, max_broadcast), "likely")
    if not likely.isEmpty():
        stars = components.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        clusters = connected_components(stars.unionByName(likely))
        sure = materialise(_sure_links(clusters, components, near, docs, size, percent, max_broadcast), "sure")
        if not sure.isEmpty():
            components = connected_components(stars.unionByName(sure))
    for done in (members, near):
        remove(done)
    groups_ = named.select("id", "set_key", "rep").join(components, F.col("rep") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    rows = found.select("id", "n_shingles").join(groups_, "id", "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, max_broadcast: int = 500_000) -> DataFrame:
    """documents without those whose near duplicate (five words, 0.8) of smaller doc_id stays; of rows with equal doc_id one stays.

    Rows with a null doc_id stay, as do null and empty texts of different doc_id. The columns are those of docs, whatever their names.
    """
    dropped = near_duplicates(docs, size=5).filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    repeated = docs.groupBy("doc_id").count().filter(F.col("count") > 1).filter("doc_id is not null").select("doc_id")
    small = broadcast_if_small(dropped, max_broadcast)
    kept = docs.join(small, docs["doc_id"] == small["gone"], "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.filter("doc_id is null").unionByName(kept.filter("doc_id is not null").dropDuplicates(["doc_id"]))


#: All pairs that share a shingle: only for small tables.
ORACLE = r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, case when w is null or len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as both_ from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id where 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from shared where 100 * both_ >= 80 * (na + nb - both_)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as node, doc_id as other from sets union select r.node, e.b from reach r join edges e on r.other = e.a),
components as (select node, min(other) as component_id from reach group by 1)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join components on doc_id = node
"""
