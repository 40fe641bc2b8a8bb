"""Operators against plain versions of themselves, and on tables that once broke them."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexvane.llm import bpe, classifier, licences, line_dedup, near_dup, packing, quality_rules, sharding, topk, url_filter
from lexvane.llm.common import join_hot

#: Names that the operators use for columns of their own.
INNER = "_id id _gone gone _bad _host host _key _text text_ _row row _words _h _t bucket raw target body lines component node cluster set_key rep n sig bands x y score predicted shard slot law part first pages join_salt pack_part pack_rank sequence_id offset length piece start v hit".split()


@pytest.fixture(scope="module")
def clashing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    return docs.select("*", *[F.lit(7).alias(c) for c in INNER])


@pytest.mark.parametrize("stage", [quality_rules.stage, classifier.stage, line_dedup.stage, near_dup.stage], ids=["quality_rules", "classifier", "line_dedup", "near_dup"])
def test_stages_and_clashing_columns(spark, small, clashing, stage):
    got = stage(spark, clashing, small)
    assert got.columns == clashing.columns
    assert got.count() == stage(spark, clashing.drop(*INNER), small).count()


def test_operators_and_clashing_columns(spark, small, clashing):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    plain = clashing.drop(*INNER)
    same = lambda f: sorted(map(repr, f(clashing).collect())) == sorted(map(repr, f(plain).collect()))
    assert same(lambda d: quality_rules.judge(d, quality_rules.fit_weights(d, quality_rules.trusted_ids(labels))))
    assert same(lambda d: sharding.shard_manifest(d))
    assert same(lambda d: near_dup.near_duplicates(d))
    assert same(lambda d: licences.scan(d))
    assert same(lambda d: line_dedup.drop_lines(d).select("doc_id", "text", "n_lines", "n_dropped"))
    assert same(lambda d: classifier.score(d, classifier.fit(d, labels)))
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert same(lambda d: bpe.round_trip_digests(d, vocabulary))
    assert same(lambda d: packing.pack_documents(d, vocabulary))
    vectors = spark.createDataFrame([(i, [0.5 * i, 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    wide = vectors.select("*", *[F.lit(7).alias(c) for c in INNER])
    assert sorted(topk.top_k(wide, F.col("vec_id") < 3).collect()) == sorted(topk.top_k(vectors, F.col("vec_id") < 3).collect())
    pages = spark.createDataFrame([(1, "http://com/de/x", ""), (2, "http://x.net/", "<link rel=canonical href='http://com/de/x'>")], "page_id long, url string, html string")
    wide = pages.select("*", *[F.lit(7).alias(c) for c in INNER])
    assert sorted(url_filter.filter_urls(wide, url_filter.RULES).collect()) == sorted(url_filter.filter_urls(pages, url_filter.RULES).collect())


def test_very_long_texts(spark):
    """One text of over 4 MB among short ones."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    long = "\n".join(" ".join(words[k] for k in rng.integers(0, 3000, 12)) for _ in range(75_000)) + " under the mit license"
    docs = spark.createDataFrame([(1, long, "s"), (2, long, "s"), (3, "a b c", "s"), (4, None, "s")], "doc_id long, text string, source string")
    n = len(long.split())
    assert len(long) > 4_000_000
    assert {r["n_words"] for r in quality_rules.judge(docs, [0] * 16).filter("doc_id < 3").collect()} == {n}
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["last_word"] for r in licences.scan(docs).filter("doc_id < 3").collect()} == {n - 4}
    assert {r["n_lines"] for r in line_dedup.drop_lines(docs.filter("doc_id <> 2")).filter("doc_id = 1").collect()} == {75_000}
    assert classifier.score(docs, classifier.boost(np.zeros((0, len(classifier.FEATURES))), np.zeros(0))).count() == 4
    vocabulary = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip_digests(docs, vocabulary).collect()}
    pieces = packing.pack_documents(docs, vocabulary).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert counts[1] == counts[2] > n and {r["doc_id"]: r["n"] - 1 for r in pieces} == counts
    assert sharding.shard_manifest(docs).filter("doc_id < 3").select("size").distinct().collect()[0][0] == len(long) + 16


# 2


@pytest.mark.parametrize("peak", [1e5, 1e6, 1e15, 3e38])
def test_top_k_of_large_vectors(spark, peak):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(80, 64)) / 4).astype(np.float32)
    vectors[::9] *= np.float32(peak)
    vectors[::9] = np.clip(vectors[::9], -3.4e38, 3.4e38)
    whole = [[int(np.floor(np.float64(x) * 1024)) for x in v] for v in vectors]
    got = topk.top_k(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0).collect()
    found = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(0, 80, 10)}
    for q, rows in found.items():
        score = lambda i: sum(a * b for a, b in zip(whole[q], whole[i]))  # noqa: B023, E731
        best = sorted((i for i in range(80) if i != q), key=lambda i: (-score(i), i))[:10]
        clip = lambda x: min(max(x, topk.LEAST), topk.MOST)
        assert rows == [(i, clip(score(i))) for i in best]


@pytest.mark.parametrize("peak", [1e150, 1e200, 1e304])
def test_top_k_of_large_doubles(spark, peak):
    """Finite doubles whose products no double holds rank by their exact value; those that quantising makes infinite take no part."""
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(40, 6))]
    for i in range(0, 40, 3):
        vectors[i] = [x * peak for x in vectors[i]]
    vectors.append([1.5e308] * 6)
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = topk.top_k(rows, F.col("vec_id") % 10 == 0).collect()
    whole = [[int(np.floor(x * 1024)) for x in v] for v in vectors[:40]]
    for q in range(0, 40, 10):
        score = lambda i: sum(a * b for a, b in zip(whole[q], whole[i]))  # noqa: B023, E731
        best = sorted((i for i in range(40) if i != q), key=lambda i: (-score(i), i))[:10]
        clip = lambda x: min(max(x, topk.LEAST), topk.MOST)
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, clip(score(i))) for i in best]


def test_top_k_shuffles_no_candidate(spark, small):
    """The plan of a block's search: a scan and an Arrow map, no exchange."""
    from lexvane.llm import blocks

    rows = spark.createDataFrame([(i, i, [1.0, 2.0], 2) for i in range(9)], "row long, id long, v array<double>, d int")
    plan = blocks.against_all(rows, rows.limit(2).collect(), topk._search(3), topk.FOUND)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_places_sort_like_numbers():
    from lexvane.llm.blocks import number, place

    rng = np.random.default_rng(5)
    some = sorted({int(x) * 10 ** int(e) + int(d) for x, e, d in zip(rng.integers(-9, 10, 400), rng.integers(0, 320, 400), rng.integers(-5, 6, 400), strict=True)} | {0, 1, -1, 15, 16, -15, -16})
    assert sorted(map(place, some)) == list(map(place, some)) and [number(place(n)) for n in some] == some


def test_top_k_of_repeated_keys(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0)
    k = 1024 * 1024
    assert sorted(tuple(r) for r in got.collect()) == sorted([(0, 1, 1, 3 * k), (0, 2, 1, 3 * k), (0, 3, 0, 2 * k), (0, 1, 1, 6 * k), (0, 2, 1, 6 * k), (0, 3, 0, 2 * k)])


# 4


def noisy_copies(n, rng):
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(n):
        words = list(base)
        for k in rng.choice(150, rng.integers(0, 26), replace=False):
            words[k] = f"x{d}-{k}"
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("blocks", [(1000, 8000, 4_000_000), (7, 30, 5_000)])
def test_one_large_group_of_near_copies(spark, monkeypatch, blocks):
    """All links between 700 versions of a text, of which many are too far from the hubs; rows stay linear in the members."""
    monkeypatch.setattr(near_dup, "BLOCK", blocks[0])
    monkeypatch.setattr(near_dup, "WIDE", blocks[1])
    monkeypatch.setattr(near_dup, "SET_BYTES", blocks[2])
    rows = noisy_copies(700 if blocks[0] == 1000 else 120, np.random.default_rng(11))
    made = []
    written = near_dup.materialise
    monkeypatch.setattr(near_dup, "materialise", lambda df, name: made.append((name, written(df, name))) or made[-1][1])
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    sets = []
    for d, t in rows:
        w = t.split()
        sets.append((d, set(zip(w, w[1:]))))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                links += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {d: find(d) for d, _ in rows}
    sizes = {name: df.count() for name, df in made if name in ("likely", "sure")}
    assert sizes.get("sure", 0) < len(rows)
    if blocks[0] == 1000:
        assert links > 10_000 and sizes["likely"] < near_dup.BANDS * len(rows)


def unlike_members(n, rng):
    """Texts of which 70 of 100 words are a passage that all share; every tenth is followed by a near copy of itself."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = []
    while len(rows) < n:
        own = [f"x{len(rows)}-{k}" for k in range(30)]
        rows.append((len(rows), passage + " " + " ".join(own)))
        if len(rows) % 10 == 0:
            rows.append((len(rows), passage + " " + " ".join(own[:-1] + ["y"])))
    return rows[:n]


@pytest.mark.parametrize("n", [300, 600, 1200])
def test_unlike_members_cost_rows_by_their_words(spark, monkeypatch, n):
    """Buckets far over WIDE members, few of them alike: rows of each step a member stay the same when members grow fourfold."""
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    monkeypatch.setattr(near_dup, "WIDE", 10)
    made = []
    written = near_dup.materialise

    def keep(df, name):
        made.append((name, df := written(df, name), df.count()))
        return df

    monkeypatch.setattr(near_dup, "materialise", keep)
    rows = unlike_members(n, np.random.default_rng(1))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == {d: d - 1 if t.endswith(" y") else d for d, t in rows}
    assert len(set(got.values())) < n
    sizes = {}
    for name, _, k in made:
        sizes[name] = max(k, sizes.get(name, 0))
    assert sizes["wide"] > 0.9 * n and 0 < sizes["rare"] <= 25 * n
    assert all(k <= 100 * n for k in sizes.values()), sizes
    assert sizes["rare_cells"] <= 5 * n, sizes


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_rare_shingles_meet(spark, percent):
    """Of two sets at the similarity, the smaller one's low shingles meet the other's low or high ones, whatever the counts are."""
    rng = np.random.default_rng(percent)
    rows = [(d, " ".join(f"w{k}" for k in np.sort(rng.choice(24, rng.integers(20, 25) if d % 2 else 2, replace=False)))) for d in range(120)]
    sets = {d: set(near_dup.shingle_hashes(t.encode(), 1).tolist()) for d, t in rows}
    seen = rng.integers(0, 3, 1 << near_dup.COUNT_BITS)
    found = near_dup._rarest(spark.createDataFrame(rows, "id long, text string"), 1, percent, seen).collect()
    low = {r["id"]: {x % 2**64 for x in r["low"]} for r in found}
    both = {r["id"]: low[r["id"]] | {x % 2**64 for x in r["high"]} for r in found}
    links = 0
    for a, x in sets.items():
        assert both[a] <= x
        for b, y in sets.items():
            if a != b and len(x) <= len(y) and 100 * len(x & y) >= percent * len(x | y):
                links += 1
                assert low[a] & both[b]
    assert links > 20


def test_candidates_find_nearly_all_links():
    """Pairs at 0.8 and a little more: share that no bucket holds or whose signatures differ too much."""
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])  # 800 of 1,000
        ma, mb = near_dup.minima(np.unique(a)), near_dup.minima(np.unique(b))
        bands = (ma == mb).reshape(near_dup.BANDS, near_dup.ROWS).all(axis=1).any()
        alike = near_dup._agreement(ma.astype(np.uint8)[None], mb.astype(np.uint8)[None])[0] >= near_dup.SIGNATURE_FLOOR
        missed += not (bands and alike)
    assert missed == 0


def test_hot_joins(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 30 > 0, F.col("id")).alias("k"), "id")
    side = spark.createDataFrame([(1, "a"), (3, "b")], "k long, v string")
    want = sorted(map(repr, join_hot(rows, side, "k", F.col("id"), 10).collect()))
    assert sorted(map(repr, join_hot(rows, side, "k", F.col("id"), -1).select("k", "id", "v").collect())) == want and len(want) == 3000


# 5


def test_aliases_by_brute_force(spark):
    """Chains of relative, later and escaped targets, and explicit allow rules on the way."""
    pages = [
        (1, "http://shop.com/x/b", '<link rel="canonical" href="../de/b">'),
        (2, "http://a.net/1", '<link rel=canonical href="/go?u=http://other.com/de/z">'),
        (3, "http://other.com/de/z", ""),
        (4, "http://b.net/1", '<link rel=canonical href="http://c.net/?a=1&amp;b=2">'),
        (5, "http://c.net/?a=1&b=2", '<meta http-equiv="refresh" content="0; url=http://other.com/de/z">'),
        (6, "http://d.net/fr/1", '<link rel=canonical href="http://b.net/1">'),
        (7, "http://d.com/fr/1", '<link rel=canonical href="http://b.net/1">'),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), url_filter.RULES, max_broadcast=0).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}


# 6


def test_licence_base_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = [(9001, "Under the MIT licence; UNDER THE MIT LICENSE under the mit license"), (9002, "cc by nc cc by nc-ccé by nc"), (9003, None)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = 0
    for r in licences.scan(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), texts[r["doc_id"]]))
        places = sorted((i, label) for phrase, label in licences.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        seen += len(places)
        want = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({label for _, label in places})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert seen > 5


# 8


def test_statistics_by_hand():
    text = "Ab ab ab é1\n\n#x ... ab ab\nAb ab ab é1"
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    row = dict(zip(classifier.FEATURES, classifier.statistics([raw, None, b""])[0], strict=True))
    assert row["log_bytes"] == pytest.approx(np.log1p(len(raw))) and row["log_words"] == pytest.approx(np.log1p(len(words)))
    assert row["word_bytes"] == pytest.approx(len(raw) / len(words)) and row["longest_word"] == pytest.approx(np.log1p(max(map(len, words))))
    for name, members in classifier._CLASSES.items():
        assert row[f"{name}_share"] == pytest.approx(sum(b in members for b in raw) / len(raw))
    assert row["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert row["same_as_last"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words))
    assert row["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines))
    assert not classifier.statistics([None, b""]).any()


def test_first_split_by_brute_force(monkeypatch):
    """The first tree's root is the split of greatest gain over all features and cuts."""
    monkeypatch.setattr(classifier, "ROUNDS", 1)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 30, size=(300, 4)).astype(float)
    y = ((x[:, 2] > 11) ^ (rng.random(300) < 0.1)).astype(float)
    tree = classifier.boost(x, y)
    p = 1 / (1 + np.exp(-tree.start))
    g, h = y - p, np.full(300, p * (1 - p))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + classifier.L2)
    gains = {}
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, classifier.BINS + 1)[1:-1])):
            low = x[:, f] <= cut
            if min(h[low].sum(), h[~low].sum()) >= classifier.LEAST_WEIGHT:
                gains[f, cut] = part(low) + part(~low) - part(np.ones(300, bool))
    best = max(gains.values())
    assert gains[tree.feature[0][0], tree.threshold[0][0]] == pytest.approx(best)


# 10


def one_by_one(counts, length):
    """Best-two-fit as it is told, a sequence at a time."""
    left, out = Counter(counts), []
    while +left:
        row, gap = [], length
        while fits := [n for n, c in left.items() if c and n <= gap]:
            row.append(max(fits))
            left[row[-1]] -= 1
            gap -= row[-1]
        if gap and len(row) > 1:
            room = row[-1] + gap
            free = sorted(n for n, c in left.items() if c and n < room)
            pairs = [(a + b, a, b) for i, a in enumerate(free) for b in free[i:] if row[-1] < a + b <= room and (a != b or left[a] > 1)]
            if pairs:
                _, a, b = max(pairs)
                left[row[-1]] += 1
                row[-1:] = [b, a]
                left[a] -= 1
                left[b] -= 1
        out.append(tuple(sorted(row)))
    return sorted(out)


def test_fill_is_best_two_fit():
    rng = np.random.default_rng(14)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 60, 9), rng.integers(1, 12, 9))}
        got = sorted(tuple(sorted(row)) for row, times in packing.fill(counts, 60) for _ in range(times))
        assert got == one_by_one(counts, 60)


@pytest.mark.parametrize("part", [50_000, 3])
def test_pack_fills_as_told(spark, monkeypatch, part):
    monkeypatch.setattr(packing, "PART", part)
    rng = np.random.default_rng(15)
    lengths = [int(n) for n in np.minimum(rng.integers(1, 24, 400), 20)]
    pieces = packing.materialise(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long"), "test")
    rows = {}
    for r in packing.pack(pieces, 20).collect():
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for row in rows.values():
        row.sort()
        assert [o for o, _ in row] == [sum(n for _, n in row[:k]) for k in range(len(row))]
    assert sorted(tuple(sorted(n for _, n in row)) for row in rows.values()) == one_by_one(Counter(lengths), 20)


# 3


def test_digits_change_no_slot(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [sharding._digits(n, 40) for n in (0, 5 * 10**8, 6 * 10**8, 10**11)] == [2, 2, 3, 4]
    want = sorted(sharding.shard_manifest(docs, shards=3).collect())
    monkeypatch.setattr(sharding, "_digits", lambda rows, shards: 4)
    assert sorted(sharding.shard_manifest(docs, shards=3).collect()) == want
