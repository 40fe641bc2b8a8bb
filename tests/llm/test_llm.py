"""The ten operators and the pipeline against brute force, on small tables and on edge cases."""

import hashlib
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexvane.llm import bpe, classifier, components, licences, line_dedup, near_dup, packing, quality_rules, sharding, topk, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, _words int, n_lines int"
EDGES = [None, "", " \n\t ", "one", "a b", "x " * 3000, "wörd ñandú 日本語 words\r\nwords", "same text here " * 20, "same text here " * 20, "<|endoftext|> Under the MIT License. under the mit license", "Σ ΑΣ İ 'S don't \x1c a b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows and keys, clashing column names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "src0", None, "k", None, 1, 2) for i, t in enumerate(EDGES)]
    rows += [rows[3], (None, None, None, None, None, None, None, None, None), (3, "another text", "en", "src0", 12, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (4, 1, 0), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words_of(text):
    return (text or "").encode().split()


# 1


def base_counts(text):
    words = [w.decode() for w in words_of(text)]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_base_counts(spark, odd, small):
    got = quality_rules.judge(odd, [0] * 16, keep=["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("n_chars < 3000")
    got += quality_rules.judge(docs, [0] * 16, keep=["doc_id", "text"]).collect()
    for r in got:
        want = base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_llr(spark, small):
    docs, labelled = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality_rules.fit_weights(docs, quality_rules.trusted_ids(labelled), max_broadcast=0)
    assert weights == quality_rules.fit_weights(docs, quality_rules.trusted_ids(labelled))
    hashed = {r["w"]: r["h"] for r in docs.select(F.explode(F.split("text", "[ \\t-\\r]+")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = {}
    texts = {r["doc_id"]: [hashed[w.decode()] for w in words_of(r["text"])] for r in docs.collect()}
    todo = sorted({(a, b) for h in texts.values() for a, b in zip(h, [*h[1:], None])}, key=repr)
    for r in spark.createDataFrame(todo, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("p")).collect():
        pairs[r["a"], r["b"]] = r["p"]
    mask = quality_rules.BUCKETS - 1
    grams = {d: [x & mask for x in h] + [pairs[a, b] & mask for a, b in zip(h, [*h[1:], None])] for d, h in texts.items()}
    trusted = {r["doc_id"] for r in labelled.collect() if r["quality"] == 1 and not r["toxic"]}
    raw, target = np.zeros(mask + 1), np.zeros(mask + 1)
    for d, g in grams.items():
        np.add.at(raw, g, 1)
        if d in trusted:
            np.add.at(target, g, 1)
    share, c = target.sum() / raw.sum(), quality_rules.PRIOR
    assert weights == [round(quality_rules.SCALE * log((t + c) / (r * share + c))) for r, t in zip(raw, target)]
    for r in quality_rules.judge(docs, weights).collect():
        g = grams[r["doc_id"]]
        assert abs(r["llr"] - (sum(weights[x] for x in g) / len(g) / quality_rules.SCALE if g else 0)) < 1e-12
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)


def test_quality_edges(spark, odd, none, labels):
    assert quality_rules.fit_weights(none, labels.select("doc_id")) == [0] * quality_rules.BUCKETS
    assert quality_rules.fit_weights(odd, labels.select("doc_id").limit(0)) == [0] * quality_rules.BUCKETS
    assert quality_rules.judge(none, [0] * 16).count() == 0


# 2


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 20)).astype(np.float32) / 4)]
    vectors[7] = (7, vectors[0][1])
    vectors += [(400, None), (401, [1.0, None] + [0.0] * 18), (402, [float("nan")] * 20), (403, [float("inf")] * 20), (None, vectors[1][1]), vectors[5], (500, [0.5] * 3), (600, [0.25] * 3), (700, [])]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
    fit = {i: np.floor(np.asarray(v, np.float32).astype(float) * 1024) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    want = []
    for q in (i for i in fit if i % 100 == 0):
        scored = sorted((-int(fit[q] @ fit[i]), i) for i in fit if i != q and len(fit[i]) == len(fit[q]))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_top_k_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rows = spark.createDataFrame([(i, [0.5, 0.25] * 8) for i in range(60)], "vec_id long, embedding array<float>")
    got = topk.top_k(rows, F.col("vec_id") < 5, k=4).collect()
    for q in range(5):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in range(6) if i != q][:4]


# 3


def test_sharding(spark, odd, none, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    both = docs.unionByName(odd.select("doc_id", "text"))
    got = sharding.shard_manifest(both).collect()
    assert len(got) == both.count()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in both.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == want
    assert all(r["grown_shard"] in (r["shard"], sharding.SHARDS) and 0 <= r["shard"] < sharding.SHARDS for r in got)
    for shard in range(3):  # by hand
        key = str(got[shard]["doc_id"] if got[shard]["doc_id"] is not None else "")
        draw = [(int(hashlib.md5(f"{key}|{s}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for s in range(41)]
        scores = [-1 / log(u) for u in draw]
        assert got[shard]["shard"] == max(range(40), key=lambda s: scores[s])
        assert got[shard]["grown_shard"] == max(range(41), key=lambda s: scores[s])
    assert sharding.shard_manifest(none).count() == 0


def test_weighted_shards(spark):
    rows = spark.range(6000).withColumnRenamed("id", "doc_id")
    before = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows, "doc_id", {0: 1.0, 1: 2.0, 2: 3.0, 9: 0.0}).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows, "doc_id", {0: 1.0, 1: 2.0, 2: 3.0, 3: 1.0}).collect()}
    shares = [sum(s == k for s in before.values()) / 6000 for k in range(3)]
    assert np.allclose(shares, [1 / 6, 1 / 3, 1 / 2], atol=0.03)
    assert all(after[k] in (s, 3) for k, s in before.items())
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("doc_id"), {0: 0.0})


# 4


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def classes(rows, size):
    """component of each (doc_id, text), by all pairs."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(t, size)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, odd, small, size):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    chain = [" ".join(f"w{i}" for i in range(k, k + 100)) for k in range(0, 40, 4)]  # each is near the next only
    chained = spark.createDataFrame([(9000 - i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    both = docs.withColumn("doc_id", F.col("doc_id") + 100).unionByName(odd.select("doc_id", "text")).unionByName(chained)
    got = near_dup.near_duplicates(both, size=size).collect()
    assert len(got) == both.count()
    want = classes([(r["doc_id"], r["text"]) for r in both.collect() if r["doc_id"] is not None], size)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert want[9000] == 8991


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Many versions of one text: hubs don't reach all of them, blocks do."""
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(40):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            words[k] = f"x{d}-{k}"
        rows.append((d, " ".join(words)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(rows, 2)


def test_near_duplicates_empty(none, odd):
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.near_duplicates(odd.filter("text is null")).count() == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (7, 9), (9, 8), (None, 4), *[(i, i + 1) for i in range(20, 60)], *[(100, i) for i in range(101, 160)]]
    got = components.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    want = [(i, 1) for i in (1, 2, 3)] + [(i, 7) for i in (7, 8, 9)] + [(i, 20) for i in range(20, 61)] + [(i, 100) for i in range(100, 160)]
    assert rows_of(got, "node", "component") == sorted(want, key=repr)
    assert components.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


# 5


def test_url_filter(spark):
    link = "<html><link rel='canonical' href='{}'></html>"
    pages = [
        (1, "http://A.example.org/es/x?q#f", None),
        (2, "https://x.net/a", link.format("http://a.example.org/es/x?q")),
        (3, "http://x.net/a#top", ""),
        (4, "http://www.shop.com/fr/1", link.format("https://x.net/a")),
        (5, "http://y.net/b", '<META content="0; URL=/c" http-equiv=refresh>'),
        (6, "https://y.net/c", None),
        (7, "http://example.org/en/12", None),
        (8, "no scheme", link.format("http://example.org/es/q")),
        (9, None, None),
        (10, "ftp://com/de/x", None),
        (11, "http://notexample.org/es/", None),
        (12, "http://org", None),
        (13, "http://only.net", link.format("http://example.org/es/elsewhere")),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages + pages[:1]], "page_id long, url string, html string, host string")
    logs = spark.createDataFrame([("http://y.net/c", "http://example.org/en/1z"), (None, "http://x.net")], "src string, dst string")
    got = url_filter.filter_urls(df, url_filter.RULES, logs)
    verdicts = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert got.count() == len(pages) + 1
    assert verdicts == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("x.net", "/a", None, "block"),
        3: ("x.net", "/a", None, "block"),
        4: ("www.shop.com", "/fr/1", "com/fr/", "allow"),
        5: ("y.net", "/b", None, "block"),
        6: ("y.net", "/c", None, "block"),
        7: ("example.org", "/en/12", "example.org/en/1", "block"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("com", "/de/x", "com/de/", "block"),
        11: ("notexample.org", "/es/", "org/", "allow"),
        12: ("org", "", None, "allow"),
        13: ("only.net", "", None, "block"),
    }
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


# 6


def test_licences(spark, odd, none):
    docs = spark.createDataFrame([(1, "Under the MIT License! under-the mit\nLicense CC BY-NC 4.0"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "work is licensed under the GNU very General Public License version 3 x"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    assert tuple(got[1])[1:7] == (13, 3, 0, 8, "cc-by-nc,mit", "cc-by-nc,mit")
    assert tuple(got[2])[2:8] == (0, None, None, "", "gpl-3", 1.0)
    assert [tuple(s)[:3] for s in got[2]["spans"]] == [("gpl-3", 0, 12)]
    assert got[3]["labels"] == "gpl-3" and got[3]["score"] == pytest.approx(11 / 12)
    assert tuple(got[4])[1:8] == (0, 0, None, None, "", "", 0.0)
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).count() == 0


def test_suffix_automaton():
    rng = np.random.default_rng(5)
    seqs = [[b"%d" % x for x in rng.integers(0, 4, n)] for n in (30, 20, 25)]
    auto = licences.SuffixAutomaton(seqs)
    text = [b"%d" % x for x in rng.integers(0, 5, 300)]
    inside = lambda part: {(s, i + len(part)) for s, q in enumerate(seqs) for i in range(len(q) - len(part) + 1) if q[i : i + len(part)] == part}
    longest = []
    for end in range(1, len(text) + 1):
        n = 0
        while n < end and inside(text[end - n - 1 : end]):
            n += 1
        longest.append(n)
    want = [(e, n) for e, n in enumerate(longest, 1) if n >= 3 and (e == len(text) or longest[e] != n + 1)]
    got = auto.matches(text, 3)
    assert [(e, n) for e, n, _ in got] == want
    assert all(set(auto.places[node]) == inside(text[e - n : e]) for e, n, node in got)


# 7


def test_line_dedup(spark, odd, none):
    rows = [(i, f"Menu \nbody {i}\n\n  footer" if i % 2 else f"body {i}\nfooter\nfooter", "s") for i in range(100)] + [(200, "footer", "t"), (201, None, "s"), (202, "Menu", None)]
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[1]["text"], got[1]["n_lines"], got[1]["n_dropped"]) == ("body 1\n", 4, 2)
    assert (got[2]["text"], got[2]["n_lines"], got[2]["n_dropped"]) == ("body 2", 3, 2)
    assert got[200]["text"] == "footer" and got[201]["text"] is None and got[202]["text"] == "Menu"
    assert line_dedup.drop_lines(odd).count() == odd.count() and line_dedup.drop_lines(none).count() == 0


@pytest.mark.parametrize("pages", [1, 2, 5, 50, 99, 100, 101])
def test_line_dedup_on_hosts_of_any_size(spark, pages):
    """A host of few pages too: each page has line k if k divides its number, so that lines stand on many shares of pages."""
    texts = {i: "\n".join([f"own {i}", *[f"each {k}" for k in range(1, 40) if i % k == 0]]) for i in range(pages)}
    on = Counter(line for t in texts.values() for line in t.split("\n"))
    want = {i: "\n".join(x for x in t.split("\n") if not (on[x] > 0.1 * pages and on[x] > 1)) for i, t in texts.items()}
    got = line_dedup.drop_lines(spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert (pages == 1) == (want == texts)


# 8


def test_classifier(spark, small, odd, none, labels):
    docs, labelled = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in classifier.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labelled.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    trees = classifier.fit(odd, labels)
    assert classifier.score(odd, trees).count() == odd.count() and classifier.score(none, trees).count() == 0
    assert classifier.fit(none, labels.limit(0)).score(np.zeros((2, len(classifier.FEATURES)))).tolist() == [0.5, 0.5]


def test_trees_from_arrays():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(classifier.FEATURES)))
    y = (x[:, 0] + x[:, 3] ** 2 > 1).astype(float)
    trees = classifier.boost(x, y)

    def slow(row):
        total = trees.start
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += v[at - len(f)]
        return 1 / (1 + np.exp(-total))

    p = trees.score(x)
    assert np.allclose(p, [slow(r) for r in x]) and ((p >= 0.5) == y).mean() > 0.97


# 9 and 10


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def test_bpe_is_the_librarys(spark, odd, none, small, vocabulary, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = [r["text"] or "" for r in docs.collect()]
    want = sorted(hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in texts)
    got = bpe.round_trip_digests(docs, vocabulary).collect()
    assert sorted(r["ids_sha256"] for r in got) == want
    coded = bpe.encode(docs, vocabulary)
    decoded = sorted(r["decoded"] for r in bpe.decode(coded, vocabulary).collect())
    assert decoded == sorted(library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts)
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in decoded)
    assert bpe.encode(none, vocabulary).count() == 0


def test_bpe_memory(monkeypatch, vocabulary, library):
    monkeypatch.setattr(bpe, "MEMORY", 20)
    coder = bpe.TrieBpe(vocabulary)
    for k in range(6):
        text = " ".join(f"word{i % 7} text{k}x{i} end" for i in range(12))
        assert [memoryview(i).cast("I").tolist() for i, _ in coder.encode_all([text.encode()])] == [library.encode(text, add_special_tokens=False).ids]


def test_packing(spark, odd, none, small, vocabulary, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    ids = sorted(library.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect())
    pieces = packing.materialise(packing.token_pieces(docs, vocabulary, with_ids=True), "test")
    got = packing.pack(pieces).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids)) and sum(r["piece"] == 0 for r in got) == len(ids)
    whole = sorted(r["ids"] for r in got if r["piece"] == 0)
    assert whole == sorted(i[:2048] for i in ids)
    by_sequence = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for rows in by_sequence.values():
        rows.sort()
        assert [o for o, _, _ in rows] == [sum(n for _, n, _ in rows[:k]) for k in range(len(rows))] and sum(n for _, n, _ in rows) <= 2048
    built = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.pack(pieces)).collect()}
    assert sorted(map(len, built.values())) == sorted(sum(n for _, n, _ in rows) for rows in by_sequence.values())
    assert len(by_sequence) <= 1.02 * sum(map(len, ids)) / 2048 + 1
    assert packing.pack_documents(none, vocabulary).count() == 0


def test_fill():
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 12), rng.integers(1, 50, 12))}
        runs = packing.fill(counts, 100)
        used = {}
        for row, times in runs:
            assert sum(row) <= 100 and times > 0
            for n in row:
                used[n] = used.get(n, 0) + times
        assert used == counts
    assert packing.fill({60: 1, 30: 1, 25: 1, 15: 1}, 100) == [([60, 25, 15], 1), ([30], 1)]  # two for the smallest
    assert packing.fill({}, 100) == []


# pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then, now = now, corpus_pipeline.materialise(stage(spark, now, small), name)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        assert now.select("doc_id").subtract(then.select("doc_id")).count() == 0
    kept = {r["doc_id"] for r in now.select("doc_id").collect()}
    assert kept and not [d for d in kept if labels.get(d) == 0]
    pieces = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == kept


def test_stages_on_odd_tables(spark, odd, none, small):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, small).columns == odd.columns
        assert stage(spark, odd, small).count() <= odd.count()
        assert stage(spark, none, small).count() == 0
    one = near_dup.stage(spark, odd.filter("doc_id is not null"), small)
    assert one.count() == one.select("doc_id").distinct().count()
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, none, small).count() == 0 and pack(spark, odd, small).select("doc_id").count() >= odd.count()
