"""Edge cases, gates that have to fail, and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexvane.functions import text as tx
from lexvane.functions import token_lists as tl
from lexvane.functions import vectors as vec
from lexvane.functions.keys import hash_key
from lexvane.operators import gates, joins, metrics, plugins, ranks, sampling, splits
from lexvane.plans import pipeline as job
from lexvane.sources import chunks, registry, tables
from lexvane.streaming import scoring


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


CLEAN_CASES = [
    ("<analysis>\n1. One\n(b) Two\n</analysis>", "One\n\nTwo"),
    ("<analysis>- **Head:** text*\n\n• __deep__\n</analysis>", "Head: text\n\ndeep"),
    ("<analysis>iv) four\n(iii) three\n(12) twelve\n– dash</analysis>", "four\n\n(iii) three\n\ntwelve\n\ndash"),
    ("<analysis>1. 2. twice</analysis>", "2. twice"),
    ("<analysis>** \n*\n</analysis>", ""),
    ("<analysis> word * </analysis>", "word "),
    ("<analysis> 1. wide </analysis>", "wide"),
    ("<analysis>cut off", None),
    (None, None),
]


@pytest.mark.parametrize("raw, want", CLEAN_CASES)
def test_clean_explanation(spark, raw, want):
    assert one(spark, tx.clean_explanation(F.lit(raw).cast("string"))) == want


def test_tags(spark):
    t = "x <e> a\nb </e> <e>c</e>"
    assert one(spark, tx.extract_tag(F.lit(t), "e")) == "a\nb"
    assert one(spark, tx.extract_tag(F.lit("</e> <e>c</e>"), "e")) == "c"
    assert one(spark, tx.extract_tag(F.lit("<e></e>"), "e")) == ""
    assert one(spark, tx.extract_tag(F.lit(" none "), "e")) is None
    assert one(spark, tx.extract_tag(F.lit(" none "), "e", on_miss="raw")) == "none"
    assert one(spark, tx.extract_tag(tx.wrap_tag(F.lit("body"), "e"), "e")) == "body"
    with pytest.raises(ValueError):
        tx.extract_tag(F.lit(""), "e", on_miss="what")


def test_templates(spark):
    assert one(spark, tx.render("a {t} b", "t", F.lit("{t}"))) == "a {t} b"
    assert one(spark, tx.unwrap(F.lit("a x b"), "a {t} b", "t")) == "x"
    assert one(spark, tx.unwrap(F.lit("a b"), "a {t} b", "t")) is None
    assert one(spark, tx.unwrap(F.lit("ax b"), "a {t} b", "t")) is None
    with pytest.raises(ValueError):
        tx.split_template("no place", "t")
    prompt = tx.user_prompt(F.lit("see <v> and <v>"))
    assert one(spark, tx.substitute_marker(prompt, "<v>", "@"))[0]["content"] == "see @ and @"
    assert one(spark, tx.substitute_marker(prompt, "<w>", "@")) is None


def test_masks_and_markers(spark):
    ids = F.array(*[F.lit(x) for x in (1, 2, 3, 1, 2, 3)])
    assert one(spark, tl.marker_sites(ids, 2, 1, 3)) == [1, 4]
    assert one(spark, tl.marker_sites(ids, 1, 2, 3)) == []
    assert one(spark, tl.marker_neighbors(ids, 2)) is None
    assert one(spark, tl.marker_neighbors(F.array(*[F.lit(x) for x in (5, 7, 6)]), 7)).asDict() == {"site": 1, "left": 5, "right": 6}
    assert one(spark, tl.marker_neighbors(F.array(*[F.lit(x) for x in (7, 5, 6)]), 7)) is None
    mask = lambda *m: F.array(*[F.lit(x) for x in m])
    assert one(spark, tl.last_set(mask(1, 0, 1, 0))) == 2 and one(spark, tl.last_set(mask(0, 0))) is None
    assert one(spark, tl.ends_with_tokens(F.array(F.lit("a")), ["x", "a"])) is False
    assert tl.stable_suffix(["a", "b", "c"]) == ["b", "c"]
    with pytest.raises(ValueError):
        tl.stable_suffix(["a"])


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "d e"), (1, 1, "user", "a b c"), (2, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["tokens"], r["mask"], r["response_length"]) for r in tl.conversation_mask(rows).collect()}
    assert got == {1: (["a", "b", "c", "d", "e"], [1, 1], 2), 2: (["x"], [], 0)}


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vec.normalize(v(0, 0), 3.0)) == [0.0, 0.0]
    assert one(spark, vec.normalize(v(3, 4), 10.0)) == pytest.approx([6, 8])
    s = math.sqrt(2)
    assert one(spark, vec.pair_mse(v(1, 0), v(-1, 0), s)) == pytest.approx(4)
    assert one(spark, vec.pair_mse(v(1, 0), v(0, 5), s)) == pytest.approx(2)
    assert one(spark, vec.pair_mse(v(0, 0), v(0, 5), s)) == pytest.approx(1)
    assert one(spark, vec.pair_mse(v(1, 2), v(1, 4))) == pytest.approx(2)
    assert one(spark, vec.pair_mse(v(1), v(1, 4))) is None
    assert one(spark, vec.reward(F.lit(0.0), F.lit("COMPLETED"), True)) == pytest.approx(-math.log(1e-8))
    assert one(spark, vec.reward(F.lit(None).cast("double"), F.lit("COMPLETED"))) == -2.0
    assert [vec.resolve_scale(x, 16) for x in (None, "raw", "sqrt_d_model", "3")] == [None, None, 4.0, 3.0] and vec.resolve_scale(None, 16, "sqrt") == 4.0
    m = one(spark, vec.mismatch(v(0, -1), v(0, -1), F.array(F.lit(0), F.lit(0))))
    assert m["n"] == 0 and m["k3"] is None
    assert one(spark, vec.mismatch(v(0), v(0, -1), F.array(F.lit(1)))) is None


def test_width_gate(spark):
    with pytest.raises(ValueError, match="1 to 2 wide"):
        vec.assert_width(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v", 2)


def test_null_keys_keep_their_place(spark):
    rows = spark.createDataFrame([(None, 5), (5, None), (None, None)], "a long, b long")
    assert rows.select(hash_key(1, F.col("a"), F.col("b"))).distinct().count() == 3


def test_sampling_is_stable(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    whole = {tuple(r) for r in sampling.base_rows(docs).select("doc_id", "n_raw_tokens").collect()}
    parts = sampling.base_rows(docs.filter("doc_id < 90")).unionByName(sampling.base_rows(docs.filter("doc_id >= 90").repartition(7)))
    assert {tuple(r) for r in parts.select("doc_id", "n_raw_tokens").collect()} == whole


def test_ranks(spark):
    df = spark.range(1000).repartition(9)
    assert sorted(r["rank"] for r in ranks.hash_rank(df, 1, ["id"]).collect()) == list(range(1, 1001))
    got = ranks.ordinal_rank(df, "id", width=37).collect()
    assert all(r["rank"] == r["id"] + 1 for r in got)
    total = ranks.running_total(df, "id", "id", "t", width=37).collect()
    assert all(r["t"] == r["id"] * (r["id"] + 1) // 2 for r in total)
    with pytest.raises(ValueError):
        ranks.truncate_balanced(df.withColumn("p", F.col("id") % 3), "p", 500, "id")


def test_shuffled_vectors_are_the_same(spark):
    df = spark.range(50).select("id", F.array(F.col("id").cast("float")).alias("v"), (F.col("id") * 2).alias("k"))
    got = ranks.shuffle_vectors(df, 3, "x", ["id"], "v").collect()
    assert sorted(r["v"][0] for r in got) == list(range(50)) and all(r["k"] == 2 * r["id"] and r["v"][0] == r["from_id"] for r in got)
    assert any(r["id"] != r["from_id"] for r in got)


def test_picks(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "k long, s double")
    got = {r["k"]: r["pick"] for r in sampling.pick_top_mid_bottom(df, "s", "k", 2, 2, 0).collect()}
    assert got == {8: "top", 7: "top", 5: "mid", 4: "mid"}


def test_caches(spark):
    rows = lambda *r: spark.createDataFrame(list(r), f"{joins.TEXT} string, {joins.EXPLANATION} string, at long")
    first, second = rows(("a", "1", 1), ("a", "2", 2), ("b", "3", 1), ("n", None, 1)), rows(("b", "0", 1))
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("n",)], f"{joins.TEXT} string")
    got = {r[0]: r[1] for r in joins.cache_join(df, [first, second], "at").collect()}
    assert got == {"a": "2", "b": "0", "c": None, "n": None}
    assert {r[0] for r in joins.cache_misses(df, [first, second]).collect()} == {"c", "n"}
    assert joins.cache_misses(df.filter(f"{joins.TEXT} in ('a', 'b')"), [first]).count() == 0
    with pytest.raises(ValueError):
        joins.union_caches([])


def test_reuse_gate(spark):
    raw = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(1).alias("n_raw_tokens"))
    known = raw.withColumn(joins.EXPLANATION, F.lit("e"))
    assert joins.reuse_join(raw, known.filter("doc_id > 0")).count() == 19
    for bad in (known.filter("doc_id > 1"), known.limit(0)):
        with pytest.raises(ValueError, match="match the earlier run"):
            joins.reuse_join(raw, bad)
    with pytest.raises(ValueError):
        joins.reuse_join(raw.limit(0), known)


def test_other_gates(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    with pytest.raises(ValueError, match="has_text: 1 rows, such as 2"):
        gates.gate_rows(df, {"has_text": F.col("t").isNotNull()}, "id")
    assert gates.gate_rows(df, {"id": F.col("id") > 0}, "id") is df
    v = spark.createDataFrame([([1.0, 2.0],)], "activation_vector array<double>")
    meta = {"stage": "rl", "d_model": 2, "row_count": 1, "norm": "none"}
    assert gates.gate_table(v, meta, "rl", []) is v
    for wrong, word in (({"stage": "base"}, "stage"), ({"d_model": 3}, "wide"), ({"row_count": 2}, "rows"), ({"norm": "l2"}, "scaled")):
        with pytest.raises(ValueError, match=word):
            gates.gate_table(v, meta | wrong, "rl", [])
    with pytest.raises(ValueError, match="missing"):
        gates.gate_table(v, meta, "rl", ["prompt"])
    assert one(spark, gates.finite(F.array(F.lit(1.0), F.lit(float("nan"))))) is False
    with pytest.raises(ValueError):
        joins.recover_cache(spark.createDataFrame([("t", "no tag")], f"{joins.TEXT} string, response string"), None, "")
    with pytest.raises(ValueError):
        joins.zip_join(spark.range(2), spark.range(3), "id", "id")
    with pytest.raises(ValueError):
        splits.document_buckets(df.withColumnRenamed("id", "doc_id"), (0.5, 0.6, 0.1), 1)


def test_shards(spark):
    parts = [spark.range(0, 5), spark.range(5, 9)]
    meta = lambda *rows: spark.createDataFrame([(*r, "m", 1, 2, "none", "c", 3) for r in rows], "start long, length long, row_count long, base_model string, layer_index int, d_model int, norm string, corpus string, positions_per_doc int")
    good = meta((5, 4, 4), (0, 5, 5))
    assert splits.merge_shards(parts, good).count() == 9
    for bad, word in ((meta((6, 3, 4), (0, 5, 5)), "start"), (meta((4, 5, 4), (0, 5, 5)), "start"), (meta((5, 4, 5), (0, 5, 5)), "records say"), (good.withColumn("layer_index", F.col("start").cast("int")), "layer_index")):
        with pytest.raises(ValueError, match=word):
            splits.merge_shards(parts, bad)


def test_registry(spark, tmp_path):
    base = {"dataset_id": "base_m_L1_x", "stage": "base", "row_count": 3, "parent_datasets": [], "created_at": "1", "nonsense": 1}
    child = {"dataset_id": "rl_m", "stage": "rl", "row_count": 3, "parent_datasets": ["base_m_L1_x"], "prompt_templates": {"actor": "a"}, "created_at": "2", "tokens": ("@", 5, 1, 2, [3, 4])}
    registry.register(registry.metadata(spark, [base, child]), f"file://{tmp_path}/r")
    assert registry.load_meta(spark, f"file://{tmp_path}/r", "rl_m")["tokens"]["critic_suffix_ids"] == [3, 4]
    with pytest.raises(KeyError):
        registry.load_meta(spark, f"file://{tmp_path}/r", "other")
    for wrong in ({"kind": "x"}, {"tokens": None}, {"prompt_templates": {}}, {"stage": "ar_sft"}):
        with pytest.raises(ValueError):
            registry.validate_meta(registry.metadata(spark, [child | wrong]).first())
    assert registry.resolve_meta(None, "m", "d") == "m"
    assert [tuple(r) for r in registry.lineage(registry.metadata(spark, [base, child]), "rl_m").collect()] == [("rl_m", "base_m_L1_x", 1)]


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).withColumn("text", F.lit("x")).write.parquet(path)
    assert tables.corpus_scan(spark, path, "c", "s", 90, 10, "text", "id").count() == 10
    with pytest.raises(ValueError, match="the corpus at 99"):
        tables.corpus_scan(spark, path, "c", "s", 95, 10, "text", "id")
    out = f"file://{tmp_path}/append"
    assert chunks.resume_append(spark.range(50), out, "id", 10) == 50
    assert chunks.resume_append(spark.range(75), out, "id", 10) == 25
    assert chunks.resume_append(spark.range(75), out, "id", 10) == 0
    assert sorted(r["id"] for r in chunks.finished(spark, out).collect()) == list(range(75))


def test_baselines(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6)) + 0.5
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>")
    for scale in (math.sqrt(6), 2.0):
        n = x / np.linalg.norm(x, axis=1)[:, None] * scale
        mu = n.mean(axis=0)
        got = metrics.mean_baselines(df, "v", scale).first()
        assert got["raw_variance"] == pytest.approx(((n - mu) ** 2).mean())
        assert got["mean_norm"] == pytest.approx(((n - mu / np.linalg.norm(mu) * scale) ** 2).mean())
    row = metrics.parity(df.limit(0).withColumn("k", F.lit(1)).withColumn("x", F.lit(1.0)), df.withColumn("k", F.lit(1)).withColumn("x", F.lit(1.0)), "k", "x", 0.1, 4).first()
    assert row["n"] == 0 and row["ok"] is False


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(Exception, match="results for"):
        plugins.apply_extractor(df, lambda texts: [], 2).collect()
    with pytest.raises(Exception, match="broken"):
        plugins.apply_provider(df.withColumnRenamed("text", "prompt"), lambda p: (_ for _ in ()).throw(RuntimeError("broken"))).collect()
    got = plugins.apply_provider(df.withColumnRenamed("text", "prompt"), lambda p: [None if x == "a" else x * 2 for x in p], chunk=1).collect()
    assert {r["doc_id"]: r["completion"] for r in got} == {1: None, 2: "bb"}


def test_stream_needs_state(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in")
    with pytest.raises(ValueError, match="no saved state"):
        scoring.resume_stream(spark, stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")


def test_config():
    cfg = job.resolve_config({"preset": "probe", "layer": 7, "extra": {"a": 1}}, {"seed": 1, "extra.b": 2})
    assert (cfg["layer"], cfg["positions_per_doc"], cfg["seed"], cfg["extra"]) == (7, 3, 1, {"a": 1, "b": 2})
    with pytest.raises(ValueError):
        job.run_pipeline(None, {"output": "x"}, None, None, stages=["nothing"])


def test_nothing_imports_the_optional_part():
    from pathlib import Path

    root = Path(job.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lexvane.llm" in p.read_text()]
