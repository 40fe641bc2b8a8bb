"""All queries of the library's own operators, with the same in SQL for an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.functions import text as tx
from lexvane.functions import token_lists as tl
from lexvane.functions import vectors as vec

from lexvane.operators import gates, joins, metrics, permutation, ranks, sampling, splits
from lexvane.plans import recipes as r
from lexvane.plans import stateful
from lexvane.sources import registry, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EXPLANATION, TEXT, VECTOR = joins.EXPLANATION, joins.TEXT, splits.VECTOR
NL = "chr(10)"
#: vectors.digest() of a list v.
DIGEST = "cast(list_sum([cast(floor(cast(v[i] as double) * 1048576) as bigint) * i for i in range(1, len(v) + 1)]) as bigint)"


def query(sql: str | None = None):
    """Register a query under its function's name; sql is what an oracle runs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# scans and samples


@query("with m as (select max(doc_id) + 1 as n from documents) select 'docs:train:' || doc_id as doc_id, doc_id as ordinal, length(text) as n from documents, m where doc_id >= n // 10 and doc_id < n // 10 + n // 2")
def q_corpus_slice(spark, sf_dir):
    n = r.table(spark, sf_dir, "documents").agg(F.max("doc_id") + 1).first()[0]
    rows = tables.corpus_scan(spark, f"{sf_dir}/documents.parquet", "docs", "train", n // 10, n // 2, "text", "doc_id")
    return rows.select("doc_id", "ordinal", F.length("text").cast("long").alias("n"))


@query(f"with {r.BASE} select doc_id, n_raw_tokens, length(prefix) as n_chars, sha256(prefix) as prefix_key from base")
def q_sample_positions(spark, sf_dir):
    rows = r.base(spark, sf_dir)
    return rows.select("doc_id", "n_raw_tokens", F.length(TEXT).cast("long").alias("n_chars"), tx.text_key(F.col(TEXT)).alias("prefix_key"))


@query(f"""with {r.BASE.split("sized as")[0]}el as (select doc_id, tok, list_filter(range(50, len(tok)), lambda i: not list_contains(['the', 'la'], tok[i + 1])) as pl from tok),
sized as (select doc_id, tok, pl, cast(len(pl) as bigint) as n, cast(least(len(pl), 10) as bigint) as k from el where len(pl) > 0),
{"drawn as" + r.BASE.split("drawn as")[1].split("base as")[0].replace("select doc_id, tok,", "select doc_id, tok, pl,", 1)}placed as (select doc_id, tok, pl[p + 1] as p from drawn, unnest(places) as u(p))
select doc_id, cast(p + 1 as bigint) as n_raw_tokens, sha256(array_to_string(list_filter(tok[1:p + 1], lambda x: x not in ('the', 'la')), ' ')) as prefix_key from placed""")
def q_special_positions(spark, sf_dir):
    """Positions and prefix texts without special tokens (two frequent words stand in for them)."""
    rows = sampling.base_rows(r.table(spark, sf_dir, "documents"), special=["the", "la"])
    return rows.select("doc_id", "n_raw_tokens", tx.text_key(F.col(TEXT)).alias("prefix_key"))


@query("with t as (select greatest(len(string_split(text, ' ')) - 50, 0) as n from documents) select count(*) as docs, count(*) filter (n = 0) as skipped, count(*) filter (n > 0 and n < 10) as short, cast(sum(least(n, 10)) as bigint) as rows from t")
def q_short_docs(spark, sf_dir):
    return sampling.short_documents(r.table(spark, sf_dir, "documents"), tx.tokens(F.col("text")))


BUCKETS = f"""{r.BASE},
docs as (select distinct doc_id from base),
placed as (select doc_id, row_number() over (order by sha256('42|' || doc_id), doc_id) as rank, count(*) over () as n from docs),
buckets as (select doc_id, case when rank <= cast(floor(n * 0.25) as bigint) then 'av' when rank <= cast(floor(n * 0.25) as bigint) * 2 then 'ar' else 'rl' end as bucket from placed)"""


@query(f"with {BUCKETS} select bucket, count(distinct b.doc_id) as docs, count(*) as rows from base b join buckets k on b.doc_id = k.doc_id group by bucket")
def q_split_docs(spark, sf_dir):
    split = splits.split_docs(r.keys(spark, sf_dir), (0.25, 0.25, 0.5), 42, documents=r.long_documents(spark, sf_dir))
    return metrics.stage_counters(split, "bucket")


@query(f"with {BUCKETS} select count(*) filter (k > 1) as docs_in_two, count(*) filter (k is null) as docs_missing from docs d left join (select doc_id, count(distinct bucket) as k from buckets group by 1) x on d.doc_id = x.doc_id")
def q_split_leak(spark, sf_dir):
    docs = r.long_documents(spark, sf_dir)
    return splits.check_split(splits.split_docs(r.keys(spark, sf_dir), (0.25, 0.25, 0.5), 42, documents=docs), docs)


# text


@query("select doc_id, sha256('Text: <<' || text || '>> {text}') as prompt_key, length(text) + 17 as n from documents")
def q_render_prompts(spark, sf_dir):
    rendered = tx.render("Text: <<{text}>> {text}", "text", F.col("text"))
    return r.table(spark, sf_dir, "documents").select("doc_id", tx.text_key(rendered).alias("prompt_key"), F.length(rendered).cast("long").alias("n"))


def _cleaned(spark, sf_dir):
    # one row in, one row out: else filters on the explanation would move below and clean each text again
    return r.completions(spark, sf_dir).select("doc_id", "raw", F.explode(F.array(tx.clean_explanation(F.col("raw")))).alias("explanation"))


@query(f"with {r.COMPLETIONS}, {r.CLEAN} select doc_id, explanation from cleaned where explanation is not null and len(string_split(explanation, {NL} || {NL})) >= 2")
def q_clean_explanations(spark, sf_dir):
    kept = gates.drop_failed(_cleaned(spark, sf_dir), "explanation")
    return kept.filter(tx.min_features(F.col("explanation"))).select("doc_id", "explanation")


@query(f"with {r.COMPLETIONS}, {r.CLEAN} select case when raw is null then 'no completion' when explanation is null then 'no tag' when len(string_split(explanation, {NL} || {NL})) < 2 then 'few features' else 'kept' end as reason, count(*) as rows from cleaned group by 1")
def q_drop_counts(spark, sf_dir):
    e = F.col("explanation")
    reason = F.when(F.col("raw").isNull(), "no completion").when(e.isNull(), "no tag").when(~tx.min_features(e), "few features")
    return gates.failure_counts(_cleaned(spark, sf_dir), reason)


TITLE = "regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g')"


@query(f"select page_id, case when regexp_matches(html, '(?s)<title>.*?</title>') then {TITLE} end as title from pages")
def q_extract_tag_strict(spark, sf_dir):
    return r.table(spark, sf_dir, "pages").select("page_id", tx.extract_tag(F.col("html"), "title").alias("title"))


@query("select page_id, sha256(regexp_replace(case when regexp_matches(html, '(?s)<summary>.*?</summary>') then regexp_extract(html, '(?s)<summary>(.*?)</summary>', 1) else html end, '^\\s+|\\s+$', '', 'g')) as body_key from pages")
def q_extract_tag_lenient(spark, sf_dir):
    return r.table(spark, sf_dir, "pages").select("page_id", tx.text_key(tx.extract_tag(F.col("html"), "summary", on_miss="raw")).alias("body_key"))


@query("select doc_id, sha256(text) as key, sha256(array_to_string(string_split(text, ' ')[1:20], ' ')) as head_key, least(len(string_split(text, ' ')), 20) as n from documents")
def q_text_keys(spark, sf_dir):
    head = tx.truncate_tokens(tx.tokens(F.col("text")), 20)
    return r.table(spark, sf_dir, "documents").select("doc_id", tx.text_key(F.col("text")).alias("key"), tx.text_key(F.array_join(head, " ")).alias("head_key"), F.size(head).cast("long").alias("n"))


@query("select doc_id, case when length(text) > 100 then left(text, 100) || '... [' || (length(text) - 100) || ' more chars]' else text end as shown, case when source like '%1%' then 'one' when source like '%src2%' then 'two' else 'other' end as label from documents")
def q_display_text(spark, sf_dir):
    rows = r.table(spark, sf_dir, "documents")
    return rows.select("doc_id", tx.display_text(F.col("text"), 100).alias("shown"), tx.source_label(F.col("source"), [("1", "one"), ("src2", "two")]).alias("label"))


# caches and joins


@query(f"with {r.PRIOR} select b.doc_id, b.n_raw_tokens, c.e as api_explanation from base b left join cache c on sha256(b.prefix) = c.k")
def q_cache_join(spark, sf_dir):
    rows = r.base(spark, sf_dir)
    return joins.cache_join(rows, r.caches(rows)).select("doc_id", "n_raw_tokens", EXPLANATION)


@query(f"with {r.PRIOR} select b.doc_id, b.n_raw_tokens from base b where sha256(b.prefix) not in (select k from cache)")
def q_cache_misses(spark, sf_dir):
    rows = r.base(spark, sf_dir)
    return joins.cache_misses(rows, r.caches(rows)).select("doc_id", "n_raw_tokens")


@query(f"with {r.PRIOR} select count(*) as rows, count(distinct k) as unique_texts, count(*) - count(distinct k) as duplicate_rows from cache_rows")
def q_cache_stats(spark, sf_dir):
    one, two = r.caches(r.base(spark, sf_dir))
    return joins.cache_stats(one.unionByName(two))


@query(f"with {r.PRIOR}, nv as (select count(*) as nv from embeddings), e as (select vec_id, embedding as v from embeddings) select doc_id, n_raw_tokens, api_explanation, sha256(prefix) as text_key, {DIGEST} as vector_digest from prior, nv, e where (doc_id * 7 + n_raw_tokens) % 200 <> 0 and e.vec_id = (doc_id * 31 + n_raw_tokens) % nv")
def q_reuse_join(spark, sf_dir):
    known = r.prior_ar(r.keys(spark, sf_dir)).filter((F.col("doc_id") * 7 + F.col("n_raw_tokens")) % 200 != 0)
    joined = joins.reuse_join(r.keys(spark, sf_dir), known, template=r.CRITIC)  # keys meet first, then vectors, then texts: none is moved twice
    joined = r.texts(r.with_vectors(joined, spark, sf_dir), spark, sf_dir)
    return joined.select("doc_id", "n_raw_tokens", EXPLANATION, tx.text_key(F.col(TEXT)).alias("text_key"), vec.digest(F.col(VECTOR)).alias("vector_digest"))


@query(f"with {r.PRIOR} select sha256(prefix) as k, api_explanation from prior")
def q_recover_cache(spark, sf_dir):
    rows = r.base(spark, sf_dir)
    found = joins.recover_cache(r.prior_av(rows).filter("doc_id % 2 = 0"), r.prior_ar(rows).filter("doc_id % 2 = 1"), r.CRITIC)
    return found.select(tx.text_key(F.col(TEXT)).alias("k"), EXPLANATION)


@query(f"""with {r.PRIOR}, a as (select doc_id, n_raw_tokens, sha256(prefix) as t from base where doc_id % 10 <> 0), b as (select doc_id, n_raw_tokens, case when doc_id % 7 = 0 then 'x' else sha256(prefix) end as t from base where doc_id % 10 <> 1),
j as (select a.t as ta, b.t as tb, a.doc_id as ia, b.doc_id as ib from a full join b on a.doc_id = b.doc_id and a.n_raw_tokens = b.n_raw_tokens)
select count(*) filter (ia is not null and ib is not null) as shared, count(*) filter (ib is null) as only_a, count(*) filter (ia is null) as only_b, count(*) filter (ia is not null and ib is not null and ta is distinct from tb) as text_mismatches,
round(100.0 * count(*) filter (ia is not null and ib is not null) / count(ia), 4) as overlap_pct from j""")
def q_audit_runs(spark, sf_dir):
    rows = r.base(spark, sf_dir).select("doc_id", "n_raw_tokens", TEXT)
    b = rows.filter("doc_id % 10 <> 1").withColumn(TEXT, F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col(TEXT)))
    return audit_runs(rows.filter("doc_id % 10 <> 0"), b)


def audit_runs(a, b):
    """Two runs compared by document and position; whole texts count, by their digests."""
    keyed = lambda run: run.select("doc_id", "n_raw_tokens", tx.text_key(F.col(TEXT)).alias("t"))
    return joins.audit(keyed(a), keyed(b), ["doc_id", "n_raw_tokens"], "t").withColumn("overlap_pct", F.col("overlap_pct").cast("double"))


@query(f"with {r.PRIOR} select p.doc_id, p.n_raw_tokens, c.e as cached, p.api_explanation as reused from prior p left join cache c on sha256(p.prefix) = c.k where (p.doc_id * 7 + p.n_raw_tokens) % 200 <> 0")
def q_stored_joins(spark, sf_dir):
    """A cache and an earlier run, stored by their keys, joined without moving them."""
    return stateful.stored_joins(spark, sf_dir)


SITES = """tk as (select doc_id, string_split(text, ' ') as ids from documents),
sites as (select doc_id, i - 1 as site, ids[i - 1] as l, ids[i + 1] as r from tk, unnest(range(2, len(ids))) as u(i) where ids[i] in ('the', 'la'))"""


@query(f"with {SITES}, s as (select doc_id, site from sites where l = 'of' and r = 'that'), z as (select doc_id, site, row_number() over (order by doc_id, site) - 1 as rank from s) select z.doc_id, z.site, e.vec_id from z join (select vec_id, row_number() over (order by vec_id) - 1 as rank, count(*) over () as m from embeddings) e on z.rank % e.m = e.rank")
def q_zip_join(spark, sf_dir):
    ids = F.col("ids")
    docs = r.table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("ids"))
    sites = docs.select("doc_id", F.explode(tl.marker_sites(ids, F.lit("the"), F.lit("of"), F.lit("that"))).alias("s")).select("doc_id", F.col("s").cast("long").alias("site"))
    vectors = r.table(spark, sf_dir, "embeddings").select("vec_id")
    n, m = sites.count(), vectors.count()
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0) // max(m, 1))))  # the vectors in their order, again and again, one a site
    dealt = ranks.ordinal_rank(vectors, "vec_id").select("vec_id", "rank", rounds.alias("round")).select("vec_id", (F.col("round").cast("long") * m + F.col("rank")).alias("turn"))
    return joins.zip_join(sites, dealt.filter(F.col("turn") <= n), ["doc_id", "site"], "turn").select("doc_id", "site", "vec_id")


@query(f"with {r.ROLLOUTS}, a as (select step, avg(reward) as m from rollouts where event_id % 2 = 0 group by 1), b as (select step, avg(reward) as m from rollouts where event_id % 2 = 1 group by 1) select a.step, round(a.m, 6) as real, round(b.m, 6) as shuffled, round(round(b.m, 6) - round(a.m, 6), 6) as gap from a join b on a.step = b.step")
def q_baseline_gap(spark, sf_dir):
    rows = r.rollouts(spark, sf_dir)
    mean = lambda k: rows.filter(F.col("event_id") % 2 == k).groupBy("step").agg(F.round(F.avg("reward"), 6).alias("m"))
    return joins.baseline_gap(mean(0), mean(1), "step", "m")


# training tables


PROMPT = "'user' as role, 'Describe the vector <v>.' as content"
WITH_VECTOR = "nv as (select count(*) as nv from embeddings), e as (select vec_id, embedding as v from embeddings)"
MOVED = "prior, nv, e where e.vec_id = (doc_id * 31 + n_raw_tokens) % nv"


def _stage(spark, sf_dir, stage, debug=False):
    rows = r.with_vectors(r.prior(r.keys(spark, sf_dir)), spark, sf_dir)
    carried = rows.withColumn("activation_layer", F.lit(20).cast("long") + F.col("vec_id") * 0)
    if debug:  # behind the join with vectors, so that texts don't move with each position
        carried = r.texts(carried, spark, sf_dir)
    return splits.build_stage(carried, stage, r.ACTOR, r.CRITIC, keep_debug=debug)


def _flat(rows):
    turn = F.get("prompt", F.lit(0))
    return rows.select("doc_id", "n_raw_tokens", turn["role"].alias("role"), turn["content"].alias("content"), F.size(VECTOR).cast("long").alias("width"), vec.digest(F.col(VECTOR)).alias("vector_digest"), *[c for c in ("response",) if c in rows.columns])


@query(f"with {r.PRIOR}, {WITH_VECTOR} select doc_id, n_raw_tokens, {PROMPT}, cast(len(v) as bigint) as width, {DIGEST} as vector_digest, '<explanation>' || {NL} || api_explanation || {NL} || '</explanation>' as response from {MOVED}")
def q_build_av(spark, sf_dir):
    return _flat(_stage(spark, sf_dir, "av_sft"))


@query(f"with {r.PRIOR} select doc_id, n_raw_tokens, 'Read: ' || api_explanation || {NL} || 'Guess:' as prompt, sha256(prefix) as debug_key from prior")
def q_build_ar(spark, sf_dir):
    return _stage(spark, sf_dir, "ar_sft", debug=True).select("doc_id", "n_raw_tokens", "prompt", tx.text_key(F.col(TEXT)).alias("debug_key"))


@query(f"with {r.PRIOR}, {WITH_VECTOR} select doc_id, n_raw_tokens, {PROMPT}, cast(len(v) as bigint) as width, {DIGEST} as vector_digest from {MOVED}")
def q_build_rl(spark, sf_dir):
    return _flat(_stage(spark, sf_dir, "rl"))


@query("select vec_id, row_number() over (order by sha256('42|emb|' || vec_id), vec_id) as shuffle_rank from embeddings")
def q_shuffle_rows(spark, sf_dir):
    return ranks.shuffle_rows(r.table(spark, sf_dir, "embeddings").select("vec_id"), 42, "emb", ["vec_id"])


@query(f"""with a as (select vec_id, row_number() over (order by sha256('42|emb|anchor|' || vec_id), vec_id) as rank from embeddings), b as (select vec_id, embedding as v, row_number() over (order by sha256('42|emb|vector|' || vec_id), vec_id) as rank from embeddings)
select a.vec_id, {DIGEST} as moved_digest, b.vec_id as from_vec_id from a join b on a.rank = b.rank""")
def q_shuffle_vectors(spark, sf_dir):
    rows = ranks.shuffle_vectors(r.table(spark, sf_dir, "embeddings"), 42, "emb", ["vec_id"], "embedding")
    return rows.select("vec_id", vec.digest(F.col("embedding")).alias("moved_digest"), "from_vec_id")


# registry


@query(f"with {r.METAS} select min(start) as start, cast(sum(length) as bigint) as length, (select count(*) from documents) as rows from metas")
def q_merge_shards(spark, sf_dir):
    metas, docs = r.shard_metas(spark, sf_dir), r.table(spark, sf_dir, "documents").select("doc_id")
    cuts = [(m["start"], m["length"]) for m in splits.order_shards(metas).collect()]  # four records
    merged = splits.merge_shards([docs.filter((F.col("doc_id") >= s) & (F.col("doc_id") < s + k)) for s, k in cuts], metas)
    return merged.agg(F.count("*").alias("rows")).join(metas.agg(F.min("start").alias("start"), F.sum("length").alias("length")))


@query(f"with {r.METAS} select start, length, lag(start + length) over (order by start) as expected_start, coalesce(lag(start + length) over (order by start) = start, true) as contiguous from metas")
def q_contiguity(spark, sf_dir):
    return gates.check_contiguous(r.shard_metas(spark, sf_dir)).select("start", "length", "expected_start", "contiguous")


IDS = f"""{r.METAS}, ids as (select start, 'base_base-1_L20_' || substr(sha256('lab/base-1|20|documents|' || start || '|' || length), 1, 8) as id from metas)"""


@query(f"with {IDS} select start, id as dataset_id, id || '__av_raw' as split_id, id || '__explained' as explained_id, 'av_sft_' || regexp_replace(id, '^base_', '') as stage_id, id || '__shuf7' as shuffled_id, id || '__shuf_activations7' as null_id from ids")
def q_dataset_ids(spark, sf_dir):
    metas = r.shard_metas(spark, sf_dir).withColumn("id", registry.dataset_id(F.col("base_model"), F.col("layer_index"), F.col("corpus"), F.col("start"), F.col("length")))
    i = F.col("id")
    return metas.select("start", i.alias("dataset_id"), registry.child_id(i, "split", "av").alias("split_id"), registry.child_id(i, "explain").alias("explained_id"), registry.child_id(i, "build", "av_sft").alias("stage_id"), registry.child_id(i, "shuffle", 7).alias("shuffled_id"), registry.child_id(i, "shuffle_vectors", 7).alias("null_id"))


@query(f"""with recursive {IDS}, edges as (select 'merged' as child, id as parent from ids union all select 'raw_' || b, 'merged' from (values ('av'), ('ar'), ('rl')) v(b) union all select 'explained_' || b, 'raw_' || b from (values ('av'), ('ar')) v(b) union all select 'final_' || b, 'explained_' || b from (values ('av'), ('ar')) v(b) union all select 'final_rl', 'raw_rl'),
up as (select child as dataset_id, parent as ancestor, 1 as depth from edges union all select up.dataset_id, e.parent, up.depth + 1 from up join edges e on up.ancestor = e.child)
select dataset_id, ancestor, cast(min(depth) as integer) as depth from up group by 1, 2""")
def q_lineage(spark, sf_dir):
    metas = r.shard_metas(spark, sf_dir)
    shard_ids = metas.agg(F.collect_list(registry.dataset_id(F.col("base_model"), F.col("layer_index"), F.col("corpus"), F.col("start"), F.col("length"))).alias("parent_datasets"))
    edges = shard_ids.select(F.lit("merged").alias("dataset_id"), "parent_datasets")
    steps = {"raw_av": "merged", "raw_ar": "merged", "raw_rl": "merged", "explained_av": "raw_av", "explained_ar": "raw_ar", "final_av": "explained_av", "final_ar": "explained_ar", "final_rl": "raw_rl"}
    for child, parent in steps.items():
        edges = edges.unionByName(shard_ids.select(F.lit(child).alias("dataset_id"), F.array(F.lit(parent)).alias("parent_datasets")))
    return registry.lineage(edges)


@query(f"with {IDS} select 'base_base-1_L20_' || substr(sha256('lab/base-1|20|documents|' || min(m.start) || '|' || cast(sum(m.length) as bigint)), 1, 8) as dataset_id, min(m.start) as start, cast(sum(m.length) as bigint) as length, cast(sum(m.length) as bigint) as row_count, 'lab/base-1' as base_model, cast(20 as integer) as layer_index, cast(64 as integer) as d_model, 'none' as norm, 'documents' as corpus, cast(10 as integer) as positions_per_doc, string_agg(ids.id, ' ' order by m.start) as parents from metas m join ids on m.start = ids.start")
def q_merged_record(spark, sf_dir):
    return splits.merged_record(r.shard_metas(spark, sf_dir)).withColumn("parents", F.array_join("parent_datasets", " ")).drop("parent_datasets")


@query(f"with {IDS} select id as dataset_id, m.length as row_count, m.start from metas m join ids on m.start = ids.start")
def q_registry(spark, sf_dir):
    """A record for each shard is written, and read again by its id."""
    return stateful.registry_roundtrip(spark, sf_dir)


@query("select label, count(*) as rows, true as refused from embeddings group by 1")
def q_table_gate(spark, sf_dir):
    """The table passes by its registered record, and is refused by one that tells another count."""
    return stateful.table_gate(spark, sf_dir)


@query(f"with {r.ROLLOUTS} select event_id, case when status = 'COMPLETED' and response_length % 3 <> 0 then reward else -2.0 end as reward from rollouts")
def q_scatter_back(spark, sf_dir):
    rows = r.rollouts(spark, sf_dir)
    scored = rows.filter((F.col("status") == "COMPLETED") & (F.col("response_length") % 3 != 0)).select("event_id", "reward")
    return joins.scatter_back(rows.select("event_id"), scored, "event_id", "reward", -2.0)


# vectors and scores


@query(f"with {r.PAIRS} select vec_id, round(ng, 6) as norm, round(8 * gold[1] / ng, 6) as first_scaled, round(gp / (ng * np), 6) as cosine from norms")
def q_normalize(spark, sf_dir):
    p = r.pairs(spark, sf_dir)
    return p.select("vec_id", F.round(vec.l2(F.col("gold")), 6).alias("norm"), F.round(F.get(vec.normalize(F.col("gold"), 8.0), F.lit(0)), 6).alias("first_scaled"), F.round(vec.cosine(F.col("pred"), F.col("gold")), 6).alias("cosine"))


@query(f"with {r.PAIRS} select vec_id, round(mse, 6) as mse, round(list_sum([(pred[i] - gold[i]) * (pred[i] - gold[i]) for i in range(1, 65)]) / 64, 6) as raw_mse from scored")
def q_pair_mse(spark, sf_dir):
    p = r.pairs(spark, sf_dir)
    return p.select("vec_id", F.round(vec.pair_mse(F.col("pred"), F.col("gold"), 8.0), 6).alias("mse"), F.round(vec.pair_mse(F.col("pred"), F.col("gold")), 6).alias("raw_mse"))


@query(f"with {r.PAIRS} select vec_id, round(case when vec_id % 5 = 0 then -2.0 else -mse end, 6) as reward, round(case when vec_id % 5 = 0 then -ln(2.0) else -ln(greatest(mse, 1e-8)) end, 6) as log_reward from scored")
def q_reward(spark, sf_dir):
    p = r.pairs(spark, sf_dir).withColumn("mse", vec.pair_mse(F.col("pred"), F.col("gold"), 8.0))
    status = F.when(F.col("vec_id") % 5 == 0, "FAILED").otherwise("COMPLETED")
    return p.select("vec_id", F.round(vec.reward(F.col("mse"), status), 6).alias("reward"), F.round(vec.reward(F.col("mse"), status, True), 6).alias("log_reward"))


MEANS = f"""{r.PAIRS}, scaled as (select vec_id, vec_id // 64 as batch, i, 8 * gold[i] / ng as x, mse, np, ng from scored, unnest(range(1, 65)) as u(i)),
mu as (select i, avg(x) as m from scaled group by i), mn as (select sqrt(sum(m * m)) as norm from mu)"""


@query(f"with {MEANS} select round(avg((x - m) * (x - m)), 6) as raw_variance, round(avg((x - m * 8 / norm) * (x - m * 8 / norm)), 6) as mean_norm from scaled s join mu on s.i = mu.i, mn")
def q_mean_baselines(spark, sf_dir):
    out = metrics.mean_baselines(r.table(spark, sf_dir, "embeddings"), "embedding", 8.0)
    return out.select(F.round("raw_variance", 6).alias("raw_variance"), F.round("mean_norm", 6).alias("mean_norm"))


@query(f"with {MEANS}, v as (select avg((x - m) * (x - m)) as v from scaled s join mu on s.i = mu.i), e as (select avg(mse) as e from scored) select round(e, 6) as mse, round(v, 6) as raw_variance, round(1 - e / v, 6) as fve from v, e")
def q_fve(spark, sf_dir):
    out = metrics.fve(r.pairs(spark, sf_dir), "pred", "gold", 8.0)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mse", "raw_variance", "fve")])


@query(f"""with {MEANS}, bm as (select batch, i, avg(x) as m from scaled group by 1, 2), bv as (select s.batch, avg((x - m) * (x - m)) as v from scaled s join bm on s.i = bm.i and s.batch = bm.batch group by 1)
select s.batch, count(*) as n, round(sum(mse), 6) as loss_sum, round(avg(np), 6) as pred_norm, round(avg(ng), 6) as gold_norm, round(1 - avg(mse) / any_value(v), 6) as fve from scored s join bv on s.batch = bv.batch group by 1""")
def q_batch_metrics(spark, sf_dir):
    out = metrics.batch_metrics(r.pairs(spark, sf_dir), "batch", "pred", "gold", 8.0)
    return out.select("batch", "n", *[F.round(c, 6).alias(c) for c in ("loss_sum", "pred_norm", "gold_norm", "fve")])


LABEL_NORMS = f"{r.PAIRS}, ln as (select label, vec_id, np from norms)"


@query(f"with {LABEL_NORMS} select label, count(*) as n, round(avg(np), 6) as mean_norm, round(quantile_cont(np, 0.5), 6) as p50, round(quantile_cont(np, 0.99), 6) as p99, cast(ceil(avg(np)) as double) as scale from ln group by 1")
def q_norm_profile(spark, sf_dir):
    out = metrics.norm_profile(r.pairs(spark, sf_dir), "pred", "label")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean_norm", "p50", "p99")], F.col("scale").cast("double").alias("scale"))


@query(f"with {LABEL_NORMS}, m as (select label, quantile_cont(np, 0.5) as q from ln group by 1) select vec_id, ln.label, vec_id % 100 < 10 or np > 1.02 * q as noisy from ln join m on ln.label = m.label")
def q_noisy_flags(spark, sf_dir):
    rows = r.pairs(spark, sf_dir).select("vec_id", "label", (F.col("vec_id") % 100).alias("position"), vec.l2(F.col("pred")).alias("norm"))
    return gates.flag_noisy(rows, "position", "norm", "label", 10, 1.02).select("vec_id", "label", "noisy")


@query(f"with {r.PAIRS}, a as (select vec_id, mse as v from scored), b as (select vec_id, case when vec_id = 7 then mse * 1.05 else mse * 1.0005 end as v from scored) select count(*) as n, round(max(abs(a.v / b.v - 1)), 6) as max_gap, max(abs(a.v / b.v - 1)) <= 0.1 as ok from a join b on a.vec_id = b.vec_id")
def q_parity(spark, sf_dir):
    one = r.pairs(spark, sf_dir).select("vec_id", vec.pair_mse(F.col("pred"), F.col("gold"), 8.0).alias("v"))
    two = one.withColumn("v", F.col("v") * F.when(F.col("vec_id") == 7, 1.05).otherwise(1.0005))
    return metrics.parity(one, two, "vec_id", "v", 0.1, 4).withColumn("max_gap", F.round("max_gap", 6))


# rollouts


@query(f"with {r.ROLLOUTS} select final_status, scorable, count(*) as rows from (select case when status = 'COMPLETED' and response_length % 3 <> 0 and response_length <= 80 then 'COMPLETED' else 'FAILED' end as final_status, status = 'COMPLETED' and response_length % 3 <> 0 and response_length <= 80 as scorable from rollouts) group by 1, 2")
def q_scorable(spark, sf_dir):
    rows = r.rollouts(spark, sf_dir)
    explanation = F.when(F.col("response_length") % 3 != 0, F.lit("x"))
    return gates.scorable(rows, explanation, F.col("response_length"), 80).groupBy("final_status", "scorable").agg(F.count("*").alias("rows"))


@query(f"""with {r.ROLLOUTS} select step, count(*) as n, count(distinct group_index) as n_groups, round(count(*) / count(distinct group_index), 6) as group_size, round(avg(reward), 6) as mean, round(stddev_pop(reward), 6) as std, round(min(reward), 6) as min, round(max(reward), 6) as max,
round(quantile_cont(reward, 0.1), 6) as p10, round(quantile_cont(reward, 0.25), 6) as p25, round(quantile_cont(reward, 0.5), 6) as p50, round(quantile_cont(reward, 0.75), 6) as p75, round(quantile_cont(reward, 0.9), 6) as p90 from rollouts group by 1""")
def q_reward_report(spark, sf_dir):
    return metrics.reward_report(r.rollouts(spark, sf_dir), "step", "reward", "group_index")


@query(f"with {r.ROLLOUTS} select step, case when cast(doc_id as varchar) like '%7%' then 'seven' else 'other' end as source, count(*) as n from rollouts group by 1, 2")
def q_source_counts(spark, sf_dir):
    return metrics.source_counts(r.rollouts(spark, sf_dir), "step", F.col("doc_id").cast("string"), [("7", "seven")])


PICKED = f"""{r.ROLLOUTS}, o as (select *, row_number() over (partition by step order by reward desc, event_id) - 1 as rank, count(*) over (partition by step) as n from rollouts),
picked as (select *, case when rank < 3 then 'top' when rank >= greatest(0, n // 2 - 1) and rank < greatest(0, n // 2 - 1) + 2 then 'mid' when rank >= n - 3 then 'bottom' end as pick from o)"""


@query(f"with {PICKED} select step, event_id, cast(rank as integer) as rank, pick from picked where pick is not null")
def q_top_mid_bottom(spark, sf_dir):
    return sampling.pick_top_mid_bottom(r.rollouts(spark, sf_dir), "reward", "event_id", 3, 2, 3, ["step"]).select("step", "event_id", "rank", "pick")


@query(f"with {PICKED} select p.step, p.event_id, p.pick, case when d.source like '%1%' then 'one' else 'other' end as source, left(d.text, 30) as explanation, case when length(d.text) > 40 then left(d.text, 40) || '... [' || (length(d.text) - 40) || ' more chars]' else d.text end as shown_text from picked p join documents d on p.doc_id = d.doc_id where pick is not null")
def q_report_rows(spark, sf_dir):
    picked = sampling.pick_top_mid_bottom(r.rollouts(spark, sf_dir), "reward", "event_id", 3, 2, 3, ["step"])
    rows = picked.join(r.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("src")), "doc_id")
    out = metrics.report_rows(rows, F.col("src"), F.concat(F.lit("<explanation> "), F.left("text", F.lit(30)), F.lit("</explanation>")), F.col("text"), [("1", "one")], n=40)
    return out.select("step", "event_id", "pick", "source", F.rpad("explanation", 30, " ").alias("explanation"), "shown_text")


ORACLE_SQL["q_report_rows"] = ORACLE_SQL["q_report_rows"].replace("left(d.text, 30) as explanation", "rpad(regexp_replace(left(d.text, 30), '^\\s+|\\s+$', '', 'g'), 30, ' ') as explanation")


@query(f"with {r.ROLLOUTS} select event_id, round((reward - avg(reward) over w) / (stddev_pop(reward) over w + 1e-6), 4) + 0.0 as advantage from rollouts window w as (partition by step, group_index)")
def q_group_advantage(spark, sf_dir):
    out = metrics.group_advantage(r.rollouts(spark, sf_dir), ["step", "group_index"], "reward")
    return out.select("event_id", (F.round("advantage", 4) + 0.0).alias("advantage"))


@query(f"with {r.ROLLOUTS} select step, count(*) as n, round(avg(response_length), 6) as mean_length, round(corr(response_length, reward), 6) as length_reward_corr from rollouts group by 1")
def q_length_drift(spark, sf_dir):
    return metrics.length_drift(r.rollouts(spark, sf_dir), "step", "response_length", "reward")


@query("""with t as (select doc_id, string_split(text, ' ') as tok from documents), p as (select doc_id, length(tok[i]) as k, i, -((length(tok[i]) * i) % 7) / 10.0 as t, -((length(tok[i]) * i) % 5) / 10.0 as s from t, unnest(range(1, len(tok) + 1)) as u(i)),
d as (select doc_id, (k + i) % 3 <> 0 as m, cast(t as double) - cast(s as double) as d from p)
select doc_id, count(*) filter (m) as n, round(avg(exp(d)) filter (m), 6) as ratio, round(avg(abs(exp(d) - 1)) filter (m), 6) as abs_ratio, round(avg(exp(d) - 1 - d) filter (m), 6) as k3 from d group by 1""")
def q_logprob_mismatch(spark, sf_dir):
    """Log-probs of every token of every document, from its length and place."""
    tok = F.col("tok")
    lp = lambda m: F.transform(tok, lambda x, i: -((F.length(x) * (i + 1)) % m).cast("double") / 10.0)
    mask = F.transform(tok, lambda x, i: F.when((F.length(x) + i + 1) % 3 != 0, 1).otherwise(0))
    rows = r.table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tok")).select("doc_id", lp(7).alias("t"), lp(5).alias("s"), mask.alias("m"))
    rows = rows.select("doc_id", vec.mismatch(F.col("t"), F.col("s"), F.col("m")).alias("m"))
    return rows.select("doc_id", F.col("m.n").cast("long").alias("n"), *[F.round(F.col(f"m.{c}"), 6).alias(c) for c in ("ratio", "abs_ratio", "k3")])


# tokens, turns and batches


@query("""with t as (select conv_id, turn, role, string_split(text, ' ') as tok from conversations), m as (select *, [case when role = 'assistant' then 1 else 0 end for x in tok] as m from t),
g as (select conv_id, flatten(list(tok order by turn)) as tokens, flatten(list(m order by turn)) as a from m group by 1), n as (select *, cast(list_sum(a) as bigint) as n from g)
select conv_id, len(tokens) as n_tokens, n as response_length, sha256(array_to_string(tokens, ' ')) as tokens_key, sha256(array_to_string(a[len(a) - n + 1:], '')) as mask_key from n""")
def q_conversation_mask(spark, sf_dir):
    rows = tl.conversation_mask(r.table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.col("response_length").cast("long").alias("response_length"), tx.text_key(F.array_join("tokens", " ")).alias("tokens_key"), tx.text_key(F.array_join("mask", "")).alias("mask_key"))


@query("select conv_id, turn, cast(2 as integer) as n_turns, 'assistant' as last_role, 'Re: ' || text as last_content from conversations where role = 'user'")
def q_append_turn(spark, sf_dir):
    rows = r.table(spark, sf_dir, "conversations").filter("role = 'user'")
    both = tx.append_turn(tx.user_prompt(F.col("text")), F.concat(F.lit("Re: "), F.col("text")))
    return rows.select("conv_id", "turn", both.alias("p")).select("conv_id", "turn", F.size("p").alias("n_turns"), F.get("p", F.lit(1))["role"].alias("last_role"), F.get("p", F.lit(1))["content"].alias("last_content"))


@query("select doc_id, case when text like '%the%' then replace(text, 'the', '<v>') end as content from documents")
def q_substitute_marker(spark, sf_dir):
    rows = r.table(spark, sf_dir, "documents")
    prompt = tx.substitute_marker(tx.user_prompt(F.col("text")), "the", "<v>")
    return rows.select("doc_id", F.get(prompt, F.lit(0))["content"].alias("content"))


@query(f"with {SITES} select doc_id, site from sites where l = 'of' and r = 'that'")
def q_marker_sites(spark, sf_dir):
    docs = r.table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("ids"))
    found = docs.select("doc_id", F.explode(tl.marker_sites(F.col("ids"), F.lit("the"), F.lit("of"), F.lit("that"))).alias("s"))
    return found.select("doc_id", F.col("s").cast("long").alias("site"))


@query("""with t as (select doc_id, string_split(text, ' ') as ids from documents), o as (select doc_id, ids, list_filter(range(1, len(ids) + 1), lambda i: ids[i] = 'with') as p from t)
select doc_id, p[1] - 1 as site, ids[p[1] - 1] as "left", ids[p[1] + 1] as "right" from o where len(p) = 1 and p[1] > 1 and p[1] < len(ids)""")
def q_neighbors(spark, sf_dir):
    docs = r.table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("ids"))
    rows = docs.select("doc_id", tl.marker_neighbors(F.col("ids"), F.lit("with")).alias("m")).filter("m is not null")
    return rows.select("doc_id", F.col("m.site").cast("long").alias("site"), "m.left", "m.right")


@query("with t as (select doc_id, string_split(text, ' ') as tok from documents), s as (select tok[-3:] as s from t where doc_id = 0) select doc_id, len(tok) >= 3 and tok[-3:] = s as fits from t, s")
def q_suffix_check(spark, sf_dir):
    """The last three tokens of the first document, as a stable suffix, against all documents."""
    docs = r.table(spark, sf_dir, "documents")
    suffix = tl.stable_suffix(docs.filter("doc_id = 0").first()["text"].split(" ")[-4:])
    return docs.select("doc_id", tl.ends_with_tokens(tx.tokens(F.col("text")), suffix).alias("fits"))


@query("with t as (select doc_id, string_split(text, ' ') as tok from documents) select doc_id, list_max(list_filter(range(0, len(tok)), lambda i: length(tok[i + 1]) > 8)) as last from t")
def q_last_set(spark, sf_dir):
    """The last long token of each document."""
    mask = F.transform(tx.tokens(F.col("text")), lambda x: F.when(F.length(x) > 8, 1).otherwise(0))
    return r.table(spark, sf_dir, "documents").select("doc_id", tl.last_set(mask).cast("long").alias("last"))


@query("select count(*) as rows, min(len(embedding)) as low, max(len(embedding)) as high from embeddings")
def q_width(spark, sf_dir):
    rows = vec.assert_width(r.table(spark, sf_dir, "embeddings"), "embedding", 64)
    return rows.agg(F.count("*").alias("rows"), F.min(F.size("embedding")).cast("long").alias("low"), F.max(F.size("embedding")).cast("long").alias("high"))


EPOCHS = """n as (select count(*) as n from documents), e as (select unnest([0, 1, 2]) as epoch),
ordered as (select doc_id, epoch, epoch * n + row_number() over (partition by epoch order by sha256((42 + epoch) || '|' || doc_id), doc_id) - 1 as pos from documents, e, n)"""


@query(f"with {EPOCHS} select doc_id, epoch, pos, pos // 96 as batch_id from ordered, n where pos < 96 * (3 * n // 96)")
def q_epoch_batches(spark, sf_dir):
    docs = r.table(spark, sf_dir, "documents").select("doc_id")
    return ranks.draw_batches(ranks.epoch_order(docs, 42, 3, ["doc_id"]), 96, 3 * docs.count() // 96).select("doc_id", F.col("epoch").cast("int").alias("epoch"), "pos", "batch_id")


PLACES = f"""nd as (select count(*) as nd from documents), ids as (select doc_id, row_number() over (order by doc_id) - 1 as ordinal from documents),
asked as (select pos, pos // nd as epoch, pos % nd as x, nd from nd, unnest(range(0, 3 * nd)) as u(pos)), {permutation.permutation_sql("asked", "s.nd", "epoch + 42", "dealt")}"""


@query(f"with recursive {PLACES} select doc_id, epoch, pos, pos // 96 as batch_id from dealt d join ids i on d.ordinal = i.ordinal, nd where pos < 96 * (3 * nd // 96)")
def q_addressed_batches(spark, sf_dir):
    """All batches of three epochs, each place from the permutation alone."""
    docs = permutation.numbered(r.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    n = docs.count()
    rows = permutation.draw(docs, n, 42, 0, 3 * n // 96 * 96)
    return rows.select("doc_id", "epoch", "pos", F.expr("pos div 96").alias("batch_id"))


CONSUMED = f"{PLACES}, taken as (select pos from unnest(range(0, cast((select nd * 2 // 3 // 4 * 4 from nd) as bigint))) as u(pos))"


@query(f"with recursive {CONSUMED} select d.pos as group_index, i.doc_id, cast(1 as bigint) as uses from taken t join dealt d on t.pos = d.pos join ids i on d.ordinal = i.ordinal")
def q_consumed_groups(spark, sf_dir):
    """Four runs over one consumption state, some groups of which come back: each position is used once."""
    return stateful.consumed_groups(spark, sf_dir)


@query(f"with {EPOCHS} select doc_id, pos as group_index, pos * 4 + i as sample_index from ordered, unnest(range(0, 4)) as u(i) where epoch = 0")
def q_replicate(spark, sf_dir):
    rows = ranks.epoch_order(r.table(spark, sf_dir, "documents").select("doc_id"), 42, 1, ["doc_id"])
    return ranks.replicate(rows, 4).select("doc_id", "group_index", "sample_index")


@query("select part, count(*) as rows, cast(sum(doc_id) as bigint) as ids from (select doc_id, doc_id % 12 % 5 as part from documents) group by 1")
def q_assign_mod(spark, sf_dir):
    rows = ranks.merge_parts(ranks.assign_mod(r.table(spark, sf_dir, "documents"), 12, "doc_id"), 5)
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@query("with p as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rn from documents), k as (select min(c) // 8 * 8 as k from (select count(*) as c from documents group by lang)) select doc_id, lang from p, k where rn <= k")
def q_truncate_balanced(spark, sf_dir):
    return ranks.truncate_balanced(r.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 8, "doc_id")


@query("select doc_id, cast(sum(len(string_split(text, ' '))) over (order by doc_id) - 1 as bigint) as last_index from documents")
def q_packed_offsets(spark, sf_dir):
    docs = r.table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n"))
    return metrics.packed_last_index(docs, "doc_id", "n").select("doc_id", "last_index")


@query("select doc_id, len(string_split(text, ' ')) as total_length, 0 as response_length from documents where len(string_split(text, ' ')) > 60")
def q_critic_rows(spark, sf_dir):
    tok = tx.tokens(F.col("text"))
    rows = r.table(spark, sf_dir, "documents").select("doc_id", F.when(F.size(tok) > 60, tok).alias("tok"), F.lit(0.5).alias("gold"))
    return tl.to_critic_rows(rows).select("doc_id", F.col("total_length").cast("long").alias("total_length"), "response_length")


@query("""with t as (select doc_id, string_split(text, ' ') as tok from documents), e as (select doc_id, tok, sum(len(tok)) over (order by doc_id) as e from t), total as (select sum(len(tok)) as n from t),
s as (select w, cast(('0x' || substr(sha256('42|' || w), 1, 12)) as bigint) % greatest(n - 64 + 1, 1) as start from unnest(range(0, 20)) as u(w), total),
hits as (select s.w, s.start, e.e - len(e.tok) + i - 1 as place, e.tok[i] as token from e join s on s.start < e.e and s.start + 64 > e.e - len(e.tok), unnest(range(1, len(e.tok) + 1)) as u(i) where e.e - len(e.tok) + i - 1 >= s.start and e.e - len(e.tok) + i - 1 < s.start + 64)
select w as window_id, cast(start as bigint) as start, count(*) as n, sha256(string_agg(token, ' ' order by place)) as window_key from hits group by 1, 2""")
def q_calibration_windows(spark, sf_dir):
    rows = sampling.calibration_windows(r.table(spark, sf_dir, "documents"), tx.tokens(F.col("text")), 20, 64, 42)
    return rows.select("window_id", "start", F.size("tokens").cast("long").alias("n"), tx.text_key(F.array_join("tokens", " ")).alias("window_key"))


# scans of text


@query("""with points as (select unnest(range(192, 256)) as cp), hits as (select cast(unicode(c) as bigint) as cp, count(*) as n from (select unnest(string_split(text, '')) as c from documents) where c <> '' and unicode(c) between 192 and 255 group by 1)
select points.cp as code_point, coalesce(n, 0) as hits from points left join hits on points.cp = hits.cp order by 2, 1 limit 1""")
def q_pick_marker(spark, sf_dir):
    return metrics.pick_marker(r.table(spark, sf_dir, "documents"), "text", 192, 255)


@query("select source as step, count(*) as rows, round(avg(case when regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]') then 1.0 else 0.0 end), 6) as cjk_rate from documents group by 1")
def q_script_drift(spark, sf_dir):
    docs = r.table(spark, sf_dir, "documents").withColumnRenamed("source", "step")
    return gates.cjk_rate(docs, "text", "step")


@query("select page_id, pattern from pages, (values ('track('), ('copy;'), ('example.org')) v(pattern) where contains(lower(html), pattern) and page_id not in (3, 5)")
def q_leak_scan(spark, sf_dir):
    return gates.leak_scan(r.table(spark, sf_dir, "pages"), "html", "page_id", ["track(", "COPY;", "example.org"], ["3", "5"])


@query("with p as (select distinct left(lower(text), 24) as pattern from documents where length(text) >= 24) select doc_id, pattern from documents, p where contains(lower(text), pattern)")
def q_leak_patterns(spark, sf_dir):
    """The beginnings of all documents, looked for in all documents at once."""
    docs = r.table(spark, sf_dir, "documents")
    patterns = docs.filter(F.length("text") >= 24).select(F.left(F.lower("text"), F.lit(24)).alias("pattern"))
    return gates.leak_patterns(docs, "text", "doc_id", patterns, "pattern")


@query("""with v as (select doc_id, len(string_split(text, ' ')) > 50 as a, contains(text, 'the') as b, len(string_split(text, 'with')) = 2 as c from documents)
select 'enough_tokens' as "check", count(*) filter (not a) as bad_rows, min(doc_id) filter (not a) as sample_key from v union all select 'has_marker', count(*) filter (not b), min(doc_id) filter (not b) from v union all select 'one_site', count(*) filter (not c), min(doc_id) filter (not c) from v""")
def q_gate_report(spark, sf_dir):
    t = F.col("text")
    checks = {"enough_tokens": F.size(tx.tokens(t)) > 50, "has_marker": F.contains(t, F.lit("the")), "one_site": F.size(F.split(t, "with")) == 2}
    return gates.violations(r.table(spark, sf_dir, "documents"), checks, "doc_id")


@query("select doc_id from documents order by sha256('7|' || doc_id), doc_id limit 50")
def q_cap(spark, sf_dir):
    return sampling.cap(r.table(spark, sf_dir, "documents").select("doc_id"), 50, 7, ["doc_id"])


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 64 as chunk_id from documents")
def q_chunks(spark, sf_dir):
    return ranks.chunk_id(r.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


# written tables, streams and plug-ins


@query(f"with {r.ROLLOUTS}, {BUCKETS} select 'bucket' as kind, bucket as name, count(*) as rows from base b join buckets k on b.doc_id = k.doc_id group by 2 union all select 'step', step, count(*) from rollouts where step in ('2024-01-02', '2024-01-05') group by 2")
def q_fanout_roundtrip(spark, sf_dir):
    return stateful.fanout_roundtrip(spark, sf_dir)


@query(f"with {r.ROLLOUTS} select event_id, case when status = 'COMPLETED' and response_length % 4 <> 0 then cast(case when event_id % 3 = 0 then -4 else -2 end as double) else cast(-2 as double) end as reward from rollouts")
def q_stream_score(spark, sf_dir):
    return stateful.stream_score(spark, sf_dir)


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(avg(value), 9) as mean, round(stddev_pop(value), 9) as std, round(min(value), 9) as min, round(max(value), 9) as max, true as percentiles_fit, true as groups_fit from events group by 1 having day < (select strftime(max(ts) - interval 2 day, '%Y-%m-%d') from events)")
def q_stream_report(spark, sf_dir):
    return stateful.stream_report(spark, sf_dir)


@query("select count(*) as samples, cast(16 as bigint) as largest, cast(0 as bigint) as repeated, cast(0 as bigint) as unfinished from events")
def q_micro_batch(spark, sf_dir):
    return stateful.micro_batches(spark, sf_dir)


@query(f"with {r.ROLLOUTS} select event_id as sample, case when response_length % 7 = 0 then 'gave up' else 'scored' end as status, case when response_length % 7 <> 0 then response_length / 2 - case status when 'COMPLETED' then 0 when 'TRUNCATED' then 1 else 2 end end as result, cast(null as varchar) as error from rollouts")
def q_batch_scores(spark, sf_dir):
    return stateful.batch_scores(spark, sf_dir)


@query("select conv_id, turn, (row_number() over (order by conv_id, turn) - 1) // 100 as chunk_id, case when length(text) % 3 <> 0 then 'Re: ' || text end as completion from conversations")
def q_resume_append(spark, sf_dir):
    return stateful.resume(spark, sf_dir)


@query("select event_id from events")
def q_resume_stream(spark, sf_dir):
    return stateful.resume_two_runs(spark, sf_dir)


@query("with t as (select doc_id, string_split(text, ' ') as tok from documents) select doc_id, i - 1 as position, cast(length(tok[i]) as double) as first from t, unnest(range(1, len(tok) + 1)) as u(i)")
def q_extractor(spark, sf_dir):
    return stateful.extractor(spark, sf_dir)


@query("select doc_id, case when length(text) % 5 <> 0 then 'about ' || text end as completion from documents where doc_id % 2 = 1")
def q_provider(spark, sf_dir):
    return stateful.provider(spark, sf_dir)


@query("select vec_id, case when vec_id % 4 <> 0 then cast(label as double) end as first from embeddings")
def q_reconstructor(spark, sf_dir):
    return stateful.reconstructor(spark, sf_dir)


@query("select doc_id, least(len(string_split(text, ' ')), 8) as counted from documents")
def q_hashed_vectors(spark, sf_dir):
    return stateful.hashed(spark, sf_dir)


JOB = f"""{r.PRIOR}, {BUCKETS[len(r.BASE) + 2 :]}, {WITH_VECTOR},
told as (select p.doc_id, p.n_raw_tokens, bucket, coalesce(c.e, p.api_explanation) as x, {DIGEST} as d from prior p join buckets k on p.doc_id = k.doc_id left join cache c on sha256(p.prefix) = c.k, nv, e where e.vec_id = (p.doc_id * 31 + p.n_raw_tokens) % nv),
made as (select doc_id, case bucket when 'av' then 'av_sft' when 'ar' then 'ar_sft' else 'rl' end as stage, concat_ws('|', doc_id, n_raw_tokens, d, case bucket when 'ar' then 'Read: ' || x || {NL} || 'Guess:' else 'Describe the vector <v>.' end,
    case bucket when 'av' then '<explanation>' || {NL} || x || {NL} || '</explanation>' end) as row from told)"""


@query(f"with {JOB} select stage, count(*) as rows, count(distinct doc_id) as docs, bit_xor(cast('0x' || substr(md5(row), 1, 15) as bigint)) as digest from made group by 1")
def q_pipeline(spark, sf_dir):
    return stateful.whole_run(spark, sf_dir)
