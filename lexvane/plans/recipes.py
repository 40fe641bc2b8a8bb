"""Inputs that the queries derive from the given tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane import share_code
from lexvane.functions.keys import hash_key
from lexvane.functions.text import render, token_count, wrap_tag
from lexvane.operators.joins import EXPLANATION, TEXT
from lexvane.operators.sampling import MIN_POSITION, base_keys, base_rows, with_texts
from lexvane.operators.splits import VECTOR

ACTOR = "Describe the vector <v>."
CRITIC = "Read: {explanation}\nGuess:"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sampled positions of each document."""
    return base_rows(table(spark, sf_dir, "documents"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_raw_tokens) of base()."""
    return base_keys(table(spark, sf_dir, "documents"))


def texts(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of keys() with the texts of base()."""
    return with_texts(rows, table(spark, sf_dir, "documents"))


def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which base() has rows."""
    return table(spark, sf_dir, "documents").filter(token_count(F.col("text")) > MIN_POSITION).select("doc_id")


#: Ten draws a document: the i-th is a hash modulo n - k + i + 1, or n - k + i where that is drawn already.
BASE = """tok as (select doc_id, string_split(text, ' ') as tok from documents),
sized as (select doc_id, tok, cast(len(tok) - 50 as bigint) as n, cast(least(len(tok) - 50, 10) as bigint) as k from tok where len(tok) > 50),
drawn as (select doc_id, tok, list_reduce(list_prepend(cast([] as bigint[]), list_transform(range(0, k), lambda i: [n - k + i, cast('0x' || substr(sha256('42|' || doc_id || '|' || i), 1, 12) as bigint) % (n - k + i + 1)])),
    lambda found, x: list_append(found, case when list_contains(found, x[2]) then x[1] else x[2] end)) as places from sized),
base as (select doc_id, cast(p + 51 as bigint) as n_raw_tokens, array_to_string(tok[1:p + 51], ' ') as prefix, cast(20 as bigint) as activation_layer from drawn, unnest(places) as u(p))"""


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows with the vector of vec_id = (31 * doc_id + n_raw_tokens) mod the number of vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.count("*").alias("_n"))
    keyed = rows.join(F.broadcast(n)).withColumn("vec_id", (F.col("doc_id") * 31 + F.col("n_raw_tokens")) % F.col("_n")).drop("_n")
    return keyed.join(vectors.select("vec_id", F.col("embedding").alias(VECTOR)), "vec_id")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): raw completions from whole texts: none, unclosed, or of a feature for each 40 words, with list marks and bold runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    part = lambda i, start, n: F.array_join(F.slice("w", 40 * i + start, n), " ")

    def feature(i):
        body = F.concat(F.lit("**"), part(i, 1, 4), F.lit(":** "), part(i, 5, 36))
        return F.when(i % 3 == 0, F.concat(F.lit("1. "), part(i, 1, 40))).when(i % 3 == 1, F.concat(F.lit("- "), body)).otherwise(F.concat(F.lit("(c) "), part(i, 1, 40), F.lit("**")))

    count = F.ceil(F.size("w") / 40).cast("int")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), feature), "\n")
    kind = F.col("doc_id") % 10
    raw = F.when(kind == 0, None).when(kind == 1, F.concat(F.lit("<analysis>\n"), lines)).otherwise(F.concat(F.lit("Sure.\n<analysis>\n"), lines, F.lit("\n</analysis> Done.")))
    return docs.select("doc_id", F.explode(F.array(raw)).alias("raw"))  # built once, however often it is read


COMPLETIONS = """cut as (select doc_id, string_split(text, ' ') as w from documents),
listed as (select doc_id, array_to_string(list_transform(range(0, (len(w) + 39) // 40), lambda i: case i % 3 when 0 then '1. ' || array_to_string(w[40 * i + 1:40 * i + 40], ' ')
    when 1 then '- **' || array_to_string(w[40 * i + 1:40 * i + 4], ' ') || ':** ' || array_to_string(w[40 * i + 5:40 * i + 40], ' ') else '(c) ' || array_to_string(w[40 * i + 1:40 * i + 40], ' ') || '**' end), chr(10)) as lines from cut),
completions as (select doc_id, case doc_id % 10 when 0 then null when 1 then '<analysis>' || chr(10) || lines else 'Sure.' || chr(10) || '<analysis>' || chr(10) || lines || chr(10) || '</analysis> Done.' end as raw from listed)"""

#: The clean-up of explanations, for input whose white space is ASCII.
CLEAN = r"""cleaned as (select doc_id, raw, case when regexp_matches(raw, '(?s)<analysis>.*?</analysis>') then array_to_string(list_filter(list_transform(
    string_split(regexp_replace(regexp_extract(raw, '(?s)<analysis>(.*?)</analysis>', 1), '^\s+|\s+$', '', 'g'), chr(10)),
    lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s*(?:[-*+]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+', ''),
        '^\*\*(.+?)\*\*\s*', '\1 '), '^\s+|\s+$', '', 'g'), '^[*_]+|[*_]+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)) end as explanation from completions)"""


def _explained(rows: DataFrame, word: str) -> DataFrame:
    digest = hash_key(7, F.col("doc_id"), F.col("n_raw_tokens"))
    text = F.concat(F.lit(f"{word} "), F.col("n_raw_tokens").cast("string"), F.lit("\n\ntext "), F.substring(digest, 1, 20))
    return rows.withColumn(EXPLANATION, text).withColumn("_digit", F.substring(digest, 1, 1))


def prior(rows: DataFrame) -> DataFrame:
    """rows with their explanation."""
    return _explained(rows, "feature").drop("_digit")


def caches(rows: DataFrame) -> list[DataFrame]:
    """Two explanation caches over three and one quarter of rows; the second has other texts."""
    one, two = _explained(rows, "feature"), _explained(rows, "other")
    return [one.filter("_digit < 'c'").select(TEXT, EXPLANATION), two.filter("_digit < '4'").select(TEXT, EXPLANATION)]


def prior_av(rows: DataFrame) -> DataFrame:
    return prior(rows).withColumn("response", wrap_tag(F.col(EXPLANATION), "explanation")).drop(EXPLANATION)


def prior_ar(rows: DataFrame) -> DataFrame:
    return prior(rows).withColumn("prompt", render(CRITIC, "explanation", F.col(EXPLANATION))).drop(EXPLANATION)


PRIOR = f"""{BASE},
hashed as (select *, sha256('7|' || doc_id || '|' || n_raw_tokens) as h from base),
prior as (select *, 'feature ' || n_raw_tokens || chr(10) || chr(10) || 'text ' || substr(h, 1, 20) as api_explanation from hashed),
cache_rows as (select sha256(prefix) as k, prefix, 1 as s, 'feature ' || n_raw_tokens || chr(10) || chr(10) || 'text ' || substr(h, 1, 20) as e from hashed where substr(h, 1, 1) < 'c'
    union all select sha256(prefix), prefix, 2, 'other ' || n_raw_tokens || chr(10) || chr(10) || 'text ' || substr(h, 1, 20) from hashed where substr(h, 1, 1) < '4'),
cache as (select k, e from (select *, row_number() over (partition by k order by s desc, e desc) as rn from cache_rows) where rn = 1)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, batch, pred, gold): pred is four parts gold and one part the next vector."""
    v = table(spark, sf_dir, "embeddings")
    n = v.agg(F.count("*").alias("_n"))
    left = v.join(F.broadcast(n)).select("vec_id", "label", "embedding", ((F.col("vec_id") + 1) % F.col("_n")).alias("next"))
    right = v.select(F.col("vec_id").alias("next"), F.col("embedding").alias("other"))
    mixed = F.zip_with("embedding", "other", lambda a, b: a.cast("double") * 0.8 + b.cast("double") * 0.2)
    return left.join(right, "next").select("vec_id", "label", F.expr("vec_id div 64").alias("batch"), mixed.alias("pred"), F.transform("embedding", lambda x: x.cast("double")).alias("gold"))


PAIRS = """n as (select count(*) as n from embeddings),
pairs as (select a.vec_id, a.label, a.vec_id // 64 as batch, [cast(x as double) for x in a.embedding] as gold,
    [cast(a.embedding[i] as double) * 0.8 + cast(b.embedding[i] as double) * 0.2 for i in range(1, len(a.embedding) + 1)] as pred
    from embeddings a, n, embeddings b where b.vec_id = (a.vec_id + 1) % n.n),
norms as (select *, sqrt(list_sum([x * x for x in gold])) as ng, sqrt(list_sum([x * x for x in pred])) as np, list_sum([gold[i] * pred[i] for i in range(1, len(gold) + 1)]) as gp from pairs),
scored as (select *, 2 - 2 * gp / (ng * np) as mse from norms)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, step, group_index, status, reward, response_length, doc_id, ts) from events."""
    e, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents").agg(F.count("*").alias("_d"))
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "TRUNCATED").otherwise("COMPLETED")
    return e.join(F.broadcast(docs)).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("step"), F.col("user_id").alias("group_index"), status.alias("status"), F.round(-F.col("value") / 250, 6).alias("reward"), F.get_json_object("props", "$.k").cast("int").alias("response_length"), (F.col("event_id") % F.col("_d")).alias("doc_id"), "ts")


ROLLOUTS = """d as (select count(*) as d from documents),
rollouts as (select event_id, strftime(ts, '%Y-%m-%d') as step, user_id as group_index, case event_type when 'error' then 'FAILED' when 'view' then 'TRUNCATED' else 'COMPLETED' end as status,
    round(-value / 250, 6) as reward, cast(json_extract_string(props, '$.k') as integer) as response_length, event_id % d as doc_id, ts from events, d)"""


def shard_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four shards of the documents, cut by doc_id."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("_n"))
    rows = docs.join(F.broadcast(n)).select("doc_id", F.expr("doc_id * 4 div _n").alias("shard"))
    return rows.groupBy("shard").agg(F.min("doc_id").alias("start"), F.count("*").alias("length")).withColumns({"row_count": F.col("length"), "base_model": F.lit("lab/base-1"), "layer_index": F.lit(20), "d_model": F.lit(64), "norm": F.lit("none"), "corpus": F.lit("documents"), "positions_per_doc": F.lit(10)})


METAS = """metas as (select doc_id * 4 // n as shard, min(doc_id) as start, count(*) as length from documents, (select count(*) as n from documents) group by 1)"""
