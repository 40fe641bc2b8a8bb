"""The dataset registry: one nested record a table, its checks, ids and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexvane.sources.scratch import written

KIND, VERSION = "dataset", 1
SCHEMA = (
    "dataset_id string, stage string, row_count long, extraction struct<base_model:string,d_model:int,layer_index:int,norm:string,corpus:string,"
    "corpus_slice:struct<start:long,length:long>,positions_per_doc:int>, kind string, schema_version int, keep_debug_metadata boolean, "
    "tokens struct<injection_char:string,injection_token_id:int,injection_left_neighbor_id:int,injection_right_neighbor_id:int,critic_suffix_ids:array<int>>, "
    "prompt_templates map<string,string>, api_summaries struct<model:string,prompt:string>, parent_datasets array<string>, created_at string, created_by string, git_commit string"
)
TRAINING = ("av_sft", "ar_sft", "rl")


def metadata(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records as a table: missing keys are null, unknown keys are left out."""
    names = [f.split(" ")[0] for f in _fields()]
    return spark.createDataFrame([tuple(({"kind": KIND, "schema_version": VERSION} | r).get(n) for n in names) for r in records], SCHEMA)


def _fields() -> list[str]:
    out, depth, now = [], 0, ""
    for c in SCHEMA:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def validate_meta(row: Row) -> Row:
    """row, if it can be used; what is wrong with it otherwise."""
    wrong = []
    if row["kind"] != KIND or row["schema_version"] != VERSION:
        wrong.append(f"kind {row['kind']}, version {row['schema_version']} are unknown")
    if row["stage"] in TRAINING:
        templates = row["prompt_templates"] or {}
        if row["tokens"] is None:
            wrong.append("tokens are missing")
        if "actor" not in templates:
            wrong.append("the actor template is missing")
        if row["stage"] == "ar_sft":
            if row["tokens"] is None or not row["tokens"]["critic_suffix_ids"]:
                wrong.append("the suffix ids are missing")
            if "critic" not in templates:
                wrong.append("the critic template is missing")
    if wrong:
        raise ValueError(f"{row['dataset_id']}: {'; '.join(wrong)}")
    return row


def register(meta: DataFrame, path: str) -> None:
    """Append records to the registry table; a JSON copy, without nulls, stands beside it."""
    meta.write.mode("append").parquet(f"{path}/registry")
    meta.select("dataset_id", F.to_json(F.struct(*meta.columns)).alias("value")).select("value").write.mode("append").text(f"{path}/json")


def known_ids(spark: SparkSession, path: str) -> set[str]:
    """Ids of all datasets in the registry at path, which may not be there yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/registry")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return set()
    return {r[0] for r in spark.read.schema(SCHEMA).parquet(f"{path}/registry").select("dataset_id").distinct().collect()}


def load_meta(spark: SparkSession, path: str, dataset_id: str) -> Row:
    """The valid record of a dataset; the latest by created_at, if several."""
    rows = spark.read.parquet(f"{path}/registry").filter(F.col("dataset_id") == dataset_id).orderBy(F.desc_nulls_last("created_at")).limit(1).collect()
    if not rows:
        raise KeyError(dataset_id)
    return validate_meta(rows[0])


def resolve_meta(explicit: Row | None, model: Row | None, dataset: Row | None) -> Row:
    """The record that applies: the explicit one, else the model's, else the dataset's."""
    for row in (explicit, model, dataset):
        if row is not None:
            return row
    raise ValueError("no record applies")


def dataset_id(base_model: Column, layer: Column, corpus: Column, start: Column, length: Column) -> Column:
    """base_, the model's last name, layer, and 8 hex digits over all that the rows depend on."""
    digest = F.substring(F.sha2(F.concat_ws("|", base_model, layer.cast("string"), corpus, start.cast("string"), length.cast("string")), 256), 1, 8)
    return F.concat(F.lit("base_"), F.substring_index(base_model, "/", -1), F.lit("_L"), layer.cast("string"), F.lit("_"), digest)


def child_id(parent: Column, op: str, value: str | int | None = None) -> Column:
    """Id of what an operation makes of a dataset: split (value: bucket), explain, build (stage), shuffle and shuffle_vectors (seed)."""
    if op == "build":
        return F.concat(F.lit(f"{value}_"), F.regexp_replace(parent, "^base_", ""))
    tail = {"split": f"__{value}_raw", "explain": "__explained", "shuffle": f"__shuf{value}", "shuffle_vectors": f"__shuf_activations{value}"}[op]
    return F.concat(parent, F.lit(tail))


def lineage(metas: DataFrame, of: str | None = None) -> DataFrame:
    """(dataset_id, ancestor, depth): all ancestors, or those of one dataset, at their least depth.

    Jumps of 1, 2, 4, .. steps are doubled from round to round and lengthen all ways so far, so a chain of 1,000 takes ten rounds. Each
    round is written. A dataset among its own ancestors is an error that names it.
    """
    jump = written(metas.select("dataset_id", F.explode("parent_datasets").alias("ancestor")).distinct(), "jumps")
    ways, step = jump.withColumn("depth", F.lit(1)), 1
    ways, datasets = ways.filter(F.col("dataset_id") == of) if of else ways, jump.select("dataset_id").distinct().count()
    while not jump.isEmpty():
        if loops := ways.filter("dataset_id = ancestor").agg(F.min("dataset_id")).first()[0]:
            raise ValueError(f"{loops} is among its own ancestors")
        if step > datasets:  # further than any way without a loop
            return lineage(metas)
        on = jump.select(F.col("dataset_id").alias("ancestor"), F.col("ancestor").alias("further"))
        longer = ways.join(on, "ancestor").select("dataset_id", F.col("further").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        ways = written(ways.unionByName(longer).groupBy("dataset_id", "ancestor").agg(F.min("depth").alias("depth")), "lineage")
        jump, step = written(jump.join(on, "ancestor").select("dataset_id", F.col("further").alias("ancestor")).distinct(), "jumps"), 2 * step
    return ways
