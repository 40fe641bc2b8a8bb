"""Queries that write tables or run streams on the way, in a scratch folder of the session."""

from __future__ import annotations

import contextlib
import time
import uuid
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.functions.text import tokens
from lexvane.functions.vectors import digest
from lexvane.operators import gates, joins, permutation, plugins, splits
from lexvane.operators.joins import cache_misses
from lexvane.plans import pipeline as job
from lexvane.plans import recipes as r
from lexvane.sources import chunks, registry, tables
from lexvane.sources.scratch import scratch, written
from lexvane.streaming import scoring
from lexvane.streaming.consumption import Consumption


def fanout_roundtrip(spark, sf_dir):
    at = scratch(spark, "fanout")
    rows = splits.split_docs(r.keys(spark, sf_dir), (0.25, 0.25, 0.5), 42, documents=r.long_documents(spark, sf_dir))
    tables.write_split(rows, f"{at}/split")
    tables.write_table(r.rollouts(spark, sf_dir).drop("ts"), f"{at}/rollouts", partition_by=["step"])
    split = tables.scan(spark, f"{at}/split", ["bucket", "doc_id"]).groupBy(F.col("bucket").alias("name")).agg(F.count("*").alias("rows"))
    some = tables.rollout_scan(spark, f"{at}/rollouts", ["2024-01-02", "2024-01-05"]).groupBy(F.date_format("step", "yyyy-MM-dd").alias("name")).agg(F.count("*").alias("rows"))
    return split.select(F.lit("bucket").alias("kind"), "name", "rows").unionByName(some.select(F.lit("step").alias("kind"), "name", "rows"))


def registry_roundtrip(spark, sf_dir):
    """(dataset_id, row_count, start) of the shards' records, as the registry gives them back."""
    at = scratch(spark, "registry")
    i = registry.dataset_id(F.col("base_model"), F.col("layer_index"), F.col("corpus"), F.col("start"), F.col("length"))
    shards = r.shard_metas(spark, sf_dir).withColumn("id", i).collect()  # four records
    records = [{"dataset_id": s["id"], "stage": "base", "row_count": s["row_count"], "extraction": (s["base_model"], s["d_model"], s["layer_index"], s["norm"], s["corpus"], (s["start"], s["length"]), s["positions_per_doc"]), "parent_datasets": []} for s in shards]
    registry.register(registry.metadata(spark, records), at)
    found = [registry.load_meta(spark, at, s["id"]) for s in shards]
    return spark.createDataFrame([(m["dataset_id"], m["row_count"], m["extraction"]["corpus_slice"]["start"]) for m in found], "dataset_id string, row_count long, start long")


def _events_in_order(spark: SparkSession, sf_dir: str, at: str, columns: list, files: int = 4) -> DataFrame:
    """A stream over files of events that are sorted by time."""
    rows = r.rollouts(spark, sf_dir).select(*columns)
    rows.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{at}/in")


def stream_score(spark, sf_dir):
    """Rollouts whose prediction is orthogonal (mse 2), or opposite (mse 4) for each third."""
    at = scratch(spark, "score")
    one = lambda x, y: F.array(F.lit(x), F.lit(y))
    response = F.when(F.col("response_length") % 4 != 0, F.lit("<explanation>\nx\n</explanation>")).otherwise(F.lit("x"))
    pred = F.when(F.col("event_id") % 3 == 0, one(-1.0, 0.0)).otherwise(one(0.0, 1.0))
    stream = _events_in_order(spark, sf_dir, at, ["event_id", "ts", "status", F.col("response_length").alias("critic_tokens"), response.alias("response"), pred.alias("pred"), one(1.0, 0.0).alias("gold")])
    scored = scoring.score_stream(stream, 2.0**0.5).select("event_id", F.round("reward", 6).alias("reward"))
    scoring.run_available(scored, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


def stream_report(spark, sf_dir):
    """Days that the watermark has closed, and whether their sketched percentiles and group counts are within the stated errors of exact ones."""
    at = scratch(spark, "report")
    events = r.table(spark, sf_dir, "events").select("event_id", "ts", "value", "user_id")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")
    report = scoring.report_stream(stream, "ts", "value", "event_id", group="user_id")
    scoring.run_available(report, f"{at}/out", f"{at}/state")
    out = spark.read.parquet(f"{at}/out").withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    days = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(F.broadcast(out.select("day", *scoring.SHARES)), "day")
    under = [F.count_if(F.col("value") < F.col(p)).alias(f"below_{p}") for p in scoring.SHARES] + [F.count_if(F.col("value") <= F.col(p)).alias(f"upto_{p}") for p in scoring.SHARES]
    exact = days.groupBy("day").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("groups"), *under)
    error = scoring.PERCENTILE_ERROR
    near = [(F.col(f"below_{p}") <= (s + error) * F.col("rows")) & (F.col(f"upto_{p}") >= (s - error) * F.col("rows")) for p, s in scoring.SHARES.items()]
    out = out.join(F.broadcast(exact), "day").withColumn("percentiles_fit", reduce(and_, near)).withColumn("groups_fit", F.abs(F.col("n_groups") - F.col("groups")) <= F.greatest(F.col("groups") * 0.03, F.lit(1)))
    out = out.select("day", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max")], "percentiles_fit", "groups_fit")
    last = events.agg(F.date_format(F.max("ts") - F.expr("interval 2 days"), "yyyy-MM-dd").alias("last"))
    return out.join(F.broadcast(last)).filter("day < last").drop("last")


#: Events of a shard and of an input file of micro_batches(), about; and its reports without news that mean that it hangs.
SHARD_EVENTS, QUIET_REPORTS = 10_000, 100


def _shards(events: int) -> int:
    """Shards and files grow with the input, so that none does."""
    return max(4, -(-events // SHARD_EVENTS))


@contextlib.contextmanager
def rocksdb(spark):
    """The state store that stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _batched(spark, sf_dir, columns, **how):
    """All batches of the events' stream.

    The stream runs until all events have left, however long that takes. A failed stream is an error, and so is one that goes on
    to report but gives nothing out.
    """
    at = scratch(spark, "batches")
    out = lambda: spark.read.schema(scoring.BATCHED).parquet(f"{at}/out")
    with rocksdb(spark):
        n = r.table(spark, sf_dir, "events").count()
        shards = _shards(n)
        stream = scoring.micro_batch(_events_in_order(spark, sf_dir, at, ["event_id", "ts", *columns], shards), "event_id", shards, timeout_ms=2_000, columns=columns, **how)
        running = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(processingTime="1 second").start()
        try:
            seen, gone, quiet = None, 0, 0
            while running.isActive and gone < n:
                time.sleep(1)
                if not (p := running.lastProgress) or p.timestamp == seen:
                    continue
                seen, before = p.timestamp, gone
                if p.batchId > 0:
                    gone = out().count()
                quiet = 0 if gone > before or p.numInputRows else quiet + 1
                if quiet >= QUIET_REPORTS:
                    raise RuntimeError(f"{n - gone} of {n} events stay in the stream")
        finally:
            running.stop()
        if running.exception():
            raise running.exception()
    return out()


def micro_batches(spark, sf_dir):
    """(samples, largest, repeated, unfinished): each event is in one batch, of 16 at most; rests leave by their timer."""
    sizes = _batched(spark, sf_dir, []).groupBy("shard", "batch").agg(F.count("*").alias("k"), F.count_distinct("sample").alias("d"))
    total = r.table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("d").alias("samples"), F.max("k").alias("largest"), F.count_if(F.col("k") != F.col("d")).alias("repeated")).join(F.broadcast(total)).withColumn("unfinished", F.col("n") - F.col("samples")).drop("n")


def _reward_of(batch):
    """Half the length, less the status; none for lengths that 7 divides."""
    cost = batch["status"].map({"COMPLETED": 0.0, "TRUNCATED": 1.0, "FAILED": 2.0})
    return [None if k % 7 == 0 else k / 2 - c for k, c in zip(batch["response_length"], cost, strict=True)]


def batch_scores(spark, sf_dir):
    """Every event's result from the batch that it was in."""
    return _batched(spark, sf_dir, ["status", "response_length"], score=_reward_of).select("sample", "status", "result", "error")


def _answer(prompts: list[str]) -> list[str | None]:
    return [f"Re: {p}" if len(p) % 3 else None for p in prompts]


def _answer_some(prompts: list[str]) -> list[str | None]:
    """Fails on chunks whose first prompt has an odd number of characters."""
    if len(prompts[0]) % 2:
        raise RuntimeError("no answer")
    return _answer(prompts)


def resume(spark, sf_dir):
    """A first run, in which the provider fails on some chunks and all others are kept; a second one, which asks for the failed ones alone."""
    at = scratch(spark, "append")
    rows = r.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    with contextlib.suppress(chunks.ChunksFailed):
        plugins.complete_chunks(rows, _answer_some, at, ["conv_id", "turn"], chunk=100)
    done = plugins.complete_chunks(rows, _answer, at, ["conv_id", "turn"], chunk=100)
    return done.select("conv_id", "turn", "chunk_id", "completion")


def resume_two_runs(spark, sf_dir):
    """Two runs of one query over a growing folder: the second takes only what is new."""
    at = scratch(spark, "resume")
    events = r.table(spark, sf_dir, "events").select("event_id")
    events.filter("event_id % 2 = 0").write.parquet(f"{at}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{at}/in")
    scoring.run_available(stream(), f"{at}/out", f"{at}/state")
    events.filter("event_id % 2 = 1").write.mode("append").parquet(f"{at}/in")
    scoring.resume_stream(spark, stream(), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


def _lengths(texts: list[str]) -> list:
    out = []
    for t in texts:
        words = t.split(" ")
        matrix = np.ones((len(words), 2))
        matrix[:, 0] = list(map(len, words))
        out.append((range(len(words)), matrix))
    return out


def extractor(spark, sf_dir):
    rows = plugins.apply_extractor(r.table(spark, sf_dir, "documents"), _lengths, 2)
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), F.get("vector", F.lit(0)).cast("double").alias("first"))


def _complete(prompts: list[str]) -> list[str | None]:
    return [f"about {p}" if len(p) % 5 else None for p in prompts]


def provider(spark, sf_dir):
    """Completions of the rows that the cache misses: the even documents are cached."""
    docs = r.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("text")).alias("detokenized_text_truncated"), "text")
    cache = docs.filter("doc_id % 2 = 0").select("detokenized_text_truncated", F.lit("known").alias("api_explanation"))
    misses = cache_misses(docs, [cache]).select("doc_id", F.col("text").alias("prompt"))
    return plugins.apply_provider(misses, _complete, concurrency=4).select("doc_id", "completion")


def _from_label(texts: list[str]) -> np.ndarray:
    return np.array([[float(t), 0.0] for t in texts])


def reconstructor(spark, sf_dir):
    rows = r.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.col("label").cast("string")).alias("explanation"))
    return plugins.apply_reconstructor(rows, _from_label, 2).select("vec_id", F.get("pred", F.lit(0)).cast("double").alias("first"))


def hashed(spark, sf_dir):
    rows = plugins.hashed_vectors(r.table(spark, sf_dir, "documents"), tokens(F.col("text")), 32)
    return rows.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("long").alias("counted"))


def whole_run(spark, sf_dir):
    """All stages of the dataset job; rows and documents of its three final tables, and a digest of all that their rows hold."""
    cfg = job.resolve_config({"preset": "small", "d_model": 64, "output": scratch(spark, "job")})
    vectors = lambda rows: r.with_vectors(rows, spark, sf_dir)
    provider = lambda rows: r.prior(rows)
    at = job.run_pipeline(spark, cfg, r.table(spark, sf_dir, "documents"), vectors, r.caches, provider)
    out = None
    for stage in ("av_sft", "ar_sft", "rl"):
        rows = spark.read.parquet(f"{at['shuffle']}/{stage}")
        prompt = F.col("prompt") if stage == "ar_sft" else F.get("prompt", F.lit(0))["content"]
        held = [F.col("doc_id").cast("string"), F.col("n_raw_tokens").cast("string"), digest(F.col("activation_vector")).cast("string"), prompt, *[F.col(c) for c in ("response",) if c in rows.columns]]
        row = F.conv(F.substring(F.md5(F.concat_ws("|", *held)), 1, 15), 16, 10).cast("long")
        part = rows.select("doc_id", row.alias("row")).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("docs"), F.bit_xor("row").alias("digest")).withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out


def table_gate(spark, sf_dir):
    """(label, rows, refused): vectors that agree with their registered record, and whether a record with another count refuses them."""
    at = scratch(spark, "gate")
    rows = r.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", splits.VECTOR)
    n = rows.agg(F.max("vec_id")).first()[0] + 1  # ids are 0, 1, ..
    tokens = ("<v>", -1, -1, -1, [-1])
    for name, count in (("right", n), ("wrong", n + 1)):
        extraction = ("lab/base-1", 64, 20, "none", "embeddings", (0, count), 1)
        registry.register(registry.metadata(spark, [{"dataset_id": name, "stage": "rl", "row_count": count, "extraction": extraction, "tokens": tokens, "prompt_templates": {"actor": r.ACTOR}, "parent_datasets": []}]), at)
    record = lambda name: (lambda m: {"stage": m["stage"], "norm": m["extraction"]["norm"], "d_model": m["extraction"]["d_model"], "row_count": m["row_count"]})(registry.load_meta(spark, at, name))
    refused = False
    try:
        gates.gate_table(rows, record("wrong"), "rl", ["label", splits.VECTOR])
    except ValueError:
        refused = True
    return gates.gate_table(rows, record("right"), "rl", ["label", splits.VECTOR]).groupBy("label").agg(F.count("*").alias("rows")).withColumn("refused", F.lit(refused))


def consumed_groups(spark, sf_dir):
    """(group_index, doc_id, uses): groups of two thirds of the documents, drawn in four runs and more; every third position of a run
    comes back unused, and is drawn again, first, by the next one."""
    docs = written(permutation.numbered(r.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]), "numbered")
    at, n = scratch(spark, "consumption"), docs.count()
    goal = n * 2 // 3 // 4 * 4
    used = []
    for run in range(4):
        state = Consumption(spark, at, must_exist=run > 0)  # as after a restart
        rows = state.draw(goal // 4)
        back = rows.filter("pos % 3 = 0") if run % 2 == 0 else rows.limit(0)
        state.give_back(back)
        used.append(written(rows.join(back, "pos", "left_anti"), "used"))
    state = Consumption(spark, at, must_exist=True)
    used.append(written(state.draw(goal - sum(u.count() for u in used)), "used"))
    rows = reduce(DataFrame.unionByName, used).groupBy("pos").agg(F.count("*").alias("uses"))
    places = permutation.places(spark, 0, goal, n, 42)
    return rows.join(places, "pos").join(docs, "ordinal").select(F.col("pos").alias("group_index"), "doc_id", "uses")


def stored_joins(spark, sf_dir):
    """(doc_id, n_raw_tokens, cached, reused): rows that a stored earlier run has, with what a stored cache has for their texts."""
    rows, name = written(r.base(spark, sf_dir), "base"), f"stored_{uuid.uuid4().hex}"  # read five times
    joins.store_cache(r.caches(rows), f"{name}_cache", scratch(spark, "cache"), 16)
    known = r.prior_ar(r.keys(spark, sf_dir)).filter((F.col("doc_id") * 7 + F.col("n_raw_tokens")) % 200 != 0)
    joins.store_prior(known, f"{name}_prior", scratch(spark, "prior"), 16, r.CRITIC)
    cached = joins.stored_cache_join(rows, f"{name}_cache").withColumnRenamed(joins.EXPLANATION, "cached")
    both = joins.stored_reuse_join(cached, f"{name}_prior").withColumnRenamed(joins.EXPLANATION, "reused")
    return both.select("doc_id", "n_raw_tokens", "cached", "reused")
