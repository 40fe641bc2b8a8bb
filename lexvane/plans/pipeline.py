"""The dataset job: chosen stages in order, from one config map, each writing a table under one output folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.functions.text import clean_explanation, min_features, render, text_key
from lexvane.operators.gates import gate_rows, gate_table
from lexvane.operators.joins import EXPLANATION, KEY, TEXT, cache_join
from lexvane.operators.plugins import complete_chunks
from lexvane.operators.ranks import shuffle_rows
from lexvane.operators.sampling import base_rows
from lexvane.operators.splits import VECTOR, build_stage, split_docs
from lexvane.sources.journal import Journal

#: Settings that a model brings along; a config's own keys win.
PRESETS = {"small": {"layer": 20, "positions_per_doc": 10, "min_position": 50}, "probe": {"layer": 4, "positions_per_doc": 3, "min_position": 50}}
#: tokens: marker, its id, its neighbours' ids and the suffix's ids for the records; -1 where no tokenizer has told them.
DEFAULTS = {"tokens": ("<v>", -1, -1, -1, [-1]), "dataset_id": "base_run", "raw_completions": False, "min_features": 2, "resume": False, "d_model": None, "instruction": "Explain: {text}", "chunk_rows": 512, "at_once": None, "seed": 42, "fractions": (0.25, 0.25, 0.5), "positions_per_doc": 10, "min_position": 50, "layer": 20, "actor_prompt": "Describe the vector <v>.", "critic_template": "Read: {explanation}\nGuess:"}
STAGES = ["base", "split", "explain", "build", "shuffle"]


def resolve_config(cfg: dict, overrides: dict | None = None) -> dict:
    """Defaults, then the preset, then cfg, then dotted overrides (a.b = value)."""
    out = DEFAULTS | PRESETS.get(cfg.get("preset", ""), {}) | cfg
    for name, value in (overrides or {}).items():
        *way, last = name.split(".")
        place = out
        for part in way:
            place[part] = dict(place.get(part, {}))
            place = place[part]
        place[last] = value
    return out


def paths(cfg: dict) -> dict[str, str]:
    return {s: f"{cfg['output']}/{s}" for s in [*STAGES, "registry"]}


def _explained(joined: DataFrame, base: DataFrame, cfg: dict, provider, complete) -> DataFrame:
    """joined with the provider's text where the caches have none; cleaned texts with too few features are null. What is asked for gets its texts from base."""
    misses = joined.filter(F.col(EXPLANATION).isNull()).drop(EXPLANATION)
    if provider or complete:
        misses = misses.join(base.select(*KEY, TEXT), KEY, "left")
    missing = None
    if complete:
        asked = misses.withColumn("prompt", render(cfg["instruction"], "text", F.col(TEXT))).drop(TEXT)
        done = complete_chunks(asked, complete, f"{cfg['output']}/completions", KEY, chunk=cfg["chunk_rows"], at_once=cfg["at_once"])
        missing = done.drop("prompt", "chunk_id").withColumnRenamed("completion", EXPLANATION)
    elif provider:
        missing = provider(misses)
    if missing is not None:
        if cfg["raw_completions"]:
            missing = missing.withColumn(EXPLANATION, clean_explanation(F.col(EXPLANATION)))
        joined = joined.filter(F.col(EXPLANATION).isNotNull()).unionByName(missing.select(*joined.columns))
    return joined.withColumn(EXPLANATION, F.when(min_features(F.col(EXPLANATION), cfg["min_features"]), F.col(EXPLANATION)))


BUILDS = (("av", "av_sft"), ("ar", "ar_sft"), ("rl", "rl"))


class _Job:
    """The stages of one run over its journal. Each table is held against counts that others have told, and gets its records."""

    def __init__(self, journal: Journal, cfg: dict):
        self.journal, self.cfg, self.base = journal, cfg, cfg["dataset_id"]

    def _table(self, name: str) -> DataFrame:
        return self.journal.spark.read.parquet(self.journal.path(name))

    def _counts(self, name: str) -> dict[str, int]:
        """Rows of a table by bucket, as its record tells; counted where it has none."""
        entry = self.journal.entry(name)
        return entry["counts"] if entry else {r["bucket"]: r["count"] for r in self._table(name).groupBy("bucket").count().collect()}

    @staticmethod
    def _by_bucket(rows: DataFrame, n: int) -> dict[str, int]:
        counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # three buckets
        if sum(counts.values()) != n:
            raise ValueError(f"{n} rows went in, {sum(counts.values())} are there")
        return counts

    def base_table(self, documents: DataFrame) -> None:
        def describe(rows: DataFrame, n: int) -> dict:
            return {"records": [{"dataset_id": self.base, "stage": "base", "row_count": n, "parent_datasets": []}]}

        cfg = self.cfg
        self.journal.write("base", lambda: base_rows(documents, cfg["positions_per_doc"], cfg["min_position"], cfg["seed"], cfg["layer"]), describe)

    def split(self) -> None:
        def keyed() -> DataFrame:
            """The base, with keys in the place of texts: these stay in the base alone, by (doc_id, n_raw_tokens)."""
            return self._table("base").withColumn("text_key", text_key(F.col(TEXT))).drop(TEXT)

        def describe(rows: DataFrame, n: int) -> dict:
            if (entry := self.journal.entry("base")) and entry["rows"] != n:
                raise ValueError(f"the split has {n} rows, the base {entry['rows']}")
            counts = self._by_bucket(rows, n)
            return {"counts": counts, "records": [{"dataset_id": f"{self.base}__{b}_raw", "stage": "base", "row_count": k, "parent_datasets": [self.base]} for b, k in sorted(counts.items())]}

        self.journal.write("split", lambda: split_docs(keyed(), self.cfg["fractions"], self.cfg["seed"]), describe, ["bucket"])

    def explain(self, caches, provider, complete) -> None:
        def describe(rows: DataFrame, n: int) -> dict:
            counts, before = self._by_bucket(rows, n), self._counts("split")
            if any(k > before.get(b, 0) for b, k in counts.items()) or counts.get("rl", 0) != before.get("rl", 0):
                raise ValueError(f"{counts} rows come from {before}")
            return {"counts": counts, "records": [{"dataset_id": f"{self.base}__{b}_raw__explained", "stage": "base", "row_count": k, "parent_datasets": [f"{self.base}__{b}_raw"]} for b, k in sorted(counts.items()) if b != "rl"]}

        def joined() -> DataFrame:
            rows = self._table("split")
            found = cache_join(rows, caches(self._table("base")), key="text_key") if caches else rows.withColumn(EXPLANATION, F.lit(None).cast("string"))
            return found.drop("text_key")

        def explained() -> DataFrame:
            self.journal.write("joined", joined)  # read twice: hits, and misses for the provider
            found = _explained(self._table("joined"), self._table("base"), self.cfg, provider, complete)
            return found.filter(F.col(EXPLANATION).isNotNull() | (F.col("bucket") == "rl"))

        self.journal.write("explain", explained, describe, ["bucket"])

    def _training(self, name: str, dataset: str, parent: str, stage: str, expected: int):
        def describe(rows: DataFrame, n: int) -> dict:
            if n != expected:
                raise ValueError(f"{name} has {n} rows, not {expected}")
            width = self.cfg["d_model"] or (rows.select(F.size(VECTOR)).limit(1).first() or (0,))[0]
            gate_table(rows, {"stage": stage, "norm": "none", "d_model": width, "row_count": n}, stage, ["prompt", VECTOR])
            templates = {"actor": self.cfg["actor_prompt"], "critic": self.cfg["critic_template"]}
            return {"records": [{"dataset_id": dataset, "stage": stage, "row_count": n, "parent_datasets": [parent], "tokens": self.cfg["tokens"], "prompt_templates": templates}]}

        return describe

    def build(self, vectors) -> None:
        rows = self._table("explain")
        gate_rows(rows, {"explained": F.col(EXPLANATION).isNotNull() | (F.col("bucket") == "rl"), "keyed": F.col("doc_id").isNotNull() & F.col("n_raw_tokens").isNotNull()}, "doc_id")
        counts = self._counts("explain")
        for bucket, stage in BUILDS:
            parent = f"{self.base}__{bucket}_raw" + "__explained" * (bucket != "rl")
            make = lambda bucket=bucket, stage=stage: build_stage(vectors(rows.filter(F.col("bucket") == bucket)), stage, self.cfg["actor_prompt"], self.cfg["critic_template"])
            self.journal.write(f"build/{stage}", make, self._training(f"build/{stage}", f"{stage}_{self.base}", parent, stage, counts.get(bucket, 0)))

    def shuffle(self) -> None:
        for _, stage in BUILDS:
            def make(stage=stage) -> DataFrame:
                return shuffle_rows(self._table(f"build/{stage}"), self.cfg["seed"], stage, KEY, in_order=True)

            entry = self.journal.entry(f"build/{stage}")
            expected = entry["rows"] if entry else self._table(f"build/{stage}").count()
            self.journal.write(f"shuffle/{stage}", make, self._training(f"shuffle/{stage}", f"{stage}_{self.base}__shuf{self.cfg['seed']}", f"{stage}_{self.base}", stage, expected))


def run_pipeline(spark: SparkSession, cfg: dict, documents: DataFrame, vectors, caches=None, provider=None, stages: list[str] | None = None, complete=None, after=None) -> dict[str, str]:
    """Run the stages (all, or some in the given order of STAGES); the paths of all tables.

    vectors: keys of base rows to rows with activation_vector. Only the base holds texts; later tables have (doc_id, n_raw_tokens) of their
    rows, and what is asked for gets its texts from the base. caches: base rows to a list of explanation caches. What no cache explains goes to
    complete, a provider of the kind of plugins.complete_chunks (a chunk that is answered is never asked for again, whatever stops the
    run), or to provider, rows to rows with api_explanation. Null ones are dropped, and so are explanations of fewer than min_features
    features; raw_completions: they are cleaned first. Each stage reads what the one before wrote. Tables go through a journal
    (sources.journal): only a recorded one is complete, and has its records in the registry. resume: complete tables are kept, all
    else is written anew; without it, tables that are there are an error. after: told each step of each table.
    """
    at = paths(cfg)
    wanted = stages or STAGES
    if unknown := set(wanted) - set(STAGES):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    job = _Job(Journal(spark, cfg["output"], cfg["resume"], after), cfg)
    work = {"base": lambda: job.base_table(documents), "split": job.split, "explain": lambda: job.explain(caches, provider, complete), "build": lambda: job.build(vectors), "shuffle": job.shuffle}
    for stage in (s for s in STAGES if s in wanted):
        work[stage]()
    return at
