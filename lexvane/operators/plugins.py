"""Batch functions that a user supplies: vector extractors, completion providers and reconstructors. Each runs in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexvane.sources import chunks


def _same(n: int, results, what: str):
    if len(results) != n:
        raise ValueError(f"the {what} gave {len(results)} results for {n} rows")
    return results


#: Positions of one Arrow batch of an extractor's results; a longer text is cut.
BATCH_POSITIONS = 100_000


def apply_extractor(df: DataFrame, fn: Callable[[list[str]], list[tuple[list[int], np.ndarray]]], d: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, vector): fn gives token ids and a positions x d matrix for each text of a batch; it splits batches itself.

    Results leave as Arrow batches of BATCH_POSITIONS rows, made from whole matrices; no position is an object of its own.
    """
    kind = df.schema[key].dataType.simpleString()

    def told(held: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
        sizes = [len(m) for _, _, m in held]
        flat = np.concatenate([m for _, _, m in held]).astype(np.float32).ravel()
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32) if d else np.zeros(sum(sizes) + 1, np.int32)), pa.array(flat))
        positions = np.concatenate([np.arange(s, s + n, dtype=np.int32) for (_, s, _), n in zip(held, sizes, strict=True)])
        names = pa.array([k for k, _, _ in held], keys).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        return pa.RecordBatch.from_arrays([names, pa.array(positions), vectors], [key, "position", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, n = batch.column(0), [], 0
            for k, (ids, matrix) in zip(keys.to_pylist(), _same(len(keys), fn(batch.column(1).to_pylist()), "extractor"), strict=True):
                if matrix.shape != (len(ids), d):
                    raise ValueError(f"{k}: {matrix.shape} isn't {len(ids)} x {d}")
                for s in range(0, len(ids), BATCH_POSITIONS):
                    part = matrix[s : s + BATCH_POSITIONS]
                    if n and n + len(part) > BATCH_POSITIONS:
                        yield told(held, keys.type)
                        held, n = [], 0
                    held.append((k, s, part))
                    n += len(part)
            if held:
                yield told(held, keys.type)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, position int, vector array<float>")


def hashed_vectors(df: DataFrame, tok, d: int, window: int = 8) -> DataFrame:
    """df with vector: the shipped extractor. Counts of the hashes of the last tokens; built-in expressions alone."""
    n = F.size(tok)
    last = F.slice(tok, F.greatest(n - window + 1, F.lit(1)), window)
    slots = F.transform(last, lambda t: F.pmod(F.xxhash64(t), F.lit(d)).cast("int"))
    return df.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float")))


def side_by_side(one: Callable[[str], str | None], at_once: int = 32, transient: tuple[type[Exception], ...] = (), tries: int = 1, wait: float = 0.0) -> Callable[[list[str]], list[str | None]]:
    """A provider from a function of one prompt: up to at_once calls run at a time within a chunk.

    A call that raises one of `transient` is made again, after wait seconds (twice as long each time), up to tries times in all; then its
    prompt is given up (null). Anything else that a call raises is raised when all calls of the chunk have ended.
    """

    def call(prompt: str) -> str | None | Exception:
        for turn in range(tries):
            try:
                return one(prompt)
            except transient:
                if turn + 1 < tries:
                    time.sleep(wait * 2**turn)
            except Exception as error:
                return error
        return None

    def run(prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(max(1, min(at_once, len(prompts)))) as pool:
            found = list(pool.map(call, prompts))
        for x in found:
            if isinstance(x, Exception):
                raise x
        return found

    return run


def complete_chunks(misses: DataFrame, fn: Callable[[list[str]], list[str | None]], path: str, keys: str | list[str], prompt: str = "prompt", chunk: int = 512, at_once: int | None = None) -> DataFrame:
    """misses with completion and chunk_id, from the table at path, to which each chunk is added when its prompts have been answered.

    fn is called once for each chunk that the table doesn't hold, over all runs: what stops a run costs no chunk that is done. A chunk
    for which fn raises is told as chunks.ChunksFailed at the end; the next run asks for it again.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(completion=pd.Series(_same(len(rows), fn(list(rows[prompt])), "provider"), index=rows.index, dtype=object))

    chunks.resume_append(misses, path, keys, chunk, work, "completion string", at_once)
    done = chunks.finished(misses.sparkSession, path)
    return done if done is not None else misses.withColumns({chunks.CHUNK: F.lit(None).cast("long"), "completion": F.lit(None).cast("string")})


def apply_provider(misses: DataFrame, fn: Callable[[list[str]], list[str | None]], prompt: str = "prompt", chunk: int = 64, concurrency: int | None = None) -> DataFrame:
    """misses with completion: fn gets chunks of prompts; null is a prompt that was given up. What fn raises ends the job.

    concurrency bounds the tasks, and so the calls, at a time.
    """
    rows = misses.repartition(concurrency) if concurrency else misses
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in misses.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list = []
            for k in range(0, len(pdf), chunk):
                some = list(pdf[prompt][k : k + chunk])
                found += _same(len(some), fn(some), "provider")
            yield pdf.assign(completion=pd.Series(found, index=pdf.index, dtype=object))

    return rows.mapInPandas(run, f"{fields}, completion string")


def apply_reconstructor(df: DataFrame, fn: Callable[[list[str]], np.ndarray], d: int, text: str = "explanation") -> DataFrame:
    """df with pred, the vector that fn reads from the text; null for a null text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf[text].notna()
            made = _same(int(known.sum()), fn(list(pdf[text][known])) if known.any() else [], "reconstructor")
            pred = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for i, v in zip(pdf.index[known], made, strict=True):
                if len(v) != d:
                    raise ValueError(f"a vector is {len(v)} wide, not {d}")
                pred[i] = np.asarray(v, np.float32)
            yield pdf.assign(pred=pred)

    return df.mapInPandas(run, f"{fields}, pred array<float>")
