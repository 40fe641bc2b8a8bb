"""Queries against all vectors, in blocks: query blocks of bounded bytes are sent to all tasks, candidates are streamed and never shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most queries of a block, and bytes of their vectors; most candidates of a cell, and bytes of theirs.
QUERY_BLOCK, QUERY_BYTES = 10_000, 32_000_000
CANDIDATE_BLOCK, CANDIDATE_BYTES = 20_000, 64_000_000
#: Scores outside these come back as the nearer of them.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_DIGITS, _REVERSED = "0123456789abcdef", str.maketrans("0123456789abcdef", "fedcba9876543210")


def place(n: int) -> str:
    """A text that sorts like the whole number, whatever its size; number() takes it back."""
    digits = format(abs(n), "x")
    text = f"{len(digits):04x}{digits}"
    return f"1{text}" if n >= 0 else f"0{text.translate(_REVERSED)}"


def number(text: str) -> int:
    return int(text[5:], 16) if text[0] == "1" else -int(text[5:].translate(_REVERSED), 16)


def as_float(n: int) -> float:
    """The nearest double; infinite for what none can hold."""
    try:
        return float(n)
    except OverflowError:
        return float("inf") if n > 0 else float("-inf")


def clamped(n: int) -> int:
    return min(max(n, LEAST), MOST)


def spread(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors dealt evenly over files, so that a small table has a few tasks, and a large one tasks of bounded size."""
    return vectors.repartition(max(min(24, ceil(rows / 500)), ceil(rows / (10 * CANDIDATE_BLOCK)), 1))


def in_blocks(queries: DataFrame, most: int = QUERY_BLOCK) -> Iterator[list]:
    """queries (with d, the width, and row) in blocks of bounded rows and bytes, which the driver holds one at a time."""
    n, cells = queries.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    blocks = max(ceil(n / most), ceil(8 * cells / QUERY_BYTES))
    for b in range(blocks):
        if found := queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect():
            yield found


def stacked(batches: list[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns but v, matrix of v) of the rows, for each width of v."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    widths = rows["d"].to_numpy()
    for d in np.unique(widths):
        some = rows.filter(pa.array(widths == d)).combine_chunks()
        matrix = some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(d))
        yield {c: some[c].to_numpy() for c in some.column_names if c != "v"}, matrix.astype(np.float64)


def cells(batches: Iterator[pa.RecordBatch], most: int = CANDIDATE_BLOCK) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """stacked() of the rows of a task, gathered to cells of bounded rows and bytes."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
            if rows >= most or size >= CANDIDATE_BYTES:
                yield from stacked(held)
                held, rows, size = [], 0, 0
    if held:
        yield from stacked(held)


def against_all(candidates: DataFrame, block: list, search: Callable, schema: str, most: int = CANDIDATE_BLOCK) -> DataFrame:
    """search(block, cells of a task) -> columns of schema, for each task of candidates; the block is sent to all of them."""
    sent = candidates.sparkSession.sparkContext.broadcast(block)
    kinds = candidates.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kinds)
        for found in search(sent.value, cells(batches, most)):
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(found, names, strict=True)], schema=names)

    return candidates.mapInArrow(run, schema)
