"""Batches of a stream that takes long, and of a large one."""

import time
from types import SimpleNamespace

import pytest

from lexvane.plans import stateful


def test_slow_streams_run_to_their_end(spark, small, monkeypatch):
    clock = iter(range(0, 10**9, 1000))  # each look at the clock is 1,000 seconds later
    monkeypatch.setattr(stateful, "time", SimpleNamespace(sleep=time.sleep, monotonic=lambda: next(clock)))
    row = stateful.micro_batches(spark, small).first()
    assert (row["samples"], row["repeated"], row["unfinished"]) == (1000, 0, 0) and row["largest"] <= 16


def test_shards_grow_with_the_input():
    assert [stateful._shards(n) for n in (0, 1_000, 100_000, 10**9)] == [4, 4, 10, 100_000]


def test_streams_without_progress_are_errors(spark, small, monkeypatch):
    batch = stateful.scoring.micro_batch
    monkeypatch.setattr(stateful.scoring, "micro_batch", lambda *a, timeout_ms, **k: batch(*a, timeout_ms=3_600_000, **k))
    monkeypatch.setattr(stateful, "QUIET_REPORTS", 3)
    with pytest.raises(RuntimeError, match="stay in the stream"):
        stateful.micro_batches(spark, small)
