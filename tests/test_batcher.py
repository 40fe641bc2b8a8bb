"""Batches of one shard, without a stream."""

from types import SimpleNamespace

import pandas as pd

from lexvane.streaming.scoring import _Batcher


class Value:
    def __init__(self):
        self.held, self.updates = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held, self.updates = value, self.updates + 1

    put = update

    def clear(self):
        self.held = None


def test_state_is_kept_once_for_many_batches():
    value, pending, timers = Value(), Value(), []
    handle = SimpleNamespace(getListState=lambda *a: pending, getValueState=lambda *a: value, listTimers=lambda: iter(timers), deleteTimer=timers.remove, registerTimer=timers.append)

    def score(batch):
        if 40 in list(batch["sample"]):
            raise RuntimeError("no")
        return [None if s % 5 == 0 else s / 2 for s in batch["sample"]]

    b = _Batcher(16, 1_000, "sample long, `x` string", score, "mark")
    b.init(handle)
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
    frame = lambda a, z: pd.DataFrame({"sample": range(a, z), "x": [None if i % 2 else "y" for i in range(a, z)]})
    out = list(b.handleInputRows((3,), iter([frame(0, 500), frame(500, 1000)]), now))
    assert len(out) == 2 and value.updates == 2 and timers == [1_005]
    out += list(b.handleExpiredTimer((3,), now, None))
    rows = pd.concat(out, ignore_index=True)
    assert list(rows["sample"]) == list(range(1000)) and list(rows["batch"]) == [i // 16 for i in range(1000)] and set(rows["shard"]) == {3}
    for s, status, result, error in zip(rows["sample"], rows["status"], rows["result"], rows["error"], strict=True):
        if 32 <= s < 48:
            assert status == "failed" and result != result and error == "RuntimeError: no"
        elif s % 5 == 0:
            assert status == "gave up" and result != result and error is None
        else:
            assert status == "scored" and result == s / 2 and error is None
