"""Subjects of one group share a timer and the pieces that wait; their runs stay apart."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from test_ordered_stream import batch_windows, split, written

from strideframe.streaming import ordered
from strideframe.streaming.windows import run_available

START = datetime(2020, 1, 1)


class Handle:
    """Keeps one group's state and counts what is asked of it."""

    def __init__(self):
        self.timers, self.pieces, self.runs, self.asked = [], [], {}, 0

    def getListState(self, name, schema):  # noqa: N802
        return SimpleNamespace(appendList=self.pieces.extend, get=lambda: iter(list(self.pieces)), clear=self.pieces.clear, put=self.pieces.extend)

    def getMapState(self, name, key, schema):  # noqa: N802
        return SimpleNamespace(exists=lambda: bool(self.runs), containsKey=self.runs.__contains__, getValue=self.runs.__getitem__, updateValue=self.runs.__setitem__)

    def listTimers(self):  # noqa: N802
        self.asked += 1
        return iter(list(self.timers))

    def registerTimer(self, ms):  # noqa: N802
        self.asked += 1
        self.timers.append(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.remove(ms)


def test_many_subjects_cost_one_timer_and_one_output():
    handle, op = Handle(), ordered.OrderedWindows(2, 1)
    op.init(handle)
    part = pd.DataFrame([(s, 1000 * i, i, float(i), 0) for i in range(3) for s in range(500)], columns=["subject", "us", "seq", "value", "label"])
    assert list(op.handleInputRows((0,), iter([part]), None)) == []
    assert handle.timers == [0] and len(handle.pieces) == 1 and handle.asked <= 3
    handle.timers.clear()
    (out,) = op.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1), None)
    assert sorted(out["subject"]) == list(range(500)) and set(out["mean_value"]) == {0.5}
    assert handle.timers == [2] and len(handle.pieces) == 1 and len(handle.runs) == 500


def test_subjects_in_few_groups_give_the_batch_windows_and_late_rows(spark, tmp_path):
    g = random.Random(7)
    at = lambda i: START + timedelta(seconds=i)
    rows = [(s, at(i // 2), i, float(i), g.choice([0, 0, 0, 1, None])) for i in range(40) for s in range(30)]
    rows.sort(key=lambda r: r[1] + timedelta(seconds=g.random() * 4))
    flush = [[(99, at(1000), 0, 0.0, None)], [(99, at(2000), 1, 0.0, None)]]
    late = [(s, at(3), 1000 + s, 7.0, None if s % 2 else 1) for s in range(5)]
    stream = written(spark, str(tmp_path / "in"), [rows[:500], rows[500:], *flush, late])
    with ordered.rocksdb(spark):
        done, behind = split(run_available(ordered.ordered_windows(stream, 3, 2, "5 seconds", groups=2), str(tmp_path / "out")))
    assert done == batch_windows(spark, rows, 3, 2) and len(done) > 100
    assert behind == [(s, ts, seq, value) for s, ts, seq, value, _ in late]
