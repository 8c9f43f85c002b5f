"""Windows over a stream whose rows come out of order, with late rows marked instead of lost.

Rows wait in the state of their subject's group until the watermark has passed them, then
join the subject's run in order of (ts, seq).  A row that is not later than
what its subject has already given to a run can't be put in order any more; it
comes out by itself, marked ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "subject bigint, kind string, run bigint, widx bigint, label int, len bigint, mean_value double, ts timestamp, seq bigint, value double"
ROW = np.dtype([("subject", "i8"), ("us", "i8"), ("seq", "i8"), ("value", "f8"), ("label", "i4"), ("none", "?")])
PIECE = 1 << 16  # rows that wait in one value
RUN = "run bigint, label int, seen bigint, last_us bigint, last_seq bigint, tail array<double>"
START = (0, None, 0, -(2**62), -1, [])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(run: tuple, rows: list[tuple], length: int, hop: int) -> tuple[tuple, list[tuple]]:
    """The run after some (us, seq, value, label) in order, and the (run, widx, label, mean) of the windows that they end."""
    number, label, seen, last_us, last_seq, tail = run
    tail, out = list(tail), []
    for us, seq, value, now in rows:
        if last_us == START[3] or now != label:
            number, label, seen, tail = number + 1, now, 0, []
        last_us, last_seq = us, seq
        if now is None:
            continue
        seen += 1
        tail = [*tail, value][-length:]
        if seen >= length and (seen - length) % hop == 0:
            out.append((number, (seen - length) // hop, label, sum(tail) / length))
    return (number, label, seen, last_us, last_seq, tail), out


def packed(rows: np.ndarray) -> list[tuple[bytes]]:
    """Rows of ``ROW`` as values of a list state, ``PIECE`` in each at most."""
    return [(rows[at : at + PIECE].tobytes(),) for at in range(0, len(rows), PIECE)]


class OrderedWindows(StatefulProcessor):
    """Works on the subjects of one group together: what waits is kept in packed pieces, each subject's run by itself."""

    def __init__(self, length: int, hop: int):
        self.length, self.hop = length, hop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.runs = handle.getMapState("runs", "subject bigint", RUN)

    def _wake(self, us: int) -> None:
        """One timer a group, for its earliest waiting row."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(us // 1000)

    def _run(self, subject: int) -> tuple:
        return tuple(self.runs.getValue((subject,))) if self.runs.containsKey((subject,)) else START

    def _rows(self, windows: list[tuple], late: list[tuple]) -> pd.DataFrame:
        done = [(subject, "window", run, widx, label, self.length, mean, None, None, None) for subject, run, widx, label, mean in windows]
        done += [(subject, "late", None, None, None if none else label, None, None, pd.Timestamp(us, unit="us"), seq, value) for subject, us, seq, value, label, none in late]
        names = [c.split(" ")[0] for c in OUTPUT.split(", ")]
        out = pd.DataFrame(done, columns=names)
        return out.astype({c: "Int64" for c in ("subject", "run", "widx", "len", "seq")} | {"label": "Int32", "mean_value": "float64", "value": "float64", "ts": "datetime64[us]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, last, first = self.runs.exists(), {}, None
        for part in rows:
            new = np.zeros(len(part), ROW)
            for c in ("subject", "us", "seq", "value"):
                new[c] = part[c].to_numpy()
            new["none"] = part["label"].isna().to_numpy()
            new["label"] = part["label"].fillna(0).to_numpy()
            if before:
                for subject in set(np.unique(new["subject"]).tolist()) - last.keys():
                    last[subject] = self._run(subject)[3:5]
                due = np.array([(us, seq) > last[subject] for subject, us, seq in zip(new["subject"].tolist(), new["us"].tolist(), new["seq"].tolist(), strict=True)], bool)
                if not due.all():
                    yield self._rows([], new[~due].tolist())
                new = new[due]
            if len(new):
                self.waiting.appendList(packed(new))
                first = min(int(new["us"].min()), first if first is not None else 2**62)
        if first is not None:
            known = list(self.handle.listTimers())
            if not known or first // 1000 < min(known):
                self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.concatenate([np.frombuffer(piece, ROW) for (piece,) in self.waiting.get()])
        ready, rest = rows[rows["us"] <= passed], rows[rows["us"] > passed]
        ready = ready[np.lexsort((ready["seq"], ready["us"], ready["subject"]))]
        before, windows = self.runs.exists(), []
        for own in np.split(ready, np.flatnonzero(np.diff(ready["subject"])) + 1) if len(ready) else []:
            subject = int(own["subject"][0])
            each = [(us, seq, value, None if none else label) for _, us, seq, value, label, none in own.tolist()]
            run, ended = advance(self._run(subject) if before else START, each, self.length, self.hop)
            self.runs.updateValue((subject,), run)
            windows += [(subject, *w) for w in ended]
        self.waiting.clear()
        if len(rest):
            self.waiting.put(packed(rest))
            self._wake(int(rest["us"].min()))
        yield self._rows(windows, [])


def ordered_windows(rows: DataFrame, length: int, hop: int, delay: str, groups: int = 256) -> DataFrame:
    """Rows of ``OUTPUT``: ``window`` rows equal to the batch windows over the rows that weren't late, and ``late`` rows.

    ``rows`` has subject, ts, seq, value, label (null: excluded; it ends the
    run).  Rows wait for ``delay`` of event time over all subjects; a
    subject's state is its run and the rows that wait.  Subjects are dealt to
    ``groups`` by a hash, as timers and the hand-over to Python cost so much a
    group and trigger; only runs of subjects with rows are read and written.
    Subjects are not null.  The state store must be RocksDB (``rocksdb``).
    """
    # The watermark is kept, but not on a column that goes on, as Spark would drop what is behind it.
    seen = rows.withWatermark("ts", delay).select(F.pmod(F.xxhash64("subject"), F.lit(groups)).alias("group"), "subject", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("seq").cast("bigint"), F.col("value").cast("double"), F.col("label").cast("int"))
    return seen.groupBy("group").transformWithStateInPandas(OrderedWindows(length, hop), OUTPUT, "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within have their state in RocksDB, which timers and lists need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
