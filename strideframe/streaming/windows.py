"""Sample-count windows over a stream (an extension: the batch operators define the result).

Per subject the state is the current run: its label, how many samples it has
had, and the last ``length`` values.  Samples are ordered within a trigger;
one that is not later than what its subject has already given is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "subject bigint, run bigint, widx bigint, label int, len bigint, mean_value double"
STATE = "run bigint, label int, seen bigint, last_us bigint, last_id bigint, tail array<double>"


def stream_windows(rows: DataFrame, length: int, hop: int) -> DataFrame:
    """``rows`` has subject, ts, seq, value, label (null: excluded; it ends the run)."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, label, seen, last_us, last_id, tail = state.get if state.exists else (0, None, 0, -(2**62), -1, [])
        tail, out = list(tail), []
        pdf = pd.concat(list(parts)).sort_values(["ts", "seq"])
        for ts, seq, value, now in zip(pdf["ts"], pdf["seq"], pdf["value"], pdf["label"], strict=True):
            us = int(ts.value // 1000)
            if (us, seq) <= (last_us, last_id):
                continue
            first = last_us == -(2**62)
            last_us, last_id = us, int(seq)
            now = None if pd.isna(now) else int(now)
            if first or now != label:
                run, label, seen, tail = run + 1, now, 0, []
            if now is None:
                continue
            seen += 1
            tail = [*tail, float(value)][-length:]
            if seen >= length and (seen - length) % hop == 0:
                out.append((key[0], run, (seen - length) // hop, label, length, sum(tail) / length))
        state.update((run, label, seen, last_us, last_id, tail))
        yield pd.DataFrame(out, columns=["subject", "run", "widx", "label", "len", "mean_value"])

    return rows.groupBy("subject").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(out: DataFrame, path: str) -> DataFrame:
    """Run a stream over what its source holds by now into ``path``; state and progress stay in ``path-state`` for the next call."""
    q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)
