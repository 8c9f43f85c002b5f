"""Streams out of order: windows equal the batch, late rows come out marked."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strideframe.operators import windows
from strideframe.streaming import ordered
from strideframe.streaming.windows import run_available

SCHEMA = "subject bigint, ts timestamp, seq bigint, value double, label int"
START = datetime(2020, 1, 1)


def batch_windows(spark, rows, length, hop):
    df = spark.createDataFrame(rows, SCHEMA)
    cut = windows.cut_windows(windows.label_runs(df, ["subject"], ["ts", "seq"], "label", "strict"), length, hop)
    got = cut.groupBy("subject", "run", "widx").agg(F.max("label").alias("label"), F.avg("value").alias("mean"))
    return sorted((r.subject, r.run, r.widx, r.label, round(r.mean, 9)) for r in got.collect())


def written(spark, path, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def split(out):
    rows = out.collect()
    done = sorted((r.subject, r.run, r.widx, r.label, round(r.mean_value, 9)) for r in rows if r.kind == "window")
    return done, sorted((r.subject, r.ts, r.seq, r.value) for r in rows if r.kind == "late")


def test_shuffled_rows_give_the_batch_windows(spark, tmp_path):
    g = random.Random(4)
    rows = []
    for s in range(4):
        label = 0
        for i in range(120):
            if g.random() < 0.15:
                label = g.choice([0, 1, None])
            rows.append((s, START + timedelta(seconds=i // 2), i, float(i), label))
    rows.sort(key=lambda r: (r[1] + timedelta(seconds=g.random() * 9)))  # up to nine seconds out of order
    assert rows != sorted(rows, key=lambda r: r[1])
    flush = [(99, START + timedelta(days=1), 0, 0.0, None)]
    stream = written(spark, str(tmp_path / "in"), [rows[i : i + 96] for i in range(0, len(rows), 96)] + [flush, [(99, START + timedelta(days=2), 1, 0.0, None)]])
    with ordered.rocksdb(spark):
        done, late = split(run_available(ordered.ordered_windows(stream, 4, 2, "10 seconds"), str(tmp_path / "out")))
    assert late == [] and done == batch_windows(spark, rows, 4, 2) and len(done) > 50


def test_late_rows_come_out_marked(spark, tmp_path):
    at = lambda i: START + timedelta(seconds=i)
    row = lambda s, i, label=0: (s, at(i), i, float(i), label)
    first = [row(1, i) for i in (0, 1, 2, 4, 5)] + [row(2, 50)]
    files = [first, [row(2, 51)], [row(1, 3), row(1, 5), row(1, 48), row(2, 49)], [row(2, 1000)], [row(2, 2000)], [row(1, 2)]]
    stream = written(spark, str(tmp_path / "in"), files)
    with ordered.rocksdb(spark):
        done, late = split(run_available(ordered.ordered_windows(stream, 2, 1, "5 seconds"), str(tmp_path / "out")))
    assert late == [(1, at(2), 2, 2.0), (1, at(3), 3, 3.0), (1, at(5), 5, 5.0)]
    # 49 of subject 2 is behind the watermark but in order for its subject, so it isn't late
    kept = [*first, row(1, 48), row(2, 49), row(2, 51), row(2, 1000)]
    assert done == batch_windows(spark, kept, 2, 1)


def test_a_stream_is_taken_up_again_with_what_waits(spark, tmp_path):
    at = lambda i: START + timedelta(seconds=i)
    row = lambda i: (1, at(i), i, float(i), 0)
    path = str(tmp_path / "in")
    written(spark, path, [[row(1), row(0)], [row(3)]])
    with ordered.rocksdb(spark):
        run_available(ordered.ordered_windows(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), 2, 1, "10 seconds"), str(tmp_path / "out"))
        for i, rows in enumerate([[row(2)], [(9, at(500), 0, 0.0, None)], [(9, at(900), 1, 0.0, None)]]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/more{i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
        done, late = split(run_available(ordered.ordered_windows(stream, 2, 1, "10 seconds"), str(tmp_path / "out")))
    assert late == [] and done == batch_windows(spark, [row(i) for i in range(4)], 2, 1)


@pytest.mark.parametrize("cut", range(6))
def test_advance_goes_on_anywhere(cut):
    rows = [(i, i, float(i), label) for i, label in enumerate([0, 0, None, 1, 1, 1])]
    whole = ordered.advance(ordered.START, rows, 2, 1)
    run, first = ordered.advance(ordered.START, rows[:cut], 2, 1)
    run, second = ordered.advance(run, rows[cut:], 2, 1)
    assert (run, first + second) == whole and whole[1] == [(1, 0, 0, 0.5), (3, 0, 1, 3.5), (3, 1, 1, 4.5)]
