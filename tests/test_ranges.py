"""Recordings read in ranges of bytes, and runs of a subject that no task sees whole."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strideframe import schema as S
from strideframe.errors import SchemaError
from strideframe.operators import windows
from strideframe.sources import recordings


@pytest.fixture
def small_ranges(spark):
    """Ranges of some lines each."""
    names = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def csv_lines(labels, index=False, seed=0):
    g = random.Random(seed)
    lines = [",".join(S.csv_schema(index).names)]
    for i, label in enumerate(labels):
        ts = (datetime(2020, 1, 1) + timedelta(milliseconds=20 * i)).isoformat(sep=" ", timespec="milliseconds")
        lines.append(",".join([ts, *([str(i)] if index else []), *[f"{g.random():.6f}" for _ in range(6)], str(label)]))
    return lines


def test_a_recording_over_several_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "harth").mkdir()
    files = {"S001": csv_lines([2, 7, 99] * 20, seed=1), "S 2": csv_lines([13] * 50, index=True, seed=2), "S003": csv_lines([6, 6], seed=3)}
    ends = {"S001": "\n", "S 2": "\r\n", "S003": "\n"}
    for name, lines in files.items():
        (tmp_path / "harth" / f"{name}.csv").write_bytes((("﻿" if name == "S003" else "") + ends[name].join(lines) + (ends[name] if name != "S003" else "")).encode())
    got = recordings.read_csv_recordings(spark, str(tmp_path), "harth", ["harth:S003", "harth:S001", "harth:S 2"])
    for name in files:
        (tmp_path / "harth" / f"{name}.csv").unlink()  # the files were read once; rows, checks and counts come of what that pass stored
    assert got.select("subject", "block").distinct().where("subject = 'harth:S001'").count() > 5
    rows = got.orderBy("place", "seq").collect()
    assert [r.subject for r in rows] == ["harth:S003"] * 2 + ["harth:S001"] * 60 + ["harth:S 2"] * 50
    for name, lines in files.items():
        own = [r for r in rows if r.subject == f"harth:{name}"]
        assert [r.seq for r in own] == list(range(len(lines) - 1))
        for r, line in zip(own, lines[1:], strict=True):
            v = line.split(",")
            assert [f"{x:.6f}" for x in r.ch] == [f"{float(x):.6f}" for x in v[-4:-1]] and r.raw_label == int(v[-1]) and r.ts == datetime.fromisoformat(v[0])
            assert r.label == S.CSV_LABELS["harth"].get(r.raw_label, S.EXCLUDED)


@pytest.mark.parametrize(
    "spoil",
    [
        lambda x: x[1:],  # no header
        lambda x: [*x[:30], x[0], *x[30:]],  # a header in the middle
        lambda x: [*x[:40], x[41], x[40], *x[42:]],  # two times swapped
        lambda x: [*x[:40], x[40] + ",1", *x[41:]],  # a row of the other header's fields
        lambda x: [*x[:40], "", *x[40:]],  # a blank line
        lambda x: [*x[:50], x[50].replace("0.", "nan0.", 1), *x[51:]],
        lambda x: [*x[:50], x[50][:-1] + "1.5", *x[51:]],
        lambda x: x[:2],  # one row
        lambda x: x[:1],
        lambda x: [],
        lambda x: [x[0], *x[1::2]],  # half the rate
    ],
)
def test_errors_wherever_they_stand(spark, tmp_path, small_ranges, spoil):
    (tmp_path / "harth").mkdir()
    (tmp_path / "harth" / "S001.csv").write_text("\n".join(csv_lines([2] * 60)) + "\n")
    lines = spoil(csv_lines([2] * 60, seed=5))
    (tmp_path / "harth" / "S002.csv").write_text("\n".join(lines) + "\n" * bool(lines))
    with pytest.raises(SchemaError):
        recordings.read_csv_recordings(spark, str(tmp_path), "harth")
    assert recordings.read_csv_recordings(spark, str(tmp_path), "harth", ["harth:S001"]).count() == 60  # what isn't asked for isn't checked


def test_logs_over_several_ranges(spark, tmp_path, small_ranges):
    g = random.Random(2)
    lines = {s: ["\t".join([str(g.randint(0, 9))] * 119 + [str(s + i % 4)]) for i in range(25)] for s in (3, 11)}
    for s, own in lines.items():
        (tmp_path / f"subject{s:02d}_ideal.log").write_text("\n".join(own) + "\n")
    got = recordings.read_logs(spark, str(tmp_path), subjects=[11, 3]).orderBy("place", "seq").collect()
    assert [(r.subject, r.seq, r.raw_label) for r in got] == [(s, i, s + i % 4) for s in (11, 3) for i in range(25)]
    assert [list(r.ch) for r in got] == [[float(x) for x in lines[s][i].split("\t")[80:86]] for s in (11, 3) for i in range(25)]
    (tmp_path / "subject04_ideal.log").write_text("")
    with pytest.raises(SchemaError):
        recordings.read_logs(spark, str(tmp_path))
    (tmp_path / "subject04_ideal.log").write_text("\n".join([*lines[3][:20], lines[3][0] + "\t1"]))
    with pytest.raises(SchemaError, match="columns"):
        recordings.read_logs(spark, str(tmp_path))


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_runs_by_parts_equal_runs(spark, mode):
    """One subject has most rows, and runs over many parts; null subjects, labels and parts of one run too."""
    g = random.Random(1)
    rows = []
    for s, n in ((1, 400), (2, 5), (3, 1), (None, 30), (4, 60)):
        label = 0
        for i in range(n):
            if g.random() < (0.02 if s == 1 and i > 200 else 0.4):
                label = g.choice([0, 1, 2, None])
            rows.append((s, i // 2, i % 2, label, float(i)))
    df = spark.createDataFrame(rows, "s int, t int, u int, label int, x double").repartition(3)
    want = windows.label_runs(df, ["s"], ["t", "u"], "label", mode)
    for parts in (1, 7, 40):
        dealt = windows.range_parts(df, ["s"], ["t", "u"], parts=parts)
        most = dealt.groupBy("part").count().agg(F.max("count")).first()[0]
        assert parts == 1 or most < 400
        got = windows.label_runs_by_parts(dealt, ["s"], ["t", "u"], "label", mode, "part")
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_runs_by_the_ranges_of_a_file(spark, tmp_path, small_ranges):
    (tmp_path / "harth").mkdir()
    (tmp_path / "harth" / "S001.csv").write_text("\n".join(csv_lines([2] * 25 + [99] * 3 + [7] * 40 + [2, 7] * 5)) + "\n")
    rows = recordings.read_csv_recordings(spark, str(tmp_path), "harth").select("subject", "seq", "block", F.nullif("label", F.lit(S.EXCLUDED)).alias("label"))
    got = windows.label_runs_by_parts(rows, ["subject"], ["seq"], "label", "strict", "block").orderBy("seq").collect()
    want = windows.label_runs(rows.drop("block"), ["subject"], ["seq"], "label", "strict").orderBy("seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    none = rows.limit(0)
    assert windows.label_runs_by_parts(none, ["subject"], ["seq"], "label", "strict", "block").count() == 0
