"""Fold runs side by side, one call for all folds, and steps that depend on the state."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.errors import ArtifactError, SplitError
from strideframe.functions import latent
from strideframe.plans import folds, loso


def test_folds_run_side_by_side(spark, tmp_path):
    meet = threading.Barrier(3, timeout=60)  # passes only when three folds are under way at once

    def one(fold):
        meet.wait()
        return spark.range(fold)

    got = folds.run_folds(spark, one, [1, 2, 3], str(tmp_path / "a"), {"seed": 1}, parallel=3).collect()
    assert [(r.fold, r.status) for r in got] == [("1", "ran"), ("2", "ran"), ("3", "ran")]


def test_a_failure_cancels_the_other_folds(spark, tmp_path):
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    root = str(tmp_path / "b")

    def one(fold):
        if fold == 2:
            time.sleep(3)
            raise RuntimeError("broken")
        return spark.range(0, 2000, 1, 2).select(slow("id").alias("id"))  # 200 s

    began = time.time()
    got = {r.fold: r.status for r in folds.run_folds(spark, one, [1, 2, 3], root, {"seed": 1}, parallel=2, stop_on_failure=True).collect()}
    assert got == {"1": "cancelled", "2": "failed", "3": "cancelled"} and time.time() - began < 100
    assert not folds.completed(spark, root, 1, folds.identity({"seed": 1}))
    assert spark.range(10).count() == 10  # later jobs are not cancelled


def table(spark, n=60):
    g = np.random.default_rng(0)
    rows = [(i, f"s{i % 3}", i // 3 % 2, (g.normal(size=4) * 0.1 + i // 3 % 2).tolist(), i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, subject string, y int, x array<double>, made boolean")


def test_loso_from_one_call(spark, tmp_path, monkeypatch):
    df, root = table(spark), str(tmp_path / "loso")
    names = {"subject": "subject", "label": "y", "flat": "x", "key": "id", "classes": 2, "trees": 3}
    real, made = df.where("not made"), df.where("made")
    calls = []
    plain = loso.evaluate_scenarios

    def counted(real, test, *a, **k):
        calls.append((real.select("subject").distinct().count(), test.select("subject").distinct().count()))
        if len(calls) == 2:
            raise RuntimeError("lost")
        return plain(real, test, *a, **k)

    monkeypatch.setattr(loso, "evaluate_scenarios", counted)
    with pytest.raises(ArtifactError, match="lost"):
        loso.run_loso(real, root, synthetic=made, parallel=1, **names)
    records, summary = loso.run_loso(real, root, synthetic=made, parallel=2, **names)  # goes on with the two folds that are left
    assert calls == [(2, 1)] * 4
    assert sorted((r.fold, r.scenario) for r in records.collect()) == sorted((s, x) for s in ("s0", "s1", "s2") for x in ("trtr", "scarce", "tstr", "tstr_scarce"))
    assert all(r.accuracy == 1.0 and r.n == 16 for r in records.where("scenario = 'trtr'").collect())
    got = summary.collect()
    assert [(r.scenario, r.n_folds) for r in got] == [("trtr", 3), ("scarce", 3), ("tstr", 3), ("tstr_scarce", 3)] and got[0].macro_f1_mean == 1.0 and got[0].macro_f1_sd == 0.0
    loso.run_loso(real, root, synthetic=made, parallel=2, **names)
    assert len(calls) == 4
    loso.run_loso(real.where("id <> 1"), root, synthetic=made, held_out=["s2"], parallel=2, **names)  # other windows: the fold runs again
    assert len(calls) == 5
    for bad in (["other"], []):
        with pytest.raises(SplitError):
            loso.run_loso(real, root, synthetic=made, held_out=bad, **names)
    own = made.withColumn("of", F.col("subject"))
    records, _ = loso.run_loso(real, str(tmp_path / "own"), synthetic=own, synthetic_subject="of", held_out=["s1"], scenarios=["TSTR"], **names)
    assert [(r.scenario, r.n_train) for r in records.collect()] == [("tstr", made.where("subject = 's1'").count())]


def test_euler_states_follow_the_field(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([0.0, 4.0],)], "z array<double>")
    field = lambda z, t: F.transform(z, lambda a: a * a * 0.1 + t)
    for steps, every in ((1, None), (7, None), (7, 3), (4, 2), (3, 10)):
        for (z,), (got,) in zip(df.collect(), df.select(latent.euler_states(F.col("z"), field, steps, every)).collect(), strict=True):
            want, now = [(0, 1.0, list(z))], list(z)
            for k in range(steps):
                now = [a - (a * a * 0.1 + max(0.0, 1.0 - k / steps)) / steps for a in now]
                if every is None or (k + 1) % every == 0 or k + 1 == steps:
                    want.append((k + 1, max(0.0, 1.0 - (k + 1) / steps), now))
            assert [s.step for s in got] == [w[0] for w in want]
            assert np.allclose([s.t for s in got], [w[1] for w in want]) and np.allclose([s.state for s in got], [w[2] for w in want])
    for bad in ((0, None), (3, 0)):
        with pytest.raises(ValueError):
            latent.euler_states(F.col("z"), field, *bad)
