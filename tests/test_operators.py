import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe import schema as S
from strideframe.errors import ArtifactError, DuplicateWindowError, NotFittedError, SchemaError, SplitError, WindowError
from strideframe.functions import latent, signal, spectral
from strideframe.operators import audit, metrics, privacy, splits, standardize, windows
from strideframe.sources import artifacts, recordings, sinks


def labelled(spark, labels):
    rows = [(1, i, l, float(i)) for i, l in enumerate(labels)]
    return spark.createDataFrame(rows, "s int, i int, label int, v double")


def test_runs_merge_or_break_at_excluded_rows(spark):
    rows = labelled(spark, [0, 0, None, None, 0, 0])
    compat = windows.label_runs(rows, ["s"], ["i"], "label", "compat")
    strict = windows.label_runs(rows, ["s"], ["i"], "label", "strict")
    assert [r.run_len for r in compat.orderBy("i").collect()] == [4] * 4
    assert [r.run_len for r in strict.orderBy("i").collect()] == [2] * 4
    with pytest.raises(WindowError):
        windows.label_runs(rows, ["s"], ["i"], "label", "other")


@pytest.mark.parametrize("n, length, hop", [(6, 4, 2), (3, 4, 2), (10, 3, 1), (9, 2, 3), (1, 1, 1)])
def test_windows_start_every_hop_and_are_never_padded(spark, n, length, hop):
    runs = windows.label_runs(labelled(spark, [1] * n), ["s"], ["i"], "label", "strict")
    got = windows.window_table(windows.cut_windows(runs, length, hop), ["s"], "label", {"x": "v"}).orderBy("widx").collect()
    starts = range(0, n - length + 1, hop)
    assert [r.x for r in got] == [[float(a + k) for k in range(length)] for a in starts]
    grid = windows.window_grid(runs, ["s"], [(length, hop)]).first()
    assert grid.n_windows == len(starts)


def test_window_parameters(spark):
    runs = windows.label_runs(labelled(spark, [1]), ["s"], ["i"], "label", "strict")
    with pytest.raises(WindowError):
        windows.cut_windows(runs, 0, 1)


def test_subject_draw_is_the_legacy_shuffle():
    got = splits.draw_subjects([1, 2, 3, 5], 5)
    assert got == {5: "held_out", 1: "validation", 2: "train", 3: "train"}
    with pytest.raises(SplitError):
        splits.draw_subjects([1, 2], 9)


def test_stratified_allocation_is_exact(spark):
    counts = spark.createDataFrame([(0, 5), (1, 5), (2, 5), (3, 5)], "label int, n bigint")
    got = splits.stratified_allocation(counts, "label", "n").collect()
    assert sum(r.n_validation for r in got) == 4 and all(r.n_validation == 1 and r.stratified for r in got)
    few = spark.createDataFrame([(0, 1), (1, 9)], "label int, n bigint")
    assert not any(r.stratified for r in splits.stratified_allocation(few, "label", "n").collect())


def test_scenarios_have_the_declared_sizes(spark):
    real = spark.createDataFrame([(k, i) for k in range(4) for i in range(5)], "label int, i int")
    syn = spark.createDataFrame([(k, i) for k in range(4) for i in range(6)], "label int, i int")
    got = {r.scenario: r["count"] for r in splits.scenario_populations(real, syn, "label", "i", scarce=2, synthetic_cap=3).groupBy("scenario").count().collect()}
    assert got == {"trtr": 20, "scarce": 8, "tstr": 12, "tstr_scarce": 20}


def test_standardizer(spark):
    samples = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 5.0)], "channel int, x double")
    s = standardize.Standardizer().fit(samples)
    assert s.mean == [2.0, 5.0] and s.std == [1.0, standardize.FLOOR]
    w = spark.createDataFrame([([1.0, 3.0, 5.0, 5.0],)], "w array<float>")
    z = w.select(s.apply("w", 2).alias("z"))
    assert z.first().z == [-1.0, 1.0, 0.0, 0.0]
    assert z.select(s.inverse("z", 2).alias("b")).first().b == [1.0, 3.0, 5.0, 5.0]
    with pytest.raises(NotFittedError):
        standardize.Standardizer().apply("w", 2)


def test_audit(spark):
    rows = spark.createDataFrame([("train", "a"), ("train", "a"), ("validation", "a"), ("held_out", "b")], "split string, digest string")
    assert [tuple(r) for r in audit.cross_split_duplicates(rows, "split", "digest").collect()] == [("train", "validation", 1, 2, 1)]
    assert [tuple(r) for r in audit.within_split_duplicates(rows, "split", "digest").collect()] == [("train", 1, 1)]
    with pytest.raises(DuplicateWindowError):
        audit.assert_no_duplicates(rows, "split", "digest")
    w = spark.createDataFrame([([1.0, 2.0],), (None,)], "w array<float>")
    import hashlib

    got = [r.d for r in w.select(audit.window_digest("w").alias("d")).collect()]
    assert got == [hashlib.sha1(np.array([1, 2], np.float32).tobytes()).hexdigest(), None]


def test_metrics(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 3], [0, 1, 1, 1, 0, 3])), "t int, p int")
    cells = metrics.confusion(rows, [], "t", "p", 4)
    f1 = {r.label: r.f1 for r in metrics.class_f1(cells, []).collect()}
    assert f1[2] == 0.0 and f1[3] == 1.0 and f1[1] == pytest.approx(0.8)
    m = metrics.macro_f1_accuracy(cells, []).first()
    assert m.accuracy == pytest.approx(4 / 6) and m.n == 6
    one = spark.createDataFrame([(0.5,), (float("nan"),)], "v double")
    assert tuple(metrics.mean_sample_sd(one, [], "v").first()) == (1, 0.5, 0.0)
    r = spark.createDataFrame([(1, "trtr", 1.0), (1, "tstr", 0.8)], "fold int, scenario string, v double")
    assert {x.scenario: x.retention for x in metrics.retention(r, "fold", "scenario", "v").collect()} == {"trtr": 1.0, "tstr": 0.8 / 1.00000001}
    share = spark.createDataFrame([(0, 0, 0.5), (0, 0, 1.0), (0, 0, float("nan"))], "truth int, pred int, share double")
    assert tuple(metrics.mean_confusions(share).first()) == (0, 0, 0.75, 2)


def test_magnitude_over_is_strict(spark):
    g = 10 * signal.STANDARD_GRAVITY
    points = spark.createDataFrame([(g, 0.0, 0.0), (math.nextafter(g, 1e9), 0.0, 0.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    r = signal.magnitude_summary(points, "x", "y", "z", 10).first()
    assert (r.n_points, r.n_over) == (3, 1)


def test_spectra_match_fft(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(3, 16))
    s = spark.createDataFrame([(w, x[w].tolist()) for w in range(3)], "w int, x array<double>")
    want = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True))) ** 2
    power = spectral.dft_power(s, ["w"], "x", 16)
    assert "Exchange" not in power._jdf.queryExecution().executedPlan().toString()
    for r in power.collect():
        assert r.power == pytest.approx(want[r.w, r.k], abs=1e-9)
    for size in (16, 8, 5, 1):  # segments overlap by half and are averaged
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
        starts = range(0, 16 - size + 1, size - size // 2)
        parts = np.stack([x[:, a : a + size] for a in starts], 1)
        p = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * hann)) ** 2 / (50 * (hann**2).sum())
        p = p.mean(1)
        p[:, [k for k in range(1, p.shape[1]) if 2 * k != size]] *= 2
        got = spectral.welch_psd(s, ["w"], "x", 16, 50.0, nperseg=size).collect()
        assert len(got) == p.size and all(r.psd == pytest.approx(p[r.w, r.k], abs=1e-12) and r.freq == pytest.approx(r.k * 50 / size) for r in got)
    assert spectral.welch_psd(s.where("w > 5"), ["w"], "x", 16, 50.0).count() == 0


def test_spectral_statistics(spark):
    f, real, synthetic = [0.0, 1.0, 2.0, 10.0, 20.0], [0.0, 4.0, 2.0, 1.0, 3.0], [1.0, 2.0, 2.0, 0.5, 0.75]
    rows = [(c, f[i], real[i] * (c == 0), synthetic[i], float(i), 2.0) for c in range(2) for i in range(5)]
    stats = spectral.spectral_statistics(spark.createDataFrame(rows, "channel int, freq double, real double, synthetic double, real_sd double, synthetic_sd double"))
    got = {r.channel: r for r in stats.collect()}
    area = lambda v, a: sum((f[i + 1] - f[i]) * (v[i] + v[i + 1]) / 2 for i in range(4) if f[i] >= a)
    assert got[0].ratio_0_25hz == pytest.approx(area(synthetic, 0) / area(real, 0)) and got[0].ratio_10_25hz == pytest.approx(area(synthetic, 10) / area(real, 10))
    assert got[0].ratio_0_2hz == pytest.approx((1.5 + 2) / (2 + 3)) and got[0].log_psd_corr == pytest.approx(np.corrcoef(np.log(real[1:]), np.log(synthetic[1:]))[0, 1])
    assert got[0].sd_ratio == pytest.approx(np.mean([2 / i for i in range(1, 5)]))
    assert got[1].ratio_0_2hz is None and got[1].log_psd_corr is None
    whole, first = spectral.mean_statistics(stats).first(), spectral.mean_statistics(stats.where("channel = 0")).first()
    assert whole.ratio_10_25hz is None and not whole.attenuated and first.attenuated


@pytest.mark.parametrize("few", [1, 7, 100_000])
def test_exact_percentiles(spark, few):
    from strideframe.functions.percentiles import exact_percentiles

    g = np.random.default_rng(3)
    groups = {0: np.exp(5 * g.normal(size=3000)), 1: np.repeat(2.5, 50), None: g.integers(0, 5, 800).astype(float), 3: np.array([1.0]), 4: np.array([-1e9, 0.1, 0.2, 1e9])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [(9, None)], "k int, x double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.k: tuple(r)[1:] for r in exact_percentiles(df, ["k"], "x", shares, few=few).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, list(shares.values()))), rel=1e-12)
    everything = np.concatenate(list(groups.values()))
    assert exact_percentiles(df, [], "x", {"m": 0.5}, few=few).first().m == pytest.approx(np.median(everything), rel=1e-12)
    assert exact_percentiles(df.where("k = 9"), [], "x", {"m": 0.5}, few=few).count() == 0


def test_band_ratio_and_log_correlation(spark):
    f = [0, 1, 2, 10, 15, 25]
    rows = [("real", float(a), float(i + 1)) for i, a in enumerate(f)] + [("synthetic", float(a), (i + 1) / 2) for i, a in enumerate(f)]
    p = spark.createDataFrame(rows, "kind string, freq double, psd double")
    assert spectral.band_ratio(p, "kind", "real", "synthetic", 0, 25).first().ratio == pytest.approx(0.5)
    pairs = spark.createDataFrame([(float(i + 1), (i + 1) / 2) for i in range(6)], "r double, s double")
    assert spectral.log_correlation(pairs, "r", "s").first().log_psd_corr == pytest.approx(1)


def test_latent(spark):
    one = spark.createDataFrame([([1.0, 2.0], [5.0, 6.0])], "z0 array<double>, z1 array<double>")
    z0, z1 = F.col("z0"), F.col("z1")
    assert one.select(latent.interpolate(z0, z1, F.lit(0.25)).alias("z")).first().z == [2.0, 3.0]
    assert one.select(latent.mean_square(z0, z1).alias("m")).first().m == 16.0
    end = latent.euler_trajectory(one.withColumn("v", latent.velocity(z0, z1)), "z1", "v", 2, 1).where("step = 2").first()
    assert end.state == [1.0, 2.0]
    seg = spark.createDataFrame([(0, [0.0, 1.0, 2.0, 3.0]), (1, [10.0, 11.0, 12.0, 13.0])], "s int, v array<double>").withColumn("g", F.lit(1))
    got = [r.value for r in latent.overlap_add(seg, ["g"], "s", "v", 4, 2, 6).orderBy("at").collect()]
    assert got == [0.0, 1.0, 2.0, 7.0, 12.0, 13.0]
    assert latent.segments_needed(500, 160, 40) == 4
    assert one.select(latent.website_seed(42, F.lit(2), F.lit(1)).alias("s")).first().s == 2142


def test_privacy(spark):
    a = spark.createDataFrame([(0, 0.099, 1.0), (0, 0.1, 1.0), (0, 0.101, 1.0)], "fold int, l2 double, b double")
    per = privacy.reconstruction_success(a, "fold", "l2", "b")
    assert per.first().n_success == 1
    r = spark.createDataFrame([("true", 0.48), ("true", 0.52), ("best", 0.51), ("best", 0.53)], "m string, auc double")
    assert {x.m: round(x["mean"], 9) for x in privacy.membership_summary(r, "m", "auc").collect()} == {"true": 0.5, "best": 0.52}


def test_log_source(spark, tmp_path):
    line = lambda label, k: "\t".join(["0.0"] * 80 + [str(1000.0 + k + c) for c in range(6)] + ["0.0"] * 33 + [str(label)])
    (tmp_path / "subject01_ideal.log").write_text("\n".join(line(l, i) for i, l in enumerate([1, 1, 99, 3])) + "\n")
    (tmp_path / "notes.txt").write_text("x")
    got = recordings.read_logs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.subject, r.seq, r.raw_label) for r in got] == [(1, 0, 1), (1, 1, 1), (1, 2, 99), (1, 3, 3)]
    assert got[0].ch == [1000.0, 1001.0, 1002.0, 1003.0, 1004.0, 1005.0]
    assert len(recordings.read_logs(spark, str(tmp_path), "three_channel").first().ch) == 3
    with pytest.raises(SchemaError):
        recordings.discover_logs(spark, str(tmp_path), [2])
    (tmp_path / "subject02_ideal.log").write_text("1\t2\n")
    with pytest.raises(SchemaError):
        recordings.read_logs(spark, str(tmp_path))
    assert recordings.subject_of("Subject007_ideal.log") == 7


def test_csv_source(spark, tmp_path):
    (tmp_path / "harth").mkdir()
    start = dt.datetime(2020, 1, 1)
    rows = ["timestamp,back_x,back_y,back_z,thigh_x,thigh_y,thigh_z,label"]
    rows += [f"{(start + dt.timedelta(milliseconds=20 * i)).isoformat(timespec='milliseconds')},0,0,0,{i}.0,1.0,2.0,{6 if i < 5 else 99}" for i in range(8)]
    (tmp_path / "harth" / "S006.csv").write_text("\n".join(rows) + "\n")
    got = recordings.read_csv_recordings(spark, str(tmp_path), "harth").orderBy("seq").collect()
    assert [r.label for r in got] == [8] * 5 + [-1] * 3 and got[3].ch == [3.0, 1.0, 2.0] and got[0].subject == "harth:S006"
    wrong = {
        "header": "a,b\n1,2\n", "order": "\n".join(rows[:3] + rows[4:5] + rows[3:4] + rows[5:]), "repeat": "\n".join(rows[:4] + rows[3:]),
        "one row": "\n".join(rows[:2]), "no row": rows[0], "number": "\n".join([*rows[:-1], rows[-1].replace("7.0", "inf")]), "fields": "\n".join([*rows, "x"]),
    }
    for text in wrong.values():
        (tmp_path / "harth" / "S007.csv").write_text(text + "\n")
        with pytest.raises(SchemaError):
            recordings.read_csv_recordings(spark, str(tmp_path), "harth")
    (tmp_path / "harth" / "S007.csv").write_text("\n".join(rows) + "\n")
    assert recordings.read_csv_recordings(spark, str(tmp_path), "harth", ["harth:S007"]).select("subject").distinct().collect() == [("harth:S007",)]
    with pytest.raises(SchemaError):
        recordings.read_csv_recordings(spark, str(tmp_path), "harth", ["harth:S008"])


def test_artifacts_and_sinks(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    entry = {"filename": "a.bin", "role": "model", "bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}
    artifacts.require_verified(spark, [entry], str(tmp_path))
    artifacts.require_verified(spark, [entry | {"sha256": entry["sha256"].upper()}], str(tmp_path))
    with pytest.raises(ArtifactError):
        artifacts.require_verified(spark, [entry | {"bytes": 4}], str(tmp_path))
    with pytest.raises(ArtifactError):
        artifacts.check_entries([entry, entry])
    assert artifacts.identity({"b": 1, "a": 2}) == artifacts.identity({"a": 2, "b": 1})
    out = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame([(1, 0.5)], "n int, f1 double"), out)
    assert json.loads("".join(p.read_text() for p in (tmp_path / "report").glob("part*.json"))) == {"n": 1, "f1": 0.5}
    with pytest.raises(Exception, match="exists"):
        sinks.write_report(spark.createDataFrame([(1,)], "n int"), out)
    with pytest.raises(SchemaError):
        sinks.write_report(spark.createDataFrame([([1.0],)], "windows array<double>"), out + "2")
    with pytest.raises(SchemaError):
        sinks.write_report(spark.createDataFrame([(float("nan"),)], "f1 double"), out + "3")


def test_schema_checks(spark):
    assert S.class_id("running") == 1 and S.class_id(3) == 3
    for bad in ("flying", True, 9):
        with pytest.raises(SchemaError):
            S.class_id(bad)
    with pytest.raises(SchemaError):
        S.check_mapping({1: 1}, S.LOG_LABELS)
    with pytest.raises(SchemaError):
        S.require_windows(spark.createDataFrame([([1.0],)], "w array<double>"), "w", 1, 2)
