"""Preparation, evaluation, fold runs, array files and reports."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe import schema as S
from strideframe.errors import ArtifactError, DuplicateWindowError, SchemaError, SplitError
from strideframe.functions import latent
from strideframe.operators import evaluate, privacy, windows
from strideframe.plans import catalogue, folds, preparation
from strideframe.sources import artifacts, arrays, sinks

SF = "/root/testdata/sf0.001"


def recording(path, labels, seed):
    g = np.random.default_rng(seed)
    lines = ["timestamp," + ",".join(S.CSV_FIELDS) + ",label"]
    for i, label in enumerate(labels):
        ms = 20 * i
        lines.append(f"2020-01-01 00:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}," + ",".join(f"{v:.6f}" for v in g.normal(size=6)) + f",{label}")
    path.write_text("\n".join(lines) + "\n")


def test_prepare_csv(spark, tmp_path):
    (tmp_path / "harth").mkdir()
    for k in range(5):
        recording(tmp_path / "harth" / f"S{k:03d}.csv", [2] * 12 + [99] * 2 + [7] * 9, k)
    got = preparation.prepare_csv(spark, str(tmp_path), "harth", length=4, hop=2)
    assert got.metadata["counts"] == {"train": 3 * 8, "validation": 8, "held_out": 8} and got.metadata["split"]["held_out"] == "harth:S000"
    own = got.metadata["per_subject"]["harth:S003"]
    assert own["window_count"] == 8 and own["excluded_row_count"] == 2 and own["class_counts"]["running"] == 5 and own["class_counts"]["sitting"] == 3
    train = np.array([r.z for r in got.windows.where("split = 'train'").collect()]).reshape(-1, 3, 4)
    assert np.allclose(train.mean(axis=(0, 2)), 0, atol=1e-5) and np.allclose(train.std(axis=(0, 2)), 1, atol=1e-5)
    assert not got.standardizer.subjects & {"harth:S000", *got.metadata["split"]["validation"]}
    recording(tmp_path / "harth" / "S009.csv", [2] * 12, 1)  # begins like S001
    with pytest.raises(DuplicateWindowError):
        preparation.prepare_csv(spark, str(tmp_path), "harth", length=4, hop=2)
    with pytest.raises(SplitError):
        preparation.prepare_csv(spark, str(tmp_path), "harth", length=4, hop=2, fraction=1.0)


def test_prepare_keeps_a_fold_without_training_windows(spark):
    rows = spark.createDataFrame([(s, i, [float(i + 10 * s)], 0) for s in (1, 2) for i in range(6 if s == 1 else 2)], "subject int, seq long, ch array<double>, label int")
    got = preparation.prepare(rows, 1, channels=1, classes=("a",), mode="compat", length=3, hop=3, empty="keep", within=False)
    assert got.standardizer is None and got.metadata["counts"] == {"train": 0, "validation": 0, "held_out": 2}
    assert sorted(r.z for r in got.windows.collect()) == [[10.0, 11.0, 12.0], [13.0, 14.0, 15.0]]
    with pytest.raises(SplitError):
        preparation.prepare(rows, 1, channels=1, classes=("a",), mode="compat", length=3, hop=3)


def test_evaluate_scenarios(spark):
    g = np.random.default_rng(0)
    rows = [(i, i % 3, (g.normal(size=4) * 0.1 + i % 3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    real, test, synthetic = df.where("id < 24"), df.where("id >= 24 and id < 36"), df.where("id >= 36")
    got = evaluate.evaluate_scenarios(real, test, synthetic, "y", "x", "id", 3, trees=5).collect()
    assert [r.scenario for r in got] == list(evaluate.SCENARIOS) and [r.n_train for r in got] == [24, 6, 24, 30]
    assert all(r.n == 12 and r.accuracy == 1.0 for r in got if r.scenario != "scarce") and got[0].retention == 1.0
    only = evaluate.evaluate_scenarios(real, test, synthetic, "y", "x", "id", 3, scenarios=["TSTR"], trees=5).collect()
    assert [r.scenario for r in only] == ["tstr"] and only[0].retention == pytest.approx(only[0].macro_f1 / (1 + 1e-8))
    for bad in ([], ["other"]):
        with pytest.raises(SplitError):
            evaluate.evaluate_scenarios(real, test, synthetic, "y", "x", "id", 3, scenarios=bad)
    with pytest.raises(SplitError):
        evaluate.evaluate_scenarios(real, test, None, "y", "x", "id", 3)


def test_folds_are_taken_up_again(spark, tmp_path):
    root, calls, broken = str(tmp_path / "run"), [], {2}

    def one(fold):
        calls.append(fold)
        if fold in broken:
            raise RuntimeError("no")
        return spark.range(fold + 3).withColumn("v", F.lit(fold))

    states = lambda **more: {r.fold: r.status for r in folds.run_folds(spark, one, [1, 2, 3], root, {"seed": 1}, **more).collect()}
    assert states(dry_run=True) == {"1": "planned", "2": "planned", "3": "planned"} and not calls
    assert states() == {"1": "ran", "2": "failed", "3": "ran"}
    with pytest.raises(ArtifactError):
        folds.fold_results(spark, [1, 2], root, {"seed": 1})
    broken.clear()
    spark.range(1).withColumn("v", F.lit(0)).write.mode("overwrite").parquet(f"{root}/results/3")  # no longer what the manifest says
    calls.clear()
    assert states() == {"1": "skipped", "2": "ran", "3": "ran"} and calls == [2, 3]
    assert folds.fold_results(spark, [1, 2, 3], root, {"seed": 1}).groupBy("fold").count().orderBy("fold").collect() == [("1", 4), ("2", 5), ("3", 6)]
    assert not folds.completed(spark, root, 1, folds.identity({"seed": 2}))
    with pytest.raises(ArtifactError):
        states(resume=False)


def test_array_files(spark, tmp_path):
    x = np.arange(2 * 3 * 4, dtype=np.float64).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", input=x, other=x[0])
    np.savez(tmp_path / "c.npz", one=x, two=x)
    np.save(tmp_path / "d.npy", x[0])
    for name in ("a.npy", "b.npz"):
        got = arrays.read_array(spark, str(tmp_path / name)).orderBy("i").collect()
        assert [r.i for r in got] == [0, 1] and got[1].shape == [3, 4] and got[1].x == x[1].ravel().tolist()
    for name in ("c.npz", "d.npy"):
        with pytest.raises(Exception, match="ArtifactError"):
            arrays.read_array(spark, str(tmp_path / name)).collect()


def test_synthetic_cache(spark, tmp_path):
    path = str(tmp_path / "k.npz")
    np.savez(path, X_syn=np.ones((3, 2, 4), np.float32), y_syn=np.array([2, 0, 1]))
    asked = {"sensor_configuration": "six", "held_out_subject": 3, "seed": 42, "steps": 50, "samples_per_class": 1}
    own = asked | {"vae_checkpoint_sha256": "a", "flow_checkpoint_sha256": "b", "config_identity": "c", "implementation_version": "1"}
    digest = hashlib.sha256(open(path, "rb").read()).hexdigest()
    put = lambda **m: (tmp_path / "k.manifest.json").write_text(json.dumps({"identity": own, "array_filename": "k.npz", "array_sha256": digest.upper()} | m), "utf-8-sig")
    with pytest.raises(ArtifactError):
        arrays.find_manifest(spark, path)
    put()
    df, fields = arrays.load_checked_synthetic(spark, path, **asked)
    assert [(r.label, len(r.x)) for r in df.orderBy("i").collect()] == [(2, 8), (0, 8), (1, 8)] and fields["identity"] == own
    with pytest.raises(ArtifactError):
        arrays.load_checked_synthetic(spark, path, **asked | {"seed": 1})
    for wrong in ({"array_sha256": "0" * 64}, {"array_filename": "z.npz"}, {"identity": own | {"config_identity": " "}}, {"identity": asked}):
        put(**wrong)
        with pytest.raises(ArtifactError):
            arrays.load_checked_synthetic(spark, path, **asked)
    (tmp_path / "manifest.json").write_text("{}")
    with pytest.raises(ArtifactError):
        arrays.find_manifest(spark, path)
    (tmp_path / "r.json").write_text(json.dumps([{"fold": 1, "acc": 0.5}, {"fold": 2}]), "utf-8-sig")
    assert arrays.read_fold_records(spark, str(tmp_path / "r.json")).orderBy("fold").select("fold", "acc").collect() == [(1, 0.5), (2, None)]


def test_sensitivity(spark):
    rows = [(length, hop, f, 0.5 + 0.1 * f, {"run": 0.1 * f}) for length, hop in privacy.WINDOW_GRID for f in range(3)]
    kind = "win_len int, hop int, fold int, trtr_accuracy double, tstr_per_class_f1 map<string,double>"
    got = privacy.sensitivity_grid(spark.createDataFrame(rows, kind)).where("win_len = 160 and hop = 40").collect()
    assert {r.metric: (r.n_folds, r.n, round(r["mean"], 9), round(r.sd, 9)) for r in got} == {"trtr_accuracy": (3, 3, 0.6, 0.1), "tstr_f1_run": (3, 3, 0.1, 0.1)}
    with pytest.raises(SchemaError):
        privacy.sensitivity_grid(spark.createDataFrame(rows[:-3], kind))
    with pytest.raises(SchemaError):
        privacy.sensitivity_summary(spark.createDataFrame([(80, 20, 0, float("nan"), None)], kind), ["win_len", "hop"])


def test_grid_equals_single_settings(spark):
    runs = spark.createDataFrame([(1, p, n) for n in (1, 5, 12) for p in range(n)], "run int, pos long, run_len long").withColumn("run", F.col("run_len").cast("int"))
    grid = [(3, 1), (3, 2), (4, 5), (12, 1)]
    whole = windows.cut_grid(runs, grid)
    for length, hop in grid:
        own = whole.where(f"win_len = {length} and hop = {hop}").select("run", "pos", "widx", "at")
        want = windows.cut_windows(runs, length, hop).select("run", "pos", "widx", "at")
        assert sorted(own.collect()) == sorted(want.collect())
    assert windows.first_windows(runs, ["run", "pos"], 4).count() == 4 and windows.first_windows(runs, ["run"], None).count() == 18


def test_website_trajectories(spark, tmp_path):
    m = latent.website_metadata(2, 1)
    assert (m["seed"], m["state_count"], m["target_samples"], m["native_segment_count"], m["flow_times"][1]) == (2142, 51, 500, 4, 0.98)
    small = {"num_steps": 4, "record_every": 3, "overlap_samples": 2, "native_window_samples": 4, "duration_seconds": 0.12}
    rows = [(1, 0, step, seg, 0, [10.0 * seg + i for i in range(4)]) for step in (0, 3, 4) for seg in range(2)]
    kind = "s int, a int, step int, seg int, channel int, values array<double>"
    got = latent.website_trajectories(spark.createDataFrame(rows, kind), "s", "a", **small)
    assert [(r.step, r.flow_time, r.signal) for r in got.orderBy("step").collect()] == [(k, t, [0.0, 1.0, 2.0, 7.0, 12.0, 13.0]) for k, t in ((0, 1.0), (3, 0.25), (4, 0.0))]
    for part in (rows[2:], rows[1:]):
        with pytest.raises(SchemaError):
            latent.website_trajectories(spark.createDataFrame(part, kind), "s", "a", **small)
    sinks.write_trajectories(got, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_trajectories(got, str(tmp_path / "t"))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5), (None, 2.0)], "name string, v double")
    assert sinks.markdown(df) == "| name | v |\n| --- | --- |\n| a\\|b | 1.5 |\n|  | 2.0 |\n"
    sinks.write_table_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    with pytest.raises(SchemaError):
        sinks.markdown(df.withColumn("signals", F.array(F.lit(1))))
    with pytest.raises(SchemaError):
        sinks.markdown(df, most=1)


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.bin", "b.bin"):
        (tmp_path / "d" / name).write_bytes(name.encode())
    entries = artifacts.describe(spark, str(tmp_path / "d"), "part")
    assert [(e["filename"], e["bytes"], e["sha256"]) for e in entries] == [(n, 5, hashlib.sha256(n.encode()).hexdigest()) for n in ("a.bin", "b.bin")]
    artifacts.write_manifest(spark, entries, str(tmp_path / "m"))
    assert artifacts.read_manifest(spark, str(tmp_path / "m"), {"part"}) == entries
    artifacts.require_verified(spark, entries, str(tmp_path / "d"))
    with pytest.raises(ArtifactError):
        artifacts.read_manifest(spark, str(tmp_path / "m"), {"other"})
    (tmp_path / "d" / "b.bin").write_bytes(b"c.bin")
    assert {r.filename: r.status for r in artifacts.verify(spark, entries, str(tmp_path / "d")).collect()} == {"a.bin": "ok", "b.bin": "sha256"}
    (tmp_path / "x").write_text('{"schema_version": 1, "artifacts": []}')
    with pytest.raises(ArtifactError):
        artifacts.read_manifest(spark, str(tmp_path / "x"))


def test_every_status_of_a_manifest(spark):
    got = {r.filename: r.status for r in catalogue.QUERIES["manifest_verify"](spark, SF).collect()}
    assert (got["nation.parquet"], got["region.parquet"], got["absent.parquet"], got["events.parquet"]) == ("sha256", "size", "missing", "ok")


def test_stream_goes_on_from_its_state(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    folder, path, half = tmp_path / "in", str(tmp_path / "out"), len(events) // 2
    folder.mkdir()
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for k, part in enumerate((events[:half], events[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        got = catalogue.streamed(spark, str(folder), "*.parquet", path)
        if k == 0:
            assert got.count() > 0
    want = {(r.user_id, r.run, r.widx): (r.label, round(r.mean_value, 6)) for r in catalogue.QUERIES["windows_strict"](spark, SF).collect()}
    assert {(r.subject, r.run, r.widx): (r.label, round(r.mean_value, 6)) for r in got.collect()} == want and got.count() == len(want)


def test_reports_refuse_nan_everywhere(spark, tmp_path):
    nan = float("nan")
    fine = spark.createDataFrame([(1, 0.5, [0.5], {"a": 0.5}), (2, None, None, None)], "n int, f double, l array<double>, m map<string,float>")
    for i, row in enumerate([(1, nan, [0.5], {"a": 0.5}), (1, 0.5, [0.5, nan], None), (1, None, None, {"a": nan})]):
        bad = fine.unionByName(spark.createDataFrame([row], fine.schema))
        with pytest.raises(SchemaError, match="NaN"):
            sinks.write_report(bad, str(tmp_path / f"r{i}"))
        with pytest.raises(SchemaError, match="NaN"):
            sinks.markdown(bad)
    with pytest.raises(SchemaError, match="NaN"):
        sinks.write_table_report(spark.createDataFrame([(nan,)], "f double"), str(tmp_path / "t"))
    with pytest.raises(SchemaError, match="NaN"):
        sinks.write_report(fine.select(F.struct(F.lit(nan).alias("x")).alias("s")), str(tmp_path / "s"))
    sinks.write_report(fine, str(tmp_path / "fine"))
    assert sinks.markdown(fine.select("n", "f")).splitlines()[2:] == ["| 1 | 0.5 |", "| 2 |  |"]


def test_manifests_without_an_identity(spark, tmp_path):
    """As others ship them: a version, artifacts with digests of upper case, and fields of their own."""
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "release": "x", "artifacts": [{"filename": "a.pt", "role": "model", "bytes": 3, "sha256": "AB" * 32, "url": "u"}]}))
    got = artifacts.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(e["filename"], e["sha256"]) for e in got] == [("a.pt", "ab" * 32)]
    for bad in ({"schema_version": 2, "artifacts": [{}]}, {"schema_version": 1, "artifacts": []}, {"schema_version": 1, "artifacts": ["a"]}, {"schema_version": 1, "artifacts": [{"filename": "../a", "role": "m", "bytes": 1, "sha256": "0" * 64}]}, []):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ArtifactError):
            artifacts.read_manifest(spark, str(tmp_path / "bad.json"))


def test_manifests_of_tables_that_are_folders(spark, tmp_path):
    from strideframe.plans import catalogue

    root = tmp_path / "tables"
    for t, parts in (("nation", 2), ("region", 1), ("documents", 3), ("labels", 3)):
        (root / f"{t}.parquet").mkdir(parents=True)
        for i in range(parts):
            (root / f"{t}.parquet" / f"part-{i}.parquet").write_bytes(f"{t} {i}".encode())
    (root / "part.parquet").write_bytes(b"alone")
    got = {r.filename: r.status for r in catalogue.QUERIES["manifest_verify"](spark, str(root)).collect()}
    assert len(got) == 11 and {n: s for n, s in got.items() if s != "ok"} == {"nation.parquet/part-0.parquet": "sha256", "region.parquet/part-0.parquet": "size", "region.parquet/absent.parquet": "missing"}
    assert got["documents.parquet/part-2.parquet"] == got["labels.parquet/part-2.parquet"] == got["part.parquet"] == "ok"
    with pytest.raises(ArtifactError, match="repeat"):
        artifacts.describe(spark, f"{root}/*.parquet", "table")  # one manifest has one folder
