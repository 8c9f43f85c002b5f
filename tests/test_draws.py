"""Splits, draws, restored statistics and audits against plain Python."""

import json

import numpy as np
import pytest

from strideframe.errors import DuplicateWindowError, NormalizationError, NotFittedError, SplitError, WindowError
from strideframe.functions import draws, latent
from strideframe.operators import audit, splits, windows
from strideframe.operators.standardize import Standardizer
from strideframe.schema import CSV_CLASSES, class_id


def labels_of(spark, counts):
    rows = [(i, label) for i, label in enumerate(k for k, n in counts for _ in range(n))]
    return spark.createDataFrame(rows, "id long, label int")


def in_order(spark, rows):
    from pyspark.sql import functions as F

    return [r.id for r in rows.select("id", draws.order_key(42, F.col("id")).alias("k")).orderBy("k", "id").collect()]


@pytest.mark.parametrize("counts", [[(0, 5), (1, 5), (2, 40)], [(None, 10), (3, 30)], [(0, 30_000), (1, 50)]])
def test_stratified_split_takes_the_first_of_each_class(spark, counts):
    rows = labels_of(spark, counts)
    got = {r.id: r.split for r in splits.stratified_split(rows, "label", "id").collect()}
    n = {r.label: r.n_validation for r in splits.stratified_allocation(rows.groupBy("label").agg({"*": "count"}).withColumnRenamed("count(1)", "n"), "label", "n").collect()}
    label, want = {r.id: r.label for r in rows.collect()}, {}
    left = dict(n)
    for i in in_order(spark, rows):
        want[i] = "validation" if left[label[i]] > 0 else "train"
        left[label[i]] -= 1
    assert got == want


def test_stratified_split_without_strata_runs_over_all_rows(spark):
    rows = labels_of(spark, [(0, 1), (1, 19)])
    got = {r.id for r in splits.stratified_split(rows, "label", "id").where("split = 'validation'").collect()}
    assert got == set(in_order(spark, rows)[:4])


def test_stratified_split_of_few_rows(spark):
    assert {r.split for r in splits.stratified_split(labels_of(spark, [(0, 9)]), "label", "id", least=10).collect()} == {"train"}
    assert splits.stratified_split(labels_of(spark, [(0, 1)]).where("id < 0"), "label", "id").count() == 0
    with pytest.raises(SplitError):
        splits.stratified_split(labels_of(spark, [(0, 1)]), "label", "id")
    with pytest.raises(SplitError):
        splits.stratified_split(labels_of(spark, [(0, 9)]), "label", "id", 1.0)


def test_draws_are_standard_and_do_not_depend_on_the_layout(spark):
    from pyspark.sql import functions as F

    at = lambda n: [tuple(r) for r in spark.range(20_000).repartition(n).select("id", draws.normal(1, F.col("id")).alias("z"), draws.uniform(1, F.col("id")).alias("u")).orderBy("id").collect()]
    one = at(1)
    assert one == at(7)
    z, u = np.array([r[1] for r in one]), np.array([r[2] for r in one])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z**3).mean()) < 0.1
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01


def test_class_samples_follow_their_class(spark):
    p = spark.createDataFrame([(k, i, 10.0 * k + i, 0.5 + k) for k in range(2) for i in range(3)], "label int, pos int, mean double, std double")
    got = latent.class_samples(p, "label", 3000).collect()
    assert sorted((r.label, r.sample) for r in got) == [(k, s) for k in range(2) for s in range(3000)]
    for k in range(2):
        x = np.array([r.latent for r in got if r.label == k])
        assert np.allclose(x.mean(0), 10 * k + np.arange(3), atol=0.1) and np.allclose(x.std(0), 0.5 + k, atol=0.1)
    with pytest.raises(ValueError):
        latent.class_samples(p, "label", 0)


def test_augment_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(300).select("id", F.array_repeat(F.lit(2.0).cast("float"), 12).alias("w"))
    part = lambda **k: np.array([r.w for r in rows.select(latent.augment("w", 4, F.col("id"), **({"jitter": 0, "scale": 0, "time_mask": 0} | k)).alias("w")).collect()]).reshape(300, 3, 4)
    assert (part() == 2).all()
    assert abs(part(jitter=0.1).std() - 0.1) < 0.01
    scaled = part(scale=0.1)
    assert (scaled == scaled[:, :, :1]).all() and len(np.unique(scaled)) > 800
    masked = part(time_mask=0.25)
    assert (masked == masked[:, :1, :]).all() and abs((masked == 0).mean() - 0.25) < 0.06


def test_standardiser_is_restored(spark):
    first = Standardizer({1, 2}).fit(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "channel int, x double"))
    again = Standardizer.from_json(first.to_json())
    assert (again.mean, again.std, again.subjects) == (first.mean, first.std, {1, 2})
    fields = json.loads(first.to_json())
    for change in ({"method": "minmax"}, {"fit_axes": [0]}, {"ddof": 1}, {"mean": [1.0]}, {"std": [0.0, 1.0]}, {"std": [1.0, float("nan")]}, {"channels": 3}, {"held_out_subject": 2}, {"validation_subjects": [1]}):
        with pytest.raises(NormalizationError):
            Standardizer.from_json(json.dumps(fields | change))
    other = {"normalization_method": "zscore", "axes": [0, 2], "standard_deviation_ddof": 0, "n_channels": 2, "mean_": [1, 2.5], "scale": [1e-12, 3], "minimum_standard_deviation": 1e-6, "fit_subjects": [4], "held_out_subject": None}
    again = Standardizer.from_json(json.dumps(other))
    assert (again.mean, again.std, again.subjects) == ([1.0, 2.5], [1e-6, 3.0], {4})
    with pytest.raises(NormalizationError, match="population.*overlap"):  # all that is wrong at once
        Standardizer.from_json(json.dumps(other | {"standard_deviation_ddof": 1, "validation_subjects": [4]}))
    for change in ({"axes": None, "fit_axes": 3}, {"minimum_standard_deviation": "x"}, {"mean_": "ab"}, {"scale": [True, 1.0]}, {"n_channels": 0, "mean_": [], "scale": []}):
        with pytest.raises(NormalizationError):
            Standardizer.from_json(json.dumps(other | change))
    with pytest.raises(NormalizationError):
        Standardizer.from_json(first.to_json(), held_out={2})
    with pytest.raises(NormalizationError):
        Standardizer.from_json("{")
    with pytest.raises(NotFittedError):
        Standardizer().to_json()


def test_audit_scopes(spark):
    rows = spark.createDataFrame([("train", "a"), ("train", "b"), ("train", "b"), ("held_out", "a"), ("validation", "c")], "split string, digest string")
    assert audit.train_validation_duplicates(rows, "split", "digest").isEmpty()
    audit.assert_no_duplicates(rows, "split", "digest", train_validation_only=True)
    for scope in ({}, {"within": True, "train_validation_only": True}):
        with pytest.raises(DuplicateWindowError):
            audit.assert_no_duplicates(rows, "split", "digest", **scope)


def test_two_spellings_of_a_size():
    assert [windows.window_size(240, default=240), windows.window_size(240, 160, default=240), windows.window_size(160, 160, default=240)] == [240, 160, 160]
    for value, alias in ((80, 160), (True, None), (240, 0), (2.0, None)):
        with pytest.raises(WindowError):
            windows.window_size(value, alias, default=240)


def test_ten_class_names():
    assert class_id("lying", CSV_CLASSES) == 9 and class_id(3, CSV_CLASSES) == 3


@pytest.mark.parametrize("cap", [1, 7, 100, 5000])
def test_drawn_caps_equal_the_ranked_filter(spark, cap):
    """One class has most rows; null labels, classes under the cap, and columns of any name."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from strideframe.functions.draws import order_key
    from strideframe.operators.splits import draw_rows_per_class

    df = spark.range(6000).select("id", F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 7, 2).when(F.col("id") < 60, 3).alias("label"), F.lit(1).alias("cell"), F.lit("x").alias("last")).repartition(5)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order_key(9, F.col("id")), "id"))
    want = df.withColumn("r", rank).where(F.col("r") <= cap).drop("r")
    got = draw_rows_per_class(df, "label", "id", cap, 9)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert draw_rows_per_class(df, "label", "id", 0).count() == 6000 and draw_rows_per_class(df.limit(0), "label", "id", cap).count() == 0
