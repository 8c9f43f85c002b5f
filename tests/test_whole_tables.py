"""Queries over whole tables, whose namesakes with SQL take the rows of that SQL only."""

import pytest
from pyspark.sql import functions as F

from strideframe.operators import splits
from strideframe.plans import catalogue

SF = "/root/testdata/sf0.01"


def found(spark, name):
    return catalogue.QUERIES[name](spark, SF)


def test_splits_hold_every_user(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    users = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert len(users) > 40
    assert {r.user_id: r.fold for r in found(spark, "loso_fold_numbers").collect()} == {u: i for i, u in enumerate(sorted(users))}
    split = found(spark, "subject_split_all").collect()
    assert {r.user_id: r.n_rows for r in split} == users and {r.split for r in split} == {"held_out", "validation", "train"}
    windows = catalogue.event_windows(spark, SF, "strict", 2, 1)
    counts = found(spark, "split_counts_all").collect()
    assert sum(r.n_windows for r in counts) == windows.count() and sum(r.n_subjects for r in counts) == windows.select("user_id").distinct().count()


def test_null_subjects_have_no_fold(spark):
    s = spark.createDataFrame([(5,), (None,), (2,), (5,)], "s int")
    assert sorted(map(tuple, splits.loso_fold_numbers(s, "s").collect())) == [(2, 0), (5, 1)]


@pytest.mark.parametrize("name, each", [("euler_trajectory", 6), ("flatten_transpose", 64)])
def test_every_vector_is_there(spark, name, each):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert n > 100 and found(spark, f"{name}_all").count() == each * n
    assert found(spark, name).exceptAll(found(spark, f"{name}_all")).isEmpty()


def test_overlap_add_joins_every_segment(spark):
    sizes = {r.label: r["count"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()}
    got = found(spark, "overlap_add_all").groupBy("label").agg(F.count("*").alias("n"), F.max("at_").alias("last")).collect()
    assert max(sizes.values()) > 4 and {r.label: (r.n, r.last + 1) for r in got} == {k: (48 * n + 16,) * 2 for k, n in sizes.items()}
