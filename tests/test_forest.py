"""Forests whose trees never come to the driver, and whose large nodes are split by counts from all tasks."""

import numpy as np
import pytest

from strideframe.errors import SplitError
from strideframe.operators import evaluate, forest
from strideframe.operators.exact_forest import fit_exact_forest


def clouds(spark, n=900, seed=0):
    g = np.random.default_rng(seed)
    return spark.createDataFrame([(i, i % 3, (g.normal(size=6) + np.array([1.5, 0, 0, -1.5, 0, 0]) * (i % 3)).tolist()) for i in range(n)], "id long, y int, x array<double>")


def test_no_tree_comes_to_the_driver(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("a forest on the driver"))
    df = clouds(spark)
    got = evaluate.predict_forest(df.where("id < 600"), df.where("id >= 600"), "y", "x", key="id", trees=10).collect()
    assert len(got) == 300 and got[0].asDict().keys() == {"id", "y", "x", "pred"}
    x = np.array([r.x for r in got])
    exact = fit_exact_forest(df.where("id < 600"), "y", "x", 3, key="id", trees=10).predict(x)
    right = [np.mean([p == r.y for p, r in zip(pred, got, strict=True)]) for pred in (exact, [r.pred for r in got])]
    assert right[1] > 0.7 and abs(right[0] - right[1]) < 0.06


def test_large_nodes_are_split_by_counts(spark, monkeypatch):
    df, sizes = clouds(spark), []
    train, test = df.where("id < 600"), df.where("id >= 600")
    plain = forest._split_large
    monkeypatch.setattr(forest, "_split_large", lambda binned, tops, *a: (plain(binned, tops, *a), sizes.append([len(t.feature) for t in tops])))
    monkeypatch.setattr(forest, "PART", 100)
    judged = [{r.id: (r.y, r.pred) for r in forest.predict_forest(rows, test, "y", "x", key="id", trees=5, whole=60).collect()} for rows in (train.coalesce(1), train.repartition(7, "y"))]
    assert judged[0] == judged[1] and len(judged[0]) == 300 and np.mean([y == p for y, p in judged[0].values()]) > 0.7
    assert sizes[0] == sizes[1] and min(sizes[0]) >= 2 * (600 * 0.6 / 60) - 1  # every node below has 60 windows at most


def test_equal_windows_and_pure_nodes_end_large_nodes(spark):
    rows = [(i, i % 3 == 0, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, True, [9.0, 9.0, float(i)]) for i in range(300, 600)]
    df = spark.createDataFrame(rows, "id long, y boolean, x array<double>").selectExpr("id", "int(y) * 5 as y", "x")
    got = {(r.id >= 300): r.pred for r in forest.predict_forest(df, df, "y", "x", key="id", trees=3, whole=20).collect()}
    assert got == {False: 0, True: 5}
    one = forest.predict_forest(df.limit(1), df, "y", "x", key="id", trees=3)  # trees that draw nothing vote with all windows
    assert one.count() == 600 and one.select("pred").distinct().count() == 1


def test_a_tree_learns_every_window():
    g = np.random.default_rng(1)
    b, y, w = g.integers(0, 256, (500, 5)).astype(np.uint8), g.integers(0, 4, 500), g.integers(1, 4, 500)
    tree = forest.grow_binned(b, y, w, 4, 2, g)
    row, k, share = tree.votes(b)
    assert np.array_equal(row, np.arange(500)) and np.array_equal(k, y) and set(share) == {forest.SHARE}
    b[1], y[:2], w[:2] = b[0], (0, 1), (1, 3)
    row, k, share = forest.grow_binned(b, y, w, 4, 2, g).votes(b[:1])
    assert dict(zip(k.tolist(), share.tolist(), strict=True)) == {0: forest.SHARE // 4, 1: forest.SHARE * 3 // 4}


def test_cuts_lie_between_values_at_equal_shares():
    v = np.array([-np.inf, -1.0, -0.0, 0.5, 2.0, np.inf])
    assert np.array_equal(np.sort(forest.order_bits(v)), forest.order_bits(v))
    assert forest.choose_cuts(np.ones(3), v[1:4], v[1:4]).tolist() == [-0.5, 0.25]
    cuts = forest.choose_cuts(np.ones(10_000), np.arange(10_000.0), np.arange(10_000.0))
    assert len(cuts) == 255 and np.abs(np.diff(cuts) - 39).max() <= 1


@pytest.mark.parametrize("bad", [[(1, 0, None)], [(1, None, [1.0])], [(1, -1, [1.0])], [(1, 0, [1.0]), (2, 0, [1.0, 2.0])], [(1, 0, [None])], []])
def test_refused_windows(spark, bad):
    df = spark.createDataFrame(bad, "id long, y int, x array<double>")
    with pytest.raises(SplitError):
        forest.predict_forest(df, df, "y", "x", key="id", trees=1)
