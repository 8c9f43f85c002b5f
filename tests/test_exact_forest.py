"""Exact trees against exhaustive search, and forests over tasks."""

import numpy as np
import pytest

from strideframe.errors import SplitError
from strideframe.operators import evaluate, exact_forest


def brute_tree(x, y, classes):
    """A nested tuple (feature, threshold, low, high) or the class shares: every feature and every cut is tried."""

    def impurity(part):
        return len(part) - sum(float((part == c).sum()) ** 2 for c in range(classes)) / max(1, len(part))

    best = None
    for f in range(x.shape[1]):
        values = sorted(set(x[:, f].tolist()))
        for a, b in zip(values, values[1:]):
            low = x[:, f] <= a
            left = impurity(y[low]) + impurity(y[~low])
            if best is None or left < best[0] - 1e-12:
                best = (left, f, (a + b) / 2, low)
    if best is None or len(set(y.tolist())) == 1:
        return tuple((y == c).mean() for c in range(classes))
    _, f, threshold, low = best
    return f, threshold, brute_tree(x[low], y[low], classes), brute_tree(x[~low], y[~low], classes)


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return tuple(tree.shares[at].tolist())
    return int(tree.feature[at]), float(tree.threshold[at]), nested(tree, tree.left[at]), nested(tree, tree.right[at])


class InOrder:
    """Draws features in their order."""

    def permutation(self, n):
        return np.arange(n)


@pytest.mark.parametrize("seed", range(12))
def test_trees_equal_exhaustive_search(seed):
    g = np.random.default_rng(seed)
    x, y = g.integers(0, 6, (40, 3)).astype(float) if seed % 2 else g.normal(size=(40, 3)), g.integers(0, 3, 40)
    tree = exact_forest.grow(x, y, 3, 3, InOrder())
    assert nested(tree) == brute_tree(x, y, 3)
    assert tree.gain.sum() == pytest.approx(1) and (tree.gain >= 0).all()
    at = exact_forest.Forest([tree]).predict(x)
    same = {tuple(r): [] for r in x.tolist()}
    for r, c in zip(x.tolist(), y.tolist(), strict=True):
        same[tuple(r)].append(c)
    assert all(p == min(set(cs), key=lambda c: (-cs.count(c), c)) for p, cs in zip(at.tolist(), (same[tuple(r)] for r in x.tolist()), strict=True))


def test_importance_of_one_telling_feature():
    g = np.random.default_rng(3)
    x, y = g.normal(size=(200, 4)), g.integers(0, 2, 200)
    x[:, 2] = y + 0.01 * g.normal(size=200)
    tree = exact_forest.grow(x, y, 2, 4, g)
    assert tree.gain.tolist() == [0, 0, 1, 0] and len(tree.feature) == 3


def test_forest_over_tasks(spark):
    g = np.random.default_rng(0)
    rows = [(i, i % 3, (g.normal(size=6) * 0.3 + i % 3).tolist(), "t") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y int, x array<float>, other string")
    first = exact_forest.fit_exact_forest(df.where("id < 60").repartition(4), "y", "x", 3, key="id", trees=7)
    again = exact_forest.fit_exact_forest(df.where("id < 60").coalesce(1), "y", "x", 3, key="id", trees=7)
    assert all((a.threshold == b.threshold).all() and (a.feature == b.feature).all() for a, b in zip(first.trees, again.trees, strict=True))
    assert len(first.trees) == 7 and len({t.threshold.tobytes() for t in first.trees}) > 1 and first.importance.sum() == pytest.approx(1)
    got = exact_forest.predict_exact_forest(df.where("id < 60"), df.where("id >= 60"), "y", "x", 3, key="id", trees=15)
    assert got.columns == [*df.columns, "pred"] and sum(r.y == r.pred for r in got.collect()) >= 27
    assert exact_forest.predict_exact_forest(df, df.limit(0), "y", "x", 3, key="id", trees=1).count() == 0
    for bad in (df.limit(0), df.selectExpr("id", "if(id = 3, null, y) as y", "x"), df.selectExpr("id", "if(id = 3, 7, y) as y", "x"), df.selectExpr("id", "y", "if(id = 3, array(1.0f), x) as x")):
        with pytest.raises(SplitError):
            exact_forest.fit_exact_forest(bad, "y", "x", 3, key="id", trees=1)


def test_too_many_values_are_refused(spark, monkeypatch):
    monkeypatch.setattr(exact_forest, "MOST_VALUES", 10)
    with pytest.raises(SplitError, match="more than"):
        exact_forest.fit_exact_forest(spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(6)], "id long, y int, x array<double>"), "y", "x", 1, key="id")


def test_scenarios_with_exact_forests(spark):
    g = np.random.default_rng(0)
    df = spark.createDataFrame([(i, i % 3, (g.normal(size=4) * 0.1 + i % 3).tolist()) for i in range(60)], "id long, y int, x array<double>")
    got = evaluate.evaluate_scenarios(df.where("id < 24"), df.where("id >= 24 and id < 36"), df.where("id >= 36"), "y", "x", "id", 3, exact=True, trees=3).collect()
    assert [r.scenario for r in got] == list(evaluate.SCENARIOS) and all(r.accuracy == 1.0 for r in got if r.scenario != "scarce")


@pytest.mark.parametrize("equal_keys", [False, True])
def test_predictions_without_the_driver_equal_the_forests(spark, monkeypatch, equal_keys):
    g = np.random.default_rng(5)
    df = spark.createDataFrame([(i // 2 if equal_keys else i, int(g.integers(0, 3)), g.normal(size=6).tolist()) for i in range(120)], "id long, y int, x array<float>").repartition(5)
    forest = exact_forest.fit_exact_forest(df, "y", "x", 3, key="id", trees=7)
    monkeypatch.setattr(exact_forest, "fit_exact_forest", None)  # the windows and trees stay with the tasks
    test = spark.createDataFrame([(i, g.normal(size=6).tolist()) for i in range(50)], "n long, x array<float>")
    got = exact_forest.predict_exact_forest(df, test, "y", "x", 3, key="id", trees=7).collect()
    assert len(got) == 50 and [r.pred for r in got] == forest.predict(np.array([r.x for r in got])).tolist()
