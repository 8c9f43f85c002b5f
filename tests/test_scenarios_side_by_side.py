"""Scenarios' forests are trained at the same time, and don't depend on the layout."""

import threading

import numpy as np

from strideframe.operators import evaluate


def table(spark):
    g = np.random.default_rng(0)
    return spark.createDataFrame([(i, i % 3, (g.normal(size=4) + i % 3).tolist()) for i in range(90)], "id long, y int, x array<double>")


def test_forests_of_all_scenarios_are_under_way_at_once(spark, monkeypatch):
    meet, plain = threading.Barrier(4, timeout=60), evaluate.predict_forest

    def one(*a, **k):
        meet.wait()
        return plain(*a, **k)

    monkeypatch.setattr(evaluate, "predict_forest", one)
    df = table(spark)
    got = evaluate.evaluate_scenarios(df.where("id < 30"), df.where("id between 30 and 59"), df.where("id > 59"), "y", "x", "id", 3, trees=2).collect()
    assert [(r.scenario, r.n_train, r.n) for r in got] == [("trtr", 30, 30), ("scarce", 6, 30), ("tstr", 30, 30), ("tstr_scarce", 36, 30)]


def test_a_forest_is_the_same_in_every_layout(spark):
    df = table(spark)
    judged = [{r.id: r.pred for r in evaluate.predict_forest(train, df, "y", "x", key="id", trees=3).collect()} for train in (df.coalesce(1), df.repartition(5, "y"))]
    assert judged[0] == judged[1]
