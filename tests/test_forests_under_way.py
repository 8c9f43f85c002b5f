"""However many folds run side by side, only four forests are under way at a time."""

import threading
import time

from pyspark.sql import functions as F

from strideframe.operators import evaluate
from strideframe.plans import loso


def test_folds_share_the_places_of_forests(spark, tmp_path, monkeypatch):
    lock, now, most = threading.Lock(), [0], [0]

    def slow(train, test, *a, **k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(2)
        with lock:
            now[0] -= 1
        return test.withColumn("pred", F.lit(0))

    monkeypatch.setattr(evaluate, "predict_forest", slow)
    df = spark.range(60).selectExpr("id", "id % 3 as subject", "int(id % 2) as y", "array(double(id)) as x", "id % 5 = 0 as made")
    _, summary = loso.run_loso(df.where("not made"), str(tmp_path / "loso"), subject="subject", label="y", flat="x", key="id", classes=2, synthetic=df.where("made"), parallel=3)
    assert [r.n_folds for r in summary.collect()] == [3] * 4 and 1 < most[0] <= 4
