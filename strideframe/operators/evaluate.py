"""Forests trained on the scenarios' populations and tried on one held-out population."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import BoundedSemaphore

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.errors import SplitError
from strideframe.operators import metrics
from strideframe.operators.exact_forest import predict_exact_forest
from strideframe.operators.forest import predict_forest
from strideframe.operators.splits import scenario_populations
from strideframe.session import stored

SCENARIOS = ("trtr", "scarce", "tstr", "tstr_scarce")
UNDER_WAY = BoundedSemaphore(len(SCENARIOS))  # forests at a time, however many folds: each one's plans and jobs take the driver's memory


def evaluate_scenarios(
    real: DataFrame, test: DataFrame, synthetic: DataFrame | None, label: str, flat: str, key: str, classes: int, *, scenarios: Iterable[str] = SCENARIOS, scarce: int = 2, synthetic_cap: int = 500, exact: bool = False, **forest
) -> DataFrame:
    """(place, scenario, n_train, macro_f1, accuracy, n, retention) of the wanted scenarios in their fixed order.

    Retention is the macro F1 over that of ``trtr``, which is trained for it
    even when it isn't asked for, and then not returned.  ``exact`` forests
    (``exact_forest``) try every value as a split and know no greatest depth,
    but hold the training windows in each task.
    """
    asked = [s.lower() for s in scenarios]
    if not asked or set(asked) - set(SCENARIOS):
        raise SplitError(f"unknown scenarios or none: {sorted(set(asked) - set(SCENARIOS))}")
    if synthetic is None and {"tstr", "tstr_scarce"} & set(asked):
        raise SplitError("these scenarios need synthetic windows")
    columns = [key, label, flat]
    populations = scenario_populations(real.select(columns), (real.limit(0) if synthetic is None else synthetic).select(columns), label, key, scarce=scarce, synthetic_cap=synthetic_cap)
    names = [s for s in SCENARIOS if s in asked or s == "trtr"]
    populations = stored(populations.where(F.col("scenario").isin(names)), "populations")  # drawn once, not in each scan of a forest
    counts = dict(map(tuple, populations.groupBy("scenario").count().collect()))  # one row a scenario
    tested = stored(test.select(columns), "tested")
    spark, tried = real.sparkSession, None

    @inheritable_thread_target(spark)
    def judge(name: str) -> tuple[tuple[int, str, int], DataFrame]:
        train = populations.where(F.col("scenario") == name).select(columns)
        with UNDER_WAY:
            judged = (predict_exact_forest if exact else predict_forest)(train, tested, label, flat, *([classes] if exact else []), key=key, **forest)
            return (SCENARIOS.index(name), name, counts.get(name, 0)), stored(judged.select(F.lit(name).alias("scenario"), label, "pred"), f"judged-{name}")

    with ThreadPoolExecutor(1 if exact else len(names)) as pool:  # a forest's own jobs follow one another and leave tasks free
        sizes, hits = zip(*pool.map(judge, names), strict=True)
    for hit in hits:
        tried = hit if tried is None else tried.unionByName(hit)
    confusion = stored(metrics.confusion(tried, ["scenario"], label, "pred", classes), "confusion")  # both are read several times below
    scores = stored(metrics.macro_f1_accuracy(confusion, ["scenario"]), "scores")
    kept = metrics.retention(scores.withColumn("_fold", F.lit(0)), "_fold", "scenario", "macro_f1").drop("_fold")
    place = spark.createDataFrame(list(sizes), "place int, scenario string, n_train long")
    return F.broadcast(place).join(kept, "scenario").where(F.col("scenario").isin(asked)).select("place", "scenario", "n_train", "macro_f1", "accuracy", "n", "retention").orderBy("place")


def summarize_scenarios(records: DataFrame) -> DataFrame:
    """Per scenario in fixed order: folds, means and sample deviations; retention is a mean of the folds' ratios."""
    place = F.array_position(F.array(*[F.lit(s) for s in SCENARIOS]), F.col("scenario"))
    known = records.where(place > 0).withColumn("place", (place - 1).cast("int"))
    out = known.groupBy("place", "scenario").agg(F.count("*").alias("n_folds"))
    for value in ("accuracy", "macro_f1", "retention"):
        s = metrics.mean_sample_sd(known, ["scenario"], value)
        out = out.join(s.select("scenario", F.col("mean").alias(f"{value}_mean"), F.col("sd_sample").alias(f"{value}_sd")), "scenario")
    return out.orderBy("place")
