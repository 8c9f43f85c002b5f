"""Classification metrics over a declared label list, and summaries over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR_ZERO = 1e-8


def _labels(df: DataFrame, classes: int) -> DataFrame:
    return F.broadcast(df.sparkSession.range(classes).select(F.col("id").cast("int").alias("k")))


def confusion(rows: DataFrame, by: list[str], truth: str, pred: str, classes: int) -> DataFrame:
    """(by, truth, pred, n) of every cell; the counts are one partial aggregation, empty cells come from a broadcast grid."""
    counts = rows.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    labels = _labels(rows, classes)
    cells = labels.select(F.col("k").alias("truth")).join(labels.select(F.col("k").alias("pred")), F.lit(True))
    if by:
        cells = counts.select(*by).distinct().join(F.broadcast(cells), F.lit(True))
    return cells.join(counts, [*by, "truth", "pred"], "left").select(*by, "truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_f1(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, tp, fp, fn, f1) from confusion cells; each cell adds to its row's and its column's label."""
    hit = F.col("truth") == F.col("pred")
    a = cells.select(*by, F.col("truth").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn"))
    b = cells.where(~hit).select(*by, F.col("pred").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    t = a.unionByName(b).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return t.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def macro_f1_accuracy(cells: DataFrame, by: list[str]) -> DataFrame:
    per = class_f1(cells, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("_tp"), F.sum(F.col("tp") + F.col("fn")).alias("n"))
    return per.select(*by, "macro_f1", F.coalesce(F.try_divide(F.col("_tp").cast("double"), "n"), F.lit(0.0)).alias("accuracy"), "n")


def normalized_confusion(cells: DataFrame, by: list[str]) -> DataFrame:
    """Row shares; null for a truth without rows."""
    rows = cells.groupBy(*by, "truth").agg(F.sum("n").alias("_row"))
    return cells.join(rows, [*by, "truth"]).select(*by, "truth", "pred", F.try_divide(F.col("n").cast("double"), "_row").alias("share"))


def mean_sample_sd(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation without NaN; one value has deviation 0, none gives nulls."""
    v = F.when(~F.isnan(value), F.col(value))
    t = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("_sd"))
    return t.select(*by, "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("_sd")).alias("sd_sample"))


def retention(df: DataFrame, fold: str, scenario: str, value: str, base: str = "trtr") -> DataFrame:
    """Value over the fold's base scenario (plus a tiny constant); the base itself is 1."""
    bases = df.where(F.col(scenario) == base).select(fold, F.col(value).alias("_base"))
    r = F.when(F.col(scenario) == base, 1.0).otherwise(F.col(value) / (F.col("_base") + NEAR_ZERO))
    return df.join(bases, fold).withColumn("retention", r).drop("_base")


def mean_confusions(shares: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """Cell-wise mean over folds without missing rows, and folds where the cell is over ``threshold``."""
    v = F.when(~F.isnan("share"), F.col("share"))
    return shares.groupBy("truth", "pred").agg(F.avg(v).alias("mean_share"), F.count_if(v > threshold).alias("n_folds"))
