"""Summaries of membership and reconstruction attacks, and of sensitivity grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.errors import SchemaError
from strideframe.operators.metrics import mean_sample_sd
from strideframe.schema import finite, require


def roc_auc(scores: DataFrame, by: list[str], member: str, score: str) -> DataFrame:
    """Area under the ROC curve per group: the share of (member, other) pairs in which the member scores higher, ties half.

    Equal scores are added up first, so that the window over a group holds its
    distinct scores only.  A group without members or without others has a
    null area.
    """
    sums = scores.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(member).alias("_m"), F.count_if(~F.col(member)).alias("_o"))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_below", F.coalesce(F.sum("_o").over(before), F.lit(0)))
    won = F.sum(F.col("_m") * (F.col("_below") + F.col("_o") / 2))
    return sums.groupBy(*by).agg(F.try_divide(won, F.sum("_m") * F.sum("_o")).alias("auc"))


def membership_summary(records: DataFrame, model: str, auc: str) -> DataFrame:
    """Per threat model, never across them."""
    sd = mean_sample_sd(records, [model], auc)
    return sd.join(records.groupBy(model).agg(F.min(auc).alias("min"), F.max(auc).alias("max")), model)


def reconstruction_success(attacks: DataFrame, fold: str, l2: str, baseline: str, share: float = 0.10) -> DataFrame:
    """Per fold: attempts, successes (strictly under the share of the baseline) and their rate."""
    return attacks.groupBy(fold).agg(F.count("*").alias("n_attempts"), F.count_if(F.col(l2) < share * F.col(baseline)).alias("n_success")).withColumn(
        "rate", F.coalesce(F.try_divide(F.col("n_success").cast("double"), "n_attempts"), F.lit(0.0))
    )


def reconstruction_summary(per_fold: DataFrame) -> DataFrame:
    """The mean of fold rates and the pooled rate."""
    return per_fold.agg(
        F.avg("rate").alias("fold_mean_rate"), F.coalesce(F.try_divide(F.sum("n_success").cast("double"), F.sum("n_attempts")), F.lit(0.0)).alias("pooled_rate"), F.sum("n_attempts").alias("n_attempts")
    )


# Window lengths and hops of the grid, metrics of a fold's record.
WINDOW_GRID = [(length, hop) for length in (80, 160, 240) for hop in (20, 40, 80)]
SCALAR_METRICS = ("trtr_macro_f1", "tstr_macro_f1", "macro_f1_retention", "trtr_accuracy", "tstr_accuracy", "aug_macro_f1", "psd_log_cosine", "hf_psd_ratio")


def sensitivity_summary(records: DataFrame, setting: list[str], per_class: str | None = "tstr_per_class_f1") -> DataFrame:
    """(setting, metric, n_folds, n, mean, sd): of each metric that the records have, and of each class in the map ``per_class``.

    Records are one row a setting and fold; a null means that a fold lacks the
    metric.  One value has deviation 0; a value that isn't finite raises.
    """
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in SCALAR_METRICS if m in records.columns]
    found = F.array(*pairs) if pairs else F.array().cast("array<struct<metric:string,v:double>>")
    if per_class in records.columns:
        own = F.transform(F.map_entries(per_class), lambda e: F.struct(F.concat(F.lit("tstr_f1_"), e["key"].cast("string")).alias("metric"), e["value"].cast("double").alias("v")))
        found = F.concat(found, F.coalesce(own, F.array().cast("array<struct<metric:string,v:double>>")))
    folds = records.groupBy(*setting).agg(F.count("*").alias("n_folds"))
    values = records.select(*setting, F.explode(found).alias("m")).select(*setting, "m.*").where("v is not null")
    require(values, {"finite metrics": finite("v")})
    s = mean_sample_sd(values, [*setting, "metric"], "v").join(F.broadcast(folds), setting)  # a row a setting
    return s.select(*setting, "metric", "n_folds", "n", "mean", F.col("sd_sample").alias("sd"))


def sensitivity_grid(records: DataFrame, setting: tuple[str, str] = ("win_len", "hop"), grid: list[tuple[int, int]] | None = None) -> DataFrame:
    """``sensitivity_summary`` of records that have just the settings of the grid; missing and other ones raise."""
    grid = WINDOW_GRID if grid is None else grid
    have = {tuple(r) for r in records.select(*setting).distinct().limit(len(grid) + 100).collect()}
    if have != set(grid):
        raise SchemaError(f"settings missing: {sorted(set(grid) - have)}, others: {sorted(have - set(grid))}")
    return sensitivity_summary(records, list(setting))


def missing_settings(records: DataFrame, setting: list[str], expected: list[tuple]) -> DataFrame:
    want = records.sparkSession.createDataFrame(expected, records.select(*setting).schema)
    return want.join(records.select(*setting).distinct(), setting, "left_anti")
