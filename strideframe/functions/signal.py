"""Signal functions on samples (channel, t, x) and on arrays; rms, percentiles and variances are population ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.percentiles import exact_percentiles

STANDARD_GRAVITY = 9.80665
NEAR_CONSTANT = 1e-12


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def array_magnitude(x: Column, y: Column, z: Column) -> Column:
    """Per position of three equally long arrays."""
    xy = F.zip_with(x, y, lambda a, b: a.cast("double") * a.cast("double") + b.cast("double") * b.cast("double"))
    return F.zip_with(xy, z, lambda s, c: F.sqrt(s + c.cast("double") * c.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def finite_counts(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    inf = F.coalesce(F.abs(c) == float("inf"), F.lit(False))
    t = df.agg(F.count("*").alias("n_total"), F.count_if(F.isnan(c) | c.isNull()).alias("n_nan"), F.count_if(inf).alias("n_inf"))
    fine = F.col("n_total") - F.col("n_nan") - F.col("n_inf")
    return t.select("n_total", "n_nan", "n_inf", fine.alias("n_finite"), F.coalesce(F.try_divide(100.0 * fine, "n_total"), F.lit(100.0)).alias("pct_finite"))


def window_variances(samples: DataFrame, window: list[str]) -> DataFrame:
    return samples.groupBy(*window, "channel").agg(F.var_pop("x").alias("variance"))


def signal_summary(samples: DataFrame, window: list[str]) -> DataFrame:
    """Per channel over all windows: moments, extremes, rms, quartile range, near-constant share."""
    variances = window_variances(samples, window)
    v = variances.groupBy("channel").agg(F.avg("variance").alias("variance_mean"), F.avg((F.col("variance") <= NEAR_CONSTANT).cast("double")).alias("near_constant"))
    t = samples.groupBy("channel").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.var_pop("x").alias("variance")
    )
    quartiles = exact_percentiles(samples, ["channel"], "x", {"_q1": 0.25, "_q3": 0.75}).select("channel", (F.col("_q3") - F.col("_q1")).alias("iqr"))
    middle = exact_percentiles(variances, ["channel"], "variance", {"variance_median": 0.5})
    return t.join(v, "channel").join(F.broadcast(quartiles), "channel").join(F.broadcast(middle), "channel")  # a row a channel


def norm_over_windows(samples: DataFrame) -> DataFrame:
    """Per channel: mean and deviation over time of the norm across windows at each position."""
    at = samples.groupBy("channel", "t").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return at.groupBy("channel").agg(F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"))


def magnitude_summary(points: DataFrame, x: str, y: str, z: str, max_g: float) -> DataFrame:
    m = points.select(magnitude(F.col(x), F.col(y), F.col(z)).alias("m"))
    over = F.count_if(F.col("m") > max_g * STANDARD_GRAVITY)
    t = m.agg(F.count("*").alias("n_points"), over.alias("n_over"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.max("m").alias("max"))
    t = t.withColumn("pct_over", F.coalesce(F.try_divide(100.0 * F.col("n_over"), "n_points"), F.lit(0.0)))
    return t.join(exact_percentiles(m, [], "m", {"median": 0.5, "p95": 0.95, "p99": 0.99}), F.lit(True), "left")  # a row each


def features(samples: DataFrame, group: list[str], channels: int = 3) -> DataFrame:
    """Six features of each of the first channels, in order, as one array: mean, std, min, max, rms, range of quartiles."""
    few = samples.where(F.col("channel") < channels)
    keys = [*group, "channel"]
    quartiles = exact_percentiles(few, keys, "x", {"_q1": 0.25, "_q3": 0.75}).select(*[F.col(c).alias(f"_{c}") for c in keys], (F.col("_q3") - F.col("_q1")).alias("_iqr"))
    per = few.groupBy(*keys).agg(F.array(F.avg("x"), F.stddev_pop("x"), F.min("x"), F.max("x"), F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("f"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    per = per.join(F.broadcast(quartiles), same).select(*keys, F.array_append("f", F.col("_iqr")).alias("f"))  # a row a group and channel
    ordered = F.array_sort(F.collect_list(F.struct("channel", "f")))
    return per.groupBy(*group).agg(F.flatten(F.transform(ordered, lambda x: x["f"])).alias("features"))


def feature_distances(features_by_class: DataFrame, label: str) -> DataFrame:
    """Between every two classes; one row a class, so the pairs are classes squared."""
    b = F.broadcast(features_by_class.select(F.col(label).alias("other"), F.col("features").alias("_g")))
    return features_by_class.join(b, F.lit(True)).select(label, "other", euclidean(F.col("features"), F.col("_g")).alias("distance"))


def compare_means(a: DataFrame, b: DataFrame) -> DataFrame:
    """Squared and absolute error between the mean windows of two sets of samples."""
    mean = lambda df, name: df.groupBy("channel", "t").agg(F.avg("x").alias(name))
    d = mean(a, "x").join(mean(b, "y"), ["channel", "t"]).withColumn("d", F.col("x") - F.col("y"))
    return d.agg(F.avg(F.col("d") * F.col("d")).alias("mse"), F.avg(F.abs("d")).alias("mae"))


def ensure_channel_major(column: str, channels: int) -> Column:
    """Transposes [time][channel] to [channel][time]; what already has ``channels`` rows stays."""
    c = F.col(column)
    turned = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda k: F.transform(c, lambda row: F.get(row, k)))
    return F.when((F.size(c) != channels) & (F.size(F.get(c, F.lit(0))) == channels), turned).otherwise(c)
