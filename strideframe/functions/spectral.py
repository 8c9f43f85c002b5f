"""Spectra of fixed-length windows; a window is one array in its row, so its spectrum needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.errors import WindowError


def _per_channel(windows: DataFrame, keep: list[str], column: str, length: int, name: str, spectrum: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keep, channel, k, name): ``spectrum`` turns (windows, channels, length) into (windows, channels, bins), batch by batch.

    ``column`` is a flat window in channel order of any number of channels,
    the same in all rows of a batch; other sizes, nulls and numbers that
    aren't finite raise.
    """

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("_w")
            sizes = set(flat.value_lengths().to_pylist())
            if len(sizes) > 1 or None in sizes or 0 in sizes or next(iter(sizes)) % length:
                raise WindowError(f"windows have sizes {sizes}, not one multiple of {length}")
            x = flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, length)
            if not np.isfinite(x).all():
                raise WindowError("windows hold finite numbers only")
            found = spectrum(x)
            bins = found.shape[-1]
            channels = pa.ListArray.from_arrays(pa.array(np.arange(found.shape[0] * found.shape[1] + 1, dtype=np.int32) * bins), pa.array(found.ravel()))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(found.shape[0] + 1, dtype=np.int32) * found.shape[1]), channels)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], rows], [*keep, "_s"])

    source = windows.select(*keep, F.transform(column, lambda v: v.cast("double")).alias("_w"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in source.dtypes[:-1])
    found = source.mapInArrow(spectra, f"{kinds}{', ' if keep else ''}_s array<array<double>>")
    found = found.select(*keep, F.posexplode("_s").alias("channel", "_s"))
    return found.select(*keep, "channel", F.posexplode("_s").alias("k", name))


def dft_power(windows: DataFrame, keep: list[str], column: str, length: int) -> DataFrame:
    """(keep, channel, k, power) of mean-removed windows; bin 0 is zero."""

    def power(x: np.ndarray) -> np.ndarray:
        return np.abs(np.fft.rfft(x - x.mean(axis=-1, keepdims=True), axis=-1)) ** 2

    return _per_channel(windows, keep, column, length, "power", power)


def welch_psd(windows: DataFrame, keep: list[str], column: str, length: int, rate: float, nperseg: int = 160) -> DataFrame:
    """(keep, channel, k, freq, psd): one-sided density by periodic Hann segments of ``nperseg`` samples that overlap by half, constant detrend.

    Segments are no longer than the window; samples behind the last whole segment don't count.
    """
    if rate <= 0 or nperseg < 1:
        raise WindowError("rate and nperseg are above 0")
    size = min(nperseg, length)
    hop = size - size // 2

    def density(x: np.ndarray) -> np.ndarray:
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
        parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::hop, :]
        tapered = (parts - parts.mean(axis=-1, keepdims=True)) * hann
        p = np.abs(np.fft.rfft(tapered, axis=-1)) ** 2 / (rate * (hann**2).sum())
        p[..., 1 : (size + 1) // 2] *= 2  # neither the first bin nor that of an even size's half rate
        return p.mean(axis=-2)

    found = _per_channel(windows, keep, column, length, "psd", density)
    return found.select(*keep, "channel", "k", (F.col("k") * rate / size).alias("freq"), "psd")


def mean_psd(psd: DataFrame, by: list[str]) -> DataFrame:
    return psd.groupBy(*by).agg(F.avg("psd").alias("psd_mean"), F.stddev_pop("psd").alias("psd_sd_pop"))


def fold_psd(psd: DataFrame, fold: str, by: list[str]) -> DataFrame:
    """Mean and population deviation over folds, each fold's mean counting once."""
    return mean_psd(psd.groupBy(fold, *by).agg(F.avg("psd").alias("psd")), by)


def band_power(psd: DataFrame, by: list[str], low: float, high: float, freq: str = "freq", value: str = "psd") -> DataFrame:
    """Trapezoid over the bins in [low, high]; fewer than two bins give 0."""
    w = Window.partitionBy(*by).orderBy(freq)
    inside = psd.where(F.col(freq).between(low, high))
    part = (F.col(freq) - F.lag(freq).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return inside.select(*by, part.alias("part")).groupBy(*by).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("power"))


def band_ratio(psd: DataFrame, kind: str, real: str, synthetic: str, low: float, high: float) -> DataFrame:
    """Synthetic over real band power; null where the real power is 0."""
    p = band_power(psd, [kind], low, high)
    pick = lambda name: F.max(F.when(F.col(kind) == name, F.col("power")))
    return p.agg(F.try_divide(pick(synthetic), pick(real)).alias("ratio"))


def log_correlation(pairs: DataFrame, real: str, synthetic: str) -> DataFrame:
    """Pearson correlation of natural logs over bins where both are positive; fewer than two bins give null."""
    p = pairs.where((F.col(real) > 0) & (F.col(synthetic) > 0))
    return p.agg(F.when(F.count("*") >= 2, F.corr(F.ln(real), F.ln(synthetic))).alias("log_psd_corr"), F.count("*").alias("n_bins"))


def spectral_summary(power: DataFrame, by: list[str], rate: float, length: int) -> DataFrame:
    """Per group: total by trapezoid, dominant frequency (first maximum), centroid, relative low, mid and high bands."""
    p = power.groupBy(*by, "k").agg(F.avg("power").alias("p")).withColumn("f", F.col("k") * rate / length)
    w = Window.partitionBy(*by).orderBy("k")
    p = p.withColumn("area", (F.col("f") - F.lag("f").over(w)) * (F.col("p") + F.lag("p").over(w)) / 2)
    f, v = F.col("f"), F.col("p")
    share = lambda rule: F.coalesce(F.try_divide(F.sum(F.when(rule, v)), F.sum(v)), F.lit(0.0))
    return p.groupBy(*by).agg(
        F.coalesce(F.sum("area"), F.lit(0.0)).alias("total"), F.max_by("f", F.struct(v, -f)).alias("dominant"), F.coalesce(F.try_divide(F.sum(f * v), F.sum(v)), F.lit(0.0)).alias("centroid"),
        share((f >= 0) & (f <= 2)).alias("low"), share((f > 2) & (f <= 10)).alias("mid"), share((f > 10) & (f <= 25)).alias("high"),
    )


# Bands of the comparison, in Hz.
BANDS = {"ratio_0_25hz": (0.0, 25.0), "ratio_10_25hz": (10.0, 25.0), "ratio_0_2hz": (0.0, 2.0)}


def spectral_statistics(bins: DataFrame) -> DataFrame:
    """Per channel of (channel, freq, real, synthetic, real_sd, synthetic_sd): log correlation, band ratios, deviation ratio.

    The correlation takes bins where both means are positive, two at least;
    a band's ratio is null where its real power isn't positive; the ratio of
    deviations is a mean over bins with a real deviation.
    """
    w = Window.partitionBy("channel").orderBy("freq")
    b = bins.withColumns({f"_{c}": (F.col("freq") - F.lag("freq").over(w)) * (F.col(c) + F.lag(c).over(w)) / 2 for c in ("real", "synthetic")} | {"_from": F.lag("freq").over(w)})
    both = (F.col("real") > 0) & (F.col("synthetic") > 0)

    def ratio(low: float, high: float):
        inside = (F.col("_from") >= low) & (F.col("freq") <= high)
        real = F.sum(F.when(inside, F.col("_real")))
        return F.when(real > 0, F.coalesce(F.sum(F.when(inside, F.col("_synthetic"))), F.lit(0.0)) / real)

    return b.groupBy("channel").agg(
        F.when(F.count_if(both) >= 2, F.corr(F.ln(F.when(both, F.col("real"))), F.ln(F.when(both, F.col("synthetic"))))).alias("log_psd_corr"),
        *[ratio(*band).alias(name) for name, band in BANDS.items()],
        F.avg(F.when(F.col("real_sd") > 0, F.col("synthetic_sd") / F.col("real_sd"))).alias("sd_ratio"),
    )


def mean_statistics(statistics: DataFrame) -> DataFrame:
    """One row: means over channels, null where a channel has none, and whether the high band is attenuated."""
    names = ["log_psd_corr", *BANDS, "sd_ratio"]
    means = statistics.agg(*[F.when(F.count(c) == F.count("*"), F.avg(c)).alias(c) for c in names])
    return means.withColumn("attenuated", F.coalesce(F.col("ratio_10_25hz") < 1, F.lit(False)))
