"""Closed-form array operations of latent flow models."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.draws import normal, uniform
from strideframe.schema import require
from strideframe.session import small, stored


def interpolate(z0: Column, z1: Column, t: Column) -> Column:
    """(1 - t) z0 + t z1, position by position."""
    return F.zip_with(z0, z1, lambda a, b: (1 - t) * a.cast("double") + t * b.cast("double"))


def velocity(z0: Column, z1: Column) -> Column:
    return F.zip_with(z0, z1, lambda a, b: b.cast("double") - a.cast("double"))


def mean_square(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(a)


def mean_absolute(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def euler_step(z: Column, v: Column, steps: int) -> Column:
    return F.zip_with(z, v, lambda a, b: a.cast("double") - b.cast("double") / steps)


def euler_states(start: Column, field: Callable[[Column, Column], Column], steps: int, every: int | None = None) -> Column:
    """Array of (step, t, state) along dz/dt = field(z, t), from t = 1 back to 0 in ``steps`` equal steps.

    ``field`` makes a column (an array as long as the state) of the state and
    the time, so each step depends on the one before; the fold stays within
    the row.  The start, every ``every``-th state (all by default) and the
    last one are kept.
    """
    if steps < 1 or (every is not None and every < 1):
        raise ValueError("steps and every are at least 1")
    time = lambda k: F.greatest(F.lit(0.0), 1.0 - k.cast("double") * F.lit(1.0 / steps))
    first = F.array(F.transform(start, lambda x: x.cast("double")))

    def step(states: Column, k: Column) -> Column:
        now = F.element_at(states, -1)
        return F.concat(states, F.array(euler_step(now, field(now, time(k)), steps)))

    states = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), first, step)
    kept = F.array(*[F.lit(k) for k in sorted({0, steps, *range(every or 1, steps + 1, every or 1)})])
    return F.transform(kept, lambda k: F.struct(k.alias("step"), time(k).alias("t"), F.get(states, k).alias("state")))


def euler_trajectory(df: DataFrame, z: str, v: str, steps: int, every: int) -> DataFrame:
    """``step`` and ``state`` of a fixed velocity: the start, every so many steps, and the last."""
    kept = sorted({0, steps, *range(every, steps + 1, every)})
    out = df.withColumn("step", F.explode(F.array(*[F.lit(s) for s in kept])))
    return out.withColumn("state", F.zip_with(z, v, lambda a, b: a.cast("double") - b.cast("double") * F.col("step") / steps))


def time_embedding(t: Column, dim: int) -> Column:
    """Sines then cosines of 1000-scaled time at geometric frequencies; an odd width ends with a zero."""
    half = dim // 2
    if half == 0:
        return F.array(F.sin(t))
    angles = [t * math.exp(-math.log(10_000) * i / max(half - 1, 1)) for i in range(half)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles], *[F.lit(0.0)] * (dim % 2))


def website_seed(base: int, subject: Column, activity: Column) -> Column:
    return base + 1000 * subject + 100 * activity


def segments_needed(target: int, native: int, overlap: int) -> int:
    return 1 + max(0, math.ceil((target - native) / (native - overlap)))


def overlap_add(segments: DataFrame, group: list[str], seg: str, values: str, native: int, overlap: int, target: int | None = None) -> DataFrame:
    """(group, at, value): linear cross-fades, normalised by the weights, cut at ``target`` (None: whole).

    A group's last segment comes from an aggregate, and the sums are by group
    and place, so a group of most rows is spread over all tasks.
    """
    hop = native - overlap
    last = segments.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.max(seg).alias("_last"))
    met = segments.join(small(stored(last, "last-segments")), [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)])
    s = met.select(*group, F.col(seg).alias("_s"), "_last", F.posexplode(values).alias("_p", "v"))
    up = F.when((F.col("_s") > 0) & (F.col("_p") < overlap), F.col("_p") / F.lit(float(overlap))).otherwise(1.0)
    down = F.when((F.col("_s") < F.col("_last")) & (F.col("_p") >= hop), 1 - (F.col("_p") - hop) / F.lit(float(overlap))).otherwise(1.0)
    s = s.select(*group, (F.col("_s") * hop + F.col("_p")).alias("at"), "v", (up * down).alias("w"))
    s = s if target is None else s.where(F.col("at") < target)
    return s.groupBy(*group, "at").agg((F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-12))).alias("value"))


# Profile of a website trajectory.
WEBSITE = {"num_steps": 100, "record_every": 2, "overlap_samples": 40, "duration_seconds": 10.0, "sampling_rate_hz": 50.0, "native_window_samples": 160, "schema_version": "m3c.website-trajectory.1"}


def website_metadata(subject: int, activity: int, base_seed: int = 42, **profile) -> dict:
    """What a trajectory of one subject and activity holds: states, samples, segments, seed."""
    p = WEBSITE | profile
    if p["num_steps"] < 1 or p["record_every"] < 1:
        raise ValueError("num_steps and record_every are at least 1")
    target = round(p["duration_seconds"] * p["sampling_rate_hz"])
    steps = sorted({*range(0, p["num_steps"] + 1, p["record_every"]), p["num_steps"]})
    return p | {
        "subject": f"subject_{subject:02d}", "subject_id": subject, "activity_id": activity, "base_seed": base_seed, "seed": base_seed + 1000 * subject + 100 * activity,
        "stored_steps": steps, "state_count": len(steps), "target_samples": target, "native_segment_count": segments_needed(target, p["native_window_samples"], p["overlap_samples"]),
        "flow_times": [round(max(0.0, 1 - s / p["num_steps"]), 5) for s in steps],
    }


def website_trajectories(native: DataFrame, subject: str, activity: str, *, places: int = 5, **profile) -> DataFrame:
    """(subject, activity, step, flow_time, channel, signal): each stored state's segments cross-faded to the target length.

    ``native`` has (subject, activity, step, seg, channel, values), for each
    subject and activity all stored steps and all segments of each step and
    channel; else it raises.
    """
    m = website_metadata(0, 0, **profile)
    group = [subject, activity, "step", "channel"]
    sizes = native.groupBy(*group).agg(F.count("*").alias("_n"), F.count_distinct("seg").alias("_d"), F.max("seg").alias("_last"), F.min(F.size("values")).alias("_least"), F.max(F.size("values")).alias("_most"))
    whole = F.lit(m["native_segment_count"])
    require(sizes, {"segments": (F.col("_n") == whole) & (F.col("_d") == whole) & (F.col("_last") == whole - 1), "samples": (F.col("_least") == m["native_window_samples"]) & (F.col("_most") == m["native_window_samples"])})
    states = sizes.groupBy(subject, activity, "channel").agg(F.sort_array(F.collect_set(F.col("step").cast("int"))).alias("_steps"))
    require(states, {"states": F.col("_steps") == F.array(*[F.lit(s) for s in m["stored_steps"]])})
    joined = overlap_add(native, group, "seg", "values", m["native_window_samples"], m["overlap_samples"], m["target_samples"])
    ordered = F.array_sort(F.collect_list(F.struct("at", F.round("value", places).alias("v"))))
    time = F.round(F.greatest(F.lit(0.0), 1 - F.col("step") / F.lit(float(m["num_steps"]))), places)
    return joined.groupBy(*group).agg(F.transform(ordered, lambda x: x["v"]).alias("signal")).select(subject, activity, "step", time.alias("flow_time"), "channel", "signal")


def class_parameters(latents: DataFrame, label: str, column: str) -> DataFrame:
    """(label, pos, mean, std) of flat latents; a small constant is added to the population deviation."""
    return latents.select(label, F.posexplode(column).alias("pos", "v")).groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), (F.stddev_pop(F.col("v").cast("double")) + 1e-6).alias("std"))


def class_samples(parameters: DataFrame, label: str, per_class: int, seed: int = 42) -> DataFrame:
    """(label, sample, latent): ``per_class`` draws from each class's own normal distribution of ``class_parameters``.

    A draw depends on seed, class, sample and position only.  A class has one
    row of parameters, as long as a latent; classes without rows have no draws.
    """
    if per_class < 1:
        raise ValueError("per_class is at least 1")
    own = parameters.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_p"))
    drawn = own.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))))
    value = lambda p: (p["mean"] + p["std"] * normal(seed, F.col(label), F.col("sample"), p["pos"])).cast("float")
    return drawn.select(label, "sample", F.transform("_p", value).alias("latent"))


def augment(column: str, samples: int, key: Column, *, jitter: float = 0.008, scale: float = 0.04, time_mask: float = 0.05, seed: int = 42) -> Column:
    """A flat window with noise on every number, one factor a channel, and some times of all channels set to 0.

    A part of size 0 is left out.  ``key`` names the window; a window that
    comes again (another epoch) needs another key or seed for other draws.
    """

    def changed(x, i):
        channel, time = F.floor(i / samples), i % samples
        y = x.cast("double")
        if jitter > 0:
            y = y + jitter * normal(f"{seed}/jitter", key, i)
        if scale > 0:
            y = y * (1 + scale * normal(f"{seed}/scale", key, channel))
        if time_mask > 0:
            y = F.when(uniform(f"{seed}/mask", key, time) < time_mask, 0.0).otherwise(y)
        return y.cast("float")

    return F.transform(column, changed)


def mean_of_batch_means(df: DataFrame, index: str, value: str, batch: int = 128) -> DataFrame:
    """The last batch weighs as much as any other."""
    means = df.groupBy(F.floor(F.col(index) / batch).alias("_b")).agg(F.avg(value).alias("_m"))
    return means.agg(F.avg("_m").alias("mean_mse"), F.count("*").alias("n_batches"))


def vae_loss(x: Column, y: Column, mu: Column, log_var: Column, l2: float, l1: float, beta: float) -> Column:
    kl = F.aggregate(F.zip_with(mu, log_var, lambda m, v: F.exp(v.cast("double")) + m.cast("double") * m.cast("double") - 1 - v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return l2 * mean_square(x, y) + l1 * mean_absolute(x, y) + beta * 0.5 * kl / F.size(mu)


def diagnostics(latents: DataFrame, mu: str, log_variance: str, floor: float = 1e-12) -> DataFrame:
    """One row: mean |mu|, population variance of mu, mean exp(log variance / 2), and the share of positions whose mu hardly varies."""
    x = latents.select(F.posexplode(F.arrays_zip(F.col(mu).alias("m"), F.col(log_variance).alias("v"))).alias("at", "x"))
    x = x.select("at", F.col("x.m").cast("double").alias("m"), F.exp(F.col("x.v").cast("double") / 2).alias("s"))
    flat = x.groupBy("at").agg(F.var_pop("m").alias("own")).agg(F.avg((F.col("own") <= floor).cast("double")).alias("constant_share"))
    all_of = x.agg(F.avg(F.abs("m")).alias("mean_abs_mu"), F.var_pop("m").alias("var_mu"), F.avg("s").alias("mean_std"))
    return all_of.join(flat, F.lit(True))
