"""Per-channel standardisation with statistics of the training split only."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.errors import NormalizationError, NotFittedError

FLOOR = 1e-8


def explode_channels(windows: DataFrame, column: str, samples: int, keep: list[str]) -> DataFrame:
    """(keep, channel, t, x) of flat windows in channel order, as doubles."""
    w = windows.select(*keep, F.posexplode(column).alias("i", "x"))
    return w.select(*keep, F.floor(F.col("i") / samples).cast("int").alias("channel"), (F.col("i") % samples).cast("int").alias("t"), F.col("x").cast("double").alias("x"))


def fit(samples: DataFrame, channel: str = "channel", x: str = "x") -> DataFrame:
    """(channel, mean, std): population deviation with a floor."""
    return samples.groupBy(channel).agg(F.avg(x).alias("mean"), F.greatest(F.stddev_pop(x), F.lit(FLOOR)).alias("std"))


class Standardizer:
    """Statistics of a few channels as literals, so that they fold into any expression."""

    def __init__(self, subjects: set | None = None):
        self.mean: list[float] | None = None
        self.std: list[float] | None = None
        self.subjects = subjects or set()

    def fit(self, samples: DataFrame, held_out: set | None = None) -> Standardizer:
        if self.subjects & (held_out or set()):
            raise NormalizationError("training and held-out subjects overlap")
        rows = fit(samples).orderBy("channel").collect()  # one row a channel
        if not rows or any(r["mean"] is None or r["mean"] != r["mean"] for r in rows):
            raise NormalizationError("no finite training samples")
        self.mean, self.std = [r["mean"] for r in rows], [r["std"] for r in rows]
        return self

    def _stat(self, values, channel):
        if values is None:
            raise NotFittedError("fit first")
        return F.get(F.array(*[F.lit(v) for v in values]), channel)

    def apply(self, column: str, samples: int, kind: str = "float"):
        """A flat window's z-scores, computed in double and stored as ``kind``."""
        m, s = lambda i: self._stat(self.mean, (i / samples).cast("int")), lambda i: self._stat(self.std, (i / samples).cast("int"))
        return F.transform(column, lambda x, i: ((x.cast("double") - m(i)) / s(i)).cast(kind))

    def inverse(self, column: str, samples: int, kind: str = "float"):
        m, s = lambda i: self._stat(self.mean, (i / samples).cast("int")), lambda i: self._stat(self.std, (i / samples).cast("int"))
        return F.transform(column, lambda x, i: (x.cast("double") * s(i) + m(i)).cast(kind))

    def to_json(self) -> str:
        """Statistics and training subjects; ``from_json`` restores them."""
        if self.mean is None:
            raise NotFittedError("fit first")
        # Names of the fields and of the method.
        fields = {"method": "per_channel_zscore", "fit_axes": [0, 2], "ddof": 0, "epsilon": FLOOR, "channels": len(self.mean)}
        return json.dumps(fields | {"mean": self.mean, "std": self.std, "training_subjects": sorted(self.subjects) or None}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str, held_out: set | None = None) -> Standardizer:
        """A fitted standardiser of stored statistics, in any of ``SPELLINGS``; all rules that they break are named in one error."""
        try:
            stored = json.loads(text)
        except ValueError as broken:
            raise NormalizationError("not JSON") from broken
        if not isinstance(stored, dict):
            raise NormalizationError("not an object")
        found = {name: next((stored[x] for x in spellings if stored.get(x) is not None), DEFAULTS.get(name)) for name, spellings in SPELLINGS.items()}
        found["apart"] = {*(held_out or ()), *(found["validation"] or ()), found["held_out"]}
        if broken := [text for text, rule in RULES.items() if not _holds(rule, found)]:
            raise NormalizationError("; ".join(broken))
        out = cls(set(found["train"] or ()))
        out.mean, out.std = list(map(float, found["mean"])), [max(float(v), float(found["floor"])) for v in found["std"]]
        return out


# Names of the fields of stored statistics, each in all its spellings, and of the method.
SPELLINGS = {
    "method": ("method", "normalization_method"),
    "axes": ("fit_axes", "axes"),
    "ddof": ("ddof", "standard_deviation_ddof"),
    "floor": ("epsilon", "minimum_standard_deviation"),
    "channels": ("channels", "n_channels"),
    "mean": ("mean", "mean_"),
    "std": ("std", "scale", "std_"),
    "train": ("training_subjects", "fit_subjects"),
    "validation": ("validation_subjects",),
    "held_out": ("held_out_subject",),
}
METHODS = ("per_channel_zscore", "zscore")
DEFAULTS = {"axes": [0, 2], "ddof": 0, "floor": FLOOR}


def _numbers(values) -> bool:
    return isinstance(values, list) and all(isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) for v in values)


def _holds(rule, found: dict) -> bool:
    """A rule that can't be asked of these values doesn't hold."""
    try:
        return bool(rule(found))
    except (TypeError, ValueError):
        return False


RULES = {
    "not a z-score by channel": lambda f: f["method"] in METHODS and list(f["axes"]) == DEFAULTS["axes"],
    "not the population deviation": lambda f: int(f["ddof"]) == 0,
    "no positive floor": lambda f: 0 < f["floor"] < math.inf,
    "mean and std aren't finite numbers, one a channel": lambda f: _numbers(f["mean"]) and _numbers(f["std"]) and 0 < len(f["mean"]) == len(f["std"]) == f["channels"],
    "deviations are above 0": lambda f: min(f["std"]) > 0,
    "training and held-out subjects overlap": lambda f: not {*(f["train"] or ())} & f["apart"],
}
