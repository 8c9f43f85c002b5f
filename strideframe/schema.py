"""Declared recordings: channels, vocabularies and the checks that come before any transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.errors import SchemaError

# Columns of the tab-separated logs, label vocabularies by dataset, class names.
LOG_COLUMNS = 120
LABEL_COLUMN = 119
CHANNELS = {"six_channel": (80, 81, 82, 83, 84, 85), "three_channel": (80, 81, 82)}
LOG_LABELS = {1: 0, 3: 1, 4: 2, 33: 3}
LOG_CLASSES = ("walking", "running", "jump_up", "cycling")
CSV_CLASSES = (
    "walking_slow",
    "walking_moderate",
    "walking_brisk",
    "running",
    "stair_climbing",
    "cycling_seated",
    "cycling_standing",
    "sitting",
    "standing",
    "lying",
)
CSV_LABELS = {
    "adult_walking_speed": {101: 0, 102: 1, 103: 2, 2: 3},
    "harth": {2: 3, 4: 4, 5: 4, 13: 5, 14: 6, 7: 7, 6: 8, 8: 9},
    "har70plus": {4: 4, 5: 4, 7: 7, 6: 8, 8: 9},
}
COMPOSITIONS = {
    "harth": ("harth",),
    "harth_walking_speed": ("harth", "adult_walking_speed"),
    "harth_walking_speed_har70plus": ("harth", "adult_walking_speed", "har70plus"),
}
LOSO_COHORT = (1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 14, 16)
EXCLUDED = -1

LOG_SCHEMA = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(LOG_COLUMNS)])
CSV_FIELDS = ("back_x", "back_y", "back_z", "thigh_x", "thigh_y", "thigh_z")


def csv_schema(with_index: bool) -> T.StructType:
    """The only two headers a CSV recording may have."""
    fields = [T.StructField("timestamp", T.TimestampNTZType())]
    if with_index:
        fields.append(T.StructField("index", T.LongType()))
    fields += [T.StructField(c, T.DoubleType()) for c in CSV_FIELDS]
    return T.StructType([*fields, T.StructField("label", T.DoubleType())])


def channels_of(variant: str) -> tuple[int, ...]:
    """Channel columns of a declared variant; a variant is declared, never cut from another."""
    if variant not in CHANNELS:
        raise SchemaError(f"unknown channel variant {variant!r}; known: {sorted(CHANNELS)}")
    return CHANNELS[variant]


def check_mapping(mapping: dict[int, int], canonical: dict[int, int] | None = None) -> dict[int, int]:
    """A label mapping without repeats; with ``canonical``, exactly that one."""
    if any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for pair in mapping.items() for x in pair):
        raise SchemaError("codes and classes are non-negative integers")
    if canonical is not None and mapping != canonical:
        raise SchemaError("the mapping differs from the declared one")
    return mapping


def class_id(value: int | str, names: tuple[str, ...] = LOG_CLASSES) -> int:
    """A class by name or number."""
    if isinstance(value, str) and value in names:
        return names.index(value)
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < len(names):
        return value
    raise SchemaError(f"unknown class {value!r}")


def finite(column):
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def require(df: DataFrame, rules: dict, error=SchemaError) -> DataFrame:
    """Raises with the counts of rows that break each rule (one aggregate for all); else ``df``."""
    broken = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]).first()
    bad = {name: broken[name] for name in rules if broken[name]}
    if bad:
        raise error(f"rows that break a rule: {bad}")
    return df


def watched(df: DataFrame, rules: dict) -> tuple[DataFrame, Observation]:
    """``df`` with an observation that counts the rows that break each rule in whatever pass reads it next."""
    seen = Observation()
    return df.observe(seen, *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]), seen


def require_seen(seen: Observation, error=SchemaError) -> None:
    """Raises with the counts of ``watched``; to be called after the pass."""
    if bad := {name: n for name, n in seen.get.items() if n}:
        raise error(f"rows that break a rule: {bad}")


def require_columns(df: DataFrame, expected: T.StructType, error=SchemaError) -> DataFrame:
    got, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in expected]
    if got != want:
        raise error(f"columns {got} differ from {want}")
    return df


def require_windows(df: DataFrame, column: str, channels: int, samples: int) -> DataFrame:
    """Flat windows of ``channels * samples`` finite numbers."""
    return require(df, {"size": F.size(column) == channels * samples, "finite": F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))})
