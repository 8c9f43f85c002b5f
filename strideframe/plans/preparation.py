"""From recordings to standardised, split and audited windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import schema as S
from strideframe.errors import SplitError
from strideframe.operators import audit, splits, windows
from strideframe.operators.standardize import Standardizer, explode_channels
from strideframe.sources import recordings

RATE_HZ = 50.0


@dataclass(frozen=True)
class Prepared:
    """``windows``: subject, run, widx, label, len, split and ``z``, a flat window in channel order; ``standardizer`` is None without training windows."""

    windows: DataFrame
    standardizer: Standardizer | None
    metadata: dict


def prepare(
    rows: DataFrame, held_out, *, channels: int, classes: tuple[str, ...], mode: str, length: int = 160, hop: int = 40, fraction: float = 0.2, seed: int = 42, empty: str = "refuse", within: bool = True
) -> Prepared:
    """Cut runs and windows, split by subject, fit on training windows only, standardise all, audit equal windows.

    ``rows`` have subject, seq, ch (array) and label (null or -1: excluded).
    ``empty`` is ``refuse`` (an error without training or validation windows)
    or ``keep`` (no training windows: no fit, values as they are).  Equal
    windows across splits, and ``within`` one, raise.  Subjects and classes
    are few; only counts by them come to the driver.
    """
    if not 0 < fraction < 1:
        raise SplitError("the fraction lies between 0 and 1")
    label = F.when(F.col("label") != S.EXCLUDED, F.col("label"))
    rows = rows.select("subject", "seq", "ch", label.alias("label"))
    totals = rows.groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("out")).collect()
    split_of = splits.draw_subjects(sorted(r["subject"] for r in totals), held_out, fraction, seed)
    cut = windows.cut_windows(windows.label_runs(rows, ["subject"], ["seq"], "label", mode), length, hop)
    table = windows.window_table(cut, ["subject"], "label", {"x": "ch"})
    turned = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform("x", lambda row: F.get(row, c))))
    table = splits.assign_split(table.withColumn("x", turned), "subject", split_of).persist(StorageLevel.MEMORY_AND_DISK)
    counts = table.groupBy("subject", "split", "label").agg(F.count("*").alias("n")).collect()
    sizes = {s: sum(r["n"] for r in counts if r["split"] == s) for s in ("train", "validation", "held_out")}
    if empty == "refuse" and not (sizes["train"] and sizes["validation"]):
        raise SplitError(f"a fold needs training and validation windows: {sizes}")
    fitted, z = None, F.transform("x", lambda v: v.cast("float"))
    if sizes["train"]:
        S.require_windows(table, "x", channels, length)
        train = {s for s, part in split_of.items() if part == "train"}
        fitted = Standardizer(train).fit(explode_channels(table.where("split = 'train'"), "x", length, []), set(split_of) - train)
        z = fitted.apply("x", length)
    out = table.withColumn("z", z).drop("x")
    audit.assert_no_duplicates(out.select("split", audit.window_digest("z").alias("digest")), "split", "digest", within=within)
    named = lambda part: sorted(s for s, p in split_of.items() if p == part)
    per = {
        r["subject"]: {
            "window_count": sum(c["n"] for c in counts if c["subject"] == r["subject"]),
            "class_counts": {name: sum(c["n"] for c in counts if c["subject"] == r["subject"] and c["label"] == i) for i, name in enumerate(classes)},
            "excluded_row_count": r["out"],
        }
        for r in sorted(totals, key=lambda r: r["subject"])
    }
    metadata = {
        "channels": channels, "classes": list(classes), "mode": mode, "window": {"length": length, "hop": hop}, "counts": sizes, "per_subject": per,
        "split": {"held_out": held_out, "validation": named("validation"), "train": named("train"), "seed": seed, "fraction": fraction},
    }
    return Prepared(out, fitted, metadata)


def prepare_csv(spark: SparkSession, root: str, composition: str = "harth_walking_speed", held_out: str | None = None, *, fraction: float = 0.15, tolerance_hz: float = 0.25, **options) -> Prepared:
    """CSV recordings: three channels, ten classes; an excluded label ends a run; the least subject is held out unless told."""
    rows = recordings.read_csv_recordings(spark, root, composition, rate_hz=RATE_HZ, tolerance_hz=tolerance_hz)
    held_out = rows.agg(F.min("subject")).first()[0] if held_out is None else held_out
    return prepare(rows, held_out, channels=3, classes=S.CSV_CLASSES, mode="strict", fraction=fraction, **options)


def prepare_logs(spark: SparkSession, root: str, held_out: int, variant: str = "six_channel", subjects: list[int] | None = None, **options) -> Prepared:
    """Logs: four classes; excluded rows go before runs are cut; a fold without training windows stays, unfitted."""
    rows = windows.encode_labels(recordings.read_logs(spark, root, variant, subjects), "raw_label", S.LOG_LABELS)
    return prepare(rows, held_out, channels=len(S.channels_of(variant)), classes=S.LOG_CLASSES, mode="compat", empty="keep", within=False, **options)
