"""Scans of sensor recordings into one tall table."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe import schema as S
from strideframe.errors import SchemaError
from strideframe.session import small, stored

LOG_NAME = r"(?i)^subject(\d+)_ideal\.log$"


def subject_of(name: str) -> int:
    """The subject number of a log's file name, without leading zeros."""
    m = re.match(LOG_NAME, name)
    if not m:
        raise SchemaError(f"not a recording log: {name!r}")
    return int(m[1])


def _names(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """(path, name) of the files that lie directly in the folders, those without bytes too; nothing is read."""
    paths = [unquote(x) for x in spark.read.option("pathGlobFilter", glob).text(roots).inputFiles()]  # one name a file
    return spark.createDataFrame([(x, x.rsplit("/", 1)[-1]) for x in paths], "path string, name string")


def discover_logs(spark: SparkSession, root: str, subjects: list[int] | None = None) -> DataFrame:
    """(subject, path) of the logs that lie directly in ``root``; errors on repeats, on missing subjects and on none at all."""
    found = _names(spark, [root], "*").where(F.col("name").rlike(LOG_NAME))
    found = found.select(F.regexp_extract("name", LOG_NAME, 1).cast("int").alias("subject"), "path")
    twice = [r[0] for r in found.groupBy("subject").count().where("count > 1").select("subject").collect()]
    if twice:
        raise SchemaError(f"subjects with several logs: {sorted(twice)}")
    if subjects is not None:
        found = found.where(F.col("subject").isin(subjects))
    have = {r[0] for r in found.select("subject").collect()}
    if not have or (subjects is not None and set(subjects) - have):
        raise SchemaError(f"missing logs: {sorted(set(subjects or []) - have) or 'all'}")
    return found


def _lines(spark: SparkSession, paths: list[str], glob: str = "*") -> DataFrame:
    """(path, block, at, line) of text files, which Spark reads in ranges of ``spark.sql.files.maxPartitionBytes``.

    ``block`` is where a line's range begins in its file and ``at`` rises by
    one from line to line of a range.  Lines end with ``\\n`` or ``\\r\\n``.
    """
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).text(paths)
    line = F.regexp_replace(F.regexp_replace("value", r"\r$", ""), r"^\x{FEFF}", "")
    return lines.select(F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), line.alias("line"))


def _blocks(rows: DataFrame, *more) -> DataFrame:
    """Of each range of a subject's stored lines: its first ``at``, its lines, and the lines before it in the file."""
    of = rows.groupBy("subject", "block").agg(F.min("at").alias("first_at"), F.count("*").alias("n"), *more)
    before = Window.partitionBy("subject").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return of.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _numbered(rows: DataFrame, blocks: DataFrame, skip: int = 0) -> DataFrame:
    """``rows`` with ``seq``, the line's number in its file less ``skip``."""
    starts = blocks.select(F.col("subject").alias("_s"), F.col("block").alias("_b"), (F.col("before") - F.col("first_at") - skip).alias("_shift"))
    met = rows.join(small(stored(starts, "blocks")), (F.col("subject") == F.col("_s")) & (F.col("block") == F.col("_b")))
    return met.withColumn("seq", (F.col("at") + F.col("_shift")).cast("long")).drop("_s", "_b", "_shift")


def _asked(spark: SparkSession, names: list, kind: str) -> DataFrame:
    """(subject, place): where a subject stands in the request."""
    return spark.createDataFrame([(x, i) for i, x in enumerate(names)], f"_s {kind}, place int")


def read_logs(spark: SparkSession, root: str, variant: str = "six_channel", subjects: list[int] | None = None) -> DataFrame:
    """(subject, seq, ch array<float>, raw_label int, place, block) of the logs; strict about columns, numbers and labels.

    Files are read in ranges, in one pass that parses, checks and stores;
    ``seq`` is the line's number, counted by ranges.  ``place`` is the
    subject's in the request (without one: by number), ``block`` the range,
    for operators that work by parts.
    """
    found = discover_logs(spark, root, subjects).collect()  # one row a file
    names = subjects if subjects is not None else sorted(r.subject for r in found)
    subject = F.regexp_extract(F.element_at(F.split("path", "/"), -1), LOG_NAME, 1).cast("int")
    rows = _lines(spark, [r.path for r in found]).select(subject.alias("subject"), "block", "at", F.transform(F.split("line", "\t"), lambda x: x.try_cast("double")).alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    label = F.get("v", F.lit(S.LABEL_COLUMN))
    rows, seen = S.watched(rows, {"columns": F.size("v") == S.LOG_COLUMNS, "numbers": F.forall("v", number), "labels": label == F.floor(label)})
    channels = F.array(*[F.get("v", F.lit(i)).cast("float") for i in S.channels_of(variant)])
    rows = stored(rows.select("subject", "block", "at", channels.alias("ch"), F.when(F.abs(label) < 2**31, label).cast("int").alias("raw_label")), "logs")
    S.require_seen(seen)
    blocks = _blocks(rows)
    if empty := {r.subject for r in found} - {r.subject for r in blocks.select("subject").distinct().collect()}:
        raise SchemaError(f"logs without lines: {sorted(empty)}")
    out = _numbered(rows, blocks).join(F.broadcast(_asked(spark, names, "int")), F.col("subject") == F.col("_s"))
    return out.select("subject", "seq", "ch", "raw_label", "place", "block")


def read_csv_recordings(spark: SparkSession, root: str, composition: str, subjects: list[str] | None = None, *, rate_hz: float = 50.0, tolerance_hz: float = 0.25) -> DataFrame:
    """(subject, seq, ts, ch, raw_label, label, place, block) of a composition's CSV files; ``subject`` is ``dataset:stem``.

    Files are read in ranges, in one pass that parses, checks and stores the
    rows: no file has to fit a task.  ``seq`` is the line's number, from lines
    counted by ranges; ``place`` is the recording's in the request (without
    one: by dataset and name), ``block`` the range, for operators that work by
    parts.  Each dataset must have files.  A header must be one of the two
    declared ones; fields must be finite numbers; in file order timestamps
    rise strictly, over two rows at least; the rate is one over the median
    step.  Labels outside a dataset's map are excluded (-1).
    """
    datasets = list(S.COMPOSITIONS[composition])
    dataset, stem = F.element_at(F.split("path", "/"), -2), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    dirs = [f"{root}/{x}" for x in datasets]
    found = _names(spark, dirs, "*.csv").select(dataset.alias("dataset"), F.concat_ws(":", dataset, stem).alias("subject"), "path").collect()  # one row a file
    if lost := set(datasets) - {r.dataset for r in found}:
        raise SchemaError(f"no recordings in {sorted(lost)}")
    if subjects is not None and (lost := set(subjects) - {r.subject for r in found}):
        raise SchemaError(f"missing recordings: {sorted(lost)}")
    names = list(subjects) if subjects is not None else [r.subject for r in sorted(found, key=lambda r: (datasets.index(r.dataset), r.subject))]
    lines = _lines(spark, dirs, "*.csv").select(dataset.alias("dataset"), F.concat_ws(":", dataset, stem).alias("subject"), "block", "at", "line")
    lines = lines.join(F.broadcast(_asked(spark, names, "string")), F.col("subject") == F.col("_s")).drop("_s")

    short, long = ([*S.csv_schema(index).names] for index in (False, True))
    header = (F.col("block") == 0) & F.col("line").isin(",".join(short), ",".join(long))
    v = F.split("line", ",", -1)
    rows = lines.select("dataset", "subject", "place", "block", "at", header.alias("header"), F.size(v).alias("n_fields"), v.alias("v"))
    field = lambda name: F.get("v", F.when(F.col("n_fields") == len(long), long.index(name)).otherwise(short.index(name)))
    rows = rows.select(
        "dataset", "subject", "place", "block", "at", "header", "n_fields", field("timestamp").try_cast("timestamp_ntz").alias("ts"),
        F.array(*[field(c).try_cast("double") for c in S.CSV_FIELDS]).alias("numbers"), field("label").try_cast("double").alias("raw"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rules = {"fields": F.col("n_fields").isin(len(short), len(long)), "timestamps": F.col("ts").isNotNull(), "finite": F.forall("numbers", finite), "labels": F.col("raw") == F.floor("raw")}
    rows, seen = S.watched(rows, {name: F.col("header") | F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})
    rows = stored(rows, "recordings")

    data = ~F.col("header")
    blocks = _blocks(
        rows, F.count_if("header").alias("heads"), F.min_by("header", "at").alias("head_first"), F.max(F.when(F.col("header"), F.col("n_fields"))).alias("head_fields"),
        F.min(F.when(data, F.col("n_fields"))).alias("least"), F.max(F.when(data, F.col("n_fields"))).alias("most"), F.max_by("ts", F.when(data, F.col("at"))).alias("last_ts"),
    )
    blocks = stored(blocks, "ranges")
    by_file = blocks.groupBy("subject").agg(F.sum("heads").alias("heads"), F.min_by("head_first", "block").alias("first"), F.max("head_fields").alias("fields"), F.min("least").alias("least"), F.max("most").alias("most"))
    wrong = by_file.where((F.col("heads") != 1) | ~F.col("first")).select("subject").collect()
    empty = set(names) - {r.subject for r in by_file.select("subject").collect()}
    if wrong or empty:
        raise SchemaError(f"files without a declared header: {sorted({r.subject for r in wrong} | empty)}")
    S.require_seen(seen)
    if uneven := by_file.where("least <> fields or most <> fields").select("subject").collect():
        raise SchemaError(f"rows of other fields than the header's: {sorted(r.subject for r in uneven)}")

    steps = time_steps(rows.where(data), ["subject"], "ts", ["at"], blocks)
    fine = (F.col("n_rows") >= 2) & (F.col("min_step_s") > 0) & (F.abs(F.col("rate_hz") - rate_hz) <= tolerance_hz)
    bad = {r.subject for r in by_file.where("least is null").select("subject").collect()} | {r.subject for r in steps.where(~F.coalesce(fine, F.lit(False))).select("subject").collect()}
    if bad:
        raise SchemaError(f"timestamps don't rise at {rate_hz} Hz over two rows at least: {sorted(bad)}")
    label = F.coalesce(*[F.when(F.col("dataset") == x, F.element_at(F.create_map(*[F.lit(y) for pair in S.CSV_LABELS[x].items() for y in pair]), F.col("raw").cast("int"))) for x in datasets], F.lit(S.EXCLUDED))
    thigh = [i for i, c in enumerate(S.CSV_FIELDS) if c in ("thigh_x", "thigh_y", "thigh_z")]
    out = _numbered(rows.where(data), blocks, skip=1)
    return out.select("subject", "seq", "ts", F.array(*[F.get("numbers", F.lit(i)).cast("float") for i in thigh]).alias("ch"), F.col("raw").cast("int").alias("raw_label"), label.alias("label"), "place", "block")


def time_steps(rows: DataFrame, subject: list[str], ts: str, order: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """Per subject: rows, least step, count of steps that don't rise, and the rate as one over the median step.

    With ``blocks`` (subject, ``block``, ``last_ts``) rows are looked at by
    ``block``; a block's first step comes from the last time before it.
    """
    w = Window.partitionBy(*subject, *(["block"] if blocks is not None else [])).orderBy(*order)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    before = F.lag(ts).over(w)
    if blocks is not None:
        along = Window.partitionBy(*subject).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ends = blocks.select(*[F.col(c).alias(f"_{c}") for c in subject], F.col("block").alias("_block"), F.last("last_ts", ignorenulls=True).over(along).alias("_end"))
        rows = rows.select(*subject, "block", *order, ts).join(small(stored(ends, "ends")), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in subject] + [F.col("block") == F.col("_block")])
        before = F.coalesce(before, F.col("_end"))
    s = rows.select(*subject, ((us(F.col(ts)) - us(before)) / F.lit(1e6)).alias("step"))
    return s.groupBy(*subject).agg(
        F.count("*").alias("n_rows"), F.min("step").alias("min_step_s"), F.count_if(F.col("step") <= 0).alias("n_not_rising"),
        F.try_divide(F.lit(1.0), F.percentile("step", 0.5)).alias("rate_hz"),
    )
