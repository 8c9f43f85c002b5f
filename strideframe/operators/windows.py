"""Label runs and fixed-length windows over them, as window functions.

``compat`` drops excluded rows before runs are cut, so equal stretches around
them merge; ``strict`` lets an excluded row end the run.  Runs follow row order
and labels only; gaps in time don't end one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.errors import WindowError
from strideframe.session import small, stored


def encode_labels(rows: DataFrame, raw: str, mapping: dict, label: str = "label", excluded: int | None = None) -> DataFrame:
    """``label`` by a constant map; codes outside it become ``excluded`` (null by default)."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col(raw))
    return rows.withColumn(label, known if excluded is None else F.coalesce(known, F.lit(excluded)))


def unknown_codes(rows: DataFrame, raw: str, mapping: dict) -> DataFrame:
    """Codes that the mapping lacks, with their row counts: a small left-anti join after the aggregate."""
    codes = rows.groupBy(raw).agg(F.count("*").alias("n"))
    return codes.where(~F.col(raw).isin(list(mapping)) | F.col(raw).isNull())


def label_runs(rows: DataFrame, subject: list[str], order: list[str], label: str, mode: str) -> DataFrame:
    """``rows`` that carry a label, with ``run``, ``pos`` (from 0) and ``run_len``.

    One shuffle by subject serves all window functions; run numbers are those
    of boundaries over the rows that the mode looks at.
    """
    if mode not in ("compat", "strict"):
        raise WindowError(f"unknown run mode {mode!r}")
    if mode == "compat":
        rows = rows.where(F.col(label).isNotNull())
    w = Window.partitionBy(*subject).orderBy(*order)
    same = F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1)
    rows = rows.withColumn("_new", (~same).cast("long"))
    rows = rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    rows = rows.where(F.col(label).isNotNull())
    by_run = Window.partitionBy(*subject, "run")
    return rows.withColumns({"pos": (F.row_number().over(by_run.orderBy(*order)) - 1).cast("long"), "run_len": F.count("*").over(by_run)})


def range_parts(rows: DataFrame, subject: list[str], order: list[str], part: str = "part", parts: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of (subject, order) and stored, with the range's number: a subject of any size is many parts of about equal size.

    The numbers are stored with the rows, as another run of the same shuffle
    may draw other bounds.
    """
    keys = [*subject, *order]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return stored(dealt.withColumn(part, F.spark_partition_id()), "parts")


def row_numbers(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number in their group, from 0, by range parts: a group of any size (or the whole table, without ``group``) is many tasks."""
    dealt = range_parts(rows, group, order, "_part")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))  # a row a part and group
    shift = counts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_had"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1)
    same = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]]
    return own.join(small(stored(shift, "row-counts")), same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_own") + F.col("_had")).alias(name))


def label_runs_by_parts(rows: DataFrame, subject: list[str], order: list[str], label: str, mode: str, part: str) -> DataFrame:
    """``label_runs`` where no task sees more of a subject than one part, by a prefix scan over the parts.

    Within a subject, rows of a lower ``part`` come before those of a higher
    one (``range_parts``, or the blocks of a recording's file).  Each part
    numbers its own runs and gives its first and last label and how many rows
    its outer runs have; a window over these summaries, some rows a part,
    says which runs go on from part to part, where numbers begin, and how long
    the outer runs are in all; a join by part applies it.
    """
    if mode not in ("compat", "strict"):
        raise WindowError(f"unknown run mode {mode!r}")
    if mode == "compat":
        rows = rows.where(F.col(label).isNotNull())
    keys = [*subject, part]
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (F.row_number().over(w) > 1) & ~F.col(label).eqNullSafe(F.lag(label).over(w))
    own = rows.withColumn("_change", change.cast("long"))
    own = own.withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")
    by_run = Window.partitionBy(*keys, "_run")
    own = own.withColumns({"_pos": (F.row_number().over(by_run.orderBy(*order)) - 1).cast("long"), "_len": F.count("*").over(by_run)})
    own = stored(own, "own-runs")

    value = F.struct(F.col(label).alias("x"))
    ends = own.groupBy(*keys).agg(
        F.min_by(value, "_run").alias("_first"), F.max_by(value, "_run").alias("_last"), F.max("_run").alias("_runs"), F.min_by("_len", "_run").alias("_head"), F.max_by("_len", "_run").alias("_tail")
    )
    along = Window.partitionBy(*subject).orderBy(part)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_on", ((F.row_number().over(along) > 1) & (F.lag("_last.x").over(along).eqNullSafe(F.col("_first.x")))).cast("long"))
    ends = ends.withColumn("_base", 1 + F.coalesce(F.sum(F.col("_runs") + 1).over(before), F.lit(0)) - F.sum("_on").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    piece = lambda tail, n: F.struct(F.lit(tail).alias("tail"), (F.col("_base") + (F.col("_runs") if tail else 0)).alias("run"), n.alias("n"))
    pieces = F.filter(F.array(piece(False, F.col("_head")), piece(True, F.when(F.col("_runs") > 0, F.col("_tail")))), lambda x: x["n"].isNotNull())
    outer = ends.select(*keys, "_base", "_runs", F.explode(pieces).alias("p")).select(*keys, "_base", "_runs", "p.*")
    same = Window.partitionBy(*subject, "run")
    outer = outer.withColumns({"_all": F.sum("n").over(same), "_had": F.coalesce(F.sum("n").over(same.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    of = lambda tail, c: F.max(F.when(F.col("tail") == F.lit(tail), F.col(c)))
    carry = outer.groupBy(*keys).agg(F.max("_base").alias("_base"), F.max("_runs").alias("_runs"), of(False, "_all").alias("_head_all"), of(False, "_had").alias("_had"), of(True, "_all").alias("_tail_all"))
    carry = stored(carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_base", "_runs", "_head_all", "_had", "_tail_all"), "carries")

    met = own.join(small(carry), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).where(F.col(label).isNotNull())
    first, last = F.col("_run") == 0, F.col("_run") == F.col("_runs")
    return met.select(
        *[F.col(f"`{c}`") for c in rows.columns if c != part], (F.col("_base") + F.col("_run")).alias("run"), (F.col("_pos") + F.when(first, F.col("_had")).otherwise(0)).alias("pos"),
        F.when(first, F.col("_head_all")).when(last, F.col("_tail_all")).otherwise(F.col("_len")).alias("run_len"),
    )


def run_table(runs: DataFrame, subject: list[str], label: str) -> DataFrame:
    return runs.groupBy(*subject, "run").agg(F.max(label).alias(label), F.count("*").alias("n_rows"))


def window_size(value: int, alias: int | None = None, *, default: int, name: str = "length") -> int:
    """One size from its two spellings: the alias counts where the value is the default; two that differ are refused."""
    for v in (value, alias):
        if v is not None and (isinstance(v, bool) or not isinstance(v, int) or v < 1):
            raise WindowError(f"{name} is a positive integer, not {v!r}")
    if alias is not None and value not in (default, alias):
        raise WindowError(f"two values of {name}: {value} and {alias}")
    return value if alias is None else alias


def cut_windows(runs: DataFrame, length: int, hop: int) -> DataFrame:
    """Each sample once per window that holds it: ``widx`` from 0, ``at`` within the window.

    Window w of a run covers [w hop, w hop + length) and exists when it lies in
    the run.  A sample names its own windows, at most ceil(length / hop), so
    there is no join.
    """
    if length < 1 or hop < 1:
        raise WindowError("length and hop are at least 1")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - length + 1) / F.lit(float(hop)))).cast("long")
    last = F.least(F.floor(F.col("pos") / F.lit(hop)), F.floor((F.col("run_len") - length) / F.lit(hop))).cast("long")
    out = runs.where(F.col("run_len") >= length).withColumns({"_a": first, "_b": last}).where("_a <= _b")
    out = out.withColumn("widx", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return out.withColumn("at", F.col("pos") - F.col("widx") * hop)


def cut_grid(runs: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """``cut_windows`` of several (length, hop) settings in one pass, with ``win_len`` and ``hop``."""
    if any(length < 1 or hop < 1 for length, hop in settings):
        raise WindowError("length and hop are at least 1")
    grid = F.array(*[F.struct(F.lit(a).cast("long").alias("win_len"), F.lit(b).cast("long").alias("hop")) for a, b in settings])
    rows = runs.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g").where("run_len >= win_len")
    out = rows.withColumns({"_a": F.expr("greatest(0, ceil((pos - win_len + 1) / double(hop)))").cast("long"), "_b": F.expr("least(pos div hop, (run_len - win_len) div hop)")})
    return out.where("_a <= _b").withColumn("widx", F.explode(F.sequence("_a", "_b"))).withColumn("at", F.col("pos") - F.col("widx") * F.col("hop")).drop("_a", "_b")


def first_windows(windows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` windows by their order; None keeps all."""
    if limit is None:
        return windows
    if limit < 0:
        raise WindowError("a limit isn't negative")
    return windows.orderBy(*order).limit(limit)


def window_table(cut: DataFrame, subject: list[str], label: str, values: dict[str, str]) -> DataFrame:
    """One row per window; ``values`` name output arrays and their sample columns, in time order."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda x: x["v"])
    return cut.groupBy(*subject, "run", "widx").agg(F.max(label).alias(label), F.count("*").alias("len"), *[ordered(c).alias(name) for name, c in values.items()])


def window_grid(runs: DataFrame, subject: list[str], settings: list[tuple[int, int]]) -> DataFrame:
    """Window counts of several (length, hop) settings in one pass over the run table."""
    grid = F.array(*[F.struct(F.lit(a).cast("long").alias("win_len"), F.lit(b).cast("long").alias("hop")) for a, b in settings])
    per_run = runs.select(*subject, "run", "run_len").distinct().withColumn("g", F.explode(grid))
    n = F.when(F.col("run_len") >= F.col("g.win_len"), F.floor((F.col("run_len") - F.col("g.win_len")) / F.col("g.hop")) + 1).otherwise(0)
    return per_run.groupBy(F.col("g.win_len").alias("win_len"), F.col("g.hop").alias("hop")).agg(F.sum(n).cast("long").alias("n_windows"), F.count_if(n > 0).alias("n_runs"))
