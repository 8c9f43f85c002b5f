"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import fit_for_broadcast, settle, words

_BITS = 12  # of the hash a histogram level resolves
KEY_BITS = 60


def mix_key(doc_id: Column) -> Column:
    """A 60-bit key of the id, equal on every engine with md5; null ids share the key of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mixing_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Weights are dealt by code point order, null last.  Water filling: with the
    sources in order of cap / weight, the first level that stays under its own
    source's ratio is the common level per unit of weight.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    t = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    t = t.withColumns({
        "_ratio": F.col("_cap") / F.col("_w"),
        "_before": F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_from": F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(Window.partitionBy()) * float(share),
    })
    t = t.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_from"))
    t = t.withColumn("_level", F.min_by(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), F.when(F.col("_ratio") > F.col("_level"), F.col("_ratio"))).over(Window.partitionBy()))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_level")))
    return t.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    levels: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_broadcast_sources: int = 100_000,
    payload: list[str] | None = None,
    scratch: list[DataFrame] | None = None,
) -> DataFrame:
    """One row per document: id, size (words), source_size, target, copies and taken.

    A source takes ``floor(target / size)`` whole passes, and one more of the
    documents whose hash key lies under a threshold.  The threshold comes from
    histograms: tokens by (source, first 12 bits of the key); the bucket in
    which the budget ends is the only one that is split by the next 12 bits,
    ``levels`` times.  The documents of the last boundary bucket are taken
    when that brings the source nearer to its target.  Nothing is sorted by
    document, and reruns agree.

    Null text has size 0, null sources form one source (last), repeated rows
    and equal keys are taken together, an empty table gives an empty result.
    Targets keep to ``max_epochs`` times a source's size, and no document is
    taken more often.  Texts of any length are counted whole; null ids have one
    key.  Columns in ``payload`` are passed on, others ignored.  Tables that
    the result still reads are added to ``scratch``, for a caller that settles
    it and discards them.
    """
    keep = payload or []
    rows = docs.select(
        F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("_d"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words(F.col(text_col).cast("string"))).cast("long").alias("size"),
        mix_key(F.col(id_col)).alias("_key"),
    )
    rows = settle(rows, "mix")
    targets = mixing_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("_k", whole).withColumn("_left", F.when(F.col("source_size") > 0, F.col("target") - F.col("_k") * F.col("source_size")).otherwise(0.0))
    plan = settle(plan.withColumn("_prefix", F.lit(0).cast("long")), "mixplan")
    tables = [rows, plan]
    for level in range(1, levels + 1):
        shift = KEY_BITS - _BITS * level
        p = fit_for_broadcast(plan.where("_left > 0").select(F.col("source").alias("_s"), F.col("_left").alias("_want"), F.col("_prefix").alias("_at")), max_broadcast_sources)
        inside = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_key", shift + _BITS) == F.col("_at"))
        hist = rows.join(p, inside).groupBy(F.col("source").alias("_s"), "_want", F.shiftright("_key", shift).alias("_b")).agg(F.sum("size").alias("_t"))
        upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_cum", F.sum("_t").over(upto)).where(F.col("_cum") > F.col("_want"))
        edge = hist.groupBy("_s").agg(F.min("_b").alias("_b"), F.min_by(F.col("_want") - (F.col("_cum") - F.col("_t")), "_b").alias("_rest"), F.min_by(F.col("_cum") - F.col("_want"), "_b").alias("_over"))
        plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "_k",
            F.coalesce(F.col("_rest"), F.lit(0.0)).alias("_left") if level < levels else F.lit(0.0).alias("_left"),
            (F.coalesce("_b", F.shiftleft("_prefix", _BITS)) + (F.coalesce(F.col("_over") < F.col("_rest"), F.lit(False)).cast("long") if level == levels else F.lit(0))).alias("_prefix"),
        )
        plan = settle(plan, "mixplan")
        tables.append(plan)
    if scratch is not None:
        scratch += tables
    under = F.shiftright("_key", KEY_BITS - _BITS * levels) < F.col("_prefix")
    plan = fit_for_broadcast(plan.withColumnRenamed("source", "_s"), max_broadcast_sources)
    copies = (F.col("_k") + under.cast("long")).alias("copies")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("_d", "size", "source_size", "target", copies)
    return out.select(
        F.col("_d.id").alias(id_col), *[F.col(f"_d.c{i}").alias(c) for i, c in enumerate(keep)],
        "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )
