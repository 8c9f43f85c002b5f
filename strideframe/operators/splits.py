"""Subject and window splits. Draws happen on the driver over tiny subject lists, so they repeat exactly."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.errors import SplitError
from strideframe.functions.draws import order_key
from strideframe.operators.windows import row_numbers
from strideframe.session import small, stored

TILE = 256  # subjects
DEALT = 16  # pairs of tiles that stay together
MOST_TILES = 4096  # broadcast
MOST_TILE_TASKS = 1024


def loso_folds(subjects: DataFrame, subject: str) -> DataFrame:
    """(held_out, subject, split): every subject held out once.

    The rows are the square of the subjects.  Pairs of tiles of about ``TILE``
    subjects are dealt to tasks by their numbers, and a task gives each
    held-out subject of the one with the whole other, so that rows repeat at a
    short distance and files stay small.  Spark keeps all rows that a join makes
    of one row, so that a shuffle lies between the pairs and their subjects.
    """
    s = stored(subjects.select(subject).distinct(), "subjects")
    n = -(-s.count() // TILE) or 1
    tile = F.pmod(F.xxhash64(subject), F.lit(n))
    tiles = stored(s.groupBy(tile.alias("tile")).agg(F.collect_list(F.struct(subject)).alias("tile_of")), "tiles")
    number = lambda name: tiles.select(F.col("tile").alias(name))
    met = number("own_tile").crossJoin(small(number("held_tile"))).repartition(min(n, MOST_TILE_TASKS), "own_tile", F.floor(F.col("held_tile") / DEALT))
    side = lambda name: small(tiles.select(F.col("tile").alias(f"{name}_tile"), F.col("tile_of").alias(f"{name}_subjects")), MOST_TILES)
    pairs = met.join(side("own"), "own_tile").join(side("held"), "held_tile")
    pairs = pairs.select("own_subjects", F.explode("held_subjects").alias("held")).select("held", F.explode("own_subjects").alias("own"))
    held_out, own = F.col(f"held.{subject}"), F.col(f"own.{subject}")
    return pairs.select(held_out.alias("held_out"), own.alias(subject), F.when(held_out == own, "held_out").otherwise("pool").alias("split"))


def loso_fold_numbers(subjects: DataFrame, subject: str) -> DataFrame:
    """(subject, fold): the fold that holds the subject out, and so the whole design in one row a subject."""
    return row_numbers(subjects.select(subject).where(F.col(subject).isNotNull()).distinct(), [], [subject], "fold")


def draw_subjects(pool: list, held_out, fraction: float = 0.2, seed: int = 42) -> dict:
    """subject: split. The sorted pool without the held-out one is shuffled by MT19937; the first are validation."""
    if held_out not in pool or len(set(pool)) != len(pool):
        raise SplitError("the held-out subject isn't in the pool, or subjects repeat")
    rest = sorted(s for s in pool if s != held_out)
    if not rest:
        raise SplitError("no training subject is left")
    np.random.RandomState(seed).shuffle(rest)
    n = min(max(1, int(len(rest) * fraction)), len(rest) - 1)
    return {held_out: "held_out"} | {s: "validation" for s in rest[:n]} | {s: "train" for s in rest[n:]}


def assign_split(rows: DataFrame, subject: str, splits: dict, outside: str | None = None) -> DataFrame:
    """``split`` by subject: a broadcast join with the driver's list; subjects outside it go, or are in the split ``outside``."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[subject]
    table = spark.createDataFrame([(k, v) for k, v in splits.items()], f"{subject} {kind}, split string")
    if outside is None:
        return rows.join(F.broadcast(table), subject)
    return rows.join(F.broadcast(table), subject, "left").withColumn("split", F.coalesce("split", F.lit(outside)))


def stratified_allocation(counts: DataFrame, label: str, n: str, fraction: float = 0.2) -> DataFrame:
    """Validation windows per class by largest remainders, at least one a class.

    ``counts`` has one row per class; ties go to the smaller class.  Where a
    class can't give one and keep one, or the sizes are under the number of
    classes, ``stratified`` is false and no allocation is given.
    """
    everything = Window.partitionBy(F.lit(1))
    t = counts.select(F.col(label), F.col(n).cast("long").alias("n"))
    t = t.withColumns({"total": F.sum("n").over(everything), "k": F.count("*").over(everything), "least": F.min("n").over(everything)})
    t = t.withColumn("n_val", F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(fraction))).cast("long"))
    t = t.withColumn("ideal", F.col("n") * F.col("n_val") / F.col("total"))
    t = t.withColumn("base", F.greatest(F.lit(1), F.floor("ideal")).cast("long"))
    t = t.withColumn("left", F.col("n_val") - F.sum("base").over(everything))
    t = t.withColumn("rank", F.row_number().over(everything.orderBy(F.desc(F.col("ideal") - F.floor("ideal")), label)))
    ok = (F.col("n_val") >= F.col("k")) & (F.col("total") - F.col("n_val") >= F.col("k")) & (F.col("least") >= 2)
    give = F.col("base") + (F.col("rank") <= F.col("left")).cast("long")
    return t.select(label, "n", ok.alias("stratified"), F.when(ok, F.least(give, F.col("n") - 1)).alias("n_validation"))


def stratified_split(rows: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 42, least: int = 0) -> DataFrame:
    """``rows`` with ``split``: the first of each class in a random order are validation, as many as ``stratified_allocation`` gives.

    Where that can't stratify, the order runs over all rows.  Fewer rows than
    ``least`` are all training; a validation part that leaves no training rows
    is refused.  ``key`` tells rows apart; null labels are a class.  No class
    is sorted: counts by class and leading bits of the order find the cell in
    which its part ends, and only that cell is ranked.
    """
    if not 0 < fraction < 1:
        raise SplitError("the fraction lies between 0 and 1")
    place = F.struct(order_key(seed, F.col(key)).alias("at"), F.col(key).alias("key"))
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(label).alias("class"), place.alias("place"))
    keyed = keyed.withColumn("cell", F.shiftright("place.at", 48))
    cells = keyed.groupBy("class", "cell").agg(F.count("*").alias("n"))
    sizes = stratified_allocation(cells.groupBy("class").agg(F.sum("n").alias("n")), "class", "n", fraction).collect()  # one row a class
    total = sum(r["n"] for r in sizes)
    whole = rows.withColumn("split", F.lit("train"))
    if total < max(least, 1):
        return whole
    n_train, n_val = split_sizes(total, fraction)
    if n_train < 1:
        raise SplitError("no training row is left")
    kind = dict(rows.dtypes)[label]
    if sizes[0]["stratified"]:
        asked = [(r["class"], r["n_validation"]) for r in sizes]
    else:
        keyed = keyed.withColumn("class", F.lit(None).cast(kind))
        cells, asked = cells.groupBy(F.lit(None).cast(kind).alias("class"), "cell").agg(F.sum("n").alias("n")), [(None, n_val)]
    asked = F.broadcast(rows.sparkSession.createDataFrame(asked, f"wanted {kind}, take long"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("cell")) - F.col("n")
    ends = cells.withColumn("before", before).join(asked, F.col("class").eqNullSafe(F.col("wanted")))
    ends = ends.where("before < take and take <= before + n").select(F.col("class").alias("c"), F.col("cell").alias("end"), (F.col("take") - F.col("before")).alias("rest"))
    last = keyed.join(F.broadcast(ends), F.col("class").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("end")))
    last = last.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy("place"))).where("rank = rest").select("c", F.col("place").alias("last"))
    out = keyed.join(F.broadcast(last), F.col("class").eqNullSafe(F.col("c")))  # a row a class on the broadcast sides
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns], F.when(F.col("place") <= F.col("last"), "validation").otherwise("train").alias("split"))


def draw_per_class(labels: np.ndarray, cap: int, g: np.random.Generator) -> np.ndarray:
    """Positions kept: at most ``cap`` of each class, classes in rising order on one generator; cap <= 0 keeps all."""
    kept = []
    for k in np.unique(labels):
        own = np.flatnonzero(labels == k)
        kept.append(own if cap <= 0 or len(own) <= cap else np.sort(g.choice(own, cap, replace=False)))
    return np.concatenate(kept) if kept else np.zeros(0, int)


def draw_rows_per_class(rows: DataFrame, label: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each class, drawn by seed and key; equal in every layout, retry and order of rows.

    A class is neither sorted nor gathered, whatever the cap: counts by class
    and leading bits of the drawn order, added up in the tasks, find the cell
    in which a class's part ends, and only that cell is ranked.  ``key`` tells
    rows apart (rows of one key come or go together, so the last one may bring
    a class over its cap); null labels are a class; ``cap`` of 0 or less keeps
    all rows, and so does a class of no more than the cap.
    """
    if cap <= 0:
        return rows
    place = F.struct(order_key(seed, F.col(key)).alias("at"), F.col(key).alias("key"))
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(label).alias("class"), place.alias("place"))
    keyed = keyed.withColumn("cell", F.shiftright("place.at", 48))
    cells = keyed.groupBy("class", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("cell")) - F.col("n")
    ends = cells.withColumn("before", before).where((F.col("before") < cap) & (F.col("before") + F.col("n") >= cap))
    ends = small(stored(ends.select(F.col("class").alias("c"), F.col("cell").alias("end"), (F.lit(cap) - F.col("before")).alias("rest")), "draw-ends"))  # a row a class
    last = keyed.join(ends, F.col("class").eqNullSafe(F.col("c")) & (F.col("cell") == F.col("end")))
    last = last.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy("place"))).where("rank = rest").select("c", F.col("place").alias("last"))
    out = keyed.join(small(stored(last, "draw-lasts")), F.col("class").eqNullSafe(F.col("c")), "left")
    return out.where(F.col("last").isNull() | (F.col("place") <= F.col("last"))).select(*[F.col(f"row.`{c}`") for c in rows.columns])


def scenario_populations(real: DataFrame, synthetic: DataFrame, label: str, order: str, *, scarce: int, synthetic_cap: int = 0, seed: int | None = None) -> DataFrame:
    """Union of the scenarios trtr, scarce, tstr and tstr_scarce with ``scenario`` and ``origin``.

    The per-class caps keep the first rows by ``order``, as a ranked filter
    (which Spark applies in each task before the shuffle, up to caps of 1000);
    with ``seed`` they are drawn by it and ``order`` (``draw_rows_per_class``).
    Nothing is collected.
    """
    top = Window.partitionBy(label).orderBy(order)
    first = lambda df, cap: df.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= cap).drop("_r")
    cut = first if seed is None else lambda df, cap: draw_rows_per_class(df, label, order, cap, seed)
    few = cut(real, scarce)
    syn = synthetic if synthetic_cap <= 0 else cut(synthetic, synthetic_cap)
    mark = lambda df, name, origin: df.withColumns({"scenario": F.lit(name), "origin": F.lit(origin)})
    out = mark(real, "trtr", "real").unionByName(mark(few, "scarce", "real")).unionByName(mark(syn, "tstr", "synthetic"))
    return out.unionByName(mark(syn, "tstr_scarce", "synthetic")).unionByName(mark(few, "tstr_scarce", "real"))


def split_sizes(n: int, fraction: float) -> tuple[int, int]:
    n_val = max(1, math.ceil(n * fraction))
    return n - n_val, n_val
