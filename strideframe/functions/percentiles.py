"""Exact percentiles of many rows by counting in cells and looking closer where a rank lies.

``percentile`` keeps every distinct value of a group in one task.  Here each
scan counts a group's values in equal cells between known bounds; the cell
that holds a rank is split again, and only when few values are left in it are
they ranked.  Nothing but counts by group and cell is shuffled before that.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 4096


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], *, few: int = 100_000) -> DataFrame:
    """(by, one column a share): linear between neighbouring ranks, as ``percentile`` gives them.

    Nulls don't count; a group of nulls only has no row.  Values are finite
    numbers.  ``few`` bounds how many values of one cell are ranked in a task;
    it changes the number of scans and not the result.  Groups are few (their
    bounds come to the driver).
    """
    spark, keys = df.sparkSession, [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    kinds = [f"{k} {kind}" for k, kind in rows.dtypes[:-1]]
    wanted, found = [], {}
    for r in rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect():
        if r["n"]:
            ranks = {math.floor((r["n"] - 1) * q) for q in shares.values()} | {math.ceil((r["n"] - 1) * q) for q in shares.values()}
            wanted += [(tuple(r[: len(keys)]), rank, 0, r["n"], r["low"], r["high"]) for rank in ranks]
            found[tuple(r[: len(keys)])] = {"n": r["n"]}
    same = lambda side: F.lit(True) if not keys else _all([F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in keys])

    def bounded(cells: list[tuple]) -> DataFrame:
        table = spark.createDataFrame([(*g, low, high) for g, low, high in cells], ", ".join([*[f"c{k}" for k in kinds], "_low double", "_high double"]))
        return rows.join(F.broadcast(table), same("c") & F.col("_v").between(F.col("_low"), F.col("_high")))

    while wanted:
        small = {(g, low, high) for g, _, _, n, low, high in wanted if n <= few and low < high}
        large = {(g, low, high) for g, _, _, n, low, high in wanted if n > few and low < high}
        values: dict[tuple, list] = {}
        if small:
            ordered = bounded(sorted(small, key=repr)).groupBy(*keys, "_low", "_high").agg(F.array_sort(F.collect_list("_v")).alias("_all"))
            at = {}
            for g, rank, before, _, low, high in wanted:
                at.setdefault((g, low, high), []).append(rank - before)
            asked = spark.createDataFrame([(*c[0], c[1], c[2], at[c]) for c in sorted(small, key=repr)], ", ".join([*[f"d{k}" for k in kinds], "_l double", "_h double", "_at array<long>"]))
            picked = ordered.join(F.broadcast(asked), same("d") & (F.col("_low") == F.col("_l")) & (F.col("_high") == F.col("_h")))
            for r in picked.select(*keys, "_low", "_high", "_at", F.transform("_at", lambda i: F.get("_all", i.cast("int"))).alias("_x")).collect():
                for place, x in zip(r["_at"], r["_x"], strict=True):
                    values[(tuple(r[: len(keys)]), r["_low"], r["_high"], place)] = x
        counts: dict[tuple, list] = {}
        if large:
            share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
            cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1))
            for r in bounded(sorted(large, key=repr)).groupBy(*keys, "_low", "_high", cell.alias("_c")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most")).orderBy("_c").collect():
                counts.setdefault((tuple(r[: len(keys)]), r["_low"], r["_high"]), []).append((r["n"], r["least"], r["most"]))
        nearer = []
        for g, rank, before, n, low, high in wanted:
            if low == high:
                found[g][rank] = low
            elif n <= few:
                found[g][rank] = values[(g, low, high, rank - before)]
            else:
                for size, least, most in counts[(g, low, high)]:
                    if rank < before + size:
                        nearer.append((g, rank, before, size, least, most))
                        break
                    before += size
        wanted = nearer
    out = []
    for g, own in found.items():
        place = [(own["n"] - 1) * q for q in shares.values()]
        out.append((*g, *[own[math.floor(p)] + (own[math.ceil(p)] - own[math.floor(p)]) * (p - math.floor(p)) for p in place]))
    names = [f"`{c}` {kind.split(' ', 1)[1]}" for c, kind in zip(by, kinds, strict=True)]
    return spark.createDataFrame(out, ", ".join([*names, *[f"`{name}` double" for name in shares]]))


def _all(rules: list):
    whole = rules[0]
    for rule in rules[1:]:
        whole = whole & rule
    return whole
