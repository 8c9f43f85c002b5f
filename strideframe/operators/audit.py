"""Exact duplicates within and across splits by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.errors import DuplicateWindowError


def text_digest(column):
    return F.sha1(column)


def window_digest(column: str):
    """SHA-1 of a flat window's float32 bytes in native order, batch by batch."""
    import pandas as pd

    def digest(values):
        import hashlib

        import numpy as np

        return values.map(lambda v: None if v is None else hashlib.sha1(np.ascontiguousarray(v, dtype=np.float32).tobytes()).hexdigest())

    digest.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(digest, "string")(F.col(column))


def digest_counts(rows: DataFrame, split: str, digest: str) -> DataFrame:
    """(digest, one count per split): one partial aggregation, no join between splits."""
    return rows.groupBy(digest, split).agg(F.count("*").alias("n"))


def cross_split_duplicates(rows: DataFrame, split: str, digest: str) -> DataFrame:
    """Per pair of splits: equal digests and the windows that carry them on each side."""
    per = digest_counts(rows, split, digest).groupBy(digest).agg(F.array_sort(F.collect_list(F.struct(F.col(split).alias("s"), "n"))).alias("g")).where(F.size("g") > 1)
    pairs = per.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where(F.col("a.s") < F.col("b.s"))
    return pairs.groupBy(F.col("a.s").alias("left_split"), F.col("b.s").alias("right_split")).agg(
        F.count("*").alias("n_digests"), F.sum("a.n").alias("left_windows"), F.sum("b.n").alias("right_windows")
    )


def within_split_duplicates(rows: DataFrame, split: str, digest: str) -> DataFrame:
    return digest_counts(rows, split, digest).where("n > 1").groupBy(split).agg(F.count("*").alias("n_digests"), F.sum(F.col("n") - 1).alias("n_extra"))


def train_validation_duplicates(rows: DataFrame, split: str, digest: str) -> DataFrame:
    """The narrower audit of training against validation; says nothing of what is held out."""
    return cross_split_duplicates(rows.where(F.col(split).isin("train", "validation")), split, digest)


def assert_no_duplicates(rows: DataFrame, split: str, digest: str, *, within: bool = False, train_validation_only: bool = False) -> DataFrame:
    """``rows``, or an error with the counts; ``within`` also looks for repeats inside a split."""
    seen = rows.where(F.col(split).isin("train", "validation")) if train_validation_only else rows
    found = [r.asDict() for r in cross_split_duplicates(seen, split, digest).collect()]  # one row a pair of splits
    if within:
        found += [r.asDict() for r in within_split_duplicates(seen, split, digest).collect()]  # one row a split
    if found:
        raise DuplicateWindowError(found)
    return rows
