"""Draws that depend on a seed and on keys of the row alone: equal in every layout, retry and engine with md5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int | str, keys: tuple[Column, ...]) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))


def _fraction(digest: Column, first: int) -> Column:
    return (F.conv(F.substring(digest, first, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def uniform(seed: int | str, *keys: Column) -> Column:
    """In (0, 1); a null key counts as the empty string."""
    return _fraction(_digest(seed, keys), 1)


def normal(seed: int | str, *keys: Column) -> Column:
    """Standard normal by Box and Muller, from two stretches of one digest."""
    digest = _digest(seed, keys)
    return F.sqrt(-2 * F.ln(_fraction(digest, 1))) * F.cos(2 * math.pi * _fraction(digest, 9))


def order_key(seed: int | str, *keys: Column) -> Column:
    """60 bits to order rows by at random."""
    return F.conv(F.substring(_digest(seed, keys), 1, 15), 16, 10).cast("long")
