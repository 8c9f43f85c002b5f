"""Product codes of vectors, by Lloyd rounds that carry their sums on from what has changed."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import discard, fit_for_broadcast, settle

BLOCK = 2048  # vectors whose distances are held at once


def nearest(x: np.ndarray, book: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Index of the entry of ``book`` that is nearest to each row of ``x``, the lower one of equals.

    With ``exact_floats`` every product and sum stays an integer below 2^53, so
    that a matrix product of doubles has the same result as integers.
    """
    if exact_floats:
        c = book.astype(np.float64)
        return np.argmin((c * c).sum(axis=1) - 2.0 * (x.astype(np.float64) @ c.T), axis=1)
    out = np.empty(len(x), np.int64)
    step = max(1, (1 << 20) // max(1, book.size))
    for lo in range(0, len(x), step):
        gap = x[lo : lo + step, None, :] - book[None]
        out[lo : lo + step] = np.argmin((gap * gap).sum(axis=2), axis=1)
    return out


def assigned(x: np.ndarray, books: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Entry of each part: ``x`` is (vectors, parts, width), ``books`` (parts, entries, width)."""
    out = np.empty(x.shape[:2], np.int64)
    for lo in range(0, len(x), BLOCK):
        for part in range(x.shape[1]):
            out[lo : lo + BLOCK, part] = nearest(x[lo : lo + BLOCK, part], books[part], exact_floats)
    return out


class Changes:
    """What changed assignments add to and take from each entry's sum and count, gathered over a task."""

    def __init__(self, books: np.ndarray):
        self.parts, self.entries, self.width = books.shape
        self.cells = np.zeros((self.parts, self.entries, self.width + 1), np.int64)  # the last one counts

    def add(self, x: np.ndarray, before: np.ndarray | None, now: np.ndarray) -> None:
        for part in range(self.parts):
            moved = np.arange(len(x)) if before is None else np.flatnonzero(before[:, part] != now[:, part])
            rows = np.concatenate([x[moved, part], np.ones((len(moved), 1), np.int64)], axis=1)
            np.add.at(self.cells[part], now[moved, part], rows)
            if before is not None:
                np.subtract.at(self.cells[part], before[moved, part], rows)

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """(cell, change) of the cells that change."""
        flat = self.cells.ravel()
        at = np.flatnonzero(flat)
        return at, flat[at]


_STATE = "v array<bigint>, codes array<int>, cell bigint, change bigint"


def compress_vectors(
    vectors: DataFrame,
    *,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: tuple[str, ...] = (),
) -> tuple[DataFrame, np.ndarray]:
    """(rows of id, ``keep`` columns, ``v`` (integers), ``codes`` (an entry for each part) and ``error``; codebooks by part, entry, position).

    A component x becomes the integer floor(``scale`` * x); a vector is cut
    into ``parts`` equal parts, each with a codebook of its own that begins
    with that part of the ``entries`` vectors of the least ids.  A round
    assigns each part to its nearest entry (squared distance, ties to the
    lower index) and makes each entry the floored mean of its parts; an entry
    without parts stays.  After ``rounds`` rounds all parts are assigned again.

    The assignments of a round are kept in a table beside the vectors.  The
    next round compares with them, and only what changed parts add to and take
    from an entry is summed up in the task and shuffled, one row a task and
    cell; the running sums are integers, so the result is that of summing all
    again, in any order.  Codebooks and sums have ``entries`` times the
    vector's width cells whatever the input's size; they are all that the
    driver holds and broadcasts.

    Vectors that are null or hold null or non-finite components are left out.
    Repeated rows are vectors of their own; of equal ids the vector that is
    less in order comes first, null ids come after all others; with fewer
    vectors than ``entries`` codebooks are shorter.  Empty vectors count as
    parts of width 0 (distance 0).  Vectors of several lengths, of a length
    that ``parts`` doesn't divide, or of components whose squared distances
    leave 64 bits are refused with ``ValueError``.  An empty table gives an
    empty result and empty codebooks.  Other columns aren't read.
    """
    spark = vectors.sparkSession
    number = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    names = ["_id", *[f"_k{i}" for i in range(len(keep))]]
    held = [vectors[f"`{c}`"].alias(n) for c, n in zip([id_col, *keep], names, strict=True)]
    rows = vectors.where(F.col(vector_col).isNotNull() & F.forall(number, finite)).select(*held, F.transform(number, lambda x: F.floor(x * scale)).alias("v"))
    state = settle(rows.select(*names, "v", F.lit(None).cast("array<int>").alias("codes")), "vectors")
    size = F.size("v")
    shape = state.agg(F.min(size), F.max(size), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if shape[0] is None:
        shape = (0, 0, 0.0)
    if shape[0] != shape[1] or shape[0] % parts:
        raise ValueError(f"vectors have {shape[0]} to {shape[1]} components; all need one number that {parts} divides")
    width = shape[0] // parts
    widest = width * (2 * int(shape[2] or 0)) ** 2
    if widest >= 1 << 63:
        raise ValueError("components are too large: squared distances leave 64 bits")
    exact_floats = widest < 1 << 53

    first = state.orderBy(F.col("_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    sums = np.zeros((parts, len(first), width + 1), np.int64)

    def parts_of(batch) -> np.ndarray:
        flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat.reshape(batch.num_rows, parts, width)

    def codes_of(batch):
        codes = batch.column(batch.schema.get_field_index("codes"))
        return None if codes.null_count else codes.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts)

    def as_lists(now: np.ndarray):
        import pyarrow as pa

        return pa.ListArray.from_arrays(pa.array(np.arange(len(now) + 1, dtype=np.int32) * parts), pa.array(now.ravel().astype(np.int32)))

    def one_round(batches, books):
        import pyarrow as pa

        changes, schema = Changes(books), None
        for batch in batches:
            x, before = parts_of(batch), codes_of(batch)
            now = assigned(x, books, exact_floats)
            changes.add(x, before, now)
            none = pa.nulls(batch.num_rows, pa.int64())
            columns = [*batch.columns[: len(names) + 1], as_lists(now), none, none]
            out = pa.record_batch(columns, names=[*names, "v", "codes", "cell", "change"])
            schema = out.schema
            yield out
        at, change = changes.left()
        if len(at):
            own = [pa.nulls(len(at), f.type) for f in list(schema)[: len(names) + 2]]
            yield pa.record_batch([*own, pa.array(at), pa.array(change)], names=schema.names)

    def last_round(batches, books):
        import pyarrow as pa

        for batch in batches:
            x = parts_of(batch)
            now = assigned(x, books, exact_floats)
            gap = x - books[np.arange(parts)[None, :], now]
            yield pa.record_batch([*batch.columns[: len(names) + 1], as_lists(now), pa.array((gap * gap).sum(axis=(1, 2)))], names=[*names, "v", "codes", "error"])

    kinds = ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in names)
    for _ in range(rounds if len(first) else 0):
        sent = spark.sparkContext.broadcast(books)
        done = settle(state.mapInArrow(lambda batches, sent=sent: one_round(batches, sent.value), f"{kinds}, {_STATE}"), "assigned")
        changed = done.where("cell is not null").groupBy("cell").agg(F.sum("change").alias("change")).collect()  # of the codebooks' cells
        discard(state)
        state = done.where("cell is null").select(*names, "v", "codes")
        state.settled_at = done.settled_at
        flat = sums.reshape(-1)
        for cell, change in changed:
            flat[cell] += change
        n = sums[:, :, -1:]
        books = np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books)
        sent.unpersist()
    sent = spark.sparkContext.broadcast(books)
    out = state.mapInArrow(lambda batches: last_round(batches, sent.value), f"{kinds}, v array<bigint>, codes array<int>, error bigint") if len(first) else state.withColumn("error", F.lit(0).cast("bigint"))
    return out.select(*[F.col(n).alias(c) for c, n in zip([id_col, *keep], names, strict=True)], "v", "codes", "error"), books


def codebooks_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components as decimal integers, joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_text(codes: Column) -> Column:
    """Codes as two hex digits each, in part order."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0")), "")


def with_group_error(rows: DataFrame, group: str, name: str = "label_error", max_broadcast_groups: int = 100_000) -> DataFrame:
    """``rows`` with the sum of ``error`` over equal ``group`` values (nulls are one); partial sums in tasks, so a hot group is no burden.

    The sums are broadcast when their count is within the bound, else joined by shuffle.
    """
    sums = settle(rows.groupBy(F.col(group).alias("_g")).agg(F.sum("error").alias(name)), "group-errors")
    return rows.join(fit_for_broadcast(sums, max_broadcast_groups), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
