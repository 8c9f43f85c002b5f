"""Shared pieces of the training-data operators.

Word rule: a word is a maximal run of characters outside ``\\x20\\x09-\\x0D``;
lower-casing touches A-Z only.  A null text counts as the empty text.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a purely local session without that setting gets a folder of its own;
    a cluster without it is refused, as executors share no local disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="strideframe-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return "file://" + _local_dirs[app]


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes what was computed."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again: all that came of them is settled itself or was brought to an end.

    The driver also collects its garbage, as Spark deletes only then the shuffle
    files that no plan refers to any more; those of what can still be computed
    again stay.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def fit_for_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of an already settled table when its counted rows are within ``max_rows``;
    beyond that the join is left to shuffle (with adaptive skew handling)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def byte_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift-multiply); different seeds give independent orders."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64), 31)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 18  # bytes hashed together
_powers = mix64(np.arange(1, 257, dtype=np.uint64), 37) | np.uint64(1)


def sequence_hashes(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches ``[first, first + size)`` of ``values`` that follow each other without gaps; none is empty."""
    global _powers
    if not len(first):
        return np.zeros(0, np.uint64)
    if (most := int(sizes.max())) > len(_powers):
        _powers = mix64(np.arange(1, 2 * most + 1, dtype=np.uint64), 37) | np.uint64(1)
    place = np.arange(len(values)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(values * _powers[place], first) + sizes.astype(np.uint64))


class WordHashes:
    """The words of several texts: ``hashes`` of all in order (A-Z lower-cased), ``sizes`` in words by text, ``starts`` and ``stops`` in the bytes of ``joined``."""

    def __init__(self, raws: list[bytes]):
        self.joined = b" ".join(raws).translate(LOWER_BYTES)
        b = np.frombuffer(self.joined, np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)])
        hashes, starts, stops, at = [], [], [], 0
        while at < len(b):
            stop = min(len(b), at + _PIECE)
            while stop < len(b) and not _SPACE[b[stop]]:  # to the end of a word
                ahead = np.flatnonzero(_SPACE[b[stop : stop + 4096]])
                stop += int(ahead[0]) if len(ahead) else min(4096, len(b) - stop)
            part = b[at:stop]
            inside = ~_SPACE[part]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            first, size = edge[::2], edge[1::2] - edge[::2]
            hashes.append(sequence_hashes(_BYTE[part[inside]], np.cumsum(size) - size, size))
            starts.append(first + at)
            stops.append(first + size + at)
            at = stop
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.stops = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        self.sizes = np.diff(np.searchsorted(self.starts, self.text_at))


def text_blocks(column, most_bytes: int = 1 << 20):
    """(first row, UTF-8 bytes of each text) of stretches of an Arrow string column of about ``most_bytes`` each, one text at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield at, [x or b"" for x in column.slice(at, stop - at).to_pylist()]
        at = stop


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words (a mixed polynomial); fewer words give one hash of them all, none gives none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    m, k = max(1, n - k + 1), min(k, n)
    with np.errstate(over="ignore"):
        out = hashes[:m] + np.uint64(k)
        for j in range(1, k):
            out = out * _MIX + hashes[j : j + m]
    return mix64(out)
