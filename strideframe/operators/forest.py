"""Forests of binned trees over any number of windows.

Values are cut into at most 256 bins a feature.  A node of more than ``WHOLE``
windows is split by counts of its bins, which all tasks count over their own
windows; a smaller one is grown to pure leaves by one task.  The driver sees
one row a large node, a class and a feature; neither windows nor trees pass
through it, and no task holds more than a node's windows.  Everything that
decides is a whole number, so that a forest doesn't depend on the layout.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.errors import SplitError
from strideframe.session import stored

BINS = 256
WHOLE = 1 << 17  # windows of a node that one task grows
CHUNK = 1 << 18  # windows to judge that one task holds
PART = 1 << 14  # windows of a partition
EXACT = 1 << 14  # windows up to which every value may end a bin; beyond it, values that agree in 11 binary places share one
FEW = 64  # windows of which a tree may draw none
MOST_TASKS = 1024
SHARE = 1 << 32
GROWN, OPEN, LEAF = -1, -2, -3
DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def drawn(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each window: Poisson numbers of mean 1, by the window's hash."""
    z = hashes.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.searchsorted(DRAWS, (z >> np.uint64(11)).astype(float) / (1 << 53), side="right")


def order_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def choose_cuts(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Up to ``BINS`` - 1 cuts between cells in rising order, at equal shares of their counts; ``x <= cut`` lies below."""
    at = np.arange(len(n) - 1)
    if len(at) >= BINS:
        before = np.cumsum(n)
        at = np.unique(np.searchsorted(before, before[-1] * np.arange(1, BINS) / BINS))
        at = at[at < len(n) - 1]
    a, b = high[at], low[at + 1]
    with np.errstate(invalid="ignore"):
        middle = a / 2 + b / 2
        return np.where((a <= middle) & (middle < b), middle, a)


def left_over(low: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows times impurity that both sides of cuts keep; classes along the last axis."""
    high = total - low
    n, m = low.sum(axis=-1), high.sum(axis=-1)
    return n - (low * low).sum(axis=-1) / np.maximum(n, 1) + m - (high * high).sum(axis=-1) / np.maximum(m, 1)


@dataclass
class Subtree:
    """Nodes by levels; an inner node's right child follows its left one. A leaf has feature -1 and its class as ``value``, or -1 - its row of ``mixed`` shares."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    mixed: np.ndarray

    def leaves(self, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        while len(rows := np.flatnonzero(self.feature[at] >= 0)):
            node = at[rows]
            at[rows] = self.left[node] + (b[rows, self.feature[node]] > self.cut[node])
        return at

    def votes(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, class, share) with shares as whole numbers, ``SHARE`` together."""
        value = self.value[self.leaves(b)]
        clear, other = np.flatnonzero(value >= 0), np.flatnonzero(value < 0)
        shares = np.rint(self.mixed[-1 - value[other]] * SHARE).astype(np.int64)
        i, k = np.nonzero(shares)
        return np.concatenate([clear, other[i]]), np.concatenate([value[clear], k]), np.concatenate([np.full(len(clear), SHARE), shares[i, k]])


def leaf(counts: np.ndarray) -> Subtree:
    counts = np.asarray(counts, float)
    return Subtree(np.array([-1]), np.array([0]), np.array([-1]), np.array([-1]), (counts / counts.sum())[None])


def grow_binned(b: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tried: int, g: np.random.Generator) -> Subtree:
    """All nodes of a level at once. At each ``tried`` features are drawn (more only while none of them can split); the one that leaves least impurity splits, the first drawn of equals, at its lowest best cut."""
    levels, mixed, n_mixed, base = [], [np.zeros((0, classes))], 0, 0
    rows, node, k = np.arange(len(b)), np.zeros(len(b), np.int64), 1
    while k:
        counts = np.bincount(node * classes + y[rows], weights=w[rows], minlength=k * classes).reshape(k, classes)
        open_ = (counts > 0).sum(axis=1) > 1
        kept = open_[node]
        rows, node = rows[kept], node[kept]
        feature, cut, best = np.full(k, -1), np.zeros(k, np.int64), np.full(k, np.inf)
        place = np.cumsum(open_) - 1
        turns = g.random((int(open_.sum()), b.shape[1])).argsort(axis=1)
        for turn in range(b.shape[1]):
            asked = open_ if turn < tried else open_ & (feature < 0)
            if not asked.any():
                break
            own = np.flatnonzero(asked[node])
            keys = node[own] * BINS + b[rows[own], turns[place[node[own]], turn]]
            order = np.argsort(keys, kind="stable")
            keys, of, labels, weights = keys[order], node[own][order], y[rows[own]][order], w[rows[own]][order]
            ends = np.flatnonzero((keys[1:] != keys[:-1]) & (of[1:] == of[:-1]))
            if not len(ends):
                continue
            at = of[ends]
            start = np.searchsorted(of, at)  # of the node
            n, m, inside, outside = (np.zeros(len(ends)) for _ in range(4))
            for c in range(classes):
                sums = np.concatenate([[0], np.cumsum(weights * (labels == c))])
                low = sums[ends + 1] - sums[start]
                high = counts[at, c] - low
                n, m, inside, outside = n + low, m + high, inside + low * low, outside + high * high
            left = n - inside / n + m - outside / m
            firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            least = np.minimum.reduceat(left, firsts)
            hit = np.flatnonzero(left == np.repeat(least, np.diff(np.append(firsts, len(at)))))
            nodes, first = np.unique(at[hit], return_index=True)
            better = least < best[nodes] - 1e-12
            nodes, first, least = nodes[better], hit[first[better]], least[better]
            best[nodes], cut[nodes] = least, keys[ends[first]] % BINS
            feature[nodes] = turns[place[nodes], turn]
        split = feature >= 0
        value = counts.argmax(axis=1)
        blunt = np.flatnonzero(open_ & ~split)
        value[blunt] = -1 - n_mixed - np.arange(len(blunt))
        mixed.append(counts[blunt] / counts[blunt].sum(axis=1, keepdims=True))
        n_mixed += len(blunt)
        rank = np.cumsum(split) - 1
        levels.append((feature, cut, np.where(split, base + k + 2 * rank, -1), value))
        kept = split[node]
        rows, node = rows[kept], node[kept]
        node = 2 * rank[node] + (b[rows, feature[node]] > cut[node])
        base, k = base + k, 2 * int(split.sum())
    f, c, left, value = (np.concatenate(x) for x in zip(*levels, strict=True))
    return Subtree(f.astype(np.int32), c.astype(np.uint8), left.astype(np.int32), value.astype(np.int32), np.concatenate(mixed))


@dataclass
class Top:
    """The large nodes of one tree: an inner one has a feature, the others say who goes on (``GROWN``, ``OPEN``) or end (``LEAF``)."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)

    def add(self, state: int) -> int:
        for column, value in ((self.feature, state), (self.cut, 0), (self.left, -1)):
            column.append(value)
        return len(self.feature) - 1

    def places(self, b: np.ndarray) -> np.ndarray:
        if len(self.feature) == 1:
            return np.zeros(len(b), np.int64)
        return Subtree(np.array(self.feature), np.array(self.cut), np.array(self.left), np.zeros(0), np.zeros(0)).leaves(b)


def _numbers(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False) if hasattr(column, "combine_chunks") else column.to_numpy(zero_copy_only=False)


def _matrix(column, width: int) -> np.ndarray:
    """Windows of doubles, one a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _bins(column, width: int) -> np.ndarray:
    """Windows of bins, one a row."""
    found = [np.zeros((0, width), np.uint8)]
    for part in getattr(column, "chunks", [column]):
        if len(part):
            ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            found.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width))
    return np.concatenate(found)


def _binary(b: np.ndarray):
    import pyarrow as pa

    b = np.ascontiguousarray(b)
    return pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((np.arange(len(b) + 1) * b.shape[1]).astype(np.int32)), pa.py_buffer(b)])


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def _cuts(rows: DataFrame, width: int, n: int) -> list[np.ndarray]:
    """The cuts of each feature; cells of values are counted where they lie, so that no sample is taken."""
    shift = 0 if n <= EXACT else 41

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), width)
            for f in range(width):
                v = np.sort(x[:, f])
                cells = order_bits(v) >> shift
                at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                ends = np.append(at[1:], len(v))
                yield pa.record_batch([pa.array(np.full(len(at), f, np.int32)), pa.array(cells[at]), pa.array(ends - at), pa.array(v[at]), pa.array(v[ends - 1])], names=["f", "cell", "n", "low", "high"])

    def chosen(key, own):
        import pyarrow as pa

        order = np.argsort(_numbers(own.column("cell")))
        cuts = choose_cuts(*(_numbers(own.column(c))[order] for c in ("n", "low", "high")))
        return pa.table({"f": pa.array([key[0].as_py()], pa.int32()), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    cells = rows.select("x").mapInArrow(counted, "f int, cell long, n long, low double, high double")
    cells = cells.groupBy("f", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = cells.groupBy("f").applyInArrow(chosen, "f int, cuts array<double>").collect()  # one row a feature
    return [np.array(r["cuts"]) for r in sorted(found, key=lambda r: r["f"])]


def _binned(df: DataFrame, columns: list[str], cuts: list[np.ndarray], n: int, by: str, name: str) -> DataFrame:
    """(columns, b): windows as bins, stored in partitions of about ``PART`` windows."""
    kinds = dict(df.dtypes)

    def binned(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(len(columns)), len(cuts))
            b = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.record_batch([*batch.columns[: len(columns)], _binary(b)], names=[*columns, "b"])

    out = df.select(*columns, "x").mapInArrow(binned, ", ".join([*[f"{c} {kinds[c]}" for c in columns], "b binary"]))
    return stored(out.repartition(-(-n // PART) or 1, by), name)


def _split_large(binned: DataFrame, tops: list[Top], leaves: dict, classes: int, width: int, tried: int, seed: int, whole: int) -> None:
    """Nodes of more than ``whole`` windows, level by level: every partition counts the bins of the open ones, a task a node judges the sums."""
    attempts = {(t, p): 0 for t, top in enumerate(tops) for p, state in enumerate(top.feature) if state == OPEN}

    def features(tree: int, place: int, attempt: int) -> np.ndarray:
        return np.random.default_rng([seed, tree, place]).permutation(width)[attempt * tried : (attempt + 1) * tried]

    while attempts:
        asked: dict[int, list] = {}
        for (t, p), attempt in attempts.items():
            asked.setdefault(t, []).append((p, attempt))

        def counted(batches):
            import pyarrow as pa

            parts = [(_numbers(batch.column(0)), _numbers(batch.column(1)), _bins(batch.column(2), width)) for batch in batches if batch.num_rows]
            if not parts:
                return
            h, y, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            for t, nodes in asked.items():
                w = drawn(h, seed, t)
                at = np.where(w > 0, tops[t].places(b), -1)
                for p, attempt in nodes:
                    own = np.flatnonzero(at == p)
                    if not len(own):
                        continue
                    cells = []
                    for f in features(t, p, attempt).tolist():
                        key = b[own, f].astype(np.int64) * (classes + 1)
                        cells.append(np.bincount(key + y[own], weights=w[own], minlength=BINS * (classes + 1)) + np.bincount(key + classes, minlength=BINS * (classes + 1)))
                    yield pa.record_batch([pa.array([t], pa.int32()), pa.array([p], pa.int32()), pa.array([np.concatenate(cells).astype(np.int32).tobytes()], pa.binary())], names=["tree", "place", "cells"])

        def judged(key, own):
            import pyarrow as pa

            t, p = key[0].as_py(), key[1].as_py()
            total = sum(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in own.column("cells")).reshape(-1, BINS, classes + 1)
            best, feature, cut, low = np.inf, -1, 0, np.zeros(classes + 1, np.int64)
            for f, cells in zip(features(t, p, attempts[t, p]).tolist(), total, strict=True):
                sums = np.cumsum(cells, axis=0)
                left = np.where((sums[:, -1] > 0) & (sums[:, -1] < sums[-1, -1]) & (cells[:, -1] > 0), left_over(sums[:, :-1].astype(float), sums[-1, :-1].astype(float)), np.inf)
                if left.min() < best - 1e-12:
                    cut = int(left.argmin())
                    best, feature, low = left[cut], f, sums[cut]
            counts = np.stack([low, total[0].sum(axis=0) - low]).astype(np.int64)
            return pa.table({"tree": pa.array([t], pa.int32()), "place": pa.array([p], pa.int32()), "feature": pa.array([feature], pa.int32()), "cut": pa.array([cut], pa.int32()), "low": pa.array([counts[0].tolist()]), "high": pa.array([counts[1].tolist()])})

        sums = binned.mapInArrow(counted, "tree int, place int, cells binary").repartition(min(len(attempts), MOST_TASKS), "tree", "place")
        splits = sums.groupBy("tree", "place").applyInArrow(judged, "tree int, place int, feature int, cut int, low array<long>, high array<long>").collect()  # one row a large node
        attempts = {key: attempt + 1 for key, attempt in attempts.items()}
        for r in sorted(splits, key=lambda r: (r["tree"], r["place"])):
            t, p = r["tree"], r["place"]
            top, sides = tops[t], (np.array(r["low"]), np.array(r["high"]))
            if r["feature"] < 0:
                if attempts[t, p] * tried < width:
                    continue
                top.feature[p], leaves[t, p] = LEAF, leaf(sides[1][:-1])
            else:
                top.feature[p], top.cut[p], top.left[p] = r["feature"], r["cut"], len(top.feature)
                for counts in sides:
                    pure = (counts[:-1] > 0).sum() == 1
                    child = top.add(LEAF if pure else GROWN if counts[-1] <= whole else OPEN)
                    if pure:
                        leaves[t, child] = leaf(counts[:-1])
                    elif top.feature[child] == OPEN:
                        attempts[t, child] = 0
            del attempts[t, p]


def predict_forest(train: DataFrame, test: DataFrame, label: str, flat: str, *, key: str, trees: int = 100, seed: int = 42, whole: int = WHOLE) -> DataFrame:
    """``test`` with ``pred``: a forest over flat windows, roots of the features a split, trees as deep as it takes.

    A tree draws each window a Poisson number of times, by a hash of ``key``,
    label and values.  Training windows, then those to judge, are shuffled to
    the nodes of at most ``whole`` windows.  Labels are whole numbers from 0;
    null windows or labels, windows of several lengths and an empty table are
    refused.
    """
    spark = train.sparkSession
    rows = train.select(F.xxhash64(key, label, flat).alias("h"), F.col(label).cast("int").alias("y"), F.col(flat).cast("array<double>").alias("x"))
    bad = lambda df: F.count_if(F.col("x").isNull() | F.exists("x", lambda v: v.isNull())).alias("bad")
    lengths = (F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"))
    sizes = rows.groupBy("y").agg(F.count("*").alias("n"), bad(rows), *lengths).collect()  # one row a class
    width = {s for r in sizes for s in (r["least"], r["most"])}
    if not sizes or len(width) != 1 or not all(s and s > 0 for s in width) or any(r["bad"] or r["y"] is None or r["y"] < 0 for r in sizes):
        raise SplitError(f"a forest needs windows of one length with labels from 0: {[r.asDict() for r in sizes[:5]]}")
    (width,), sizes = width, sorted(sizes, key=lambda r: r["y"])
    names, n = [r["y"] for r in sizes], sum(r["n"] for r in sizes)
    classes, tried = len(names), max(1, int(width**0.5))
    asked = stored(test.withColumn("_id", F.monotonically_increasing_id()), "asked")
    to_judge = asked.select("_id", F.col(flat).cast("array<double>").alias("x"))
    other = to_judge.agg(F.count("*").alias("n"), bad(to_judge), *lengths).first()
    if other["n"] and (other["bad"] or {other["least"], other["most"]} != {width}):
        raise SplitError(f"windows to judge don't have {width} values each")

    cuts = _cuts(rows, width, n)
    place = F.array_position(F.array(*[F.lit(k) for k in names]), F.col("y")) - 1
    binned = _binned(rows.withColumn("y", place.cast("int")), ["h", "y"], cuts, n, "h", "binned")
    judge = _binned(to_judge, ["_id"], cuts, other["n"], "_id", "binned-asked")
    tops, leaves = [Top() for _ in range(trees)], {}
    hashes = np.array([r["h"] for r in binned.select("h").collect()], np.int64) if n <= FEW else None
    for t, top in enumerate(tops):
        if hashes is not None and not drawn(hashes, seed, t).any():
            leaves[t, top.add(LEAF)] = leaf([r["n"] for r in sizes])
        else:
            top.add(GROWN if n <= whole else OPEN)
    _split_large(binned, tops, leaves, classes, width, tried, seed, whole)

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            h, y, b = _numbers(batch.column(0)), _numbers(batch.column(1)), _bins(batch.column(2), width)
            for t, top in enumerate(tops):
                w = drawn(h, seed, t)
                at, goes = top.places(b), np.array(top.feature) == GROWN
                own = np.flatnonzero((w > 0) & goes[at])
                yield pa.record_batch([pa.array(np.full(len(own), t, np.int32)), pa.array(at[own].astype(np.int32)), pa.array(y[own]), pa.array(w[own].astype(np.int32)), _binary(b[own])], names=["tree", "place", "y", "w", "b"])

    def grown(key, own):
        import pyarrow as pa

        t, p = key[0].as_py(), key[1].as_py()
        tree = grow_binned(_bins(own.column("b"), width), _numbers(own.column("y")), _numbers(own.column("w")), classes, tried, np.random.default_rng([seed, t, p, 1]))
        return pa.table({"tree": pa.array([t], pa.int32()), "place": pa.array([p], pa.int32()), "grown": pa.array([pickle.dumps(tree)], pa.binary())})

    nodes = sum(state == GROWN for top in tops for state in top.feature)
    tasks = min(nodes, MOST_TASKS, max(16, n * trees // (2 * PART))) or 1
    learned = binned.mapInArrow(dealt, "tree int, place int, y int, w int, b binary").repartition(tasks, "tree", "place")
    subtrees = learned.groupBy("tree", "place").applyInArrow(grown, "tree int, place int, grown binary")
    if leaves:
        subtrees = subtrees.union(spark.createDataFrame([(t, p, bytearray(pickle.dumps(x))) for (t, p), x in leaves.items()], subtrees.schema))
    subtrees = stored(subtrees, "subtrees")
    chunks = -(-other["n"] // CHUNK) or 1

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            ids, b = _numbers(batch.column(0)), _bins(batch.column(1), width)
            part = pa.array(_part(ids, chunks).astype(np.int32))
            for t, top in enumerate(tops):
                yield pa.record_batch([pa.array(np.full(len(ids), t, np.int32)), pa.array(top.places(b).astype(np.int32)), part, batch.column(0), batch.column(1)], names=["tree", "place", "part", "_id", "b"])

    def voted(key, own, other):
        import pyarrow as pa

        found = [np.zeros(0, np.int64)] * 3
        if own.num_rows and other.num_rows:
            row, k, share = pickle.loads(own.column("grown")[0].as_py()).votes(_bins(other.column("b"), width))
            found = [_numbers(other.column("_id"))[row], k, share]
        return pa.table({"_id": pa.array(found[0], pa.int64()), "k": pa.array(found[1].astype(np.int32)), "share": pa.array(found[2], pa.int64())})

    by = ["tree", "place", "part"]
    met = subtrees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(tasks, *by).groupBy(*by)
    met = met.cogroup(judge.mapInArrow(spread, "tree int, place int, part int, _id long, b binary").repartition(tasks, *by).groupBy(*by))
    votes = met.applyInArrow(voted, "_id long, k int, share long").groupBy("_id", "k").agg(F.sum("share").alias("share"))
    most = votes.groupBy("_id").agg((-F.max(F.struct("share", (-F.col("k")).alias("k")))["k"]).alias("k"))  # the lower class of equals
    pred = F.element_at(F.array(*[F.lit(k) for k in names]), F.col("k") + 1)
    return asked.join(most.hint("merge"), "_id").select(*[F.col(f"`{c}`") for c in test.columns], pred.alias("pred"))
