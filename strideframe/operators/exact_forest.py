"""Forests of exact trees: every value is a possible split, and trees grow until their leaves are pure.

Each tree is one task: it draws its rows with replacement from the training
windows, whose size is counted and bounded, and grows alone, so a lost executor
costs its trees only.  ``predict_exact_forest`` shuffles the windows to the
trees and judges them where they grow, so that neither windows nor trees pass
through the driver; ``fit_exact_forest`` hands the forest to the driver.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.errors import SplitError
from strideframe.session import stored

MOST_VALUES = 1 << 26  # of the training windows, broadcast as doubles (512 MB)


@dataclass
class Tree:
    """Node 0 is the root; a leaf has feature -1; ``shares`` are the class shares of a node's rows; ``gain`` is the impurity that each feature took away."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray
    gain: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class shares of the leaves that the rows come to."""
        at = np.zeros(len(x), np.int64)
        while len(rows := np.flatnonzero(self.feature[at] >= 0)):
            node = at[rows]
            low = x[rows, self.feature[node]] <= self.threshold[node]
            at[rows] = np.where(low, self.left[node], self.right[node])
        return self.shares[at]


def gini(counts: np.ndarray) -> np.ndarray:
    """Rows times impurity, of class counts along the last axis."""
    n = counts.sum(axis=-1)
    return n - (counts * counts).sum(axis=-1) / np.maximum(n, 1)


def best_split(values: np.ndarray, y: np.ndarray, classes: int) -> tuple[float, float] | None:
    """(impurity left in both sides, threshold) of the best cut between two different values, the lowest of equals; None without one."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    cuts = np.flatnonzero(v[1:] > v[:-1])
    if not len(cuts):
        return None
    low = np.cumsum(np.eye(classes)[y[order]], axis=0)
    both = gini(low[cuts]) + gini(low[-1] - low[cuts])
    k = int(np.argmin(both))
    a, b = v[cuts[k]], v[cuts[k] + 1]
    middle = a / 2 + b / 2
    return float(both[k]), float(middle if a <= middle < b else a)


def grow(x: np.ndarray, y: np.ndarray, classes: int, tried: int, g: np.random.Generator) -> Tree:
    """At each node ``tried`` features are drawn (more only while none of them can split); the one that leaves least impurity splits, the first drawn of equals."""
    nodes: list[list] = []  # feature, threshold, left, right, shares
    gain = np.zeros(x.shape[1])

    def node(rows: np.ndarray) -> int:
        counts = np.bincount(y[rows], minlength=classes).astype(float)
        nodes.append([-1, 0.0, -1, -1, counts / counts.sum()])
        return len(nodes) - 1

    everything = np.arange(len(x))
    open_ = [(node(everything), everything)]
    while open_:
        at, rows = open_.pop()
        if nodes[at][4].max() == 1.0:
            continue
        best, seen = None, 0
        for f in g.permutation(x.shape[1]).tolist():
            seen += 1
            if (found := best_split(x[rows, f], y[rows], classes)) and (best is None or found[0] < best[0] - 1e-12):
                best = (*found, f)
            if seen >= tried and best:
                break
        if best is None:
            continue  # equal windows of several classes
        left, threshold, f = best
        gain[f] += float(gini(np.bincount(y[rows], minlength=classes).astype(float))) - left
        low = x[rows, f] <= threshold
        nodes[at][:2] = f, threshold
        for side, part in ((2, rows[low]), (3, rows[~low])):
            nodes[at][side] = node(part)
            open_.append((nodes[at][side], part))
    columns = list(zip(*nodes, strict=True))
    total = gain.sum()
    return Tree(*(np.array(c) for c in columns[:4]), np.array(columns[4]), gain / total if total else gain)


def decide(shares: list[np.ndarray]) -> np.ndarray:
    """The class of the highest mean share of the trees, the lower one of equals."""
    return np.argmax(np.round(sum(shares) / len(shares), 12), axis=1)


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The class of the highest mean share, the lower one of equals."""
        return decide([t.predict(x) for t in self.trees])

    @property
    def importance(self) -> np.ndarray:
        return np.mean([t.gain for t in self.trees], axis=0)


def _training(train: DataFrame, label: str, flat: str, key: str, classes: int):
    """(k, y, x) of the training windows, and their counted size, within the bound."""
    rows = train.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.col(flat).cast("array<double>").alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.count_if(F.col("y").isNull() | F.col("x").isNull() | ~F.col("y").between(0, classes - 1)).alias("bad")).first()
    if not size["n"] or size["bad"] or size["least"] != size["most"]:
        raise SplitError(f"a forest needs windows of one length with labels 0 to {classes - 1}: {size.asDict()}")
    if size["n"] * size["most"] > MOST_VALUES:
        raise SplitError(f"{size['n']} windows of {size['most']} values are more than {MOST_VALUES} values")
    return rows, size


def _grown(x: np.ndarray, y: np.ndarray, classes: int, features: int, seed: int, number: int, bootstrap: bool) -> Tree:
    g = np.random.default_rng([seed, number])
    drawn = g.integers(0, len(x), len(x)) if bootstrap else np.arange(len(x))
    return grow(x[drawn], y[drawn], classes, features, g)


def fit_exact_forest(train: DataFrame, label: str, flat: str, classes: int, *, key: str, trees: int = 100, seed: int = 42, tried: int | None = None, bootstrap: bool = True) -> Forest:
    """A forest over flat windows; ``tried`` features a split (the root of their number by default).

    Windows are taken in order of ``key``, so that draws don't depend on the
    layout of files.  More than ``MOST_VALUES`` values are refused: such a
    table wants ``predict_forest``, whose splits are binned.  Labels are 0 to
    ``classes`` - 1; null windows or labels, other labels, and an empty table
    are refused.
    """
    spark = train.sparkSession
    rows, size = _training(train, label, flat, key, classes)
    table = rows.orderBy("k", "y", "x").toArrow()  # within the bound
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size["n"], size["most"])
    sent = spark.sparkContext.broadcast((x, table.column("y").to_numpy().astype(np.int64)))
    features = tried or max(1, int(size["most"] ** 0.5))

    def grown(batches):
        import pyarrow as pa

        x, y = sent.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([number]), pa.array([pickle.dumps(_grown(x, y, classes, features, seed, number, bootstrap))], pa.binary())], names=["number", "tree"])

    found = spark.range(0, trees, 1, trees).mapInArrow(grown, "number bigint, tree binary").collect()  # at most two nodes a window and tree
    sent.unpersist()
    return Forest([pickle.loads(r["tree"]) for r in sorted(found, key=lambda r: r["number"])])


def _matrix(column) -> np.ndarray:
    x = column.combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def _in_order(table):
    """As Spark orders (k, y, x): nulls first; windows of one key and label by their values."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = pc.sort_indices(table, sort_keys=[("k", "ascending"), ("y", "ascending")], null_placement="at_start").to_numpy()
    table = table.take(pa.array(at))
    pairs = table.select(["k", "y"])
    if pairs.group_by(["k", "y"]).aggregate([]).num_rows < table.num_rows:
        k, y, x = table.column("k").to_pylist(), table.column("y").to_pylist(), _matrix(table.column("x")).tolist()
        table = table.take(pa.array(sorted(range(len(k)), key=lambda i: (k[i] is not None, k[i] if k[i] is not None else 0, y[i], x[i]))))
    return table


def predict_exact_forest(
    train: DataFrame, test: DataFrame, label: str, flat: str, classes: int, *, key: str, trees: int = 100, seed: int = 42, tried: int | None = None, bootstrap: bool = True
) -> DataFrame:
    """``test`` with ``pred``, by the forest that ``fit_exact_forest`` fits to ``train``.

    A tree's task gets the training windows and those to judge by a shuffle,
    and returns the class shares of the latter; they are added up by window.
    """
    rows, size = _training(train, label, flat, key, classes)
    features = tried or max(1, int(size["most"] ** 0.5))
    whole = stored(test.withColumn("_id", F.monotonically_increasing_id()), "judged")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("number")
    dealt = lambda df, *columns: df.select(numbers, *columns).repartitionByRange(trees, "number").groupBy("number")
    learned = dealt(rows.select("k", "y", F.col("x").cast(train.schema[flat].dataType).alias("x")), "k", "y", "x")
    asked = dealt(whole, "_id", F.col(flat).cast("array<double>").alias("x"))

    def judged(key, own, other):
        import pyarrow as pa

        own = _in_order(own)
        shares = np.zeros((0, classes))
        if other.num_rows:
            number = key[0].as_py()
            shares = _grown(_matrix(own.column("x")), own.column("y").to_numpy().astype(np.int64), classes, features, seed, number, bootstrap).predict(_matrix(other.column("x")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1) * classes, pa.int32()), pa.array(shares.ravel()))
        return pa.table({"_id": other.column("_id").combine_chunks(), "number": pa.array([key[0].as_py()] * len(shares), pa.int32()), "shares": lists})

    def decided(batches):
        import pyarrow as pa

        for batch in batches:
            votes = np.array([[v["shares"] for v in row] for row in batch.column(1).to_pylist()]).reshape(batch.num_rows, trees, classes)
            pred = decide([votes[:, t] for t in range(trees)]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.int32())], names=["_id", "pred"])

    shares = learned.cogroup(asked).applyInArrow(judged, "_id bigint, number int, shares array<double>")
    votes = shares.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("number", "shares"))).alias("votes"))
    return whole.join(votes.mapInArrow(decided, "_id bigint, pred int"), "_id").select(*[F.col(f"`{c}`") for c in test.columns], "pred")
