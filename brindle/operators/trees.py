"""Gradient-boosted trees over binned features: histograms by Spark, splits by the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stats
from .base import Classifier, Regressor, classes, relation
from .shared import stage


@dataclass
class Tree:
    """Nodes in lists; a row goes left where its feature is at most the threshold, or missing and ``missing_left`` says so."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)

    def __post_init__(self):
        self.missing_left += [False] * (len(self.value) - len(self.missing_left))

    def add(self, value: float) -> int:
        for v, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.missing_left, False)):
            v.append(x)
        return len(self.value) - 1

    def split(self, node: int, feature: int, threshold: float, missing_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.missing_left[node] = feature, threshold, missing_left
        self.left[node], self.right[node] = self.add(values[0]), self.add(values[1])
        return self.left[node], self.right[node]

    def leaves(self, x: np.ndarray, missing: float = np.nan) -> np.ndarray:
        """The leaf of each row. ``missing`` stands for a missing feature, in bin codes a number."""
        feature, threshold, left, right, gone = map(np.array, (self.feature, self.threshold, self.left, self.right, self.missing_left))
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            i = at[inner]
            v = x[inner, feature[i]]
            absent = np.isnan(v) if missing != missing else v == missing
            at[inner] = np.where(np.where(absent, gone[i], v <= threshold[i]), left[i], right[i])

    def predict(self, x: np.ndarray, missing: float = np.nan) -> np.ndarray:
        return np.array(self.value)[self.leaves(x, missing)]

    def expression(self, features: Column, node: int = 0) -> Column:
        """The tree as nested conditions, for trees of moderate size."""
        if self.feature[node] < 0:
            return F.lit(float(self.value[node]))
        v = features[self.feature[node]]
        goes_left = F.coalesce(~F.isnan(v) & (v <= float(self.threshold[node])), F.lit(False))
        if self.missing_left[node]:
            goes_left = v.isNull() | F.isnan(v) | goes_left
        return F.when(goes_left, self.expression(features, self.left[node])).otherwise(self.expression(features, self.right[node]))


def predict_all(features: Column, trees: list[Tree], baseline: float = 0.0) -> Column:
    """The baseline plus the leaves' values of all trees."""
    out = F.lit(float(baseline))
    for t in trees:
        out = out + t.expression(features)
    return out


#: The code of a missing feature, and how many codes there are.
MISSING, CODES = 255, 256
#: Histogram numbers in one pass, and iterations after which the raw scores are written again.
HISTOGRAMS, KEPT = 4_000_000, 8
#: Rows are stored once for each combination of codes where there are this many times more of them than combinations there can be.
REPEATS = 4


def _with_missing(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Features as a matrix; null and NaN elements are NaN. ValueError for null arrays, other lengths and infinities."""
    column = batch.column("features")
    if column.null_count or pc.any(pc.not_equal(pc.list_value_length(column), d)).as_py():
        raise ValueError("features must be arrays of one length")
    x = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(float)
    if np.isinf(x).any():
        raise ValueError("features must be finite or missing")
    return x.reshape(len(column), d)


def _packed(column: pa.Array, kind: str) -> np.ndarray:
    """A matrix from a binary column whose values all have one length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def _pack(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (data.nbytes // max(1, len(x)))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


@dataclass
class _Leaf:
    """A leaf that may be split: its histograms, its best split, and where known those of the two leaves that makes."""

    hist: np.ndarray
    depth: int
    gain: float = -np.inf
    feature: int = -1
    bin: int = -1
    missing_left: bool = False
    small_left: bool = False
    under: tuple[np.ndarray, np.ndarray] | None = None


class _Boosting:
    """Per iteration and output one tree, grown best leaf first.

    Rows are stored once as codes of bins, a byte for each feature, with a code for
    missing values (null or NaN), which go to the side where the gain is larger. Bins
    are approximate quantiles, at most ``max_bins``. A pass sums gradients by leaf,
    feature and bin for the smaller child of a split alone, the other is what is
    left of its parent; it does so for all leaves that are likely to be split next, so
    a tree takes about as many passes as it has levels. Raw scores are those stored
    plus the trees since, and are written again every ``KEPT`` iterations; nothing
    is cached over generations.

    Raw scores follow from the codes, so rows alike in codes and label have the same
    gradients, for a squared loss up to the label, in which it is linear. Where there are
    many times more rows than combinations of codes (and classes), one row stands for
    all that are alike, with their number and mean label.
    """

    def _value(self, hist: np.ndarray) -> float:
        g, h = hist[:2, 0].sum(axis=1)
        return -self.learning_rate * g / (h + self.l2_regularization + 1e-12)

    def _leaf(self, hist: np.ndarray, depth: int, cuts: np.ndarray) -> _Leaf:
        """With the best split, of equals the first feature and bin; ``cuts`` has how many thresholds each feature has."""
        leaf = _Leaf(hist, depth)
        if self.max_depth is not None and depth >= self.max_depth:
            return leaf
        total, r, width_ = hist[:, 0].sum(axis=1), self.l2_regularization + 1e-12, int(cuts.max()) + 1
        absent = hist[:, :, MISSING]
        upto = np.cumsum(hist[:, :, :width_], axis=2)
        gains = []
        for to_left in (False, True):
            gl, hl, cl = upto + absent[:, :, None] * to_left
            gr, hr, cr = (t - x for t, x in zip(total, (gl, hl, cl), strict=True))
            gain = gl**2 / (hl + r) + gr**2 / (hr + r) - total[0] ** 2 / (total[1] + r)
            least = max(1, self.min_samples_leaf)
            gain[(cl < least) | (cr < least) | (np.arange(width_) > cuts[:, None])] = -np.inf
            if to_left:
                gain[absent[2] == 0] = -np.inf
            gains.append(gain)
        side, j, b = np.unravel_index(int(np.argmax(gains)), (2, *gains[0].shape))
        if gains[side][j, b] > 1e-12:
            below = upto[2, j, b] + absent[2, j] * side
            # Where no value was missing, one that is goes with the most rows.
            leaf.gain, leaf.feature, leaf.bin, leaf.small_left = float(gains[side][j, b]), int(j), int(b), bool(2 * below <= total[2])
            leaf.missing_left = bool(side) if absent[2, j] else not leaf.small_left
        return leaf

    def _grow(self, sums, bins: list[np.ndarray]) -> tuple[Tree, Tree]:
        """A tree by thresholds and the same by codes. ``sums(tree, splits)`` gives the histograms of rows, by slot of the leaf and side they fall to."""
        d, cuts = len(bins), np.array([len(b) for b in bins])
        tree, coded = Tree(), Tree()
        root = sums(coded, None)[0]
        for t in (tree, coded):
            t.add(self._value(root))
        open_, leaves = {0: self._leaf(root, 0, cuts)}, 1
        most = max(1, HISTOGRAMS // (3 * d * CODES))
        while leaves < self.max_leaf_nodes:
            order = sorted((n for n in open_ if open_[n].gain > 0), key=lambda n: (-open_[n].gain, n))
            if not order:
                break
            node = order[0]
            if open_[node].under is None:
                wanted = [n for n in order if open_[n].under is None][: min(most, self.max_leaf_nodes - leaves)]
                small = sums(coded, {n: (i, open_[n].feature, open_[n].bin, open_[n].missing_left, open_[n].small_left) for i, n in enumerate(wanted)})
                for i, n in enumerate(wanted):
                    rest = open_[n].hist - small[i]
                    open_[n].under = (small[i], rest) if open_[n].small_left else (rest, small[i])
            leaf = open_.pop(node)
            values = tuple(map(self._value, leaf.under))
            edges = bins[leaf.feature]
            threshold = float(edges[leaf.bin]) if leaf.bin < len(edges) else np.inf
            tree.split(node, leaf.feature, threshold, leaf.missing_left, values)
            for child, hist in zip(coded.split(node, leaf.feature, leaf.bin, leaf.missing_left, values), leaf.under, strict=True):
                open_[child] = self._leaf(hist, leaf.depth + 1, cuts)
            leaves += 1
        return tree, coded

    def _boost(self, df: DataFrame, y: Column, baseline: np.ndarray, gradients, labels: int = 0) -> None:
        """``labels`` tells how many labels there are, which are kept apart where rows are put together; with 0 the gradients are linear in them."""
        first = df.select("features").first()
        if first is None or first[0] is None:
            raise ValueError("no rows to fit" if first is None else "features must be arrays of one length")
        if not 2 <= self.max_bins <= MISSING:
            raise ValueError(f"max_bins must be 2 to {MISSING}")
        d, k = len(first[0]), len(baseline)
        self.n_features_in_ = d
        at = lambda j: F.get("features", F.lit(j))
        cuts = df.agg(*[F.percentile_approx(F.when(~F.isnan(at(j)), at(j)), [i / self.max_bins for i in range(1, self.max_bins)], 10_000).alias(f"q{j}") for j in range(d)], F.count("*").alias("rows")).first()
        bins = [np.unique(np.array(c or [], float)) for c in cuts[:d]]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _with_missing(batch, d)
                codes = np.stack([np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(bins[j], x[:, j])) for j in range(d)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([_pack(codes), batch.column("y")], ["codes", "y"])

        coded = df.select("features", y.cast("double").alias("y")).mapInArrow(encode, "codes binary, y double")
        if REPEATS * math.prod(len(b) + 2 for b in bins) * max(1, labels) <= cuts["rows"]:
            coded = coded.groupBy("codes", *["y"] * bool(labels)).agg(*([] if labels else [F.avg("y").alias("y")]), F.count("*").cast("double").alias("n"))
        else:
            coded = coded.withColumn("n", F.lit(1.0))
        data = stage(coded.select("codes", "y", "n", F.lit(baseline.astype("<f8").tobytes()).alias("raw")), "bin-codes")
        self.baseline_, self.trees_ = baseline, []
        since: list[list[Tree]] = []

        def scores(batch: pa.RecordBatch, codes: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
            raw = _packed(batch.column("raw"), "<f8").copy()
            for row in trees:
                raw += np.stack([t.predict(codes, MISSING) for t in row], axis=1)
            return raw

        def summing(output: int, trees: list[list[Tree]]):
            def sums(tree: Tree, splits: dict[int, tuple] | None) -> np.ndarray:
                slots = 1 if splits is None else len(splits)
                number = {} if splits is None else splits

                def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
                    codes = _packed(batch.column("codes"), "u1")
                    n = batch.column("n").to_numpy()
                    g, h = (x * n[:, None] for x in gradients(scores(batch, codes, trees), batch.column("y").to_numpy()))
                    slot = np.zeros(len(codes), np.int64)
                    if splits is not None:
                        slot[:] = -1
                        leaf = tree.leaves(codes, MISSING)
                        for node, (i, j, b, missing_left, small_left) in number.items():
                            own = np.flatnonzero(leaf == node)
                            v = codes[own, j]
                            goes_left = np.where(v == MISSING, missing_left, v <= b)
                            slot[own[goes_left == small_left]] = i
                    keep = np.flatnonzero(slot >= 0)
                    out = np.zeros((slots, 3, d, CODES))
                    base = slot[keep] * CODES
                    for j in range(d):
                        key = base + codes[keep, j]
                        for c, w in enumerate((g[keep, output], h[keep, output], n[keep])):
                            out[:, c, j] = np.bincount(key, w, slots * CODES).reshape(slots, CODES)
                    return {"hist": out}

                return stats.sums(data, part, ["hist"])["hist"].reshape(slots, 3, d, CODES)

            return sums

        for i in range(self.max_iter):
            pairs = [self._grow(summing(o, list(since)), bins) for o in range(k)]
            self.trees_.append([t for t, _ in pairs])
            since.append([c for _, c in pairs])
            if len(since) == KEPT and i + 1 < self.max_iter:

                def update(batches: Iterator[pa.RecordBatch], trees: list[list[Tree]] = list(since)) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        codes = _packed(batch.column("codes"), "u1")
                        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("codes", "y", "n")), _pack(scores(batch, codes, trees))], ["codes", "y", "n", "raw"])

                data, since = stage(data.mapInArrow(update, data.schema), "boosted"), []

    def _raw(self, df: DataFrame) -> DataFrame:
        """``df`` with __raw array<double>."""
        shared, d = df.sparkSession.sparkContext.broadcast((self.baseline_, self.trees_)), self.n_features_in_
        schema = T.StructType([*df.schema.fields, T.StructField("__raw", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            baseline, trees = shared.value
            for batch in batches:
                x = _with_missing(batch, d)
                raw = np.tile(baseline, (len(x), 1))
                for row in trees:
                    raw += np.stack([t.predict(x) for t in row], axis=1)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(baseline))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(raw.ravel()))], [*batch.schema.names, "__raw"])

        return df.mapInArrow(run, schema)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, o, n, t.feature[n], float(t.threshold[n]), t.left[n], t.right[n], t.feature[n] < 0, float(t.value[n]), t.missing_left[n]) for i, row in enumerate(self.trees_) for o, t in enumerate(row) for n in range(len(t.value))]
        return relation(spark, rows, "tree int, output int, node int, feature int, threshold double, left int, right int, is_leaf boolean, value double, missing_left boolean")


class HistGradientBoostingRegressor(_Boosting, Regressor):
    def __init__(self, learning_rate: float = 0.1, max_iter: int = 100, max_leaf_nodes: int = 31, max_depth: int | None = None, min_samples_leaf: int = 20, l2_regularization: float = 0.0, max_bins: int = 255):
        self.learning_rate, self.max_iter, self.max_leaf_nodes, self.max_depth = learning_rate, max_iter, max_leaf_nodes, max_depth
        self.min_samples_leaf, self.l2_regularization, self.max_bins = min_samples_leaf, l2_regularization, max_bins

    def fit(self, df: DataFrame) -> HistGradientBoostingRegressor:
        mean = float(df.agg(F.avg("label")).first()[0])
        self._boost(df, F.col("label"), np.array([mean]), lambda raw, y: (raw - y[:, None], np.ones_like(raw)))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self._raw(df).withColumn("prediction", F.col("__raw")[0]).drop("__raw")


class HistGradientBoostingClassifier(_Boosting, Classifier):
    """Logistic loss for two classes, softmax with one tree for each class and iteration for more."""

    __init__ = HistGradientBoostingRegressor.__init__

    def fit(self, df: DataFrame) -> HistGradientBoostingClassifier:
        self.classes_ = classes(df)
        counts = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
        share = np.array([counts[c] for c in self.classes_], float) / sum(counts.values())
        at = F.array_position(F.array(*[F.lit(c) for c in self.classes_]), F.col("label")) - 1
        if len(self.classes_) < 2:
            raise ValueError("two classes at least are needed")
        if len(self.classes_) == 2:

            def two(raw, y):
                p = 1 / (1 + np.exp(-raw))
                return p - y[:, None], p * (1 - p)

            self._boost(df, at, np.array([np.log(share[1] / share[0])]), two, 2)
        else:

            def many(raw, y):
                p = np.exp(raw - raw.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                return p - (y[:, None] == np.arange(raw.shape[1])), p * (1 - p)

            self._boost(df, at, np.log(share), many, len(self.classes_))
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        from ..functions import vectors as V

        raw = self._raw(df)
        if len(self.classes_) == 2:
            p = V.sigmoid(F.col("__raw")[0])
            return raw.withColumn("probability", F.array(1.0 - p, p)).drop("__raw")
        return raw.withColumn("probability", V.softmax(F.col("__raw"))).drop("__raw")

    def predict(self, df: DataFrame) -> DataFrame:
        """The second of two classes at odds of one half or more, else the likeliest."""
        names, raw = F.array(*[F.lit(c) for c in self.classes_]), self._raw(df)
        if len(self.classes_) == 2:
            return raw.withColumn("prediction", F.when(F.col("__raw")[0] >= 0, names[1]).otherwise(names[0])).drop("__raw")
        best = (F.array_position("__raw", F.array_max("__raw")) - 1).cast("int")
        return raw.withColumn("prediction", F.get(names, best)).drop("__raw")
