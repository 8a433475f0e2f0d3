"""Distances and nearest neighbours, exact.

Neighbours, and pairs within a radius, are searched in a metric partition
(``metric``), which leaves out blocks and rows that can't be near enough. The tasks'
lists of the k best are merged by a window. All distances of two tables are put out
block by block (``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import squared_distance
from ..sources.frames import width
from . import blocks, metric as partition
from .base import Classifier, Estimator, Regressor
from .metric import distances
from .shared import stage

METRICS = ("euclidean", "sqeuclidean", "manhattan", "cosine")
#: Pairs in one numpy step, and rows and columns of a tile that is put out with its like.
PAIRS, TILE = 500_000, 8
#: Points of a cell that one task compares with those around; a cell with more is split.
CELL = 2_000


def pairwise(left: DataFrame, right: DataFrame, metric: str = "euclidean", within: float | None = None) -> DataFrame:
    """left_id, right_id, distance for all pairs, or those at distance ``within`` or less. Both have id and features."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    d = width(left)
    if within is not None:
        if right.isEmpty():
            return left.sparkSession.createDataFrame([], "left_id long, right_id long, distance double")
        return partition.within(left, right, d, within, metric)

    def step(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, turned: bool) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), most := max(1, PAIRS // len(own))):
            dist = distances(x[at : at + most], y, metric)
            for cols in _turned(ids[at : at + most], own, dist) if turned else [(np.repeat(ids[at : at + most], len(own)), np.tile(own, len(dist)), dist)]:
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in cols], ["left_id", "right_id", "distance"])

    return blocks.meet(left, right, d, step, "left_id long, right_id long, distance double")


def _turned(ids: np.ndarray, own: np.ndarray, dist: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """left_id, right_id, distance of all pairs and of the same pairs turned round, by small tiles, so that a file's codec meets a distance twice close by."""
    n, m = (size - size % TILE for size in dist.shape)
    for rows in (slice(0, n), slice(n, None)):
        for cols in (slice(0, m), slice(m, None)):
            d = dist[rows, cols]
            if not d.size:
                continue
            high, wide = min(TILE, d.shape[0]), min(TILE, d.shape[1])
            tiles = d.reshape(d.shape[0] // high, high, d.shape[1] // wide, wide).transpose(0, 2, 1, 3)
            left, right, value = (np.empty((*tiles.shape[:2], 2, high, wide), t) for t in (np.int64, np.int64, float))
            i, j = ids[rows].reshape(-1, 1, high, 1), own[cols].reshape(1, -1, 1, wide)
            left[:, :, 0], left[:, :, 1], right[:, :, 0], right[:, :, 1] = i, j, j, i
            value[:, :, 0] = value[:, :, 1] = tiles
            yield left, right, value


def kneighbors(train: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: the k nearest rows of ``train``, ties to the smaller id.

    A query that is itself in ``train`` is its own neighbour. Fewer than k rows
    give fewer neighbours.
    """
    if metric not in METRICS or k < 1:
        raise ValueError(f"k must be positive, metric one of {METRICS}")

    d = width(train)
    if queries.isEmpty():
        return train.sparkSession.createDataFrame([], "query_id long, rank int, neighbor_id long, distance double")
    found = partition.nearest(train, queries, d, k, metric)
    near = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


class NearestNeighbors(Estimator):
    def __init__(self, n_neighbors: int = 5, metric: str = "euclidean"):
        self.n_neighbors, self.metric = n_neighbors, metric

    def fit(self, df: DataFrame) -> NearestNeighbors:
        """Keeps a reference to ``df`` (id, features and, for the others, label)."""
        self.n_features_in_, self.train_ = width(df), df
        return self

    def kneighbors(self, df: DataFrame | None = None, n_neighbors: int | None = None) -> DataFrame:
        """As ``kneighbors``; without ``df`` the training rows are the queries, themselves included."""
        return kneighbors(self.train_, self.train_ if df is None else df, n_neighbors or self.n_neighbors, self.metric)

    def radius_neighbors(self, radius: float, df: DataFrame | None = None) -> DataFrame:
        return pairwise(self.train_ if df is None else df, self.train_, self.metric, radius)


class _Voting(NearestNeighbors):
    def __init__(self, n_neighbors: int = 5, weights: str = "uniform", metric: str = "euclidean"):
        if weights not in ("uniform", "distance"):
            raise ValueError("weights must be uniform or distance")
        super().__init__(n_neighbors, metric)
        self.weights = weights

    def _labelled(self, df: DataFrame) -> DataFrame:
        near = self.kneighbors(df)
        w = F.lit(1.0) if self.weights == "uniform" else 1.0 / (F.col("distance") + 1e-10)
        labels = self.train_.select(F.col("id").alias("neighbor_id"), "label")
        return near.withColumn("w", w).join(labels, "neighbor_id")


class KNeighborsClassifier(_Voting, Classifier):
    def predict_proba(self, df: DataFrame) -> DataFrame:
        """id, label, share: each query's shares of the weighted vote."""
        votes = self._labelled(df).groupBy(F.col("query_id").alias("id"), "label").agg(F.sum("w").alias("w"))
        return votes.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("id"))).drop("w")

    def predict(self, df: DataFrame) -> DataFrame:
        """The label with the greatest weight; among equals the smallest for uniform weights, the nearest's for others."""
        votes = self._labelled(df).groupBy(F.col("query_id").alias("id"), "label").agg(F.sum("w").alias("w"), F.min("rank").alias("nearest"))
        tie = ["label"] if self.weights == "uniform" else ["nearest", "label"]
        order = Window.partitionBy("id").orderBy(F.col("w").desc(), *tie)
        best = votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", F.col("label").alias("prediction"))
        return df.join(best, "id")


class KNeighborsRegressor(_Voting, Regressor):
    def predict(self, df: DataFrame) -> DataFrame:
        """The (weighted) mean of the neighbours' labels."""
        means = self._labelled(df).groupBy(F.col("query_id").alias("id")).agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))
        return df.join(means, "id")


def radius_edges(points: DataFrame, eps: float, dims: int = 3) -> DataFrame:
    """id, other for all pairs of different rows within ``eps`` (Euclidean, inclusive), both ways.

    Points are filed in cells of side ``eps`` over their first ``dims`` features
    and copied to the cells around; pairs are compared within a cell only. A cell
    of more than ``CELL`` points is split: each point lies in one of its parts, and
    what is around is copied to all of them.
    """
    d = min(width(points), dims)
    cell = F.array(*[F.floor(F.col("features")[j] / eps).cast("long") for j in range(d)])
    a = points.select("id", "features", cell.alias("cell"))
    sizes = stage(a.groupBy("cell").count().where(F.col("count") > CELL).select("cell", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "large-cells")
    around = a.select(F.col("id").alias("other"), F.col("features").alias("there"), "cell")
    for j in range(d):
        around = around.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("cell", F.transform("cell", lambda c, i: F.when(i == j, c + F.col("o")).otherwise(c))).drop("o")
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(sizes, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    around = around.join(sizes, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    near = squared_distance(F.col("features"), F.col("there")) <= eps * eps
    return a.join(around, ["cell", "part"]).where((F.col("id") != F.col("other")) & near).select("id", "other")
