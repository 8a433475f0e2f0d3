"""K-Means by Lloyd's passes over the data, DBSCAN by a graph of cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..sources.frames import width
from . import stats
from .base import Estimator, relation
from .density import clusters
from .metric import distances


#: Numbers in the centres from which on they aren't written out in an expression, which Spark could no longer compile.
LITERALS = 2_000


def assign(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first among equals, and its squared distance.

    Products tell the nearest but for rounding; rows with two centres closer to
    each other than that are decided by differences.
    """
    norms = (centers * centers).sum(axis=1)
    d = norms - 2 * (x @ centers.T)
    c = d.argmin(axis=1)
    own = (x * x).sum(axis=1)
    near = d <= d[np.arange(len(x)), c][:, None] + 1e-12 * (own[:, None] + norms.max(initial=0.0))
    unsure = np.flatnonzero(near.sum(axis=1) > 1)
    if len(unsure):
        c[unsure] = distances(x[unsure], centers, "sqeuclidean").argmin(axis=1)
    return c, ((x - centers[c]) ** 2).sum(axis=1)


def _drawn(data: DataFrame, most: int, seed: int, centers: np.ndarray | None = None) -> np.ndarray:
    """At most ``most`` different rows, each drawn as likely as its squared distance to the nearest of ``centers``; without those all alike.

    Equal rows have equal numbers, so tasks each pass on their own few best, and
    only those are compared: a pass over the data without a shuffle of it.
    """
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "features"), F.lit(2**40)) + 0.5) / 2**40

    def best(batches):
        held: dict[bytes, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for piece in stats.slices(batch):
                x = stats.matrix(piece)
                d2 = np.ones(len(x)) if centers is None else assign(x, centers)[1]
                with np.errstate(divide="ignore"):
                    key = -np.log(piece.column("u").to_numpy()) / d2
                for i in np.argsort(key, kind="stable")[: len(x)]:
                    if len(held) >= most and (not np.isfinite(key[i]) or key[i] > max(k for k, _ in held.values())):
                        break
                    if np.isfinite(key[i]):
                        held[x[i].tobytes()] = float(key[i]), x[i]
                if len(held) > most:
                    held = dict(sorted(held.items(), key=lambda e: e[1][0])[:most])
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist() for _, v in held.values()], pa.list_(pa.float64())), pa.array([k for k, _ in held.values()], pa.float64())], ["features", "key"])

    rows = data.select("features", uniform.alias("u")).mapInArrow(best, "features array<double>, key double")
    picked = rows.dropDuplicates(["features"]).orderBy("key", "features").limit(most).collect()
    return np.array([r.features for r in picked], float)


class KMeans(Estimator):
    """Lloyd's algorithm from k-means|| or random seeds, or from given centres; the best of ``n_init`` runs.

    Each iteration is a pass in which tasks pass on sums per cluster. A cluster
    without rows keeps its centre. Stops when no centre moves by ``tol`` or more.
    """

    def __init__(self, n_clusters: int = 8, init: str | np.ndarray = "k-means++", n_init: int | str = "auto", max_iter: int = 300, tol: float = 1e-4, random_state: int = 0):
        self.n_clusters, self.init, self.n_init, self.max_iter, self.tol, self.random_state = n_clusters, init, n_init, max_iter, tol, random_state

    def fit(self, df: DataFrame) -> KMeans:
        d, k = width(df), self.n_clusters
        data = df.select("features").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            given = not isinstance(self.init, str)
            runs = 1 if given else self.n_init if self.n_init != "auto" else 1 if self.init == "k-means++" else 5
            best = None
            for r in range(runs):
                start = np.array(self.init, float).reshape(k, d) if given else self._seeds(data, k, self.random_state + r)
                found = self._lloyd(data, start)
                best = found if best is None or found[1] < best[1] else best
        finally:
            data.unpersist()
        self.cluster_centers_, self.inertia_, self.n_iter_ = best
        self.n_features_in_, self._fitted = d, df
        return self

    @property
    def labels_(self) -> DataFrame:
        """The rows that were fitted with their clusters as ``prediction``."""
        return self.predict(self._fitted)

    def _seeds(self, data: DataFrame, k: int, seed: int) -> np.ndarray:
        """k distinct rows by their seeded hash, or by k-means||: rounds of rows drawn by squared distance, then clustered by weight."""
        if self.init == "random":
            picked = _drawn(data, k, seed)
            if len(picked) < k:
                raise ValueError("fewer distinct rows than clusters")
            return picked
        centers = _drawn(data, 1, seed)
        for i in range(2 + int(math.log(k + 1))):
            more = _drawn(data, 2 * k, seed * 1000 + i, centers)
            if not len(more):
                break
            centers = np.vstack([centers, more])
        if len(centers) < k:
            raise ValueError("fewer distinct rows than clusters")
        weights = stats.sums(data, lambda b: {"n": np.bincount(assign(stats.matrix(b), centers)[0], minlength=len(centers))}, ["n"])["n"]
        rng = np.random.default_rng(seed)
        out = [centers[int(np.argmax(weights))]]
        while len(out) < k:
            p = assign(centers, np.array(out))[1] * np.maximum(weights, 1e-9)
            out.append(centers[rng.choice(len(centers), p=p / p.sum())])
        return np.array(out)

    def _lloyd(self, data: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, float, int]:
        k, d = centers.shape

        def pass_over(centers: np.ndarray) -> dict[str, np.ndarray]:
            def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
                x = stats.matrix(batch)
                c, d2 = assign(x, centers)
                total = np.zeros((k, d))
                for j in range(d):
                    total[:, j] = np.bincount(c, x[:, j], k)
                return {"n": np.bincount(c, minlength=k), "x": total, "inertia": np.array([d2.sum()])}

            return stats.sums(data, part, ["n", "x", "inertia"])

        i = 0
        for i in range(1, self.max_iter + 1):
            s = pass_over(centers)
            n = s["n"][:, None]
            new = np.where(n > 0, s["x"].reshape(k, d) / np.maximum(n, 1), centers)
            moved = np.sqrt(((new - centers) ** 2).sum(axis=1)).max()
            centers = new
            if moved < self.tol:
                break
        return centers, float(pass_over(centers)["inertia"][0]), i

    def _by_matrix(self, df: DataFrame, name: str, kind: T.DataType, found) -> DataFrame:
        """``df`` with a column of what ``found(x, centers)`` gives for a batch of rows; the centres go out as one matrix."""
        shared = df.sparkSession.sparkContext.broadcast(self.cluster_centers_)
        kept = df.drop(name)
        schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])

        def run(batches):
            for batch in batches:
                for piece in stats.slices(batch):
                    x = stats.matrix(piece).astype(float) if len(piece) else np.empty(shared.value.shape)[:0]
                    yield pa.RecordBatch.from_arrays([*piece.columns, found(x, shared.value)], schema.names)

        return kept.mapInArrow(run, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """distances array<double>: to each centre."""
        if self.cluster_centers_.size > LITERALS:

            def away(x: np.ndarray, centers: np.ndarray) -> pa.Array:
                step = max(1, stats.STEP // len(centers))
                d = [distances(x[at : at + step], centers, "euclidean").ravel() for at in range(0, len(x), step)]
                return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(centers)), pa.array(np.concatenate([*d, np.empty(0)])))

            return self._by_matrix(df, "distances", T.ArrayType(T.DoubleType()), away)
        return df.withColumn("distances", F.array(*[F.sqrt(V.squared_distance(F.col("features"), V.literal(c))) for c in self.cluster_centers_]))

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the nearest centre's number, the first among equals, as ``prediction``."""
        if self.cluster_centers_.size > LITERALS:
            return self._by_matrix(df, "prediction", T.IntegerType(), lambda x, centers: pa.array(assign(x, centers)[0].astype(np.int32)))
        d2 = F.array(*[V.squared_distance(F.col("features"), V.literal(c)) for c in self.cluster_centers_])
        return df.withColumn("__d", d2).withColumn("prediction", V.argmin(F.col("__d"))).drop("__d")

    def inertia(self, df: DataFrame) -> float:
        """The sum of squared distances to the nearest centres."""
        return float(self.transform(df).agg(F.sum(F.pow(F.array_min("distances"), F.lit(2)))).first()[0] or 0.0)

    def score(self, df: DataFrame) -> float:
        return -self.inertia(df)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, j, float(v)) for c, center in enumerate(self.cluster_centers_) for j, v in enumerate(center)]
        return relation(spark, rows, "cluster int, dim int, value double")


class DBSCAN(Estimator):
    """Core points have ``min_samples`` rows, themselves included, within ``eps``; clusters are their connected components.

    Clusters are numbered by their smallest core id; a border point belongs to
    the cluster of its smallest core neighbour; noise is -1. Rows have unique
    ids.
    """

    def __init__(self, eps: float = 0.5, min_samples: int = 5):
        self.eps, self.min_samples = eps, min_samples

    def fit(self, df: DataFrame) -> DBSCAN:
        self._fitted = df
        self.labels_ = clusters(df.select("id", "features"), self.eps, self.min_samples)
        return self

    @property
    def core_sample_indices_(self) -> DataFrame:
        """The ids of the core points."""
        return self.labels_.where("is_core").select("id")

    @property
    def components_(self) -> DataFrame:
        """The core points themselves, as rows of what was fitted."""
        return self._fitted.join(self.core_sample_indices_, "id", "left_semi")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df``, which is the fitted one, with its clusters as ``prediction``."""
        return df.join(self.labels_.select("id", F.col("cluster").alias("prediction")), "id")

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self.labels_
