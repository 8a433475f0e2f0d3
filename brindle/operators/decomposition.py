"""Truncated SVD and PCA from one pass for the Gram matrix, then a symmetric eigenproblem of the features' size; of very many features by a
range finder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from . import stats, wide
from .base import Estimator, relation


class _Decomposition(Estimator):
    def _eigen(self, a: np.ndarray, k: int) -> np.ndarray:
        """The k largest eigenvalues; sets ``components_``, each with its entry of largest size positive."""
        values, vectors = np.linalg.eigh(a)
        self._signed(vectors[:, ::-1].T[:k])
        return np.maximum(values[::-1][:k], 0.0)

    def _signed(self, rows: np.ndarray) -> None:
        lead = rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)]
        self.components_ = rows * np.where(lead < 0, -1.0, 1.0)[:, None]

    def _by_passes(self, df: DataFrame, centred: bool) -> None:
        found = wide.leading(df, self.n_components, centred)
        self._signed(found["vectors"])
        self.n_features_in_ = len(found["mean"])
        self.singular_values_ = found["values"]
        self.explained_variance_ = found["values"] ** 2 / max(found["n"] - 1, 1)
        total = found["m2"].sum() / max(found["n"] - 1, 1)
        self.explained_variance_ratio_ = self.explained_variance_ / total if total > 0 else np.zeros(len(found["values"]))
        if centred:
            self.n_components_, self.mean_ = self.n_components, found["mean"]

    def _moved(self, df: DataFrame, found, d: int) -> DataFrame:
        """``df`` with features that ``found`` makes of theirs and the components, which go out as one matrix."""
        return wide.appended(df, "features", T.ArrayType(T.DoubleType()), lambda x, c: wide.lists(found(x, c)), self.components_, d)

    def _components(self, x: Column) -> Column:
        return F.array(*[V.dot(x, V.literal(c)) for c in self.components_])

    def to_df(self, spark: SparkSession) -> DataFrame:
        """component, singular_value, explained_variance, explained_variance_ratio, vector."""
        cols = (self.singular_values_, self.explained_variance_, self.explained_variance_ratio_)
        rows = [(i, *(float(c[i]) for c in cols), [float(x) for x in v]) for i, v in enumerate(self.components_)]
        return relation(spark, rows, "component int, singular_value double, explained_variance double, explained_variance_ratio double, vector array<double>")


class TruncatedSVD(_Decomposition):
    """The leading right singular vectors, without centring. ``method``: "gram", "passes" (no matrix of features by features), or "auto"."""

    def __init__(self, n_components: int = 2, method: str = "auto"):
        self.n_components, self.method = n_components, method

    def fit(self, df: DataFrame) -> TruncatedSVD:
        g = stats.gram(df, most=wide.most_features(self.method))
        if g is None:
            self._by_passes(df, centred=False)
            return self
        d = self.n_features_in_ = len(g["mean"])
        if not 1 <= self.n_components <= d:
            raise ValueError("n_components must lie between 1 and the number of features")
        s2 = self._eigen(g["xx"] + g["n"] * np.outer(g["mean"], g["mean"]), self.n_components)
        self.singular_values_ = np.sqrt(s2)
        self.explained_variance_ = s2 / max(g["n"] - 1, 1)
        total = np.trace(g["xx"]) / max(g["n"] - 1, 1)
        self.explained_variance_ratio_ = self.explained_variance_ / total if total > 0 else np.zeros_like(s2)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.components_.size > wide.LITERALS:
            return self._moved(df, lambda x, c: x @ c.T, self.components_.shape[1])
        return df.withColumn("features", self._components(F.col("features")))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self.components_.size > wide.LITERALS:
            return self._moved(df, lambda x, c: x @ c, self.components_.shape[0])
        return df.withColumn("features", F.array(*[V.dot(F.col("features"), V.literal(c)) for c in self.components_.T]))


class PCA(_Decomposition):
    """Principal axes of the centred data. ``n_components``: a number, None for all, or a share of variance between 0 and 1.

    ``method`` as for ``TruncatedSVD``; all axes, or a share, need the Gram matrix.
    """

    def __init__(self, n_components: int | float | None = None, method: str = "auto"):
        self.n_components, self.method = n_components, method

    def fit(self, df: DataFrame) -> PCA:
        number = isinstance(self.n_components, int)
        if self.method == "passes" and not number:
            raise ValueError("passes need a number of components")
        g = stats.gram(df, most=wide.most_features(self.method) if number else None)
        if g is None:
            self._by_passes(df, centred=True)
            return self
        self.mean_ = g["mean"]
        d = self.n_features_in_ = len(self.mean_)
        s2 = self._eigen(g["xx"], d)
        variance, total = s2 / max(g["n"] - 1, 1), max(s2.sum(), 1e-300) / max(g["n"] - 1, 1)
        k = self.n_components
        if k is None:
            k = min(d, int(g["n"]))
        elif isinstance(k, float):
            k = int(np.searchsorted(np.cumsum(variance / total), k - 1e-12) + 1)
        if not 1 <= k <= d:
            raise ValueError("n_components must lie between 1 and the number of features")
        self.n_components_, self.components_ = k, self.components_[:k]
        self.singular_values_, self.explained_variance_ = np.sqrt(s2[:k]), variance[:k]
        self.explained_variance_ratio_ = self.explained_variance_ / total
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.components_.size > wide.LITERALS:
            mean = self.mean_
            return self._moved(df, lambda x, c: (x - mean) @ c.T, len(mean))
        centred = F.zip_with("features", V.literal(self.mean_), lambda x, m: x - m)
        return df.withColumn("__x", centred).withColumn("features", self._components(F.col("__x"))).drop("__x")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        if self.components_.size > wide.LITERALS:
            mean = self.mean_
            return self._moved(df, lambda x, c: x @ c + mean, self.components_.shape[0])
        back = F.array(*[V.dot(F.col("features"), V.literal(c)) + float(m) for c, m in zip(self.components_.T, self.mean_, strict=True)])
        return df.withColumn("features", back)
