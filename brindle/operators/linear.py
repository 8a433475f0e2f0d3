"""Linear models. Squared-loss models need one pass for the Gram matrix and are solved from it, those of very many features and logistic ones
take a pass for each step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from . import stats, wide
from .base import Classifier, Regressor, classes, relation


class _Linear(Regressor):
    """``method``: "gram" solves from the Gram matrix, "passes" takes proximal steps of one pass each, which need vectors of the
    features' size only; "auto" is the first up to ``wide.WIDE`` features. Passes end at ``max_iter`` or within ``tol``."""

    method, max_iter, tol = "auto", 1_000, 1e-9

    def _by_passes(self, df: DataFrame, l1=lambda n: 0.0, l2=lambda n: 0.0) -> _Linear:
        self.coef_, self.intercept_, self.n_iter_ = wide.penalised(df, l1, l2, self.fit_intercept, self.max_iter, self.tol)
        self.n_features_in_ = len(self.coef_)
        return self

    def _gram(self, df: DataFrame) -> dict[str, np.ndarray] | None:
        g = stats.gram(df, label=True, most=wide.most_features(self.method))
        if g is None:
            return None
        if not self.fit_intercept:  # about zero instead of the means
            g["xx"] = g["xx"] + g["n"] * np.outer(g["mean"], g["mean"])
            g["xy"] = g["xy"] + g["n"] * g["mean"] * g["y_mean"]
        return g

    def _set(self, w: np.ndarray, g: dict) -> _Linear:
        self.coef_ = w
        self.intercept_ = float(g["y_mean"] - g["mean"] @ w) if self.fit_intercept else 0.0
        self.n_features_in_ = len(w)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if len(self.coef_) > wide.LITERALS:
            b = self.intercept_
            return wide.appended(df, "prediction", T.DoubleType(), lambda x, w: pa.array(x @ w + b), self.coef_, len(self.coef_))
        return df.withColumn("prediction", V.linear(F.col("features"), self.coef_, self.intercept_))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """feature_idx and coef; the intercept is at -1."""
        rows = [(-1, float(self.intercept_)), *((j, float(c)) for j, c in enumerate(self.coef_))]
        return relation(spark, rows, "feature_idx int, coef double")


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By Cholesky, or least squares where ``a`` is singular. Scaled to a unit diagonal first."""
    s = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    scaled = a / np.outer(s, s)
    try:
        if np.linalg.cond(scaled) > 1e12:
            raise np.linalg.LinAlgError
        low = np.linalg.cholesky(scaled)
        return np.linalg.solve(low.T, np.linalg.solve(low, b / s)) / s
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(scaled, b / s, rcond=1e-12)[0] / s


class LinearRegression(_Linear):
    def __init__(self, fit_intercept: bool = True, method: str = "auto"):
        self.fit_intercept, self.method = fit_intercept, method

    def fit(self, df: DataFrame) -> LinearRegression:
        g = self._gram(df)
        if g is None:
            return self._by_passes(df)
        return self._set(_solve(g["xx"], g["xy"]), g)


class Ridge(_Linear):
    """|y - Xw|^2 + alpha |w|^2; the intercept is free."""

    def __init__(self, alpha: float = 1.0, fit_intercept: bool = True, method: str = "auto"):
        self.alpha, self.fit_intercept, self.method = alpha, fit_intercept, method

    def fit(self, df: DataFrame) -> Ridge:
        g = self._gram(df)
        if g is None:
            return self._by_passes(df, l2=lambda n: self.alpha / n)
        return self._set(_solve(g["xx"] + self.alpha * np.eye(len(g["xy"])), g["xy"]), g)


class ElasticNet(_Linear):
    """|y - Xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2), by coordinate descent on the Gram matrix or by passes."""

    def __init__(self, alpha: float = 1.0, l1_ratio: float = 0.5, fit_intercept: bool = True, max_iter: int = 10_000, tol: float = 1e-10, method: str = "auto"):
        self.alpha, self.l1_ratio, self.fit_intercept, self.max_iter, self.tol, self.method = alpha, l1_ratio, fit_intercept, max_iter, tol, method

    def fit(self, df: DataFrame) -> ElasticNet:
        g = self._gram(df)
        if g is None:
            return self._by_passes(df, lambda n: self.alpha * self.l1_ratio, lambda n: self.alpha * (1 - self.l1_ratio))
        xx, xy, n = g["xx"], g["xy"], g["n"]
        l1, l2 = n * self.alpha * self.l1_ratio, n * self.alpha * (1 - self.l1_ratio)
        w = np.zeros(len(xy))
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        for self.n_iter_ in range(1, self.max_iter + 1):
            change = 0.0
            for j in range(len(w)):
                if xx[j, j] + l2 <= 0:
                    continue
                r = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                new = np.sign(r) * max(abs(r) - l1, 0.0) / (xx[j, j] + l2)
                change = max(change, abs(new - w[j]) * scale[j])
                w[j] = new
            if change <= self.tol * max(1.0, float(np.max(np.abs(w) * scale))):
                break
        return self._set(w, g)


class Lasso(ElasticNet):
    def __init__(self, alpha: float = 1.0, fit_intercept: bool = True, max_iter: int = 10_000, tol: float = 1e-10, method: str = "auto"):
        super().__init__(alpha, 1.0, fit_intercept, max_iter, tol, method)

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in ("alpha", "fit_intercept", "max_iter", "tol", "method")}


class LogisticRegression(Classifier):
    """Sum of the log losses + |w|^2 / 2C; the intercept is free.

    Two classes: Newton steps, each a pass that sums gradient and Hessian. More:
    softmax with L-BFGS, each evaluation a pass that sums loss and gradient. The
    data is kept in memory (or on disk) between passes; the driver holds
    parameters only.
    """

    def __init__(self, C: float = 1.0, fit_intercept: bool = True, max_iter: int = 100, tol: float = 1e-8):
        self.C, self.fit_intercept, self.max_iter, self.tol = C, fit_intercept, max_iter, tol

    def fit(self, df: DataFrame) -> LogisticRegression:
        self.classes_ = classes(df)
        at = F.array_position(F.array(*[F.lit(c) for c in self.classes_]), F.col("label")) - 1
        data = df.select("features", at.cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            mean, var = stats.moments(data)
            d = self.n_features_in_ = len(mean)
            std = np.where(var < 1e-30, 1.0, np.sqrt(var))
            if not self.fit_intercept:
                mean = np.zeros(d)
            k = len(self.classes_)
            if k < 2:
                raise ValueError("two classes at least are needed")
            w = self._newton(data, mean, std, d) if k == 2 else self._lbfgs(data, mean, std, d, k)
        finally:
            data.unpersist()
        w = w.reshape(-1, d + 1)
        self.coef_ = w[:, :d] / std
        self.intercept_ = w[:, d] - self.coef_ @ mean
        return self

    def _design(self, mean: np.ndarray, std: np.ndarray):
        one = 1.0 if self.fit_intercept else 0.0
        return lambda batch: np.hstack([(stats.matrix(batch) - mean) / std, np.full((len(batch), 1), one)])

    def _penalty(self, std: np.ndarray) -> np.ndarray:
        return np.append(1 / (self.C * std**2), 0.0 if self.fit_intercept else 1.0)

    def _newton(self, data: DataFrame, mean: np.ndarray, std: np.ndarray, d: int) -> np.ndarray:
        design, penalty, w, last = self._design(mean, std), self._penalty(std), np.zeros(d + 1), np.inf
        step = np.zeros(d + 1)

        def part_at(w: np.ndarray):
            def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
                x, y = design(batch), batch.column("y").to_numpy()
                z = x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -100, 100)))
                return {"loss": np.array([np.sum(np.logaddexp(0, z) - y * z)]), "grad": x.T @ (p - y), "hess": x.T @ (x * (p * (1 - p))[:, None])}

            return part

        for self.n_iter_ in range(1, self.max_iter + 1):
            s = stats.sums(data, part_at(w), ["loss", "grad", "hess"])
            loss = s["loss"][0] + 0.5 * float(penalty @ (w * w))
            if loss > last + 1e-12 * abs(last):
                step /= 2
                w = w - step
                continue
            last = loss
            step = -np.linalg.lstsq(s["hess"].reshape(d + 1, d + 1) + np.diag(penalty), s["grad"] + penalty * w, rcond=None)[0]
            w = w + step
            if np.max(np.abs(step)) <= self.tol * max(1.0, float(np.max(np.abs(w)))):
                break
        return w

    def _lbfgs(self, data: DataFrame, mean: np.ndarray, std: np.ndarray, d: int, k: int) -> np.ndarray:
        design, penalty = self._design(mean, std), self._penalty(std)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            m = w.reshape(k, d + 1)

            def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
                x, y = design(batch), batch.column("y").to_numpy().astype(int)
                z = x @ m.T
                z -= z.max(axis=1, keepdims=True)
                log_sum = np.log(np.exp(z).sum(axis=1))
                p = np.exp(z - log_sum[:, None])
                out = {"loss": np.array([np.sum(log_sum - z[np.arange(len(y)), y])])}
                p[np.arange(len(y)), y] -= 1
                return out | {"grad": p.T @ x}

            s = stats.sums(data, part, ["loss", "grad"])
            return s["loss"][0] + 0.5 * float((penalty * m * m).sum()), s["grad"] + (penalty * m).ravel()

        w = np.zeros(k * (d + 1))
        f, g = loss(w)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for self.n_iter_ in range(1, self.max_iter + 1):
            q, alphas = g.copy(), []
            for s, y in reversed(pairs):
                alphas.append(s @ q / (s @ y))
                q -= alphas[-1] * y
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(g)))
            for (s, y), a in zip(pairs, reversed(alphas), strict=True):
                q += s * (a - y @ q / (s @ y))
            t = 1.0
            while True:
                f2, g2 = loss(w - t * q)
                if f2 <= f - 1e-4 * t * float(g @ q) or t < 1e-6:
                    break
                t /= 2
            s, y = -t * q, g2 - g
            if s @ y > 1e-12:
                pairs = [*pairs[-9:], (s, y)]
            done = abs(f - f2) <= self.tol * max(1.0, abs(f)) or np.max(np.abs(g2)) <= self.tol * max(1.0, float(np.linalg.norm(w)))
            w, f, g = w + s, f2, g2
            if done:
                break
        return w

    def decision(self):
        x = F.col("features")
        return F.array(*[V.linear(x, w, b) for w, b in zip(self.coef_, self.intercept_, strict=True)])

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """probability array<double>, in the order of ``classes_``."""
        z = self.decision()
        if len(self.classes_) == 2:
            p = V.sigmoid(z[0])
            return df.withColumn("probability", F.array(1.0 - p, p))
        return df.withColumn("__z", z).withColumn("probability", V.softmax(F.col("__z"))).drop("__z")

    def predict(self, df: DataFrame) -> DataFrame:
        """The second of two classes where its log odds are over 0, else the likeliest class, the first among equals."""
        names, z = F.array(*[F.lit(c) for c in self.classes_]), self.decision()
        if len(self.classes_) == 2:
            return df.withColumn("prediction", F.when(z[0] > 0, names[1]).otherwise(names[0]))
        return df.withColumn("__z", z).withColumn("prediction", F.get(names, V.argmax(F.col("__z")))).drop("__z")

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, j, float(v)) for i, (w, b) in enumerate(zip(self.coef_, self.intercept_, strict=True)) for j, v in ((-1, b), *enumerate(w))]
        return relation(spark, rows, "class_idx int, feature_idx int, coef double")
