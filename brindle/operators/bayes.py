"""Gaussian naive Bayes: one grouped aggregation to fit, one expression to score."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.frames import width
from .base import Classifier, relation


class GaussianNB(Classifier):
    """``var_smoothing`` times the largest variance of a feature is added to all variances. ``priors`` replaces the class shares."""

    def __init__(self, priors: list[float] | None = None, var_smoothing: float = 1e-9):
        self.priors, self.var_smoothing = priors, var_smoothing

    def fit(self, df: DataFrame) -> GaussianNB:
        d = self.n_features_in_ = width(df)
        x = [F.col("features")[j] for j in range(d)]
        each = [f(c).alias(f"{n}{j}") for n, f in (("m", F.avg), ("v", F.var_pop)) for j, c in enumerate(x)]
        rows = df.groupBy("label").agg(F.count("*").alias("n"), *each).orderBy("label").collect()
        if rows[0].label is None:
            raise ValueError("labels must not be null")
        self.classes_ = [r.label for r in rows]
        self.class_count_ = np.array([r.n for r in rows], float)
        self.class_prior_ = np.array(self.priors) if self.priors is not None else self.class_count_ / self.class_count_.sum()
        self.theta_ = np.array([[r[f"m{j}"] for j in range(d)] for r in rows])
        within = np.array([[r[f"v{j}"] for j in range(d)] for r in rows])
        # The variance of all rows, from that within and between the classes.
        share = (self.class_count_ / self.class_count_.sum())[:, None]
        mean = (share * self.theta_).sum(axis=0)
        whole = (share * (within + (self.theta_ - mean) ** 2)).sum(axis=0)
        self.epsilon_ = self.var_smoothing * float(whole.max())
        self.var_ = within + self.epsilon_
        return self

    def joint_log_likelihood(self) -> Column:
        def of(i: int) -> Column:
            v = np.maximum(self.var_[i], 1e-300)
            fixed = math.log(self.class_prior_[i]) - 0.5 * float(np.sum(np.log(2 * math.pi * v)))
            scaled = V.column_transform(F.col("features"), self.theta_[i], 1 / np.sqrt(v))
            return fixed - 0.5 * V.norm_squared(scaled)

        return F.array(*[of(i) for i in range(len(self.classes_))])

    def predict(self, df: DataFrame) -> DataFrame:
        best = F.get(F.array(*[F.lit(c) for c in self.classes_]), V.argmax(F.col("__j")))
        return df.withColumn("__j", self.joint_log_likelihood()).withColumn("prediction", best).drop("__j")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__j", self.joint_log_likelihood()).withColumn("probability", V.softmax(F.col("__j"))).drop("__j")

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, j, float(self.class_prior_[i]), float(self.theta_[i, j]), float(self.var_[i, j])) for i, c in enumerate(self.classes_) for j in range(self.theta_.shape[1])]
        kind = "string" if isinstance(self.classes_[0], str) else "long"
        return relation(spark, rows, f"label {kind}, feature_idx int, prior double, theta double, var double")
