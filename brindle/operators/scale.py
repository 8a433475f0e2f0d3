"""Scalers: one aggregation to fit, one expression to transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import stats
from .base import Estimator, relation


class _Scaler(Estimator):
    """x -> (x - center) * factor."""

    center: np.ndarray
    factor: np.ndarray

    @property
    def n_features_in_(self) -> int:
        return len(self.center)

    def expression(self, features: Column) -> Column:
        return V.column_transform(features, self.center, self.factor)

    def transform(self, df: DataFrame) -> DataFrame:
        """``features`` replaced by the scaled ones."""
        return df.withColumn("features", self.expression(F.col("features")))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        back = F.zip_with(F.zip_with("features", V.literal(1 / self.factor), lambda x, s: x * s), V.literal(self.center), lambda x, c: x + c)
        return df.withColumn("features", back)

    def _table(self, spark: SparkSession, **columns: np.ndarray) -> DataFrame:
        rows = [(j, *(float(v[j]) for v in columns.values())) for j in range(len(self.center))]
        return relation(spark, rows, "feature_idx int, " + ", ".join(f"{c} double" for c in columns))


class StandardScaler(_Scaler):
    """Mean 0 and population deviation 1; a constant feature is only centred."""

    def __init__(self, with_mean: bool = True, with_std: bool = True):
        self.with_mean, self.with_std = with_mean, with_std

    def fit(self, df: DataFrame) -> StandardScaler:
        self.mean_, self.var_ = stats.moments(df)
        std = np.sqrt(self.var_)
        self.scale_ = np.where(std < 1e-15, 1.0, std)
        self.center = self.mean_ if self.with_mean else np.zeros_like(self.mean_)
        self.factor = 1 / self.scale_ if self.with_std else np.ones_like(self.mean_)
        return self

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, mean=self.mean_, var=self.var_, scale=self.scale_)


class MinMaxScaler(_Scaler):
    """To the range ``feature_range``; a constant feature goes to its lower end."""

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        self.feature_range = feature_range

    def fit(self, df: DataFrame) -> MinMaxScaler:
        low, high = self.feature_range
        if low >= high:
            raise ValueError("feature_range must rise")
        self.data_min_, self.data_max_ = stats.extremes(df)
        self.data_range_ = self.data_max_ - self.data_min_
        self.scale_ = (high - low) / np.where(self.data_range_ < 1e-10, 1.0, self.data_range_)
        self.min_ = low - self.data_min_ * self.scale_
        self.center, self.factor = self.data_min_ - low / self.scale_, self.scale_
        return self

    def expression(self, features: Column) -> Column:
        scaled = V.column_transform(features, self.data_min_, self.scale_)
        return F.transform(scaled, lambda x: x + float(self.feature_range[0]))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, data_min=self.data_min_, data_max=self.data_max_, data_range=self.data_range_, scale=self.scale_)


class RobustScaler(_Scaler):
    """Median 0 and interquartile range 1, from exact quantiles; a range of 0 counts as 1."""

    def __init__(self, with_centering: bool = True, with_scaling: bool = True):
        self.with_centering, self.with_scaling = with_centering, with_scaling

    def fit(self, df: DataFrame) -> RobustScaler:
        low, self.center_, high = stats.quantiles(df, (0.25, 0.5, 0.75))
        self.scale_ = np.where(high - low < 1e-15, 1.0, high - low)
        self.center = self.center_ if self.with_centering else np.zeros_like(low)
        self.factor = 1 / self.scale_ if self.with_scaling else np.ones_like(low)
        return self

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, center=self.center_, scale=self.scale_)
