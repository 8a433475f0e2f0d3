"""What estimators share: parameters, fit then predict or transform, scores."""

from __future__ import annotations

import contextvars
import functools
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config

#: Whether a fit is under way in this thread: what it fits in turn isn't routed again.
_inside: contextvars.ContextVar[bool] = contextvars.ContextVar("inside", default=False)


def _routed(fit):
    @functools.wraps(fit)
    def run(self, df: DataFrame):
        if _inside.get():
            return fit(self, df)
        token = _inside.set(True)
        try:
            return fit(self, config.routed(df, type(self).__name__))
        finally:
            _inside.reset(token)

    return run


class Estimator:
    """Fits a DataFrame with columns ``features`` (array<double>) and, if supervised, ``label``.

    ``fit`` runs Spark jobs and leaves small results in attributes that end in
    ``_``; ``predict`` and ``transform`` only add columns to a plan. Each ``fit``
    reads its input as ``config`` routes it for the estimator's name and size.
    """

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if "fit" in cls.__dict__:
            cls.fit = _routed(cls.__dict__["fit"])

    def get_params(self) -> dict:
        names = [p for p in inspect.signature(type(self).__init__).parameters if p != "self"]
        return {n: getattr(self, n) for n in names}

    def set_params(self, **params) -> Estimator:
        for k, v in params.items():
            if k not in self.get_params():
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
            setattr(self, k, v)
        return self

    def fit(self, df: DataFrame) -> Estimator:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)


class Regressor(Estimator):
    def score(self, df: DataFrame) -> float:
        """The share of the label's variance that predictions explain."""
        p = self.predict(df).select(F.col("label").cast("double").alias("y"), (F.col("label") - F.col("prediction")).alias("e"))
        left, all_ = p.agg(F.sum(F.col("e") * F.col("e")), F.var_pop("y") * F.count("*")).first()
        return 1.0 - left / all_


class Classifier(Estimator):
    def score(self, df: DataFrame) -> float:
        """The share of rows whose label is predicted."""
        return self.predict(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def classes(df: DataFrame, most: int = 10_000) -> list:
    """The distinct labels in order; ValueError for a null label or more than ``most``."""
    found = [r[0] for r in df.select("label").distinct().limit(most + 1).collect()]
    if None in found or len(found) > most:
        raise ValueError("labels must not be null, nor more than can be classes")
    return sorted(found)


def relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fitted model's numbers as a DataFrame."""
    return spark.createDataFrame(rows, schema)
