"""Tables as feature frames: an optional id, ``features array<double>`` and an optional label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_features(df: DataFrame, features: Sequence[str] | str, id: Column | None = None, label: Column | None = None) -> DataFrame:
    """``features`` is one array column or several numeric ones; the others become columns id and label."""
    if isinstance(features, str):
        x = F.col(features).cast("array<double>")
    else:
        x = F.array(*[F.col(c).cast("double") for c in features])
    extra = [c.alias(n) for c, n in ((id, "id"), (label, "label")) if c is not None]
    return df.select(*extra[:1] if id is not None else [], x.alias("features"), *(extra[-1:] if label is not None else []))


def width(df: DataFrame, features: str = "features") -> int:
    """The number of features. Raises ValueError unless all rows have that many, and all are finite numbers; one pass."""
    x = F.col(features)
    bad = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    low, high, wrong = df.agg(F.min(F.size(x)), F.max(F.size(x)), F.coalesce(F.bool_or(bad), F.lit(False))).first()
    if low is None:
        raise ValueError("no rows to fit")
    if wrong or low != high:
        raise ValueError("features must be arrays of one length without nulls, NaN or infinities")
    return low
