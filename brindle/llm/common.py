"""What the training-data operators share: words, the shared folder, ordered buckets."""

from __future__ import annotations

import uuid  # noqa: F401  names of stored files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_dir, stage, tidy, to_discard  # noqa: F401

#: One white-space character, and a word: the text between white space (ASCII space and U+0009 to U+000D).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def id_buckets(df: DataFrame, id_col: str, per_interval: int, tie: Column, intervals: int = 64) -> Column:
    """A bucket number that never falls as the id rises, for work in id order without one big sort.

    Quantiles of the ids (one pass over that column, ``intervals`` values to the
    driver) give intervals of about equal row counts; each is cut linearly into
    ``per_interval`` buckets. Null ids come first, in buckets of their own. These, and
    the rows of an id that fills an interval, are dealt to as many buckets as all
    others by the hash ``tie``: the order of rows with one id is free, and they may be
    very many. The quantiles only shape the buckets: any bounds give the same order.
    """
    cuts = df.agg(
        F.percentile_approx(F.col(id_col).cast("double"), [i / intervals for i in range(intervals + 1)], 1000)
    ).first()[0] or [0.0]
    bounds, many = sorted(set(cuts)), per_interval * intervals
    if len(bounds) < 2:
        bounds = [bounds[0], bounds[0] + 1.0]
    array = F.array(*[F.lit(float(b)) for b in bounds])
    x, part = F.col(id_col).cast("double"), F.pmod(tie, F.lit(many))
    at = F.greatest(F.lit(1), F.least(F.lit(len(bounds) - 1), F.size(F.filter(array, lambda b: b <= x))))
    low, high = F.element_at(array, at), F.element_at(array, at + 1)
    within = F.floor(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), (x - low) / (high - low))) * per_interval)
    bucket = (at - 1) * per_interval + within
    # An id that is two bounds at once fills what lies between them.
    full = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    if full:
        # Its rows begin their bucket, those of the last bound end theirs.
        place = F.when((x == bounds[-1]) & F.lit(bounds[-1] in full), part + many + 1).when(x.isin(full), part).otherwise(F.lit(many))
        bucket = bucket * (many + 1) + place
    return F.when(x.isNull(), part).otherwise(bucket + many).cast("long")
