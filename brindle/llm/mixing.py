"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything is DataFrame operations. Each source gets a share of all words in
proportion to its weight; a share above ``max_epochs`` times the source's size
stops there and the excess goes to the other sources by weight until none is
above. In closed form: with the sources ordered by cap / weight, the capped ones
are a prefix, and the rest share what the prefix leaves by weight.

A source whose target is ``k + f`` times its size takes every document ``k``
times and, for the fraction, documents in a seeded order until the fractional
words are reached. The order is the md5 of seed and id, and a prefix of that md5
splits each source into ``buckets`` parts, so running sums never need a whole
source in one task: they are taken within a bucket and shifted by the sums of
the buckets before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Sources up to this many are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target: one row per source of ``sizes`` (source, size).

    Sources are ordered by code point, null last, and take ``weights`` in turn.
    The windows below see one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    s = s.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long").alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - F.sum("cap").over(before) + F.col("cap")).alias("left"),
        (F.sum("weight").over(everything) - F.sum("weight").over(before) + F.col("weight")).alias("left_weight"),
    ).withColumn("capped", F.col("cap") * F.col("left_weight") <= F.col("left") * F.col("weight"))
    # The first source that isn't capped sets the level for all later ones: it has the most weight left.
    open_ = F.when(~F.col("capped"), F.struct("left_weight", "left"))
    s = s.withColumn("level", F.max(open_).over(everything))
    shared = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.left_weight").cast("double")
    return s.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    buckets: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken and ``keep``: how often the mix takes each document.

    ``size`` is the number of words, 0 for a null or blank text. A null source
    is a source of its own, a null id sorts as the empty string, equal ids are
    ordered by size, repeated rows each count. A source without words has target
    0. No input rows: no output rows. Columns that aren't asked for are ignored;
    those of ``keep`` have other names than the result's. ``buckets`` is a power
    of 16.
    """
    digits = len(f"{buckets - 1:x}")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key")
    sizes = common.stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
            key,
            *keep,
        ),
        "mix-sizes",
    )
    targets = common.stage(source_targets(sizes, weights, max_epochs), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    bucketed = sizes.withColumn("bucket", F.substring("key", 1, digits))
    parts = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    running = bucketed.withColumn("upto", F.sum("size").over(parts.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ordered = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("bucket_size").over(ordered) - F.col("bucket_size")).alias("offset"))
    placed = running.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    t = targets.select(F.col("source").alias("t"), "source_size", "target")
    both = placed.join(t, F.col("source").eqNullSafe(F.col("t")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    both = both.withColumn("whole", whole)
    middle = (F.col("offset") + F.col("upto") - F.col("size")).cast("double") + F.col("size") / 2.0
    extra = (F.col("whole") < max_epochs) & (middle <= F.col("target") - F.col("whole") * F.col("source_size"))
    both = both.withColumn("repeats", F.col("whole") + extra.cast("long"))
    return both.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), *keep)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``plan`` says; ``how`` are its other parameters.

    Every row takes part by itself: null ids and rows that share an id or are the
    same throughout are mixed like others. Rows without words are left out, for
    they add nothing to a mix. Other columns come along, whatever their names; no
    rows give none.
    """
    # Rows are numbered once and written, so that the plan finds them again.
    numbered = common.stage(docs.select(F.monotonically_increasing_id().alias("row_number"), F.struct(*docs.columns).alias("row")), "mix-rows")
    flat = numbered.select("row_number", *[F.col("row")[c].alias(n) for n, c in (("doc_id", id_col), ("text", text_col), ("source", source_col))])
    repeats = plan(flat, **how, keep=("row_number",)).where("repeats > 0 and size > 0").select("row_number", "repeats")
    joined = numbered.join(repeats, "row_number").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: every document with its source's target and the words the mix takes from it.

    Null texts have size 0, null sources are one source, repeated rows and ids each
    count; no documents give no rows; other columns are ignored.
    """
    return plan(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(concat('17:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes GROUP BY source),
filled AS (
  SELECT *, source_size * 3 AS cap, sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER f, 0) AS lft,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS left_weight
  FROM named
  WINDOW f AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_max(lft, left_weight) AS lft, max(left_weight) AS left_weight FROM filled WHERE cap * left_weight > lft * weight),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap * f.left_weight <= f.lft * weight THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * l.lft AS DOUBLE) / CAST(l.left_weight AS DOUBLE) END AS target
  FROM filled f CROSS JOIN level l),
placed AS (
  SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN whole < 3 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
