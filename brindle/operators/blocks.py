"""Two tables of vectors brought together block by block, without the driver and without a copy of a block for those it meets.

Both sides are written once, in rows that hold many vectors each. A task reads a part
of either side and brings its blocks together two by two, so what is written and
shuffled grows with the tables, not with their product, and a task's memory is that
of its part of the right side, which a read of files bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .metric import _bytes, _matrix
from .shared import stage

#: Numbers (rows times features) in a block of either side, and in one that isn't cut smaller to give all cores some.
LEFT, RIGHT, SHARE = 250_000, 250_000, 16_384
PACKED = "ids binary, x binary"


def pack(df: DataFrame, d: int, numbers: int) -> DataFrame:
    """block, ids, x: rows of ``df`` (id, features) in blocks of about ``numbers`` numbers, or fewer where there are few, written to the shared folder."""
    whole = df.count() * max(1, d)
    cores = df.sparkSession.sparkContext.defaultParallelism
    many = max(1, -(-whole // numbers), min(math.ceil(2 * math.sqrt(cores)), whole // SHARE))
    # Rows are dealt evenly but for a few.
    most = max(1, 2 * min(numbers, -(-whole // many)) // max(1, d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, n = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([_bytes(np.concatenate(x))], pa.binary())], ["ids", "x"])

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, most - n)
                ids.append(part.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
                x.append(stats.matrix(part).astype(float))
                at, n = at + len(part), n + len(part)
                if n == most:
                    yield out()
                    ids, x, n = [], [], 0
        if n:
            yield out()

    rows = df.select(F.col("id").cast("long").alias("id"), "features").repartition(many).mapInArrow(run, PACKED)
    return stage(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def meet(left: DataFrame, right: DataFrame, d: int, step: Callable, schema: str) -> DataFrame:
    """What ``step(ids, x, others, y, turned)`` yields for every block of ``left`` with every one of ``right`` (both id, features).

    Where both are one DataFrame, two different blocks meet once: ``turned`` tells that
    what comes of them is asked for the other way round, too.
    """
    alike = left is right
    a = pack(left, d, min(LEFT, RIGHT) if alike else LEFT)
    b = a if alike else pack(right, d, RIGHT)
    of = lambda side, df: df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "ids", "x")])
    # A product of the two reads, without a shuffle or a broadcast of either.
    pairs = of("left", a).hint("shuffle_replicate_nl").crossJoin(of("right", b))
    if alike:
        # Either order of two blocks by a coin, so that all tasks have some.
        i, j = F.col("left_block"), F.col("right_block")
        pairs = pairs.where((i == j) | ((i < j) == (F.xxhash64(i).bitwiseXOR(F.xxhash64(j)) % 2 == 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(batch: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(batch.column(f"{side}_ids")[i].as_py(), np.int64)
            return ids, _matrix(batch.column(f"{side}_x")[i].as_py(), len(ids), d)

        for batch in batches:
            for i in range(len(batch)):
                turned = alike and batch.column("left_block")[i] != batch.column("right_block")[i]
                yield from step(*block(batch, i, "left"), *block(batch, i, "right"), turned)

    return pairs.mapInArrow(run, schema)
