"""One-pass statistics: moments, extremes, quantiles, Gram matrices and other sums of numpy partials."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values in one numpy step of a task.
STEP = 1_000_000
#: How many times fewer rows of partial results each level of the tree has, and how many the driver merges at most.
FAN = 64


def matrix(batch: pa.RecordBatch, column: str = "features") -> np.ndarray:
    """An array column as a matrix, without a copy per row."""
    a = batch.column(column)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def slices(batch: pa.RecordBatch, column: str = "features") -> Iterator[pa.RecordBatch]:
    wide = max(1, len(batch.column(column).flatten()) // max(1, len(batch)))
    step = max(1, STEP // wide)
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def reduced(df: DataFrame, part: Callable[[pa.RecordBatch], dict[str, np.ndarray]], merge: Callable[[dict, dict], dict]) -> dict[str, np.ndarray] | None:
    """What ``part`` gives for the batches of ``df``, named arrays, merged pairwise; None without rows.

    Each task merges its own batches in numpy and passes on one row, its arrays as
    they are in memory. Those meet in a tree: one reducer for each ``FAN`` partitions
    that a shuffle has merges the tasks' rows, one after the other, further levels
    merge theirs, and the driver the last few, ``FAN`` at most. So what is shuffled is a row for each task, however
    many numbers it holds, and no one gathers all of them. ``merge`` must be
    associative, for what it is given comes in the order of tasks, in any grouping.
    """

    def rows(state: dict | None) -> Iterator[pa.RecordBatch]:
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in slices(batch) if "features" in batch.schema.names else [batch]:
                if len(piece):
                    own = part(piece)
                    held = own if held is None else merge(held, own)
        yield from rows(held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for x in batch.column("state"):
                own = pickle.loads(x.as_py())
                held = own if held is None else merge(held, own)
        yield from rows(held)

    level, left = df.mapInArrow(run, "state binary"), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        left = -(-left // FAN)
        level = level.withColumn("task", F.spark_partition_id()).withColumn("to", F.pmod("task", F.lit(left)))
        level = level.repartition(left, "to").sortWithinPartitions("to", "task").mapInArrow(again, "state binary")
        if left <= FAN:
            break
    level = level.withColumn("task", F.spark_partition_id())
    out = None
    for row in sorted(level.collect(), key=lambda r: r.task):
        own = pickle.loads(row.state)
        out = own if out is None else merge(out, own)
    return out


def sums(df: DataFrame, part: Callable[[pa.RecordBatch], dict[str, np.ndarray]], names: list[str]) -> dict[str, np.ndarray]:
    """The sums, over all rows of ``df``, of what ``part`` gives for a batch of them: named flat arrays, empty where none gave one."""

    def add(a: dict, b: dict) -> dict:
        return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a | b}

    found = reduced(df, lambda batch: {k: np.asarray(v, float).ravel() for k, v in part(batch).items()}, add) or {}
    return {k: found.get(k, np.empty(0)) for k in names}


def sound(bad) -> None:
    if bad:
        raise ValueError("features must be arrays of one length without nulls, NaN or infinities")


def is_sound(batch: pa.RecordBatch, d: int) -> bool:
    """Whether all features are arrays of ``d`` finite numbers."""
    column = batch.column("features")
    if column.null_count or pc.any(pc.not_equal(pc.list_value_length(column), d)).as_py():
        return False
    values = column.flatten()
    return not values.null_count and bool(np.isfinite(values.to_numpy(zero_copy_only=False)).all())


def _moments_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    column = batch.column("features")
    d = len(column[0]) if column[0].is_valid else -1
    if not is_sound(batch, d):
        return {"bad": np.ones(1)}
    x = matrix(batch)
    mean = x.mean(axis=0)
    # What rounding leaves of the deviations' sum corrects the mean and their squares.
    off = x - mean
    rest = off.sum(axis=0)
    m2 = np.einsum("ij,ij->j", off, off) - rest * rest / len(x)
    return {"n": np.array([float(len(x))]), "mean": mean, "rest": rest / len(x), "m2": m2, "low": x.min(axis=0), "high": x.max(axis=0)}


def merged_moments(a: dict, b: dict) -> dict:
    """Counts, means, sums of squared deviations and extremes of two sets of rows taken together.

    A mean is ``mean + rest``, two numbers of which the second has what the first rounds
    off, so the distance of two means is exact where they are large and close.
    """
    if "bad" in a or "bad" in b or len(a["mean"]) != len(b["mean"]):
        return {"bad": np.ones(1)}
    n = a["n"] + b["n"]
    step, share = (b["mean"] - a["mean"]) + (b["rest"] - a["rest"]), b["n"] / n
    move = a["rest"] + step * share
    mean = a["mean"] + move
    return {"n": n, "mean": mean, "rest": (a["mean"] - mean) + move, "m2": a["m2"] + b["m2"] + step * step * a["n"] * share, "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"])}


def describe(df: DataFrame) -> dict[str, np.ndarray]:
    """n, mean, m2 (sum of squared deviations), low and high of each feature, in one pass, which also checks the features."""
    found = reduced(df.select(F.col("features").cast("array<double>").alias("features")), _moments_of, merged_moments)
    if found is None:
        raise ValueError("no rows to fit")
    sound("bad" in found)
    found["mean"] = found["mean"] + found.pop("rest")
    return found


def moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and population variances."""
    s = describe(df)
    return s["mean"], np.maximum(s["m2"], 0.0) / s["n"]


def extremes(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    s = describe(df)
    return s["low"], s["high"]


#: Bins of a histogram in which ranks are looked for, and how often a bin is cut into bins again.
BINS, PASSES = 1024, 2


def quantiles(df: DataFrame, at: tuple[float, ...]) -> np.ndarray:
    """(len(at), d) exact quantiles with linear interpolation.

    Histograms narrow each wanted rank down to a millionth of its feature's range;
    the values in there are counted by Spark, and running counts of them give the
    rank. So no task holds a feature's values, however many there are.
    """
    s = describe(df)
    low, high, n = s["low"], s["high"], int(s["n"][0])
    d = len(low)
    place = [(n - 1) * q for q in at]
    ranks = sorted({int(np.floor(p)) for p in place} | {int(np.ceil(p)) for p in place})
    # Of each feature and rank: the interval it lies in, whether that has its upper end, and how many values are below.
    want = [(j, r, float(low[j]), float(high[j]), True, 0) for j in range(d) for r in ranks]

    def edges(a: float, b: float) -> np.ndarray:
        return np.unique(np.append(a + (b / BINS - a / BINS) * np.arange(BINS), b))

    for _ in range(PASSES):
        spans = sorted({(j, a, b, c) for j, _, a, b, c, _ in want if a < b})
        if not spans:
            break

        def part(batch: pa.RecordBatch, spans=spans) -> dict[str, np.ndarray]:
            x, out = matrix(batch), np.zeros((len(spans), BINS))
            for i, (j, a, b, closed) in enumerate(spans):
                v = x[:, j]
                e = edges(a, b)
                v = v[(v >= a) & ((v <= b) if closed else (v < b))]
                out[i] = np.bincount(np.minimum(np.searchsorted(e, v, "right") - 1, len(e) - 2), minlength=BINS)
            return {"n": out}

        counts = sums(df.select("features"), part, ["n"])["n"].reshape(len(spans), BINS)
        number = {s: i for i, s in enumerate(spans)}
        for k, (j, r, a, b, closed, below) in enumerate(want):
            if a < b:
                e, upto = edges(a, b), np.cumsum(counts[number[j, a, b, closed]])
                i = int(np.searchsorted(upto, r - below, "right"))
                want[k] = (j, r, float(e[i]), float(e[i + 1]), closed and i == len(e) - 2, below + int(upto[i - 1] if i else 0))
    spans = sorted({(j, a, b, c, below) for j, _, a, b, c, below in want})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                x = matrix(piece)
                for i, (j, a, b, closed, _) in enumerate(spans):
                    v = x[:, j]
                    v, c = np.unique(v[(v >= a) & ((v <= b) if closed else (v < b))], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(c)], ["span", "v", "n"])

    values = df.select("features").mapInArrow(inside, "span int, v double, n long").groupBy("span", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("v"))
    wanted = F.array(*[F.array(*[F.lit(r - below) for r in ranks]) for _, _, _, _, below in spans])
    found = values.withColumn("upto", upto).withColumn("rank", F.explode(F.get(wanted, F.col("span"))))
    found = found.where("rank >= upto - n and rank < upto").select("span", "rank", "v").collect()
    value = {(spans[r.span][0], r.rank + spans[r.span][4]): r.v for r in found}
    return np.array([[value[j, int(np.floor(p))] + (p - np.floor(p)) * (value[j, int(np.ceil(p))] - value[j, int(np.floor(p))]) for j in range(d)] for p in place])


def gram(df: DataFrame, label: bool = False, most: int | None = None) -> dict[str, np.ndarray] | None:
    """n, the sums x and products xx of all features, and with ``label`` y, yy and xy; centred on a first row against cancellation.

    Keys: n, mean (d), xx (d, d) about the mean; y_mean, yy, xy about the means.
    The pass also checks the features: ValueError as for ``width``. None, without a
    pass, if a row has more than ``most`` features.
    """
    first = df.select("features", *(["label"] if label else [])).first()
    if first is None:
        raise ValueError("no rows to fit")
    try:
        x0, y0 = np.array(first[0], float), float(first[1]) if label else 0.0
    except (TypeError, ValueError):
        sound(True)
    if x0.ndim != 1 or not np.isfinite(x0).all():
        sound(True)
    d = len(x0)
    if most is not None and d > most:
        return None
    names = ["n", "x", "xx", "y", "yy", "xy", "bad"]

    def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        if not is_sound(batch, d):
            return {"bad": np.array([1.0])}
        x = matrix(batch) - x0
        out = {"n": np.array([len(x)]), "x": x.sum(axis=0), "xx": x.T @ x}
        if label:
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float) - y0
            out |= {"y": np.array([y.sum()]), "yy": np.array([y @ y]), "xy": x.T @ y}
        return out

    cols = [F.col("features"), *([F.col("label").cast("double").alias("label")] if label else [])]
    s = sums(df.select(*cols), part, names)
    sound(len(s["bad"]))
    n = s["n"][0]
    xm = s["x"] / n
    out = {"n": n, "mean": xm + x0, "xx": s["xx"].reshape(d, d) - n * np.outer(xm, xm)}
    if label:
        ym = s["y"][0] / n
        out |= {"y_mean": ym + y0, "yy": s["yy"][0] - n * ym * ym, "xy": s["xy"] - n * xm * ym}
    return out
