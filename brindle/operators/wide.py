"""Tables of very many features: fits whose passes sum vectors or slim blocks, so that no matrix of features by features exists."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stats

#: Features from which on "auto" goes without the Gram matrix.
WIDE = 4_000
#: Numbers in a model from which on they aren't written out in an expression, which Spark could no longer compile.
LITERALS = 2_000
#: Blocks of vectors that the search for leading directions keeps before it starts again from the best of them.
BLOCKS = 4

METHODS = ("auto", "gram", "passes")


def most_features(method: str) -> int | None:
    """How many features the Gram matrix may have: None for any number."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    return {"auto": WIDE, "gram": None, "passes": 0}[method]


def appended(df: DataFrame, name: str, kind: T.DataType, found: Callable[[np.ndarray, np.ndarray], pa.Array], given: np.ndarray, d: int) -> DataFrame:
    """``df`` with a column ``name`` of what ``found(x, given)`` gives for the features of a batch of rows.

    ``given`` is sent out once, as an array. Rows whose features are null, hold a null or
    aren't ``d`` long get a null. A column of that name is replaced.
    """
    shared, step = df.sparkSession.sparkContext.broadcast(given), max(1, stats.STEP // max(given.shape))
    fields = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    schema = T.StructType([*fields, T.StructField(name, kind)])

    def run(batches):
        for batch in batches:
            for piece in [batch.slice(at, step) for at in range(0, len(batch), step)]:
                column = piece.column("features")
                right = pc.fill_null(pc.equal(pc.list_value_length(column), d), False).to_numpy(zero_copy_only=False)
                values = column.filter(pa.array(right)).flatten()
                if values.null_count:
                    right[right] = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
                    values = column.filter(pa.array(right)).flatten()
                out = found(values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, d), shared.value)
                if not right.all():
                    out = out.take(pa.array(np.cumsum(right) - 1, mask=~right))
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in fields), out], schema.names)

    return df.mapInArrow(run, schema)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


@contextmanager
def _sent(df: DataFrame, value: np.ndarray):
    """An array as a broadcast for one pass, afterwards taken back from the executors."""
    shared = df.sparkSession.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.unpersist()


def penalised(df: DataFrame, l1: Callable[[int], float], l2: Callable[[int], float], intercept: bool, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    """Weights, intercept and number of passes for the least |y - Xw|^2 / 2n + l1 |w|_1 + l2 |w|^2 / 2, by accelerated proximal steps.

    The penalties are functions of n. For the search alone features are centred and scaled
    so that the loss with its square penalty curves alike along all of them. Each step is one pass, which sums a
    vector of the features' size: gradients of a squared loss are affine, so that at the
    extrapolated point follows from those of the last two, and the pass at a new point
    also tells whether the step was within the curvature; if not, it is taken again,
    shorter. Extrapolation starts anew where it points uphill. Constant features get no
    weight. The search ends where no feature breaks its optimality condition by more
    than ``tol`` of the steepest slope at 0, or with a warning.
    """
    y = F.col("label").cast("double")
    data = df.select(F.col("features").cast("array<double>").alias("features"), y.alias("y"))
    s = stats.describe(data.select(F.concat("features", F.array("y")).alias("features")))
    n = s["n"][0]
    both = s["mean"] if intercept else np.zeros_like(s["mean"])
    mean, y_mean = both[:-1], both[-1]
    square = s["m2"][:-1] / n + (0.0 if intercept else s["mean"][:-1] ** 2)
    varied = square > 1e-24 * np.maximum(1e-270, s["mean"][:-1] ** 2)
    inv = np.where(varied, 1 / np.sqrt(np.where(varied, square + l2(n), 1.0)), 0.0)
    limit, ridge = l1(n) * inv, l2(n) * inv * inv

    def slope(u: np.ndarray) -> np.ndarray:
        with _sent(data, u) as at:

            def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
                x = (stats.matrix(batch) - mean) * inv
                return {"g": (x @ at.value - (batch.column("y").to_numpy() - y_mean)) @ x}

            return stats.sums(data, part, ["g"])["g"] / n + ridge * u

    def broken(u: np.ndarray, g: np.ndarray) -> float:
        return float(np.max(np.where(u != 0, np.abs(g + limit * np.sign(u)), np.maximum(np.abs(g) - limit, 0.0)), initial=0.0))

    data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        last = np.zeros(len(inv))
        g_last = slope(last)
        steepest, passes = float(np.max(np.abs(g_last), initial=0.0)), 1
        if broken(last, g_last) > 0:
            along = g_last / np.linalg.norm(g_last)
            bound, passes = 1.01 * float(along @ (slope(along) - g_last)), 2
            at, g_at, t = last, g_last, 1.0
            while passes < max_iter:
                new = at - g_at / bound
                new = np.sign(new) * np.maximum(np.abs(new) - limit / bound, 0.0)
                g_new, move = slope(new), new - at
                passes += 1
                curved = float(move @ (g_new - g_at))
                if curved > bound * (move @ move) * (1 + 1e-9) + 1e-13 * steepest * np.abs(move).sum():
                    bound = max(1.5 * bound, 1.05 * curved / float(move @ move))
                    continue
                done = broken(new, g_new) <= tol * steepest
                if (at - new) @ (new - last) > 0:
                    t = 1.0
                further = (1 + np.sqrt(1 + 4 * t * t)) / 2
                on = (t - 1) / further
                at, g_at = new + on * (new - last), g_new + on * (g_new - g_last)
                last, g_last, t = new, g_new, further
                if done:
                    break
            else:
                warnings.warn(f"the search ended after {passes} passes, before it came within its tolerance", stacklevel=2)
    finally:
        data.unpersist()
    w = last * inv
    return w, float(y_mean - mean @ w), passes


def _perpendicular(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal columns for what ``block`` has beside ``basis``, without directions shorter than ``least``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block, least = u[:, s > least], 0.5
    return block


def leading(df: DataFrame, k: int, centred: bool, extra: int = 10, tol: float = 1e-9, max_passes: int = 100, seed: int = 0) -> dict[str, np.ndarray]:
    """The k leading right singular vectors of the rows, as rows of ``vectors``, with ``values``; also n, mean and m2 of the features.

    A range finder: a random block of k + ``extra`` directions is sent out, each task
    multiplies its rows by it and the result by the rows' transpose, and the sums, of the
    features by k + ``extra``, are the next block, less what the blocks before span. After
    ``BLOCKS`` of them the search starts again from the best directions found, until
    every one of the k is left in place but for ``tol`` of the largest square. A last
    pass takes the rows' images by a QR of tall blocks, whose triangles merge in a tree, and
    their singular values are those of the last triangle, without a square.
    """
    data = df.select(F.col("features").cast("array<double>").alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        s = stats.describe(data)
        d = len(s["mean"])
        if not 1 <= k <= d:
            raise ValueError("n_components must lie between 1 and the number of features")
        mean = s["mean"] if centred else np.zeros(d)
        wide = min(k + extra, d)

        def image(block: np.ndarray) -> np.ndarray:
            with _sent(data, block) as at:

                def part(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
                    x = stats.matrix(batch) - mean
                    return {"z": x.T @ (x @ at.value)}

                return stats.sums(data, part, ["z"])["z"].reshape(block.shape)

        block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
        basis, images = np.empty((d, 0)), np.empty((d, 0))
        for _ in range(max_passes):
            basis, images = np.hstack([basis, block]), np.hstack([images, image(block)])
            small = basis.T @ images
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1][:wide], turn[:, ::-1][:, :wide]
            best, moved = basis @ turn, images @ turn
            rest = moved - best * values
            top = max(float(values[0]), 0.0)
            if np.max(np.linalg.norm(rest[:, :k], axis=0)) <= tol * top:
                break
            if basis.shape[1] + wide > BLOCKS * wide:
                basis, images = best, moved
            block = _perpendicular(rest, basis, 1e-14 * top)
            if not block.shape[1]:
                break
        else:
            warnings.warn(f"the search for directions ended after {max_passes} passes, before it came within its tolerance", stacklevel=2)
        best = np.linalg.qr(best)[0]
        with _sent(data, best) as at:
            triangle = stats.reduced(
                data,
                lambda batch: {"r": np.linalg.qr((stats.matrix(batch) - mean) @ at.value, mode="r")},
                lambda a, b: {"r": np.linalg.qr(np.vstack([a["r"], b["r"]]), mode="r")},
            )["r"]
    finally:
        data.unpersist()
    _, values, turn = np.linalg.svd(triangle, full_matrices=True)
    values = np.append(values, np.zeros(max(0, k - len(values))))
    return {"vectors": (best @ turn.T).T[:k], "values": values[:k], "n": s["n"][0], "mean": s["mean"], "m2": s["m2"]}
