"""Exact search among vectors by a metric partition: pivots, radii and the triangle inequality.

Data and queries are dealt to the nearest of some pivots, sorted by cell and by their
distance from the pivot there, and packed in blocks. A block is a ring of a cell. A
row x at distance r from a pivot p is at least |d(q, p) - r| from a query q, so a
query with a known reach needs only the rings that its own interval around d(q, p)
meets, and of those only the rows whose r lies in it.

``nearest`` takes the reach from a first search of each query block in the one data
block nearest it, or from the cells' counts and radii where that block has fewer
than k rows. The pairs of blocks that are left are brought together by a shuffle; what
is moved is in proportion to them. Between blocks that no bound can tell apart, as in
many dimensions without clusters, all pairs are left.

Pairs that are left are screened in single precision, Euclidean and cosine ones by
matrix products, Manhattan ones first by codes of a byte for each coordinate, with a bound on what rounding takes; those that the screen can't rule
out get their distances in double precision, so the result is that of all distances.

Pivots come from a bounded sample; they shape the work, not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import stats
from .shared import stage

#: Numbers (rows times features) in a block of queries, at most, and of data; pivots at most; data blocks that a task brings to one query block at most.
LEFT, RIGHT, PIVOTS, SHARE = 2_000_000, 250_000, 1024, 256
#: Sampled rows for each pivot, and numbers in the sample at most.
SAMPLE, NUMBERS = 16, 4_000_000
#: Numbers that numpy goes over at once, so that they stay in a core's cache; queries and rows of a screened tile.
STEP, TILE = 32_768, 512
#: The greatest code of a coordinate: four of them fit in a byte.
CODE = 63
#: Edges that a task holds before it draws them together; all pairs of blocks over those that bounds leave, from which on only those are brought together.
EDGES, SPARSE = 1_000_000, 4


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """(len(a), len(b)). Euclidean ones come from differences, not from products, so equal rows are at 0."""
    if metric == "cosine":
        return 1.0 - (a @ b.T) / np.sqrt(np.outer((a * a).sum(axis=1), (b * b).sum(axis=1)))
    out = np.zeros((len(a), len(b)))
    wide = min(len(b), STEP)
    a, b = np.asarray(a, float), np.ascontiguousarray(np.asarray(b, float).T)
    d = np.empty((max(1, STEP // max(1, wide)), wide))
    for at in range(0, len(a), len(d)):
        for begin in range(0, b.shape[1], wide):
            part = out[at : at + len(d), begin : begin + wide]
            own = d[: part.shape[0], : part.shape[1]]
            for j in range(a.shape[1]):
                np.subtract(a[at : at + len(d), j, None], b[None, j, begin : begin + wide], out=own)
                part += np.abs(own, out=own) if metric == "manhattan" else np.multiply(own, own, out=own)
    return np.sqrt(out, out=out) if metric == "euclidean" else out


def _between(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of ``a`` from that of ``b``, summed in the order of ``distances``."""
    if metric == "cosine":
        # Sums in one order, so that equal rows are at equal distances wherever they are met.
        dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
        for j in range(a.shape[1]):
            u, v = a[:, j], b[:, j]
            dot, aa, bb = dot + u * v, aa + u * u, bb + v * v
        return 1.0 - dot / np.sqrt(aa * bb)
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        out += np.abs(d) if metric == "manhattan" else d * d
    return np.sqrt(out) if metric == "euclidean" else out


class Screen:
    """Queries, and which rows lie within a distance of each.

    Most pairs are told to be further apart in single precision, from coordinates
    around the queries' mean: a pair's score is how far it lies inside the distance,
    up to ``error``, a bound on what rounding does to it. The others are measured.
    """

    def __init__(self, x: np.ndarray, metric: str):
        self.x, self.metric = x, metric
        self.middle = np.zeros(x.shape[1]) if metric == "cosine" or not len(x) else x.mean(axis=0)
        own = self._moved(x)
        self.norms = (own * own).sum(axis=1)
        self.sides = self._size(own)
        self.own = own.astype(np.float32)
        half = min(float(np.abs(own).max(initial=0.0)), 3.5 * float(np.sqrt(np.mean(own * own)))) if own.size and metric == "manhattan" else 0.0
        #: The range of the codes around the middle, and what a code is worth; no codes without a range.
        self.half, self.unit = (half, 2 * half / CODE) if 1e-150 < half < 1e150 else (0.0, 0.0)
        if self.unit:
            self.codes, self.code_sums, self.rests = self._coded(own)

    def _coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Moved coordinates as codes (features, rows), each row's sum of codes, and how far it lies from them, not counting what is beyond the range."""
        inside = np.clip(x, -self.half, self.half)
        codes = np.rint((inside + self.half) / self.unit)
        rests = np.abs(inside + self.half - codes * self.unit).sum(axis=1)
        return np.ascontiguousarray(codes.T.astype(np.uint8)), codes.sum(axis=1), rests

    def _apart(self, rows: np.ndarray, v: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """Which Manhattan distances may be at ``worst`` or less, by codes of a byte.

        Coordinates drawn into a range are no further apart than they were, and codes tell how far
        apart those are up to both rows' rests. Of two codes the difference is twice the greater less
        both, so only greater ones are summed: four fit in a byte.
        """
        codes, sums, rests = self._coded(v)
        own, d = self.codes[:, rows], len(self.codes)
        size = float(self.sides[rows].max()) + float(self._size(v).max()) + float(worst.max())
        slack = 1e-15 * (d + 16) * (float(np.abs(self.x[rows]).sum(axis=1).max()) + size + d * self.half)
        # Half codes; the last term is what single precision may take.
        most = ((worst + self.rests[rows] + slack) / self.unit + self.code_sums[rows]) / 2 + 0.01 + 2e-6 * CODE * d
        less = ((rests / self.unit + sums) / 2).astype(np.float32)
        out = np.empty((len(rows), len(v)), bool)
        step = max(1, 2 * STEP // len(v))
        four, one = (np.empty((step, len(v)), np.uint8) for _ in range(2))
        for at in range(0, len(rows), step):
            stop = min(len(rows), at + step)
            a, b = four[: stop - at], one[: stop - at]
            upto = np.zeros(a.shape, np.uint16 if CODE * d < 1 << 16 else np.int64)
            for j in range(0, d, 4):
                np.maximum(own[j, at:stop, None], codes[None, j], out=a)
                for k in range(j + 1, min(d, j + 4)):
                    np.add(a, np.maximum(own[k, at:stop, None], codes[None, k], out=b), out=a)
                np.add(upto, a, out=upto)
            out[at:stop] = upto - less <= most[at:stop, None].astype(np.float32)
        return out

    def _moved(self, x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if self.metric == "cosine" else x - self.middle

    def _size(self, x: np.ndarray) -> np.ndarray:
        return np.abs(x).sum(axis=1) if self.metric == "manhattan" else np.sqrt((x * x).sum(axis=1))

    def _scores(self, rows: np.ndarray, v: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, float]:
        d = v.shape[1]
        size, other = float(self.sides[rows].max()), float(self._size(v).max())
        if self.metric == "manhattan":
            t, whole = worst, size + other
            whole += float(t.max())
        elif self.metric == "cosine":
            t = 1.0 - worst
            whole = 1.0 + float(np.abs(t).max())
        else:
            t = (self.norms[rows] - (worst * worst if self.metric == "euclidean" else worst)) / 2
            whole = size * other + other * other / 2 + float(np.abs(t).max())
        # Of single precision, of numbers too small for it, and of moving the coordinates.
        raw = float(np.abs(self.x[rows]).sum(axis=1).max()) + size + other
        error = (d + 16) * 2.0**-23 * whole + 1e-38 + 1e-15 * d * raw * (1.0 if self.metric == "manhattan" else size + other + 1.0)
        if not max(whole, error, size * size) < 1e30:
            return np.full((len(rows), len(v)), np.inf, np.float32), np.inf
        if self.metric != "manhattan":
            ones = np.ones((len(rows), 1), np.float32)
            half = np.zeros((len(v), 1)) if self.metric == "cosine" else -(v * v).sum(axis=1, keepdims=True) / 2
            left = np.hstack([self.own[rows], ones, t[:, None].astype(np.float32)])
            right = np.hstack([v, half, np.full((len(v), 1), -1.0)]).astype(np.float32)
            return left @ right.T, error
        out = np.empty((len(rows), len(v)), np.float32)
        a, b = np.ascontiguousarray(self.own[rows].T), np.ascontiguousarray(v.astype(np.float32).T)
        step = max(1, STEP // len(v))
        gap = np.empty((step, len(v)), np.float32)
        for at in range(0, len(rows), step):
            part = out[at : at + step]
            part[:] = t[at : at + step, None]
            own = gap[: len(part)]
            for j in range(d):
                np.subtract(a[j, at : at + step, None], b[None, j], out=own)
                part -= np.abs(own, out=own)
        return out, error

    def close(self, rows: np.ndarray, y: np.ndarray, worst: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) for all of ``rows[i]`` and ``y[j]`` at ``worst[i]`` or less; where that is infinite, for the ``k`` nearest and more."""
        known = np.isfinite(worst)
        if self.unit and len(rows) and len(y) and known.all() and max(float(np.abs(y).max()), float(np.abs(worst).max())) < 1e150:
            mask = self._apart(rows, self._moved(y), worst)
            # Where codes leave many pairs, single precision is cheaper than measuring them.
            if 16 * np.count_nonzero(mask) <= mask.size:
                return self._measured(rows, y, worst, mask)
        score, error = self._scores(rows, self._moved(y), np.where(known, worst, 0.0))
        mask = score >= np.float32(-error * 1.001)
        if not known.all():
            if k < len(y) and np.isfinite(error):
                own = score[~known]
                kth = np.partition(own, len(y) - k, axis=1)[:, len(y) - k, None]
                mask[~known] = own >= kth - np.float32(2.001 * error)
            else:
                mask[~known] = True
        return self._measured(rows, y, worst, mask)

    def _measured(self, rows: np.ndarray, y: np.ndarray, worst: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(mask)
        i, j = np.divmod(at, len(y))
        if 4 * len(at) > mask.size and self.metric != "cosine":
            dist = distances(self.x[rows], y, self.metric).ravel()[at]
        else:
            most = max(1, 8 * STEP // max(1, y.shape[1]))
            parts = [_between(self.x[rows[i[s : s + most]]], y[j[s : s + most]], self.metric) for s in range(0, len(at), most)]
            dist = np.concatenate(parts) if parts else np.empty(0)
        with np.errstate(invalid="ignore"):
            ok = dist <= worst[i]
        return i[ok], j[ok], dist[ok]


class Space:
    """Pivots, and distances from them in the metric by which ``metric`` can be bounded: cosine ones by those of unit vectors."""

    def __init__(self, pivots: np.ndarray, metric: str):
        self.metric = metric
        self.pivots = self._unit(pivots)
        scale = float(np.abs(self.pivots).max(initial=0.0)) * pivots.shape[1] + 1.0
        #: What rounding may take from a distance.
        self.slack = (1e-6 if metric == "cosine" else 1e-9) * scale

    def _unit(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(n > 0, n, 1.0)

    def away(self, x: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
        """Distances of rows from all pivots, or from those of ``cells``."""
        p = self.pivots if cells is None else self.pivots[cells]
        return distances(self._unit(x), p, "manhattan" if self.metric == "manhattan" else "euclidean")

    def reach(self, worst: np.ndarray) -> np.ndarray:
        """How far in this space rows may be whose distance is at most ``worst``."""
        with np.errstate(invalid="ignore"):
            far = {"sqeuclidean": np.sqrt, "cosine": lambda w: np.sqrt(2 * np.maximum(w, 0.0))}.get(self.metric, lambda w: w)(worst)
        return far * (1 + 1e-9) + self.slack

    def worst(self, reach: np.ndarray) -> np.ndarray:
        """The distance of a row at ``reach`` in this space."""
        return {"sqeuclidean": reach * reach, "cosine": reach * reach / 2}.get(self.metric, reach)


def space(df: DataFrame, d: int, metric: str, rows: int) -> Space:
    """Pivots for ``rows`` rows: about two for each block of them, far from each other within a sample by hash."""
    many = int(min(PIVOTS, max(1, 2 * -(-rows * max(1, d) // RIGHT)), max(1, NUMBERS // max(1, d))))
    most = max(many, min(SAMPLE * many, NUMBERS // max(1, d)))
    # Equal rows have equal hashes, so repeats stand together and are told apart below.
    found = df.select("features", F.xxhash64("features").alias("h")).orderBy("h").limit(most).select("features").collect()
    x = np.unique(np.array([r.features for r in found], float).reshape(len(found), -1), axis=0)
    own = Space(x, metric)
    picked, near = [0], own.away(x, np.array([0]))[:, 0]
    while len(picked) < many and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, own.away(x, np.array(picked[-1:]))[:, 0])
    return Space(x[picked], metric)


def _bytes(x: np.ndarray) -> bytes:
    """In single precision where that loses nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        short = x.astype(np.float32)
    return (short if np.array_equal(short, x) else x).tobytes()


def _matrix(x: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(x, np.float32 if len(x) == 4 * n * d else np.float64).reshape(n, d).astype(float)


RING = "cell int, size long, low double, high double, ids binary, x binary, r binary"


def pack(df: DataFrame, d: int, at: Space, numbers: int, name: str, files: int | None = None) -> DataFrame:
    """block, cell, size, low, high, ids, x, r: rows (id, features) in blocks, each a ring of a cell in order of distance r from its pivot. ``files``: in so many."""
    most = max(1, numbers // max(1, d))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in stats.slices(batch):
                x = stats.matrix(part).astype(float) if len(part) else np.empty((0, d))
                if at.metric == "cosine" and len(x) and not (some := x.any(axis=1)).all():
                    # Zero vectors are at no distance from anything.
                    x, part = x[some], part.filter(pa.array(some))
                if len(part):
                    away = at.away(x)
                    cell = away.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("features"), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(x)), cell])], ["id", "features", "cell", "r"])

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, last = 0, None

        def out() -> pa.RecordBatch:
            ids, x, r = (np.concatenate(c) for c in zip(*held, strict=True))
            values = [last, len(ids), r[0], r[-1], ids.tobytes(), _bytes(x), r.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], [c.split()[0] for c in RING.split(", ")])

        for batch in batches:
            cell = batch.column("cell").to_numpy()
            begin = 0
            while begin < len(batch):
                if held and (n == most or cell[begin] != last):
                    yield out()
                    held, n = [], 0
                last = int(cell[begin])
                stop = min(begin + most - n, begin + int(np.searchsorted(cell[begin:], last, "right")))
                part = batch.slice(begin, stop - begin)
                held.append((part.column("id").to_numpy(), stats.matrix(part).astype(float), part.column("r").to_numpy()))
                n, begin = n + len(part), stop
        if held:
            yield out()

    rows = df.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    dealt = rows.mapInArrow(deal, "id long, features array<double>, cell int, r double").repartitionByRange(*([files] if files else []), "cell", "r", "id").sortWithinPartitions("cell", "r", "id")
    return stage(dealt.mapInArrow(rings, RING).withColumn("block", F.monotonically_increasing_id()), name)


def _arrays(ids: bytes, x: bytes, r: bytes, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, _matrix(x, len(ids), d), np.frombuffer(r)


def _intervals(away: np.ndarray, reach: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that some query reaches, and from which distance to which of their pivots the queries' intervals go."""
    open_ = away - reach[:, None] <= radii
    cells = np.flatnonzero(open_.any(axis=0))
    low = np.where(open_, away - reach[:, None], np.inf).min(axis=0)
    high = np.where(open_, away + reach[:, None], -np.inf).max(axis=0)
    return cells.astype(np.int32), low[cells], high[cells]


def _radii(data: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The radius and the number of rows of each cell; a row for each pivot at most reaches the driver."""
    radii, counts = np.full(cells, -np.inf), np.zeros(cells, np.int64)
    for r in data.groupBy("cell").agg(F.max("high").alias("high"), F.sum("size").alias("n")).collect():
        radii[r.cell], counts[r.cell] = r.high, r.n
    return radii, counts


def _by_counts(away: np.ndarray, radii: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each query a distance within which k rows lie: all of the cells with the least furthest rows; infinite with fewer rows."""
    far = away + radii
    order = np.argsort(far, axis=1)
    enough = np.cumsum(counts[order], axis=1) >= k
    at = enough.argmax(axis=1)
    found = np.take_along_axis(far, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
    return np.where(enough.any(axis=1), found, np.inf)


def surviving(reached: DataFrame, data: DataFrame) -> DataFrame:
    """left, block for each of ``reached`` (left, cell, low, high) and each ring of that cell it meets."""
    rings = data.select("block", "cell", F.col("low").alias("from"), F.col("high").alias("to"))
    return reached.join(rings, "cell").where((F.col("to") >= F.col("low")) & (F.col("from") <= F.col("high"))).select("left", "block")


def _tasks(pieces: int) -> int:
    """As many that few of them get several pieces by chance."""
    return max(1, min(2 * pieces, 4096))


def _left(rows: int, d: int, spark: SparkSession) -> int:
    """Numbers in a block of queries: so many blocks that all cores have some, for what is found in each share of the data is merged."""
    return int(max(RIGHT // 4, min(LEFT, -(-rows * max(1, d) // (4 * spark.sparkContext.defaultParallelism)))))


def _groups(queries: DataFrame, d: int, cores: int) -> DataFrame:
    """left, group: blocks of queries side by side, of ``LEFT`` numbers or one for each core, that a data block is sent to once."""
    sized = stage(queries.select("left", (F.octet_length("ids") / 8 * max(1, d)).alias("numbers")), "group-sizes")
    most = max(1.0, min(LEFT, (sized.agg(F.sum("numbers")).first()[0] or 0) / cores))
    # The window sees one short row for each block.
    before = F.sum("numbers").over(Window.orderBy("left").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("numbers")
    return stage(sized.select("left", F.floor(before / most).cast("long").alias("group")), "groups")


def together(queries: DataFrame, data: DataFrame, pairs: DataFrame, d: int, start: Callable, step: Callable, finish: Callable | None, schema: str) -> DataFrame:
    """What comes of each pair of blocks: a data block goes once to each group of query blocks, which goes once to each of its shares of up to ``SHARE`` data blocks or so.

    A cell's queries may be few, so without groups a data block would be sent as often as there are cells.
    Shares are smaller where all cores would not have some; each lies in a task with few others.

    ``queries`` has left, ids and columns that ``start(row, first)`` makes a state of,
    ``first`` telling one of its shares; ``step(state, cell, ids, x, r)`` yields batches.
    Query blocks without a pair take part, too.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups = _groups(queries, d, cores)
    pairs = stage(pairs.join(groups, "left").groupBy("group", "block").agg(F.collect_set("left").alias("lefts")), "pairs-left")
    share = max(1, min(SHARE, -(-pairs.count() // (4 * cores))))
    sized = pairs.join(pairs.groupBy("group").agg(F.ceil(F.count("*") / share).alias("shares")), "group")
    dealt = sized.select("group", "block", "lefts", F.pmod(F.xxhash64("block"), F.col("shares")).alias("share"))
    dealt = stage(dealt, "block-pairs")
    places = stage(dealt.select("group", "share").unionAll(groups.select("group", F.lit(0).cast("long").alias("share"))).distinct(), "shares")
    own = [c for c in queries.columns if c != "left"]
    none = F.lit(None).cast("struct<block:long,cell:int,ids:binary,x:binary,r:binary>")
    a = queries.select("left", F.struct(*own).alias("query")).join(groups, "left").join(places, "group").select("group", "share", F.array("left").alias("lefts"), "query", none.alias("ring"))
    b = data.select("block", F.struct("block", "cell", "ids", "x", "r").alias("ring")).join(dealt, "block")
    both = a.unionAll(b.select("group", "share", "lefts", F.lit(None).cast(a.schema["query"].dataType).alias("query"), "ring"))
    order = both.repartition(_tasks(places.count()), "group", "share").sortWithinPartitions("group", "share", F.col("ring.block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        last = None

        def end() -> Iterator[pa.RecordBatch]:
            for state in states.values() if finish else ():
                yield from finish(state)
            states.clear()

        for batch in batches:
            for i in range(len(batch)):
                here = batch.column("group")[i].as_py(), batch.column("share")[i].as_py()
                if here != last:
                    yield from end()
                    last = here
                lefts, ring = batch.column("lefts")[i].as_py(), batch.column("ring")[i].as_py()
                if ring is None:
                    states[lefts[0]] = start(batch.column("query")[i].as_py(), here[1] == 0)
                else:
                    parts = _arrays(ring["ids"], ring["x"], ring["r"], d)
                    for left in lefts:
                        yield from step(states[left], ring["cell"], *parts)
        yield from end()

    return order.mapInArrow(run, schema)


class _Best:
    """The k nearest so far of each query of a block."""

    def __init__(self, at: Space, k: int, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, best: tuple[np.ndarray, np.ndarray] | None):
        self.at, self.k, self.ids, self.x, self.floor = at, k, ids, x, floor
        none = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.d, self.i = best or none
        self.screen = Screen(x, at.metric)

    @property
    def worst(self) -> np.ndarray:
        return np.minimum(self.floor, self.d[:, -1])

    def meet(self, cell: int, own: np.ndarray, y: np.ndarray, r: np.ndarray) -> None:
        away = self.at.away(self.x, np.array([cell]))[:, 0]
        reach = self.at.reach(self.worst)
        # Queries that reach the ring, and the rows of it that any of them reaches.
        rows = np.flatnonzero((away - reach <= r[-1]) & (away + reach >= r[0]))
        if len(rows):
            a, b = np.searchsorted(r, (away - reach)[rows].min()), np.searchsorted(r, (away + reach)[rows].max(), "right")
            for begin in range(a, b, TILE):
                stop = min(b, begin + TILE)
                for at in range(0, len(rows), TILE):
                    self._add(rows[at : at + TILE], own[begin:stop], y[begin:stop])

    def _add(self, rows: np.ndarray, own: np.ndarray, y: np.ndarray) -> None:
        i, j, found = self.screen.close(rows, y, np.minimum(self.floor[rows], self.d[rows, -1]), self.k)
        if not len(i):
            return
        some, i = np.unique(i, return_inverse=True)
        some = rows[some]
        row = np.concatenate([np.repeat(np.arange(len(some)), self.k), i])
        dist, who = np.concatenate([self.d[some].ravel(), found]), np.concatenate([self.i[some].ravel(), own[j]])
        by = np.lexsort((who, dist, row))
        pick = by[np.searchsorted(row[by], np.arange(len(some)))[:, None] + np.arange(self.k)]
        self.d[some], self.i[some] = dist[pick], who[pick]


def nearest(train: DataFrame, queries: DataFrame, d: int, k: int, metric: str) -> DataFrame:
    """query_id, neighbor_id, distance: a few rows for each query among which its k nearest of ``train`` are (both id, features)."""
    at = space(train, d, metric, train.count())
    data, left = pack(train, d, at, RIGHT, "rings"), pack(queries, d, at, _left(queries.count(), d, queries.sparkSession), "queries").withColumnRenamed("block", "left")
    radii, counts = _radii(data, len(at.pivots))
    names = ["left", "ids", "x", "floor", "best_d", "best_i", "cells", "lows", "highs"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x, _ = _arrays(row["ids"], row["x"], row["r"], d)
                best = _Best(at, k, ids, x, np.full(len(ids), np.inf), None)
                if row["ring"] is not None:
                    best.meet(row["ring"]["cell"], *_arrays(row["ring"]["ids"], row["ring"]["x"], row["ring"]["r"], d))
                away, worst = at.away(x), best.worst
                if (unknown := np.isinf(worst)).any():
                    worst[unknown] = at.worst(_by_counts(away[unknown], radii, counts, k) * (1 + 1e-9) + at.slack)
                reached = _intervals(away, at.reach(worst), radii)
                values = [row["left"], row["ids"], row["x"], worst.tobytes(), best.d.tobytes(), best.i.tobytes(), *reached]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    # The ring of its own cell that lies nearest: one data block for each query block.
    gap = F.greatest(F.lit(0.0), F.col("from") - F.col("high"), F.col("low") - F.col("to"))
    rings = data.select("block", "cell", F.col("low").alias("from"), F.col("high").alias("to"))
    home = left.select("left", "cell", "low", "high").join(rings, "cell").groupBy("left").agg(F.min(F.struct(gap.alias("gap"), "block")).alias("home")).select("left", F.col("home.block").alias("block"))
    home = stage(home, "homes")
    ring = data.select("block", F.struct("block", "cell", "ids", "x", "r").alias("ring"))
    begun = left.select("left", "ids", "x", "r").join(home.join(ring, "block"), "left", "left").select("left", "ids", "x", "r", "ring")
    schema = "left long, ids binary, x binary, floor binary, best_d binary, best_i binary, cells array<int>, lows array<double>, highs array<double>"
    begun = stage(begun.repartition(_tasks(left.count()), "left").mapInArrow(first, schema), "first-search")
    reached = begun.select("left", F.inline(F.arrays_zip(F.col("cells").alias("cell"), F.col("lows").alias("low"), F.col("highs").alias("high"))))
    pairs = surviving(reached, data).join(home, ["left", "block"], "left_anti")

    def start(row: dict, is_first: bool) -> _Best:
        ids = np.frombuffer(row["ids"], np.int64)
        best = tuple(np.frombuffer(row[c], t).reshape(len(ids), k).copy() for c, t in (("best_d", float), ("best_i", np.int64))) if is_first else None
        return _Best(at, k, ids, _matrix(row["x"], len(ids), d), np.frombuffer(row["floor"]), best)

    def step(best: _Best, cell: int, ids: np.ndarray, x: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        best.meet(cell, ids, x, r)
        yield from ()

    def finish(best: _Best) -> Iterator[pa.RecordBatch]:
        ok = np.isfinite(best.d)
        yield pa.RecordBatch.from_arrays([pa.array(best.ids[np.nonzero(ok)[0]]), pa.array(best.i[ok]), pa.array(best.d[ok])], ["query_id", "neighbor_id", "distance"])

    return together(begun.drop("cells", "lows", "highs"), data, pairs, d, start, step, finish, "query_id long, neighbor_id long, distance double")


def within(left: DataFrame, right: DataFrame, d: int, radius: float, metric: str) -> DataFrame:
    """left_id, right_id, distance for all pairs at ``radius`` or less."""
    at = space(right, d, metric, right.count())
    data, own = pack(right, d, at, RIGHT, "rings"), pack(left, d, at, _left(left.count(), d, left.sparkSession), "queries").withColumnRenamed("block", "left")
    radii, _ = _radii(data, len(at.pivots))
    reach = float(at.reach(np.array([float(radius)]))[0])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x, _ = _arrays(row["ids"], row["x"], row["ids"], d)
                cells, low, high = _intervals(at.away(x), np.full(len(ids), reach), radii)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), row["left"])), pa.array(cells), pa.array(low), pa.array(high)], ["left", "cell", "low", "high"])

    pairs = surviving(own.select("left", "ids", "x").mapInArrow(reached, "left long, cell int, low double, high double"), data)

    def start(row: dict, is_first: bool) -> tuple[np.ndarray, Screen]:
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, Screen(_matrix(row["x"], len(ids), d), metric)

    def step(state, cell: int, ids: np.ndarray, y: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        own_ids, screen = state
        away = at.away(screen.x, np.array([cell]))[:, 0]
        rows = np.flatnonzero((away - reach <= r[-1]) & (away + reach >= r[0]))
        for begin in range(0, len(ids), TILE):
            for first in range(0, len(rows), TILE):
                own = rows[first : first + TILE]
                i, j, dist = screen.close(own, y[begin : begin + TILE], np.full(len(own), float(radius)))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(own_ids[own[i]]), pa.array(ids[begin + j]), pa.array(dist)], ["left_id", "right_id", "distance"])

    return together(own.select("left", "ids", "x"), data, pairs, d, start, step, None, "left_id long, right_id long, distance double")


class Counts:
    """id, n: how many rows are near each query."""

    schema = "id long, n long"

    def __init__(self):
        self.ids = self.n = np.empty(0, np.int64)

    def begin(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from self.end()
        self.ids, self.n = ids, np.zeros(len(ids), np.int64)

    def add(self, i: np.ndarray, others: np.ndarray) -> None:
        self.n += np.bincount(i, minlength=len(self.n))

    def end(self) -> Iterator[pa.RecordBatch]:
        some = self.n > 0
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.n[some])], ["id", "n"])


class Least:
    """id, least: the smallest id near each query that has any."""

    schema = "id long, least long"

    def __init__(self):
        self.ids = self.least = np.empty(0, np.int64)

    def begin(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from self.end()
        self.ids, self.least = ids, np.full(len(ids), np.iinfo(np.int64).max)

    def add(self, i: np.ndarray, others: np.ndarray) -> None:
        np.minimum.at(self.least, i, others)

    def end(self) -> Iterator[pa.RecordBatch]:
        some = self.least < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.least[some])], ["id", "least"])


class Stars:
    """u, v: what is near each other, as an edge from each id to the smallest it reaches by the pairs of a task."""

    schema = "u long, v long"

    def __init__(self):
        self.ids, self.held, self.size = np.empty(0, np.int64), [], 0

    def begin(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.ids = ids
        yield from ()

    def add(self, i: np.ndarray, others: np.ndarray) -> None:
        u = self.ids[i]
        some = u != others
        self.held.append(np.stack([u[some], others[some]]))
        self.size += self.held[-1].shape[1]
        if self.size > EDGES:
            self.held = [stars(*np.concatenate(self.held, axis=1))]
            self.size = 0

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            u, v = stars(*np.concatenate(self.held, axis=1))
            self.held = []
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def stars(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Edges from each end of the edges (u, v) to the smallest it reaches, but for that itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[root[moved]]])


def gather(left: DataFrame, right: DataFrame, d: int, radius: float, metric: str, kind: type) -> DataFrame:
    """What a collector (``Counts``, ``Least``, ``Stars``) makes of all pairs at ``radius`` or less, without a list of them; both have id and features.

    Where bounds leave out few pairs of blocks, tasks read a part of either side and go over
    the product; nothing is shuffled then. Else the pairs that are left are brought together.
    """
    spark = right.sparkSession
    rows = right.count()
    at = space(right, d, metric, rows)
    files = lambda n: max(1, min(2 * spark.sparkContext.defaultParallelism, -(-n * max(1, d) // RIGHT)))
    data = pack(right, d, at, RIGHT, "rings", files(rows))
    own = (data if left is right else pack(left, d, at, RIGHT, "queries", files(left.count()))).withColumnRenamed("block", "left").select("left", "ids", "x")
    radii, _ = _radii(data, len(at.pivots))
    reach = float(at.reach(np.array([float(radius)]))[0])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, x, _ = _arrays(row["ids"], row["x"], row["ids"], d)
                cells, low, high = _intervals(at.away(x), np.full(len(ids), reach), radii)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), row["left"])), pa.array(cells), pa.array(low), pa.array(high)], ["left", "cell", "low", "high"])

    def start(row: dict) -> tuple:
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, Screen(_matrix(row["x"], len(ids), d), metric)

    def meet(screen: Screen, cell: int, ids: np.ndarray, y: np.ndarray, r: np.ndarray, into) -> None:
        away = at.away(screen.x, np.array([cell]))[:, 0]
        rows = np.flatnonzero((away - reach <= r[-1]) & (away + reach >= r[0]))
        for begin in range(0, len(ids), TILE):
            for first in range(0, len(rows), TILE):
                own = rows[first : first + TILE]
                i, j, _ = screen.close(own, y[begin : begin + TILE], np.full(len(own), float(radius)))
                if len(i):
                    into.add(own[i], ids[begin + j])

    pairs = stage(surviving(own.mapInArrow(reached, "left long, cell int, low double, high double"), data), "near-blocks")
    if SPARSE * pairs.count() < own.count() * data.count():

        def first(row: dict, _) -> tuple:
            ids, screen = start(row)
            into = kind()
            # Nothing is held yet, so a collector has nothing to put out.
            list(into.begin(ids))
            return screen, into

        def step(state: tuple, cell: int, ids: np.ndarray, y: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
            meet(state[0], cell, ids, y, r, state[1])
            yield from ()

        return together(own, data, pairs, d, first, step, lambda state: state[1].end(), kind.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, last, screen = kind(), None, None
        for batch in batches:
            for i in range(len(batch)):
                here = batch.column("left")[i].as_py()
                if here != last:
                    ids, screen = start({c: batch.column(f"own_{c}")[i].as_py() for c in ("ids", "x")})
                    yield from into.begin(ids)
                    last = here
                meet(screen, batch.column("cell")[i].as_py(), *_arrays(*(batch.column(c)[i].as_py() for c in ("ids", "x", "r")), d), into)
        yield from into.end()

    queries = own.select("left", F.col("ids").alias("own_ids"), F.col("x").alias("own_x"))
    return queries.hint("shuffle_replicate_nl").crossJoin(data.select("cell", "ids", "x", "r")).mapInArrow(run, kind.schema)
