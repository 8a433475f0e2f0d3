"""Exact top-k by inner product with a dual-tree search over cover trees.

The rows are dealt to cells around pivots, sorted by cell and distance from its
pivot, and indexed in blocks of ``BLOCK`` neighbours, each a cover tree: a node's
children have centres picked farthest first, its own centre among them, until
half its radius covers all its points or there are ``FANOUT`` of them. So centres
are further apart than the radius they cover, and every node of more than ``LEAF``
points is split. Queries are put into trees in the same way.

A query node and a data node are compared once for all their points: no inner
product between them exceeds ``<c,d> + r|d| + s|c| + rs`` (centres c, d, radii
r, s). If that is below the worst k-th score in the query node, the pair of
nodes is done. Otherwise the wider node is opened, most promising child first;
two leaves are multiplied with numpy, and so are two nodes of at most ``WHOLE``
pairs of points if none of their pairs of leaves can be left out.

The same bound is first taken between whole blocks. Every query block is searched
together with its most promising data block; then, with the worst k-th scores that
gives, only those pairs of blocks are brought together that can still matter. A
wave of query blocks and the data blocks it is to meet are rows of one table,
sorted so that each task reads the queries, then data blocks by falling bound; the
tasks' results are merged by a window. Nothing goes through the driver but a
bounded sample for the pivots and the numbers of blocks and waves.

Inner products are sums of doubles while they are exact; from the first vector on
that makes them too large for that, a query block goes on in whole numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import common

BLOCK, LEAF, FANOUT = 1024, 64, 8
#: Pairs of points that are multiplied in one step at most: 8 MB.
WHOLE = BLOCK * BLOCK
#: Query blocks in a wave: 32,768 queries, 16 MB at 64 dimensions, which a task holds.
WAVE = 32
#: Rows of a sample from which pivots are picked, and pivots. They only shape the blocks.
SAMPLE, PIVOTS = 2048, 256
#: Rows that a task searches at least, if there are so many.
SHARE = 8 * BLOCK
TREE = ("center", "first", "last", "child", "children")
SCHEMA = "dim int, ids array<long>, vectors binary, " + ", ".join(f"{c} array<int>" for c in TREE) + ", radius array<double>, middle array<double>, reach double"
LONG = 2**63 - 1


class CoverTree:
    """Nodes in arrays; node i holds points first[i] to last[i] of the reordered ``vectors``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: dict[str, np.ndarray]):
        self.ids, self.vectors, self.nodes = ids, vectors, nodes
        self.radius, self.child, self.children = nodes["radius"], nodes["child"], nodes["children"]
        self.first, self.last = nodes["first"], nodes["last"]
        self.centers = vectors[nodes["center"]]
        leaves = np.flatnonzero(self.children == 0)
        self.leaves = leaves[np.argsort(self.first[leaves], kind="stable")]
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.centers**2).sum(axis=1))
            self.largest = float(np.sqrt((vectors**2).sum(axis=1).max(initial=0.0)))

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> CoverTree:
        order = np.arange(len(ids))
        out: dict[str, list] = {c: [] for c in (*TREE, "radius")}

        def distances(points: np.ndarray, center: int) -> np.ndarray:
            with np.errstate(over="ignore"):
                return np.sqrt(((vectors[points] - vectors[center]) ** 2).sum(axis=1))

        def add(center: int, first: int, last: int) -> int:
            far = distances(order[first:last], center).max()
            for c, x in zip((*TREE, "radius"), (center, first, last, 0, 0, float(far)), strict=True):
                out[c].append(x)
            return len(out["radius"]) - 1

        todo = [add(0, 0, len(ids))]
        while todo:
            i = todo.pop()
            first, last, radius = out["first"][i], out["last"][i], out["radius"][i]
            if last - first <= leaf or not 0 < radius < np.inf:
                continue
            points, centers = order[first:last].copy(), [out["center"][i]]
            near, own = distances(points, centers[0]), np.zeros(last - first, np.int64)
            while len(centers) < FANOUT and near.max() > radius / 2:
                centers.append(int(points[near.argmax()]))
                d = distances(points, centers[-1])
                own[d < near] = len(centers) - 1
                near = np.minimum(near, d)
            by = np.argsort(own, kind="stable")
            order[first:last] = points[by]
            sizes = np.bincount(own, minlength=len(centers))
            at, out["child"][i], out["children"][i] = first, len(out["radius"]), len(centers)
            for c, n in zip(centers, sizes.tolist(), strict=True):
                todo.append(add(c, at, at + n))
                at += n
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        nodes = {c: np.array(v, float if c == "radius" else np.int64) for c, v in out.items()}
        nodes["center"] = place[nodes["center"]]
        return cls(ids[order], vectors[order], nodes)

    def bounds(self, nodes: np.ndarray, other: CoverTree, node: int) -> np.ndarray:
        """The largest inner products possible between points of each of ``nodes`` and of the other's node."""
        r, s = self.radius[nodes], other.radius[node]
        return self.centers[nodes] @ other.centers[node] + r * other.norms[node] + s * self.norms[nodes] + r * s


    def under(self, node: int) -> np.ndarray:
        """The leaves that a node's points are in, in their order."""
        first = self.first[self.leaves]
        return self.leaves[np.searchsorted(first, self.first[node]) : np.searchsorted(first, self.last[node])]


class Best:
    """The k best (score, id) of each query of a tree, by falling score, then rising id."""

    def __init__(self, queries: CoverTree, k: int):
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries.ids), k), -np.inf)
        self.ids = np.full((len(queries.ids), k), np.iinfo(np.int64).max)
        self.whole: list[list[tuple[int, int]]] | None = None

    def worst(self, node: int) -> float:
        q = self.queries
        return self.scores[q.first[node] : q.last[node], -1].min()

    def all_matter(self, i: int, data: CoverTree, j: int) -> bool:
        """Whether no pair of leaves under query node i and data node j can be left out."""
        q = self.queries
        if (q.last[i] - q.first[i]) * (data.last[j] - data.first[j]) > WHOLE:
            return False
        a, b = q.under(i), data.under(j)
        worst = np.minimum.reduceat(self.scores[q.first[i] : q.last[i], -1], q.first[a] - q.first[i])
        r, s = q.radius[a][:, None], data.radius[b]
        bound = q.centers[a] @ data.centers[b].T + r * data.norms[b] + s * q.norms[a][:, None] + r * s
        return bool((bound + np.abs(bound) * 1e-9 + 1e-6 >= worst[:, None]).all())

    def offer(self, a: int, b: int, data: CoverTree, c: int, d: int) -> None:
        """Takes data points c to d into account for queries a to b."""
        if self.whole is not None or self.queries.largest * data.largest >= 2.0**52:
            self._offer_whole(a, b, data, c, d)
            return
        q, ids = self.queries, data.ids[c:d]
        s = q.vectors[a:b] @ data.vectors[c:d].T
        floor = self.scores[a:b, -1]
        if not (s >= floor[:, None]).any():
            return
        s[q.ids[a:b, None] == ids[None, :]] = -np.inf
        if d - c > self.k:
            floor = np.maximum(floor, np.partition(s, d - c - self.k, axis=1)[:, d - c - self.k])
        row, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
        old = np.repeat(np.arange(b - a), self.k)
        row_, score, id_ = np.concatenate([row, old]), np.concatenate([s[row, col], self.scores[a:b].ravel()]), np.concatenate([ids[col], self.ids[a:b].ravel()])
        by = np.lexsort((id_, -score, row_))
        start = np.searchsorted(row_[by], np.arange(b - a))
        pick = by[start[:, None] + np.arange(self.k)]
        self.scores[a:b], self.ids[a:b] = score[pick], id_[pick]

    def _offer_whole(self, a: int, b: int, data: CoverTree, c: int, d: int) -> None:
        """The same in whole numbers of any size; the scores are then kept as such, too."""
        if self.whole is None:
            self.whole = [[(int(s), int(i)) for s, i in zip(x, y, strict=True) if s > -np.inf] for x, y in zip(self.scores, self.ids, strict=True)]
        right = [[int(x) for x in v] for v in data.vectors[c:d].tolist()]
        for i in range(a, b):
            left, own = [int(x) for x in self.queries.vectors[i].tolist()], int(self.queries.ids[i])
            new = [(sum(map(int.__mul__, left, v)), j) for v, j in zip(right, data.ids[c:d].tolist(), strict=True) if j != own]
            self.whole[i] = heapq.nsmallest(self.k, [*self.whole[i], *new], key=lambda x: (-x[0], x[1]))
            if len(self.whole[i]) == self.k:
                # Only for bounds: a little below the true score.
                self.scores[i, -1] = float(max(-(10**300), min(10**300, self.whole[i][-1][0]))) * (1 - 1e-12 * np.sign(self.whole[i][-1][0]))

    def results(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, ids, scores); whole numbers beyond the range of long are its bounds."""
        if self.whole is None:
            ok = self.scores > -np.inf
            yield self.queries.ids[np.nonzero(ok)[0]], self.ids[ok], self.scores[ok].astype(np.int64)
        else:
            rows = [(int(q), i, max(-LONG - 1, min(LONG, s))) for q, own in zip(self.queries.ids, self.whole, strict=True) for s, i in own]
            yield tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def search(best: Best, data: CoverTree) -> tuple[int, int, int]:
    """Dual-tree search; returns the pairs of nodes looked at, those pruned, and the pairs of points multiplied."""
    q, seen, pruned, done = best.queries, 0, 0, 0
    todo = [(0, 0, float(data.bounds(np.array([0]), q, 0)[0]))]
    while todo:
        i, j, bound = todo.pop()
        seen += 1
        worst = best.worst(i)
        if bound + abs(bound) * 1e-9 + 1e-6 < worst:
            pruned += 1
            continue
        open_q, open_d = q.children[i] > 0, data.children[j] > 0
        if not open_q and not open_d or worst > -np.inf and best.all_matter(i, data, j):
            best.offer(q.first[i], q.last[i], data, data.first[j], data.last[j])
            done += (q.last[i] - q.first[i]) * (data.last[j] - data.first[j])
        elif open_d and (not open_q or data.radius[j] >= q.radius[i]):
            under = np.arange(data.child[j], data.child[j] + data.children[j])
            b = data.bounds(under, q, i)
            todo += [(i, int(under[x]), float(b[x])) for x in np.argsort(b)]
        else:
            under = np.arange(q.child[i], q.child[i] + q.children[i])
            b = q.bounds(under, data, j)
            todo += [(int(under[x]), j, float(b[x])) for x in np.argsort(b)]
    return seen, pruned, int(done)


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id, v array<double> of floor(scale * x). Rows with a null id or vector, or with a null, NaN or infinite component, are left out,

    and so are those that the scale takes beyond the range of doubles."""
    v = F.col(vector_col).cast("array<double>")
    big = F.lit(float("inf"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < big))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x * scale).alias("v"))


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """By number of dimensions, up to ``PIVOTS`` vectors picked farthest first from a sample of ``SAMPLE`` rows, in the order of a cover tree: neighbours follow each other."""
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    out = {}
    for dim in {len(r.v) for r in picked} - {0}:
        x = np.floor(np.array([r.v for r in picked if len(r.v) == dim], float)).reshape(-1, dim)
        at, near = [0], np.full(len(x), np.inf)
        with np.errstate(over="ignore"):
            while len(at) < min(PIVOTS, len(x)) and near.max() > 0:
                near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(axis=1))
                at.append(int(near.argmax()))
        out[dim] = CoverTree.build(np.array(at), x[at], 1).vectors
    return out


def placed(rows: DataFrame, around: dict[int, np.ndarray]) -> DataFrame:
    """id and v in order of dimensions, nearest pivot and distance from it, dealt by ranges of that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            v = batch.column("v")
            flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            n = np.diff(ends)
            for dim in np.unique(n).tolist():
                if dim in around and dim:
                    for own in np.array_split(np.flatnonzero(n == dim), -(-len(batch) // 2000)):
                        x, p = flat[ends[own][:, None] + np.arange(dim)], around[dim]
                        with np.errstate(over="ignore", invalid="ignore"):
                            d = np.nan_to_num((x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1), nan=0.0)
                        cell[own] = d.argmin(axis=1)
                        far[own] = np.maximum(d.min(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(n.astype(np.int32)), pa.array(cell), pa.array(far)], ["id", "v", "dim", "cell", "far"])

    found = rows.select("id", "v").mapInArrow(run, "id long, v array<double>, dim int, cell int, far double")
    order = ["dim", "cell", "far", "id"]
    return found.repartitionByRange(*order).sortWithinPartitions(*order)


def index(rows: DataFrame) -> DataFrame:
    """Blocks of cover trees, as rows of ``SCHEMA``, over id and v in their order; components are rounded down.

    Vectors of different lengths go to different blocks and are never compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids = np.array([i for i, _ in held[dim]], np.int64)
            t = CoverTree.build(ids, np.floor(np.stack([x for _, x in held.pop(dim)])))
            cols = [pa.array([dim], pa.int32()), pa.array([t.ids]), pa.array([t.vectors.tobytes()], pa.binary())]
            cols += [pa.array([t.nodes[c].astype(np.int32)]) for c in TREE] + [pa.array([t.radius])]
            cols += [pa.array([t.centers[0]], pa.list_(pa.float64())), pa.array([t.radius[0]])]
            return pa.RecordBatch.from_arrays(cols, ["dim", "ids", "vectors", *TREE, "radius", "middle", "reach"])

        for batch in batches:
            vectors = batch.column("v")
            flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, a, b in zip(batch.column("id").to_pylist(), ends[:-1], ends[1:], strict=True):
                own = held.setdefault(int(b - a), [])
                own.append((i, flat[a:b].copy()))
                if len(own) == BLOCK:
                    yield block(int(b - a))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, SCHEMA)


def _tree(batch: pa.RecordBatch, i: int) -> CoverTree:
    row = {c: batch.column(c)[i].as_py() for c in ("dim", "ids", "vectors", *TREE, "radius")}
    nodes = {c: np.array(row[c], np.int64) for c in TREE} | {"radius": np.array(row["radius"], float)}
    return CoverTree(np.array(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(len(row["ids"]), row["dim"]), nodes)


def _searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int, shares: int) -> DataFrame:
    """query_id, vec_id, score of the k best that each query's wave meets in each share of ``pairs`` (wave, block, bound); and, without query_id, block and worst k-th score of each query block."""
    cols = ["dim", "ids", "vectors", *TREE, "radius"]
    met = pairs.select("wave", "block", "bound", F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"))
    d = met.join(data, "block").select("wave", "share", F.lit(1).alias("kind"), "bound", "block", *cols)
    q = met.select("wave", "share").distinct().join(queries, "wave").select("wave", "share", F.lit(0).alias("kind"), F.lit(0.0).alias("bound"), "block", *cols)
    rows = d.unionByName(q).repartition("wave", "share").sortWithinPartitions("wave", "share", "kind", F.col("bound").desc(), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, Best]] = []
        searching = False

        def out() -> Iterator[pa.RecordBatch]:
            for block, b in best:
                for ids, others, scores in b.results():
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(scores), pa.nulls(len(ids), pa.float64())], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([block]), pa.nulls(1, pa.int64()), pa.array([b.worst(0)])], names)

        names = ["query_id", "vec_id", "score", "worst"]
        for batch in batches:
            for i, (kind, block) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                tree = _tree(batch, i)
                if kind == 0:
                    if searching:
                        yield from out()
                        best, searching = [], False
                    best.append((block, Best(tree, k)))
                else:
                    searching = True
                    for _, b in best:
                        if b.queries.vectors.shape[1] == tree.vectors.shape[1]:
                            search(b, tree)
        yield from out()

    return rows.mapInArrow(run, "query_id long, vec_id long, score long, worst double")


def top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of (id, v) that ``is_query`` holds for, the k best other ids.

    Fewer than k others give fewer rows. Ties go to the smaller id. Rows that
    share an id are never each other's results; repeated rows count as often as
    they occur. No queries or no rows: no results. Scores are exact; those
    beyond the range of long count as its bounds. Other columns are ignored.
    """
    around = pivots(rows)
    number = F.monotonically_increasing_id().alias("block")
    data = common.stage(index(placed(rows, around)).select(number, "*"), "cover-trees")
    queries = common.stage(index(placed(rows.where(is_query), around)).select(number, "*"), "query-trees")
    # One row for each query block, in the order of its place.
    turn = F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1
    waves = queries.select("dim", "block", turn.alias("turn")).groupBy("dim", F.floor(F.col("turn") / WAVE).alias("n")).agg(F.collect_list("block").alias("blocks"))
    waves = common.stage(waves.select((F.row_number().over(Window.orderBy("dim", "n")) - 1).alias("wave"), "dim", F.explode("blocks").alias("block")), "waves")
    queries = queries.join(waves.select("block", "wave"), "block")
    n_waves, n_data = waves.agg(F.coalesce(F.max("wave") + 1, F.lit(0))).first()[0], data.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    if not n_waves or not n_data:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # Bounds between whole blocks: each data block against the few query blocks of each wave.
    norm = F.sqrt(V.norm_squared(F.col("middle")))
    there = queries.groupBy("wave").agg(F.first("dim").alias("there"), F.collect_list(F.struct("block", "middle", "reach", norm.alias("norm"))).alias("q"))
    here = data.select("block", "dim", "middle", "reach", norm.alias("norm"), F.explode(F.sequence(F.lit(0), F.lit(n_waves - 1))).alias("wave"))
    reach = lambda q: V.dot(q["middle"], F.col("middle")) + q["reach"] * F.col("norm") + q["norm"] * F.col("reach") + q["reach"] * F.col("reach")
    pairs = here.join(there, "wave").where("dim = there")
    pairs = pairs.select("wave", "block", F.transform("q", lambda q: F.struct(q["block"].alias("query"), reach(q).alias("bound"))).alias("bounds"))
    pairs = common.stage(pairs, "block-bounds")
    first = pairs.select("wave", "block", F.explode("bounds").alias("b")).groupBy("wave", "b.query").agg(F.max_by("block", F.struct("b.bound", "block")).alias("block"))
    first = common.stage(first.select("wave", "block").distinct().withColumn("bound", F.lit(0.0)), "first-pairs")
    found = common.stage(_searched(first, queries, data, k, 1), "first-found")
    # A wave is one task here, so the worst k-th score of a query block is over all it has met. Without k there is no bound.
    worst = found.where("query_id is null").select(F.col("vec_id").alias("query"), "worst")
    left = pairs.join(first.select("wave", "block"), ["wave", "block"], "left_anti").select("wave", "block", F.explode("bounds").alias("b"))
    left = left.select("wave", "block", "b.query", "b.bound").join(worst, "query").where(F.col("bound") + F.abs("bound") * 1e-9 + 1e-6 >= F.col("worst"))
    left = common.stage(left.groupBy("wave", "block").agg(F.max("bound").alias("bound")), "left-pairs")
    shares = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_data // SHARE)))
    found = found.unionAll(_searched(left, queries, data, k, shares)).where("query_id is not null")
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best rows for each row whose id is divisible by 20.

    Rows with a null id or with a vector that is null or has null or non-finite
    components take no part; ties go to the smaller id; other columns are ignored.
    """
    rows = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows, F.col("id") % 20 == 0, 20)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
