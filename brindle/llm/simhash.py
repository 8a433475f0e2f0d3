"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

The binary Golay code [23, 12] is perfect: every 23-bit word lies within 3 bits
of exactly one codeword. A word's keys are the indices of all codewords within 4
bits of it: one, or six where the nearest is 3 bits away. If two words differ in
one bit, the nearest codeword of either is among the keys of the other.

*Fingerprints of 64 bits that differ in at most 3* (``link_exact``). Cut into
three segments of 22, 21 and 21 bits, by the pigeonhole principle such a pair
either agrees in one segment and differs by at most one bit in another, or
differs by one bit in each. So a fingerprint is filed under (segment, Golay key
of another segment) for all six ordered pairs, and under the Golay keys of all
three. Words that differ by one bit differ in parity, so only odd words file
under all their keys and even ones under the nearest codeword. That is about 50
keys of 34 or 36 bits for a fingerprint; no link is lost.

*Similar texts* (``similar_components``) are those whose sets of shingles have a
cosine, the similarity that SimHash tells, of 0.8 or more. They are filed under
the keys above of a SimHash of their words, which finds scattered edits, and under
one key of three Golay words for each of 16 SimHashes of samples of their shingles,
which finds replaced passages: a sample is the same in both texts if its shingles
are in both. Pairs with a common key and close fingerprints are proposals; each is
then verified by the exact cosine of the two sets, by joins.

Rows are sorted by key, and each task goes through its runs of equal keys with
numpy. A run's components are found by searching outward from a member among
those not reached yet. They leave the task as trees, not as pairs: a group of
thousands of near copies costs an edge per member. Proposals are verified one by
one, so the trees' roots are the members nearest the group's centre, for that is
where the text lies that all others were made from. Only distinct fingerprints
take part.

Where verified proposals leave the members of a long run in several components, as
texts made from one template do, the rest is done exactly: such members are filed by
their rarest shingles, as many as two similar sets must share one of, and pairs of
different components that meet are verified, too. So a pair with a key in common is
found however many others have that key.

Keys that very many fingerprints share are told from a sample of the fingerprints,
and dealt to several tasks. For exact links those of a pair that differ in 3 bits
at most agree in one of four parts of the segment that the key leaves open, and are
dealt by these. For similar texts they are dealt by chance, the busiest member of
each large component found is then compared with all who share a key with it, and
what is left meets by rare shingles like that of other long runs.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.graph import connected_components
from . import common

SEED = 42
#: Shingles whose bits are counted in one numpy step, and in one sum of bytes (255 at most).
STEP, BLOCK = 16_384, 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code.
GOLAY = 0b110001110101


# ---- fingerprints


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """More 64-bit hashes from one: the hash itself, then mixes of it."""
    out = [h]
    for i in range(1, lanes):
        x = h + np.uint64(0x9E3779B97F4A7C15 * i & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The hash of each shingle in order; fewer words are one shingle, no words none."""
    w = text.lower().split()
    size = max(1, len(w) - shingle + 1) if w else 0
    pieces = w if shingle == 1 else [b" ".join(w)] if size == 1 else map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in pieces), np.uint64, size)


def simhash(texts: list[bytes], shingle: int, lanes: int = 1, seed: int = SEED, distinct: bool = False, samples: int = 0) -> np.ndarray:
    """(texts, lanes) unsigned 64-bit fingerprints: a bit is 1 if set in over half of the shingles' hashes.

    A-Z are taken as a-z; shingles are of ``shingle`` words joined by a space,
    repeats included unless ``distinct``; fewer words are one shingle, no words
    give zeros. Bits are counted ``STEP`` shingles at a time, whatever the
    lengths of the texts. With ``samples``, so many more columns follow: the SimHash of
    the smallest hashes in each of four parts of the range of hashes, zero where
    there are none.
    """
    counts, totals = np.zeros((len(texts), 64 * lanes), np.int64), np.zeros(len(texts), np.int64)
    least, bounds = np.zeros((len(texts), 4 * samples + 1), np.uint64), np.array([i * 2**64 // (4 * samples or 1) for i in range(4 * samples)], np.uint64)
    hashes: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        if hashes:
            n = np.array([len(h) for h in hashes])
            # Each text's hashes begin a new block, and blocks are filled up with zeros: their bits add up along one axis.
            blocks = -(-n // BLOCK)
            first = np.cumsum(blocks) - blocks
            rows = np.zeros((BLOCK * int(blocks.sum()), lanes), np.uint64)
            rows[np.arange(n.sum()) + np.repeat(BLOCK * first - (np.cumsum(n) - n), n)] = _lanes(np.concatenate(hashes), lanes)
            bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").reshape(-1, BLOCK, 64 * lanes)
            counts[owners] += np.add.reduceat(bits.sum(axis=1, dtype=np.uint8), first, axis=0, dtype=np.int64)
            hashes.clear()
            owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        own = shingle_hashes(text, shingle, seed)
        if not len(own):
            continue
        if distinct or samples:
            own = np.unique(own)
        if samples:
            at = np.searchsorted(own, bounds)
            has = at < np.append(at[1:], len(own))
            least[i, :-1][has] = own[at[has]]
        totals[i] = len(own)
        for at in range(0, len(own), STEP):
            hashes.append(own[at : at + STEP])
            owners.append(i)
            waiting += len(hashes[-1])
            if waiting >= STEP:
                count()
                waiting = 0
    count()
    whole = np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view(np.uint64)
    if not samples:
        return whole
    parts = least[:, :-1].reshape(-1, 4)
    bits = np.unpackbits(_lanes(parts.ravel(), 2)[:, 1].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 4, 64) * (parts > 0)[:, :, None]
    sampled = np.packbits(bits.sum(axis=1) * 2 > (parts > 0).sum(axis=1)[:, None], axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([whole, sampled.reshape(len(texts), samples)], axis=1)


def fingerprints(docs: DataFrame, specs: list[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash and, for each of ``specs`` (arguments of ``simhash``), its columns as longs f0_0, f0_1, ...

    One row for each input row; a null text counts as empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"f{i}_{k}" for i, spec in enumerate(specs) for k in range(spec.get("lanes", 1) + spec.get("samples", 0))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = pc.fill_null(part.column("text"), b"").to_pylist()
                lanes = [simhash(texts, **spec).view(np.int64) for spec in specs]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), *[pa.array(x[:, j].copy()) for x in lanes for j in range(x.shape[1])]], ["id", "text_hash", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join([f"id {kind}, text_hash long", *(f"{n} long" for n in names)]))


# ---- Golay keys


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the index change to the nearest codeword's own bits, whether it is 3 bits away, and the five others' index changes."""
    words = np.arange(1 << 12, dtype=np.int64) << 11
    rest = _syndrome(words)
    codewords = words | rest
    error = np.zeros(1 << 11, np.int64)
    weight = np.zeros(1 << 11, np.int64)
    ones = [1 << i for i in range(23)]
    patterns = [0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)]
    p = np.array(patterns)
    s = _syndrome(p)
    error[s], weight[s] = p, np.bitwise_count(p)
    others = np.zeros((1 << 11, 5), np.int64)
    found = np.zeros(1 << 11, np.int64)
    for c in codewords[np.bitwise_count(codewords) == 7].tolist():
        bits = [b for b in ones if c & b]
        for i, a in enumerate(bits):
            for j, b in enumerate(bits[:i]):
                for d in bits[:j]:
                    k = int(_syndrome(np.array([a | b | d]))[0])
                    others[k, found[k]] = c >> 11
                    found[k] += 1
    return error >> 11, weight == 3, others


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for i in range(22, 10, -1):
        x = np.where(x >> i & 1, x ^ (GOLAY << (i - 11)), x)
    return x


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices, the nearest first, and whether each word has all six."""
    change, far, others = _golay()
    s = _syndrome(x)
    first = (x >> 11) ^ change[s]
    return np.concatenate([first[:, None], first[:, None] ^ others[s]], axis=1), far[s]


def _exact_keys(f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) pairs under which the 64-bit fingerprints ``f`` are filed."""
    rows = np.arange(len(f))
    seg = [(f >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
    keys, more = zip(*map(golay_keys, seg), strict=True)
    more = [m & (np.bitwise_count(s) % 2 == 1) for m, s in zip(more, seg, strict=True)]
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        base = (tag << 60) | (seg[i] << 12)
        yield rows, base | keys[j][:, 0]
        for k in range(1, 6):
            yield rows[more[j]], (base | keys[j][:, k])[more[j]]
    for pick in product(range(6), repeat=3):
        has = np.ones(len(f), bool)
        for m, k in zip(more, pick, strict=True):
            has &= m | (k == 0)
        key = (6 << 60) | (keys[0][:, pick[0]] << 24) | (keys[1][:, pick[1]] << 12) | keys[2][:, pick[2]]
        yield rows[has], key[has]


def _similar_keys(lanes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys): those of ``_exact_keys`` for the first column, and for each other column that isn't zero the nearest codewords of its three segments."""
    yield from _exact_keys(lanes[:, 0])
    for lane in range(1, lanes.shape[1]):
        rows = np.flatnonzero(lanes[:, lane])
        key = np.full(len(rows), (7 << 60) | (lane << 36), np.int64)
        for i, (at, n) in enumerate(SEGMENTS):
            key |= golay_keys((lanes[rows, lane] >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1))[0][:, 0] << (12 * i)
        yield rows, key


# ---- links within runs of equal keys


def _component_trees(f: np.ndarray, limit: int) -> list[np.ndarray]:
    """The components, of two or more, of fingerprints that link at ``limit`` or fewer differing bits; as indices."""
    left, out = np.arange(len(f)), []
    while len(left) > 1:
        member, frontier, left = [left[0]], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(f[left] ^ f[frontier.pop()]).sum(axis=1, dtype=np.int64) <= limit
            new = left[near]
            if len(new):
                member += new.tolist()
                frontier += new.tolist()
                left = left[~near]
        if len(member) > 1:
            out.append(np.array(member))
    return out


#: Runs up to this length are compared by shifting the whole batch; longer ones one by one.
SHORT = 8


def _links(key: np.ndarray, node: np.ndarray, f: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes of each run of equal keys; all rows of a run are here."""
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(np.append(starts, len(key)))
    short = np.repeat(sizes <= SHORT, sizes)
    a, b = [], []
    for d in range(1, min(SHORT, int(sizes.max()))):
        i = np.flatnonzero((key[:-d] == key[d:]) & short[:-d])
        i = i[np.bitwise_count(f[i] ^ f[i + d]).sum(axis=1, dtype=np.int64) <= limit]
        a.append(node[i])
        b.append(node[i + d])
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        for m in _component_trees(f[s : s + n], limit):
            own, i = node[s : s + n][m], np.arange(1, len(m))
            a.append(own[(i - 1) // 2])
            b.append(own[i])
    a, b = np.concatenate([*a, node[:0]]), np.concatenate([*b, node[:0]])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    return both[:, 0], both[:, 1]


#: Members at the centre of a component, the nearest of which each other one is compared with.
HUBS = 3


def _distance(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f ^ x).sum(axis=-1, dtype=np.int64)


def _tree(f: np.ndarray, limit: int) -> np.ndarray:
    """A spanning tree of connected fingerprints: each one's parent, and -1 for the root, which lies nearest the centre.

    A member goes with the nearest of the ``HUBS`` at the centre that were reached before
    it, and else with the member from which it was reached. So parents come before
    their children, and no edge is longer than ``limit``.
    """
    bits = np.unpackbits(f.view(np.uint8), axis=1)
    center = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(f)).view(np.uint64)
    hubs = np.argsort(_distance(f, center), kind="stable")[:HUBS]
    parent, turn, left = np.full(len(f), -1), np.zeros(len(f), np.int64), np.delete(np.append(hubs, np.delete(np.arange(len(f)), hubs)), 0)
    frontier, reached = deque(hubs[:1].tolist()), 1
    while frontier and len(left):
        i = frontier.popleft()
        near = _distance(f[left], f[i]) <= limit
        new, left = left[near], left[~near]
        parent[new], turn[new] = i, reached + np.arange(len(new))
        reached += len(new)
        frontier.extend(new.tolist())
    best = np.full(len(f), limit + 1)
    for h in hubs:
        d = _distance(f, f[h])
        closer = (turn > turn[h]) & (d < best)
        parent[closer], best[closer] = h, d[closer]
    return parent


def _proposals(key: np.ndarray, node: np.ndarray, f: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (member, other) at ``limit`` or fewer bits within runs of equal keys, as rows, and which of these come from long runs.

    Short runs give all pairs. Each row of a longer run comes once, with its parent in the
    tree of its component, or with itself where it has none: enough to join a group
    whose members are all alike, and no more rows than the run has. Other pairs in
    long runs are for ``_unsettled``.
    """
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(np.append(starts, len(key)))
    short = np.repeat(sizes <= SHORT, sizes)
    a, b = [], []
    for d in range(1, min(SHORT, int(sizes.max()))):
        i = np.flatnonzero((key[:-d] == key[d:]) & short[:-d])
        i = i[_distance(f[i], f[i + d]) <= limit]
        a.append(i)
        b.append(i + d)
    a, b = np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])
    # One row of each pair of nodes, however many keys they share here.
    pairs = np.stack([node[a], node[b]], axis=1)
    once = np.unique(pairs, axis=0, return_index=True)[1]
    once = once[pairs[once, 0] != pairs[once, 1]]
    a, b, parent = a[once], b[once], np.arange(len(key))
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        left = np.arange(s, s + n)
        while len(left) > 1:
            members, frontier, left = [left[:1]], deque(left[:1].tolist()), left[1:]
            while frontier and len(left):
                i = frontier.popleft()
                near = _distance(f[left], f[i]) <= limit
                if near.any():
                    new, left = left[near], left[~near]
                    members.append(new)
                    frontier.extend(new.tolist())
            m = np.concatenate(members)
            if len(m) > 1:
                up = _tree(f[m], limit)
                parent[m] = np.where(up < 0, m, m[up])
    own = np.flatnonzero(~short)
    return np.append(a, own), np.append(b, parent[own]), np.repeat([False, True], [len(a), len(own)])


def _edges(filed: DataFrame, lanes: list[str], limit: int, links=_links) -> DataFrame:
    """a, b: what ``links`` gives for the runs of equal ``key``. ``filed`` has key, node and ``lanes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(table: np.ndarray) -> pa.RecordBatch:
            x, y = links(table[:, 0], table[:, 1], table[:, 2:].copy().view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            table = np.stack([batch.column(c).to_numpy() for c in ("key", "node", *lanes)], axis=1)
            if kept and kept[-1][-1, 0] == table[-1, 0]:
                kept.append(table)
                continue
            # The last key may go on in the next batch.
            whole = np.concatenate([*kept, table])
            at = np.searchsorted(whole[:, 0], whole[-1, 0])
            kept = [whole[at:]]
            if at:
                yield out(whole[:at])
        if kept:
            yield out(np.concatenate(kept))

    order = filed.repartition("key").sortWithinPartitions("key", "node")
    return order.mapInArrow(run, "a long, b long")


def _searched(filed: DataFrame, lanes: list[str], limit: int) -> DataFrame:
    """a, b for the ``_proposals`` of the runs of equal ``run``; each row of a long one gives one row, with its key, and without b if nothing is proposed for it. ``filed`` has run, key, node and ``lanes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(table: np.ndarray) -> pa.RecordBatch:
            a, b, long = _proposals(table[:, 0], table[:, 2], table[:, 3:].copy().view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(table[a, 2]), pa.array(table[b, 2], mask=a == b), pa.array(table[a, 1], mask=~long)], ["a", "b", "key"])

        for batch in batches:
            if not len(batch):
                continue
            table = np.stack([batch.column(c).to_numpy() for c in ("run", "key", "node", *lanes)], axis=1)
            if kept and kept[-1][-1, 0] == table[-1, 0]:
                kept.append(table)
                continue
            # The last run may go on in the next batch.
            whole = np.concatenate([*kept, table])
            at = np.searchsorted(whole[:, 0], whole[-1, 0])
            kept = [whole[at:]]
            if at:
                yield out(whole[:at])
        if kept:
            yield out(np.concatenate(kept))

    order = filed.repartition("run").sortWithinPartitions("run", "node")
    return order.mapInArrow(run, "a long, b long, key long")


def _file(nodes: DataFrame, keys, key_lanes: list[str], keep: list[str]) -> DataFrame:
    """key, node and ``keep`` for each key of each row of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                f = np.stack([part.column(c).to_numpy() for c in key_lanes], axis=1).view(np.uint64)
                rows, key = map(np.concatenate, zip(*keys(f), strict=True))
                both = np.unique(np.stack([key, rows], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), *[part.column(c).take(pa.array(both[:, 1])) for c in ["node", *keep]]], ["key", "node", *keep])

    cols = list(dict.fromkeys(["node", *key_lanes, *keep]))
    return _spread(nodes.select(*cols)).mapInArrow(run, ", ".join(["key long", "node long", *(f"{c} long" for c in keep)]))


def _spread(nodes: DataFrame) -> DataFrame:
    """As many tasks as a shuffle has: filing makes many rows of one, so tasks must not be merged by their input's size.

    By an expression of its own, as a shuffle by the column that the rows are dealt by already would be left out.
    """
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(n, F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(n)))


#: One in so many fingerprints tells which keys are hot, from so many of them on; and members of a hot key in a task.
SAMPLED, HOT, DEALT = 32, 256, 4096


def _hot(nodes: DataFrame, keys, key_lanes: list[str], hot: int = HOT) -> DataFrame | None:
    """key, parts: the keys of about ``hot * SAMPLED`` nodes or more, and the tasks to deal them to; None without such."""
    few = nodes.where(F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.lit(SAMPLED)) == 0)
    found = _file(few, keys, key_lanes, []).groupBy("key").count().where(F.col("count") >= hot)
    found = common.stage(found.select("key", F.ceil(F.col("count") * (SAMPLED / DEALT)).cast("int").alias("parts")), "hot-keys")
    return None if found.isEmpty() else found


#: The segment that a key of each tag of ``_exact_keys`` leaves open.
OPEN = [next(k for k in range(3) if k not in (i, j)) for i in range(3) for j in range(3) if i != j]


def _dealt_exactly(filed: DataFrame, hot: DataFrame) -> DataFrame:
    """``filed`` with hot keys made finer, without loss: under each of four parts of the segment they leave open, of which 3 bits leave one alone.

    Keys of all three segments stay: their fingerprints differ in the balls of three codewords at most.
    """
    tag, f = F.shiftrightunsigned("key", 60), F.col("f")
    parts = []
    for quarter in range(4):
        value = F.lit(0).cast("long")
        for t, k in enumerate(OPEN):
            at, n = SEGMENTS[k]
            low, high = at + n * quarter // 4, at + n * (quarter + 1) // 4
            value = F.when(tag == t, F.shiftrightunsigned(f, low).bitwiseAND((1 << (high - low)) - 1)).otherwise(value)
        parts.append(F.xxhash64("key", F.lit(quarter), value))
    finer = F.when(F.col("parts").isNull() | (tag == 6), F.array("key")).otherwise(F.array(*parts))
    return filed.join(hot, "key", "left").select(F.explode(finer).alias("key"), "node", "f")


def link_exact(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges between the distinct 64-bit fingerprints ``node`` that join all those at 3 or fewer differing bits, and no others."""
    rows, keys = nodes.select("node", F.col("node").alias("f")), lambda f: _exact_keys(f[:, 0])
    filed, busy = _file(rows, keys, ["f"], ["f"]), _hot(rows, keys, ["f"], hot)
    return _edges(filed if busy is None else _dealt_exactly(filed, busy), ["f"], 3)


def _with_components(marked: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``marked`` (id, ``node``, ...) with component_id, the smallest id reachable through equal nodes and edges."""
    firsts = common.stage(marked.groupBy(node).agg(F.min("id").alias("first")), "first-ids")
    labels = connected_components(edges).select(F.col("id").alias("__node"), "component")
    named = firsts.join(labels, F.col(node) == F.col("__node"), "left").select(F.col(node).alias("__node"), F.coalesce("component", node).alias("root"), "first")
    named = common.stage(named, "components")
    # Written first, so that the join below deals both sides itself and can split a root with very many nodes.
    least = common.stage(named.groupBy("root").agg(F.min("first").alias("component_id")), "least-ids")
    of_node = named.join(least, "root").select("__node", "component_id")
    return marked.join(of_node, marked[node] == of_node["__node"]).drop("__node")


def components(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint long, component_id: fingerprints of 64 bits, linked at 3 or fewer differing bits.

    One row for each input row. Null, empty and blank texts have fingerprint 0
    and link like others. A null id never names a component; a component without
    ids has null.
    """
    prints = common.stage(fingerprints(docs, [{"shingle": shingle}], id_col, text_col).drop("text_hash"), "simhash").withColumnRenamed("f0_0", "fingerprint")
    edges = link_exact(prints.select(F.col("fingerprint").alias("node")).distinct())
    return _with_components(prints, "fingerprint", edges)


#: For similar texts: lanes of the SimHash of distinct shingles by which proposals are made, and SimHashes of samples.
LANES, SAMPLES = 4, 16


def bits_for(similarity: float, lanes: int = LANES) -> int:
    """The most bits in which fingerprints of sets of that cosine differ, but for one pair in forty: the expected number and two deviations more."""
    share, n = float(np.arccos(min(1.0, similarity))) / np.pi, 64 * lanes
    return round(n * share + 2 * (n * share * (1 - share)) ** 0.5)


def _shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """node, shingles array<long>: the distinct shingles of the text that stands for each node in ``wanted``."""
    reps = nodes.join(wanted, "node", "left_semi").select("node", F.col("text.id").alias("__id"), F.col("text.text_hash").alias("__hash"))
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.join(reps, texts["__id"].eqNullSafe(reps["__id"]) & (texts["__hash"] == reps["__hash"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in pc.fill_null(part.column("text"), b"").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(proposed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b of ``proposed`` whose sets have a cosine of ``similarity`` or more.

    The sets of a go along with the pairs and meet those of b, where many pairs may
    share one: that side isn't moved on, and a large one is split by the join.
    """
    here = proposed.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = here.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common_ = F.size(F.array_intersect("x", "y")).cast("double")
    # One multiplication on each side, no root: exact at the threshold.
    return both.where(common_ * common_ >= similarity * similarity * F.size("x") * F.size("y") - 1e-9).select("a", "b")


def _across(filed: DataFrame, hot: DataFrame, edges: DataFrame, labels: DataFrame, limit: int, lanes: list[str], least: int) -> DataFrame:
    """a, b: the members of hot keys beside the busiest node of each component with ``least`` or more members there, where they lie close and apart."""
    labels = labels.select(F.col("id").alias("node"), "component")
    degree = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    here = filed.join(hot.select("key"), "key", "left_semi")
    here = common.stage(here.join(labels, "node", "left").join(degree, "node", "left"), "hot-members")
    busiest = F.max(F.struct("degree", F.struct("node", *lanes).alias("hub"))).alias("top")
    tops = here.where("component is not null").groupBy("key", "component").agg(F.count("*").alias("n"), busiest).where(F.col("n") >= least)
    tops = tops.select("key", F.col("component").alias("of"), "top.hub")
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub.{c}"))) for c in lanes), F.lit(0))
    apart = ~F.col("component").eqNullSafe(F.col("of"))
    return here.join(tops, "key").where(apart & (F.col("node") != F.col("hub.node")) & (bits <= limit)).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


#: Cells of the table of rough shingle counts.
CELLS = 1 << 18


def _star(labels: DataFrame) -> DataFrame:
    """a, b: as few edges as say the same as ``labels`` (id, component)."""
    return labels.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, component: the members of all long runs (node, key) whose ``labels`` (id, component) differ within a run."""
    labels = labels.select(F.col("id").alias("node"), "component")
    named = common.stage(members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "long-runs")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    mixed = common.stage(mixed, "mixed-runs")
    return common.stage(named.join(mixed, "key", "left_semi").select("node", "component").distinct(), "unsettled")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """shingle, node, component, size, pos, first: the shingles of each set by which a similar one must be met.

    In any one order of shingles, two sets with a cosine of ``similarity`` share one
    among the first n - ceil(similarity * n) + 1 of the smaller (``first``) and the
    first n - ceil(similarity^2 * n) + 1 of the larger. The order is by how many sets
    have a shingle, roughly, so what many share comes last; that only saves work.
    """
    mask = np.uint64(CELLS - 1)

    def rough(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = batch.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return {"n": np.bincount((x & mask).astype(np.int64), minlength=CELLS).astype(np.int32)}

    found = stats.reduced(sets.select("shingles"), rough, lambda a, b: {"n": a["n"] + b["n"]})
    counts = sets.sparkSession.sparkContext.broadcast(np.zeros(CELLS, np.int32) if found is None else found["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                size = pc.list_value_length(part.column("shingles")).to_numpy(zero_copy_only=False).astype(np.int64)
                x = part.column("shingles").flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(size)), size)
                x = x[np.lexsort((x, counts.value[(x.view(np.uint64) & mask).astype(np.int64)], of))]
                pos = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
                first, whole = (size - np.ceil(size * s - 1e-9).astype(np.int64) + 1 for s in (similarity, similarity * similarity))
                keep = np.flatnonzero(pos < whole[of])
                x, of, pos = x[keep], of[keep], pos[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x), part.column("node").take(pa.array(of)), part.column("component").take(pa.array(of)), pa.array(size[of]), pa.array(pos), pa.array(pos < first[of])], ["shingle", "node", "component", "size", "pos", "first"])

    return sets.select("node", "component", "shingles").mapInArrow(run, "shingle long, node long, component long, size long, pos long, first boolean")


def _met(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of different components that may have a cosine of ``similarity``; none that has it is missing."""
    rows = common.stage(_prefixes(sets, similarity), "prefixes")
    # Shingles of one component alone are told from sums, whatever its size.
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("shingle")
    rows = common.stage(rows.join(common.stage(mixed, "mixed-shingles"), "shingle", "left_semi"), "shared-prefixes")
    small = rows.where("first").select("shingle", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("size").alias("na"), F.col("pos").alias("pa"))
    large = rows.select("shingle", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("size").alias("nb"), F.col("pos").alias("pb"))
    t2 = similarity * similarity
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    # If this shingle is their first in common, no more are than what is left from here on.
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")).cast("double")
    may = (F.col("nb") * t2 <= F.col("na") + 1e-9) & (left * left >= F.col("na") * F.col("nb") * t2 - 1e-9)
    return small.join(large, "shingle").where((F.col("ca") != F.col("cb")) & order & may).select("a", "b").distinct()


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, component_id: documents whose sets of ``shingle`` words have a cosine of ``similarity`` or more, together with those they reach.

    No two documents are joined that such links don't join. A link is found if the
    two have a key in common, which is so with high, not full, probability (README
    has rates); how many others have that key makes no difference. Texts with equal
    fingerprints are taken as equal; blank texts are together. Null ids as in
    ``components``. One row for each input row; no rows give none; other columns
    are ignored.
    """
    specs = [{"shingle": 1, "distinct": True}, {"shingle": shingle, "distinct": True, "lanes": LANES, "samples": SAMPLES}]
    prints = common.stage(fingerprints(docs, specs, id_col, text_col), "simhash")
    lanes, samples = [f"f1_{k}" for k in range(LANES)], [f"f1_{LANES + k}" for k in range(SAMPLES)]
    key_lanes = ["f0_0", *samples]
    prints = prints.withColumn("node", F.xxhash64(*key_lanes, *lanes))
    # Written, so that what follows meets each fingerprint once, however many copies it has.
    nodes = common.stage(prints.groupBy("node", *key_lanes, *lanes).agg(F.min(F.struct("id", "text_hash")).alias("text")), "fingerprints")
    filed, busy, limit = _file(nodes, _similar_keys, key_lanes, lanes), _hot(nodes, _similar_keys, key_lanes, hot), bits_for(similarity)
    dealt = filed.withColumn("run", F.col("key"))
    if busy is not None:
        part = F.pmod(F.xxhash64("node", "key"), F.col("parts"))
        dealt = filed.join(busy, "key", "left").withColumn("run", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", part))).drop("parts")
    searched = common.stage(_searched(dealt, lanes, limit), "searched")
    proposed = common.stage(searched.where("b is not null").select("a", "b").distinct(), "proposed")

    def checked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
        sets = common.stage(_shingle_sets(docs, nodes, wanted, shingle, id_col, text_col), "shingle-sets")
        return common.stage(_verified(pairs, sets, similarity), "verified")

    edges = checked(proposed)
    labels = connected_components(edges)
    if busy is not None:
        # Joins the large components that were dealt to several tasks.
        more = common.stage(_across(filed, busy, edges, labels, limit, lanes, hot * SAMPLED // 8), "proposed-across")
        labels = connected_components(_star(labels).unionAll(checked(more)))
    # Pairs in long runs that no edge joins yet are met by their rare shingles.
    open_, edges = _unsettled(searched.where("key is not null").select(F.col("a").alias("node"), "key"), labels), _star(labels)
    if not open_.isEmpty():
        sets = common.stage(_shingle_sets(docs, nodes, open_.select("node"), shingle, id_col, text_col), "open-sets")
        met = common.stage(_met(sets.join(open_, "node"), similarity), "proposed-by-shingles")
        edges = edges.unionAll(common.stage(_verified(met, sets, similarity), "verified"))
    return _with_components(prints.select("id", "node"), "node", edges).select("id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Rows with a null id stay. Rows that share an id count as one document, of
    which one row stays.
    """
    found = common.stage(similar_components(docs.where(F.col(id_col).isNotNull()), similarity, id_col=id_col, text_col=text_col), "near-duplicates")
    extra = found.where("id != component_id").select(F.col("id").alias("__id")).distinct()
    repeated = found.groupBy("id").count().where("count > 1").select(F.col("id").alias("__id"))
    if repeated.isEmpty():
        return docs.join(extra, docs[id_col] == extra["__id"], "left_anti")
    single = docs.join(extra.union(repeated).distinct(), F.col(id_col) == F.col("__id"), "left_anti")
    one = docs.join(repeated.join(extra, "__id", "left_anti"), F.col(id_col) == F.col("__id"), "left_semi").dropDuplicates([id_col])
    return single.unionByName(one)


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Null, empty and blank texts have fingerprint zero and link like others;
    repeated rows and ids stay; no documents give no rows; other columns are
    ignored.
    """
    rows = components(common.documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
