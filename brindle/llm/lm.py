"""Language-model scoring by prediction by partial matching over bytes, beside a word-frequency base.

A text becomes its words in order, one space between them and an end mark. The
model is a trie of byte contexts up to ``ORDER`` bytes with the counts of the
bytes that follow, gathered from all training documents. A byte is coded in its
longest context that the trie has; a byte not seen there costs an escape, whose
weight is half the number of different bytes seen, each of which gives up half a
count (method D), and is then coded in the
next shorter context without the bytes that the longer one has already offered
(symbol exclusion), down to all bytes alike. A document's score is the sum of
the log10 probabilities of all its bytes and its end.

Counting is a Spark aggregation over every training document, and the trie has
every context that occurs, so it grows with the corpus and is never in one place.
A byte's cost depends on it and the ``ORDER`` bytes before it alone, so each
distinct byte string is scored once: those that share the last ``BASE + 1`` bytes
of context lie together and hold all the deeper branches they need; the branches
up to depth ``BASE``, strings of three bytes, are broadcast. Of the scores, those
of strings with at least one in ``SHARED`` of all bytes (at most that many) are
broadcast; each document's other strings are joined to the table of scores by
shuffle, where none of them can be a hot key. The result doesn't depend on that bound.

A ``resolution`` makes the trie as fine as one in so many of the training bytes: a
branch with a smaller share is not a node of its own; its count stays in its
context's total and belongs to the escape.

The base needs the count of each token of each document. Tokens with at least
one in ``RESOLUTION`` of all occurrences (at most that many) are broadcast; each
document's other tokens are joined to the table of counts by shuffle, where none
of them can be a hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .wordpool import steps

ORDER = 5  # 5 at most: a byte string and its document's number in a step share 64 bits
#: Depth of the branches that are broadcast to score the others, byte strings that are scored in one step, and share of those whose score is broadcast.
BASE = 2
CHUNK = 1_000_000
SHARED = 1 << 22
RESOLUTION = 1 << 20
STEP = 1_000_000
#: Distinct tokens and byte strings that a counting task holds before it passes its counts on.
HELD = 300_000
END = b"\xff"  # in no UTF-8 text


def held_out(id_: Column) -> Column:
    """The documents that teach nothing; a null id teaches."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of batches, of 65,536 rows at most, with their texts' words; bytes.lower and bytes.split are those of ASCII alone."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), b"")
        # An empty text counts for its share of the rows, too.
        for a, b in steps(pc.add(pc.binary_length(texts), STEP >> 15).to_pylist(), STEP):
            yield batch.slice(a, b - a), [t.lower().split() for t in texts[a:b].to_pylist()]


def _keys(docs: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of all documents, ends included, that byte and the ``order`` before it as one number; and the bytes of each."""
    joined = [END * order + b" ".join(w) + END for w in docs]
    n = np.fromiter(map(len, joined), np.int64, len(joined))
    data = END * 7 + b"".join(joined)
    key = np.empty(len(data) - 7, np.uint64)
    for at in range(8):  # every eighth string of eight bytes lies in a row
        key[at::8] = np.frombuffer(data, ">u8", (len(data) - at) // 8, at)
    key &= np.uint64((1 << 8 * (order + 1)) - 1)
    pad = (np.cumsum(n) - n)[:, None] + np.arange(order)
    own = np.ones(len(key), bool)
    own[pad.ravel()] = False
    return key[own], n - order


def _added(counts_: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of several counts, ascending, and their sums."""
    key, n = (np.concatenate(x) for x in zip(*counts_, strict=True))
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(n[by], first) if len(first) else n


def counts(docs: DataFrame, order: int = ORDER, text_col: str = "text", train: Column | None = None) -> DataFrame:
    """token binary, gram long, n long, m long: how often each token, and each byte with the ``order`` bytes before it, occurs in ``docs``.

    One of token and gram is null. The end of a document isn't among the tokens.
    With ``train``, n and the tokens are those of the rows it holds for; m counts all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        grams: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

        def out_tokens() -> pa.RecordBatch:
            n = pa.array(list(tokens.values()), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.binary()), pa.nulls(len(tokens), pa.int64()), n, n], ["token", "gram", "n", "m"])
            tokens.clear()
            return batch

        def out_grams(taught: bool) -> pa.RecordBatch:
            key, m = _added(grams[taught])
            grams[taught].clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.binary()), pa.array(key.astype(np.int64)), pa.array(m * taught), pa.array(m)], ["token", "gram", "n", "m"])

        for part, docs_ in _steps(batches):
            teaches = part.column("train").to_pylist()
            for w, t in zip(docs_, teaches, strict=True):
                if t:
                    tokens.update(w)
            if len(tokens) > HELD:
                yield out_tokens()
            for taught in (True, False):
                own = [w for w, t in zip(docs_, teaches, strict=True) if t is taught]
                if not own:
                    continue
                g = grams[taught]
                g.append(np.unique(_keys(own, order)[0], return_counts=True))
                if sum(len(key) for key, _ in g) > 4 * HELD:
                    g[:] = [_added(g)]
                    if len(g[0][0]) > 2 * HELD:
                        yield out_grams(taught)
        if tokens:
            yield out_tokens()
        for taught in (True, False):
            if grams[taught]:
                yield out_grams(taught)

    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.coalesce(F.lit(True) if train is None else train, F.lit(False)).alias("train"))
    rows = rows.mapInArrow(run, "token binary, gram long, n long, m long")
    return rows.groupBy("token", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Trie:
    """Per depth k: byte strings of k + 1 bytes (context and byte), and the contexts with their totals."""

    def __init__(self, table: pd.DataFrame, order: int = ORDER):
        """``table`` has level, gram, n and total: the count of the gram's context with any byte."""
        self.order, self.grams, self.nodes, self.logs = order, [], [], []
        levels = []
        for k in range(order + 1):
            t = table[table.level == k].sort_values("gram")
            gram, n = t.gram.to_numpy().astype(np.uint64), t.n.to_numpy().astype(float)
            context, first, distinct = np.unique(gram >> np.uint64(8), return_index=True, return_counts=True)
            levels.append((gram, n, context, first, distinct, t.total.to_numpy().astype(float)[first], np.add.reduceat(n, first) if len(n) else np.empty(0)))
        with np.errstate(divide="ignore"):
            for k, (gram, n, context, first, distinct, total, kept) in enumerate(levels):
                log = {"n": np.log10(n - 0.5), "den": np.log10(total), "escape": np.log10(total - kept + distinct / 2) - np.log10(total)}
                log["byte"] = log["n"] - log["den"][np.searchsorted(context, gram >> np.uint64(8))]
                if k:
                    # After an escape from here the shorter context has these bytes no more.
                    gram_, n_, context_, _, distinct_, total_, kept_ = levels[k - 1]
                    taken = n_[np.searchsorted(gram_, gram & np.uint64((1 << 8 * k) - 1))]
                    taken = np.add.reduceat(taken, first) if len(taken) else np.empty(0)
                    up = np.searchsorted(context_, context & np.uint64((1 << 8 * (k - 1)) - 1))
                    weight = total_[up] - kept_[up] + (distinct_[up] - distinct) / 2
                    den = total_[up] - taken
                    log["up_den"] = np.log10(den)
                    log["up_escape"] = np.where(weight > 0, np.log10(np.maximum(weight, 1e-300)) - log["up_den"], 0.0)
                self.grams.append(pd.Index(gram))
                self.nodes.append(pd.Index(context))
                self.logs.append(log)
        self.rest = -np.log10(max(1, 256 - len(levels[0][0])))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key after the bytes before it."""
        out = np.zeros(len(keys))
        rest, child = np.arange(len(keys)), np.full(len(keys), -1)
        for k in range(self.order, -1, -1):
            log = self.logs[k]
            key = keys[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = self.grams[k].get_indexer(key)
            seen, after = at >= 0, child >= 0
            if after.any():
                up = self.logs[k + 1]
                i = seen & after
                out[rest[i]] += log["n"][at[i]] - up["up_den"][child[i]]
                i = ~seen & after
                out[rest[i]] += up["up_escape"][child[i]]
            i = seen & ~after
            out[rest[i]] += log["byte"][at[i]]
            left = ~seen
            rest, key, after = rest[left], key[left], after[left]
            child = self.nodes[k].get_indexer(key >> np.uint64(8))
            i = (child >= 0) & ~after
            out[rest[i]] += log["escape"][child[i]]
            if not len(rest):
                break
        out[rest] += self.rest
        return out


def _least(total: int, resolution: int | None) -> int:
    return 1 if resolution is None else max(1, -(-total // resolution))


def gather(counted: DataFrame, order: int = ORDER, resolution: int | None = None) -> pd.DataFrame:
    """The trie's table from ``counts``, to depth ``order`` and no further: with a ``resolution``, at most so many rows for each of the depths."""
    grams = counted.where("gram is not null and n > 0").select(F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = grams.select(F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level"), "gram", "n")
    mask = F.get(F.array(*[F.lit((1 << 8 * (k + 1)) - 1) for k in range(order + 1)]), F.col("level"))
    grams = grams.select("level", F.col("gram").bitwiseAND(mask).alias("gram"), "n").groupBy("level", "gram").agg(F.sum("n").alias("n"))
    context = Window.partitionBy("level", "context")  # 256 rows at most
    grams = grams.withColumn("context", F.shiftright("gram", 8)).withColumn("total", F.sum("n").over(context))
    grams = common.stage(grams.drop("context"), "byte-counts")
    total = grams.where("level = 0").agg(F.sum("n")).first()[0] or 0
    return grams.where(F.col("n") >= _least(total, resolution)).toPandas()


def _branches(gram: np.ndarray, n: np.ndarray, levels: range, least: int) -> list[pd.DataFrame]:
    """The trie's tables at ``levels`` from the counts of whole byte strings, all those with the same context at each of ``levels``."""
    out = []
    for k in levels:
        own, at = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.zeros(len(own), np.int64)
        np.add.at(count, at, n)
        _, first, size = np.unique(own >> np.uint64(8), return_index=True, return_counts=True)
        total = np.repeat(np.add.reduceat(count, first), size) if len(own) else count
        keep = count >= least
        out.append(pd.DataFrame({"level": k, "gram": own[keep].astype(np.int64), "n": count[keep], "total": total[keep]}))
    return out


def gram_scores(counted: DataFrame, order: int = ORDER, resolution: int | None = None) -> DataFrame:
    """gram, m, s: log10 of the probability of each byte string's last byte after those before it, by the whole trie."""
    base = min(order, BASE)
    rows = counted.where("gram is not null").select("gram", "n", "m")
    least = _least(rows.agg(F.sum("n")).first()[0] or 0, resolution)
    top = gather(counted, base, resolution)
    shared = counted.sparkSession.sparkContext.broadcast(top)
    low = (1 << 8 * (BASE + 1)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(x: np.ndarray) -> pa.RecordBatch:
            gram, seen = x[0].astype(np.uint64), x[1] > 0
            trie = Trie(pd.concat([shared.value, *_branches(gram[seen], x[1][seen], range(base + 1, order + 1), least)]), order)
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[2]), pa.array(trie.score(gram))], ["gram", "m", "s"])

        for batch in batches:
            if len(batch):
                held.append(np.stack([batch.column(c).to_numpy() for c in ("gram", "n", "m")]))
            if sum(x.shape[1] for x in held) >= CHUNK:
                # The last context may go on in the next batch.
                x = np.concatenate(held, axis=1)
                context = x[0] >> 8 & low
                at = int(np.flatnonzero(context != context[-1])[-1]) + 1 if (context != context[-1]).any() else 0
                held = [x[:, at:]]
                if at:
                    yield out(x[:, :at])
        if held:
            yield out(np.concatenate(held, axis=1))

    context = F.shiftright("gram", 8).bitwiseAND(low)
    return rows.repartition(context).sortWithinPartitions(context).mapInArrow(run, "gram long, m long, s double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, order: int = ORDER, resolution: int | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row.

    ``train`` tells which rows teach; by default those that ``held_out`` doesn't
    hold for. Null and empty texts are the end alone. Repeated rows count as
    often as they occur. Without training rows every byte is as likely as any
    other, and the base is 0. Memory follows the longest text and the most byte
    strings that share the three bytes before their last. The trie is whole unless a
    ``resolution`` is given.
    """
    if not 0 <= order <= ORDER:
        raise ValueError(f"the order must be 0 to {ORDER}")
    spark = docs.sparkSession
    train = ~held_out(F.col(id_col)) if train is None else train
    kind = docs.schema[id_col].dataType.simpleString()
    teaching = docs.where(train)
    counted = common.stage(counts(docs, order, text_col, train), "counts")
    tokens = counted.where("token is not null").select("token", "n")
    words, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = teaching.count()
    n_all = words + ends
    log_all = float(np.log10(n_all + distinct + (ends > 0) + 1))
    often = max(1, -(-n_all // RESOLUTION))
    frequent = tokens.where(F.col("n") >= often).toPandas()
    grams = common.stage(gram_scores(counted, order, resolution), "gram-scores")
    often_grams = max(1, -(-(grams.agg(F.sum("m")).first()[0] or 0) // SHARED))
    scored = grams.where(F.col("m") >= often_grams).select("gram", "s").toPandas()
    shared = spark.sparkContext.broadcast((scored, dict(zip(map(bytes, frequent.token), np.log10(frequent.n + 1.0), strict=True))))
    end_score, end_known = float(np.log10(ends + 1) - log_all), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value
        frequent_grams, own_scores = pd.Index(table.gram.to_numpy().astype(np.uint64)), np.append(table.s.to_numpy(), 0.0)
        for part, texts in _steps(batches):
            keys, n_bytes = _keys(texts, order)
            at = frequent_grams.get_indexer(keys)
            scores = np.add.reduceat(own_scores[at], np.cumsum(n_bytes) - n_bytes)
            left = np.flatnonzero(at < 0)
            of, key = np.repeat(np.arange(len(texts)), n_bytes)[left], keys[left]
            # A document's number and a string are one number; a step has no more documents than that leaves room for.
            both, times_ = np.unique((of.astype(np.uint64) << np.uint64(8 * (order + 1))) | key, return_counts=True)
            ends_at = pa.array(np.append(0, np.cumsum(np.bincount((both >> np.uint64(8 * (order + 1))).astype(np.int64), minlength=len(texts)))).astype(np.int32))
            rare_grams = [pa.ListArray.from_arrays(ends_at, pa.array(x.astype(np.int64))) for x in (both & np.uint64((1 << 8 * (order + 1)) - 1), times_)]
            base, n_known, rare, times = [], [], [], []
            for w in texts:
                logs = [known.get(x) for x in w]
                own = [x for x in logs if x is not None]
                others = Counter(x for x, y in zip(w, logs, strict=True) if y is None) if len(own) < len(w) else {}
                base.append(sum(own) - len(own) * log_all + end_score)
                n_known.append(len(own) + end_known)
                rare.append(list(others))
                times.append(list(others.values()))
            cols = [part.column("id"), part.column("held_out"), pa.array([len(w) + 1 for w in texts], pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(scores)]
            cols += [pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), *rare_grams]
            yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times", "grams", "gram_times"])

    rows = docs.select(F.col(id_col).alias("id"), (~train).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<long>, grams array<long>, gram_times array<long>")
    rows = common.stage(rows.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rest = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    rest = rest.join(tokens.where(F.col("n") < often), "token", "left")
    rest = rest.groupBy("uid").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - log_all)).alias("rest"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rest_known"),
    )
    deep = rows.select("uid", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("uid", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
    deep = deep.join(grams.where(F.col("m") < often_grams), "gram").groupBy("uid").agg(F.sum(F.col("times") * F.col("s")).alias("deep"))
    return rows.drop("rare", "times", "grams", "gram_times").join(rest, "uid", "left").join(deep, "uid", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("deep", F.lit(0.0))).alias("score"),
    )


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token counts, base and model scores of every document.

    Null and empty texts are the end alone; repeated documents count as often as
    they occur; a null id teaches; no documents give no rows; other columns are
    ignored.
    """
    return score(common.documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
