"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network with calibrated odds.

A word counts as two items: its letters in lower case and its shape (case and
the punctuation around it); both are hashed to buckets, so every word takes part
and tables stay of fixed size. Each bucket has a sparse random index vector of
+1 and -1. A bucket's word vector is the sum of the index vectors of what stands
beside it in all documents, scaled to length 1, plus its own index vector. The
sums are whole numbers, added up by Spark over every document, so they don't
depend on the order of work.

A document is the mean of its words' vectors, the mean of its shapes' vectors,
its share of immediate repeats and its log length. A network with one hidden
layer, in numpy, is fitted to a bounded sample of labelled documents; a part of
that sample is kept aside for the temperature that calibrates its logits.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordpool import steps, strings

WORDS, SHAPES, DIM, ONES = 8192, 1024, 64, 4
#: Labelled documents that the network is fitted to, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.7
STEP, KNOWN = 1_200_000, 1_000_000
PUNCTUATION = string.punctuation + "«»„“”‘’–—…¡¿"


def index_vectors() -> np.ndarray:
    """(WORDS + SHAPES, DIM) with ONES entries of +1 or -1 in each row, from a fixed seed."""
    rng = np.random.default_rng(20240917)
    n = WORDS + SHAPES
    out = np.zeros((n, DIM), np.int8)
    where = np.argsort(rng.random((n, DIM)), axis=1)[:, :ONES]
    np.put_along_axis(out, where, rng.choice(np.array([-1, 1], np.int8), (n, ONES)), axis=1)
    return out


@lru_cache(maxsize=100_000)
def _shape(before: str, kind: str, after: str) -> int:
    return WORDS + crc32(f"{before}{kind}{after}".encode()) % SHAPES


class Items:
    """The buckets of words; distinct words are looked at once and kept up to a limit."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.word, self.shape = np.empty(0, np.int32), np.empty(0, np.int32)

    @staticmethod
    def of(w: str) -> tuple[int, int]:
        """The word's bucket and its shape's: what is before its core, the core's kind, what is after it."""
        core = w if w.isalpha() else w.strip(PUNCTUATION)
        low = core.lower()
        if low == core and core.isalpha():
            kind = "x"
        else:
            kind = "" if not core else "X" if core.isupper() and len(core) > 1 else "Xx" if core[0].isupper() else "9" if core.isdigit() else "x" if core.isalpha() else "m"
        i = 0 if len(core) == len(w) else w.find(core)
        return crc32(low.encode()) % WORDS, _shape(w[:i][:3], kind, w[i + len(core) :][:3])

    def __call__(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all words in a row: word and shape buckets, whether each repeats the one before, and the words per text.

        Only distinct words become Python strings.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.utf8_split_whitespace(texts)
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, order = strings(coded.dictionary), coded.indices.to_numpy()
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(self.at) + len(new) > KNOWN:
            self.at.clear()
            self.word, self.shape, new = self.word[:0], self.shape[:0], np.arange(len(words))
        if len(new):
            own = [words[j] for j in new.tolist()]
            both = np.array([self.of(w) for w in own], np.int32)
            at[new] = len(self.at) + np.arange(len(new))
            self.at.update(zip(own, at[new].tolist(), strict=True))
            self.word, self.shape = np.append(self.word, both[:, 0]), np.append(self.shape, both[:, 1])
        if "" in words:  # what is before a blank at the beginning of a text, and after one at its end
            keep = order != words.index("")
            n = np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
            order = order[keep]
        i = at[order]
        first = (np.cumsum(n) - n)[n > 0]
        repeats = np.append(False, i[1:] == i[:-1])[: len(i)]
        repeats[first] = False
        return self.word[i], self.shape[i], repeats, n


@lru_cache(maxsize=1)
def _items() -> Items:
    """What this worker knows of words, from one task to the next."""
    return Items()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for a, b in steps(pc.utf8_length(texts).to_pylist(), STEP):
            yield batch.slice(a, b - a), texts[a:b]


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, v array<long>: the summed index vectors of what stands beside each bucket, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = _items(), index_vectors()
        where = np.argsort(index == 0, axis=1, kind="stable")[:, :ONES]
        sign = np.take_along_axis(index, where, axis=1).astype(np.float64)
        sums = np.zeros((WORDS + SHAPES) * DIM)
        for _, texts in _texts(batches):
            word, shape, _, n = items(texts)
            if not len(word):
                continue
            doc = np.repeat(np.arange(len(n)), n)
            near = np.flatnonzero(doc[1:] == doc[:-1])
            for a, b in ((word[near], word[near + 1]), (word[near + 1], word[near]), (shape[near], shape[near + 1]), (shape[near + 1], shape[near]), (word, shape)):
                for k in range(ONES):
                    sums += np.bincount(a.astype(np.int64) * DIM + where[b, k], sign[b, k], len(sums))
        sums = sums.reshape(-1, DIM)
        used = np.flatnonzero(sums.any(axis=1))
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * DIM, pa.int32()), pa.array(sums[used].astype(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), v], ["bucket", "v"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, v array<long>")
    total = parts.groupBy("bucket").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM)])
    return total.select("bucket", F.array(*[f"v{i}" for i in range(DIM)]).alias("v"))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(WORDS + SHAPES, DIM): a table of fixed size, whatever the input."""
    out = index_vectors().astype(np.float32)
    for r in context_sums(docs, text_col).collect():
        v = np.array(r.v, np.float32)
        out[r.bucket] = out[r.bucket] / 2 + v / max(float(np.linalg.norm(v)), 1e-9)
    return out


def pool(items: Items, vectors: np.ndarray, texts: pa.Array | list[str]) -> np.ndarray:
    """(texts, 2 * DIM + 2); zeros for a text without words."""
    word, shape, repeats, n = items(texts)
    out = np.zeros((len(texts), 2 * DIM + 2), np.float32)
    ends = np.cumsum(n)
    for at in range(0, len(texts), 128):
        # Counts of buckets by document, times the buckets' vectors.
        own, m = n[at : at + 128], min(128, len(texts) - at)
        rows = slice(ends[at] - n[at], ends[at + m - 1])
        doc = np.repeat(np.arange(m), own)
        some = np.maximum(own, 1)[:, None].astype(np.float32)
        for ids, low, size, to in ((word, 0, WORDS, 0), (shape, WORDS, SHAPES, DIM)):
            count = np.bincount(doc * size + (ids[rows] - low), minlength=m * size).reshape(m, size).astype(np.float32)
            out[at : at + m, to : to + DIM] = count @ vectors[low : low + size] / some
        out[at : at + m, 2 * DIM] = np.bincount(doc, repeats[rows], m) / some[:, 0]
    out[:, 2 * DIM + 1] = np.log1p(n) / 10
    return out


class Network:
    """Inputs scaled to mean 0 and deviation 1, a hidden layer of tanh, one logit divided by the temperature."""

    def __init__(self, hidden: int = 32, epochs: int = 60, seed: int = 7):
        self.hidden, self.epochs, self.seed = hidden, epochs, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(self.seed)
        if len(y) < 10 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.constant = None
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.std
        aside = rng.random(len(y)) < 0.2
        own, labels = z[~aside], y[~aside]
        d = x.shape[1]
        w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(self.epochs):
            for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 256)):
                a, b = own[batch], labels[batch]
                h = np.tanh(a @ w[0] + w[1])
                g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - b) / len(b)
                back = g[:, None] * w[2] * (1 - h * h)
                grads = [a.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ g + 1e-4 * w[2], g.sum(keepdims=True)]
                t += 1
                rate = 0.01 * (1 - epoch / self.epochs) + 1e-4
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        self.temperature = 1.0
        if aside.any():
            logit = self._logit(x[aside])
            grid = np.exp(np.linspace(np.log(0.5), np.log(20), 120))
            loss = [np.mean(np.logaddexp(0, -np.where(y[aside] > 0, 1, -1) * logit / s)) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.std) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -35, 35)))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs`` and a network for ``labels`` (``id_col``, quality 0 or 1).

    Held-out ids, null ids and null labels teach nothing; an id with several
    labels has their maximum. Of more than ``sample`` labelled ids those with
    the smallest hashes are taken; of documents that share an id the one whose
    text has the smallest hash, so the driver gets ``sample`` rows at most. With fewer than 10
    examples or one class, all scores are the mean label, 0.5 if there is none.
    """
    vectors = word_vectors(docs, text_col)
    usable = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    usable = usable.orderBy(F.xxhash64("id"), "id").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items()
        for part, texts in _texts(batches):
            x = pool(items, shared.value, texts)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), part.column("hash"), rows], ["id", "y", "hash", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash")).join(F.broadcast(usable), "id")
    rows = chosen.select("id", "y", "hash", "text").mapInArrow(run, f"id {kind}, y int, hash long, x array<float>")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("y", "x"), "hash").alias("r")).select("id", "r.y", "r.x").toArrow()
    rows = rows.sort_by("id")
    y = rows.column("y").to_numpy().astype(float)
    x = rows.column("x").combine_chunks()
    return vectors, Network().fit(x.values.to_numpy(zero_copy_only=False).reshape(len(y), -1).astype(float) if len(y) else np.empty((0, 2 * DIM + 2)), y)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; higher: label 1 is likelier.

    Null and empty texts have one as well, equal texts the same; repeated rows and
    all other columns stay; a column ``name`` is replaced; no rows give none.
    """
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        items = _items()
        for batch in batches:
            texts = pc.fill_null(batch.column(text_col), "")
            found = [network.predict(pool(items, vectors, texts[a:b]).astype(float)) for a, b in steps(pc.utf8_length(texts).to_pylist(), STEP)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*found, np.empty(0)]))], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op2_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels teach only outside the held-out quarter.

    Null and empty texts are scored, repeated rows and ids stay, a null id isn't held
    out; no documents give no rows; other columns are ignored.
    """
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
