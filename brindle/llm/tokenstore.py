"""A content-addressed store of token ids.

Each document's ids are cut into chunks where a rolling hash of the last few ids
has its low bits zero, so equal passages in different documents give equal
chunks. A chunk's address is the SHA-256 of its bytes, and each chunk is stored
once. The store is three Parquet datasets:

* ``chunks``: hash binary, payload binary (ids as little-endian unsigned integers of ``width`` bytes), and where
  the chunk stands first (doc, pos), and whether it stands elsewhere, too (shared)
* ``recipes``: shard, doc (the document's key in the store), doc_id, start, n_tokens, hashes array<binary>, root; in
  ascending doc_id order
* ``manifest``: level, node, root, width: a Merkle tree over the recipes' roots, 1,024 or fewer to a node

Reading checks every chunk against its address, every recipe against its root,
the whole tree against the manifest, and every document's chunks against its
recipe. As most chunks stand in one place, writing and reading move payloads of
shared chunks only; a document's own chunks go straight to it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import Bpe, library, vocabulary
from .wordpool import PieceCache, WordPool, gather, steps

#: A chunk ends where the low BITS bits of the rolling hash are zero: 256 ids on average, within these bounds.
BITS, SHORTEST, LONGEST = 8, 32, 2048
#: Recipes in a shard, and nodes under a node of the Merkle tree.
SHARD, FANOUT = 8_192, 1_024
#: Characters of text in one step; chunk hashes a task remembers so as not to send a payload twice.
STEP, SEEN = 3_000_000, 200_000
#: The first letter beyond those that the words of Latin scripts are cut by here.
LATIN = "\u0250"
#: Marks of chunks with copies that are broadcast; beyond that they are joined by shuffle.
BROADCAST_MARKS = 1_000_000


def merger(whole):
    """The tokenizer ``whole`` for pieces that it, or ``Bpe``, has normalized and cut, with a space between any two: its model alone, which both share."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

    own = Tokenizer(whole.model)
    own.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
    return own


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The vocabulary's size, and what turns texts into (all ids in a row, how many each text has)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    # The one that words are cut with: a second copy would take a worker 40 MB.
    t = library(path)
    t.no_truncation()
    t.no_padding()

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int32, int(n.sum())), n

    try:
        cut = Bpe(path)
    except (ValueError, KeyError, TypeError):  # another kind of vocabulary: whole texts
        return t.get_vocab_size(), lambda texts: encode(texts.to_pylist())
    is_end = np.array([x.endswith(cut.end) for x in cut.tokens])
    merge = merger(t)

    def pieces(words: list[str]) -> list:
        # Words of Latin letters are cut here as the library cuts them; others are left to it whole.
        if max(map(max, filter(None, words)), default="") < LATIN:
            return cut.cut(words)
        own = [w.isascii() or max(w) < LATIN for w in words]
        got = cut.cut([w if o else "" for w, o in zip(words, own, strict=True)])
        ends = (i for i, p in enumerate(got) if p == "\n")
        for o, w, i in zip(own, words, ends, strict=True):
            if not o:
                got[i] = ((w,), "\n")
        return list(chain.from_iterable(p if isinstance(p, tuple) and isinstance(p[0], tuple) else (p,) for p in got))

    def encode_pieces(new: list) -> tuple[np.ndarray, np.ndarray]:
        ids, n, order = [], [], []
        plain = [i for i, p in enumerate(new) if isinstance(p, str)]
        for at in range(0, len(plain), 20_000):
            # The spaces between pieces are dropped and every piece ends with a token that says so.
            own = plain[at : at + 20_000]
            got = np.array(merge.encode_batch_fast([" ".join([new[i] for i in own])], add_special_tokens=False)[0].ids, np.int32)
            ids.append(got)
            n.append(np.diff(np.flatnonzero(is_end[got]), prepend=-1))
            order += own
        if others := [i for i, p in enumerate(new) if not isinstance(p, str)]:
            got, each = encode([new[i][0] for i in others])
            ids.append(got)
            n.append(each)
            order += others
        ids, n = np.concatenate(ids), np.concatenate(n)
        back = np.argsort(order)
        return gather(ids, (np.cumsum(n) - n)[back], n[back]), n[back]

    return t.get_vocab_size(), WordPool(PieceCache(pieces, encode_pieces))


def gear(size: int) -> np.ndarray:
    """A fixed pseudo-random number for each token id."""
    x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def cuts(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """Where each document's chunks end, counted from its start. ``ids`` has all documents in a row."""
    g = table[ids]
    h = g.copy()
    for k in range(1, BITS):
        h[k:] += g[:-k] << np.uint32(k)
    marks = np.flatnonzero((h & np.uint32((1 << BITS) - 1)) == 0) + 1
    out = []
    for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
        own, last, ends = marks[np.searchsorted(marks, a) : np.searchsorted(marks, b, "right")] - a, 0, []
        for m in [*own.tolist(), int(b - a)]:
            while m - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if m - last >= SHORTEST or m == b - a and m > last:
                ends.append(last := m)
        out.append(np.array(ends, np.int64))
    return out


def chunked(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, hashes, has, payloads: a document's chunks in order; a payload is null, and has false, where its task has sent it before."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, encode = _encoder(path)
        table, seen, width = gear(max(size, end_id + 1)), set(), width_of(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for at, to in steps(pc.utf8_length(texts).to_pylist(), STEP):
                flat, n = encode(texts[at:to])
                ids = np.insert(flat, np.cumsum(n), end_id)
                n = n + 1
                data = ids.astype(f"<u{width}")
                hashes, has, payloads = [], [], []
                for a, ends in zip(np.cumsum(n) - n, cuts(ids, np.cumsum(n) - n, table), strict=True):
                    own_h, own_p = [], []
                    for s, e in zip([0, *ends[:-1]], ends, strict=True):
                        raw = data[a + s : a + e].tobytes()
                        own_h.append(key := hashlib.sha256(raw).digest())
                        own_p.append(None if key in seen else raw)
                        seen.add(key)
                    hashes.append(own_h)
                    payloads.append(own_p)
                    has.append([p is not None for p in own_p])
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([batch.column("id")[at:to], pa.array(n, pa.int64()), pa.array(hashes, pa.list_(pa.binary())), pa.array(has, pa.list_(pa.bool_())), pa.array(payloads, pa.list_(pa.binary()))], ["id", "n_tokens", "hashes", "has", "payloads"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, hashes array<binary>, has array<boolean>, payloads array<binary>")


def width_of(path: str) -> int:
    return 2 if _encoder(path)[0] <= 1 << 16 else 4


def _root(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def _hash_list(hashes: Column) -> Column:
    return _root(F.transform(hashes, lambda h: F.hex(h)))


def _tree(shards: DataFrame) -> DataFrame:
    """All levels of the Merkle tree over (node, root): level 0 are the shards, the last has one node."""
    level, levels = shards.select(F.lit(0).alias("level"), "node", "root"), []
    while True:
        levels.append(level := common.stage(level, "merkle"))
        if level.count() <= 1:
            break
        up = level.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("under"))
        level = up.select(F.lit(len(levels)).alias("level"), F.col("up").alias("node"), _root(F.col("under.root")).alias("root"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


def _shard_roots(recipes: DataFrame) -> DataFrame:
    inside = recipes.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("start", "root"))).alias("docs"))
    return inside.select(F.col("shard").alias("node"), _root(F.col("docs.root")).alias("root"))


def write(docs: DataFrame, store: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store. A null or empty text is the end id alone; repeated ids are kept, in an order that follows from content; no rows give empty datasets."""
    spark = docs.sparkSession
    made = chunked(docs, path, end_id, id_col, text_col).withColumn("doc", F.monotonically_increasing_id())
    parts = spark.read.parquet(_write(made, f"{store}/parts"))
    n = parts.count()
    parts = parts.withColumn("bucket", common.id_buckets(parts, "id", max(1, -(-n // (64 * SHARD))), F.xxhash64("hashes")))
    refs = parts.select("doc", F.posexplode(F.arrays_zip("hashes", "has")).alias("pos", "c"))
    refs = refs.select("doc", "pos", F.col("c.hashes").alias("hash"), F.col("c.has").alias("has"))
    # A chunk's home is the first place that has its payload; the other places that have it lose theirs.
    place = F.struct("doc", "pos")
    many = refs.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.when(F.col("has"), place)).alias("home"), F.collect_list(F.when(F.col("has"), place)).alias("having")).where("n > 1")
    marks = many.select("home", F.explode("having").alias("at")).select("at.doc", "at.pos", (F.col("at") != F.col("home")).alias("extra"))
    marks = common.stage(marks, "marks")
    if marks.count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    held = parts.select("doc", F.posexplode(F.arrays_zip("hashes", "payloads")).alias("pos", "c")).where("c.payloads is not null")
    held = held.join(marks, ["doc", "pos"], "left").where("not coalesce(extra, false)")
    _write(held.select(F.col("c.hashes").alias("hash"), F.col("c.payloads").alias("payload"), "doc", "pos", F.col("extra").isNotNull().alias("shared")), f"{store}/chunks")
    order = [F.col("id").asc_nulls_first(), F.col("n_tokens"), F.col("hashes")]
    w = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row for each bucket: their number follows the rows / SHARD, not the rows.
    before = parts.groupBy("bucket").agg(F.sum("n_tokens").alias("all"))
    before = before.select(F.col("bucket").alias("shard"), (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("offset"))
    placed = parts.select("bucket", "doc", "id", "n_tokens", "hashes", (F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("inside"))
    recipes = placed.join(before, placed["bucket"] == before["shard"]).select("shard", "doc", F.col("id").alias("doc_id"), (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "hashes", _hash_list(F.col("hashes")).alias("root"))
    _write(recipes.repartitionByRange("shard", "start").sortWithinPartitions("start"), f"{store}/recipes")
    _write(_tree(_shard_roots(spark.read.parquet(f"{store}/recipes"))).withColumn("width", F.lit(width_of(path))), f"{store}/manifest")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/parts")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _write(df: DataFrame, path: str) -> str:
    df.write.option("compression", "zstd").parquet(path)
    return path


def verify(spark: SparkSession, store: str) -> None:
    """Recomputes every root from the recipes up; raises ValueError where the manifest differs."""
    recipes, manifest = spark.read.parquet(f"{store}/recipes"), spark.read.parquet(f"{store}/manifest")
    wrong = recipes.where(_hash_list(F.col("hashes")) != F.col("root")).limit(1).count()
    tree, known = _tree(_shard_roots(recipes)), manifest.select("level", "node", F.col("root").alias("known"))
    wrong += tree.join(known, ["level", "node"], "full").where(~F.col("root").eqNullSafe(F.col("known"))).limit(1).count()
    if wrong:
        raise ValueError(f"the recipes in {store} don't match their manifest")


def read(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary: little-endian unsigned 32-bit integers), rebuilt from the chunks and checked."""
    verify(spark, store)
    first = spark.read.parquet(f"{store}/manifest").select("width").first()
    width = first[0] if first else 4
    chunks = spark.read.parquet(f"{store}/chunks")
    intact = F.sha2("payload", 256) == F.lower(F.hex("hash"))
    chunks = chunks.select("doc", "pos", "hash", "shared", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("a chunk doesn't match its address"))).alias("payload"))
    recipes = spark.read.parquet(f"{store}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    refs = recipes.select("doc", F.posexplode("hashes").alias("pos", "hash"))
    away = refs.join(chunks.select("doc", "pos"), ["doc", "pos"], "left_anti").join(chunks.where("shared").select("hash", "payload"), "hash")
    cols = ["doc", "pos", "hash", "payload"]
    whole = chunks.select(*cols).unionByName(away.select(*cols)).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "payload"))).alias("parts"))
    # A document has the end id at least, so none is without chunks.
    whole = recipes.select("doc", "doc_id", "start", "n_tokens", "hashes").join(whole, "doc", "left")
    good = F.col("parts.hash").eqNullSafe(F.col("hashes"))
    parts = F.when(good, F.col("parts.payload")).otherwise(F.raise_error(F.lit("a document's chunks differ from its recipe")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), f"<u{width}").astype("<u4").tobytes() for p in batch.column("parts").to_pylist()]
            n = [len(x) // 4 for x in ids]
            if n != batch.column("n_tokens").to_pylist():
                raise ValueError("a document's chunks don't add up to its recipe's length")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return whole.select("doc_id", "start", "n_tokens", parts.alias("parts")).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def op3_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from a store in the shared folder that holds all ids.

    Null and empty texts are the end id alone; null ids come first, equal ones are
    in an order that follows from content; no documents give no rows; other columns are
    ignored. The store goes with what is staged.
    """
    store = f"{common.shared_dir(spark).rstrip('/')}/tokens-{common.uuid.uuid4().hex}"
    common.to_discard(store)
    write(common.documents(spark, sf_dir), store, vocabulary())
    return read(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
