"""Which tokens of one tokenizer stand for which of another, in every text and over a corpus.

Both token lists of a text cover the same bytes. B's tokens are a static index of
intervals: their starts and their ends, both sorted. Each token of A asks it by
bisection for the first and the last interval it overlaps. A gap between two tokens
of A is spanned if the last interval of the one is the first of the other; where no
interval spans a gap, tokens of both sides end, and a new group begins. All A tokens
of a group are linked to all its B tokens.

Texts are cut before each blank that follows a character other than white space, for
there both tokenizers always begin a token, whatever stands around; so a group
never goes across. Distinct chunks are encoded, checked and aligned once for each
batch, and remembered up to a limit; a text's groups are those of its chunks in a
row. Vocabularies for which that isn't so are given whole texts.

How many documents hold a pair of ids linked is counted by Spark over all of them.
Pairs with at least one in ``RESOLUTION`` of all such counts, of which there can't be
more than ``RESOLUTION``, are broadcast; a text's other pairs go to their counts by a
shuffle. The result is the same at any bound.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import byte_letters, vocabulary
from .wordpool import gather, steps

#: Characters of text in one step of a task; chunks that a worker remembers.
STEP, REMEMBERED = 3_000_000, 500_000
#: Characters of chunks that are encoded as one text.
BLOCK = 20_000
#: Pairs of ids that are broadcast, at most.
RESOLUTION = 1 << 20
#: Links in a group from which only distinct ids are paired, with how often they stand there.
WIDE = 64
BLANK = "▁"


class Side:
    """A tokenizer: what it makes of " " + chunk, and the bytes of each of its ids."""

    def __init__(self, encode, pieces: list[bytes], apart: bool):
        #: ``apart``: a token begins at each blank that follows a character other than white space.
        self.encode, self.pieces, self.apart = encode, pieces, apart
        self.lens = np.array([len(p) for p in pieces], np.int64)
        self.bytes, self.starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(self.lens) - self.lens
        self.names = pa.array(list(map(str, range(len(pieces)))), pa.string())


def byte_level(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library; special tokens inside texts are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of, vocab = {x: i for i, x in enumerate(byte_letters())}, t.get_vocab()
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
    cut = spec["pre_tokenizer"] or {}
    apart = not spec["normalizer"] and cut.get("type") == "ByteLevel" and bool(cut.get("use_regex")) and not cut.get("add_prefix_space")
    return Side(lambda chunks: [e.ids for e in t.encode_batch_fast([f" {c}" for c in chunks], add_special_tokens=False)], pieces, apart)


def sentence_pieces(path: str) -> Side:
    """A sentencepiece model that puts a blank before each text."""
    from sentencepiece import SentencePieceProcessor

    t = SentencePieceProcessor(model_file=path)
    names = [t.id_to_piece(i) for i in range(t.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if t.IsByte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
    return Side(lambda chunks: t.encode(chunks, num_threads=1), pieces, not any(BLANK in p.lstrip(BLANK) for p in names))


def groups(a_lens: np.ndarray, b_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups begin among A's tokens and among B's, of two token lists that cover the same bytes."""
    a_ends, b_ends = np.cumsum(a_lens), np.cumsum(b_lens)
    a_starts, b_starts = a_ends - a_lens, b_ends - b_lens
    first = np.searchsorted(b_ends, a_starts, "right")
    last = np.searchsorted(b_starts, a_ends, "left") - 1
    begins = np.flatnonzero(np.append(True, last[:-1] != first[1:])[: len(a_lens)])
    return begins, first[begins]


def _joined(strings: pa.Array, n: np.ndarray, by: str) -> pa.Array:
    """Runs of ``n`` strings each, joined."""
    upto = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(upto, strings), by)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())), n


class Aligner:
    """Alignments of texts by way of their distinct chunks."""

    def __init__(self, a: Side, b: Side, remembered: int = REMEMBERED):
        self.a, self.b, self.limit, self.apart = a, b, remembered, a.apart and b.apart
        #: A pair of ids is one number: A's id in front of this many bits for B's.
        self.bits = max(1, len(b.pieces) - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.n = np.empty((0, 5), np.int64)  # tokens of A and B, groups, links, and 1 if the bytes are the text's
        self.text = pa.array([], pa.string())
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.starts, self.lens = np.empty(0, np.int64), np.empty(0, np.int64)

    def _tokens(self, side: Side, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids that ``side`` makes of ``chunks`` in a row, how many each has, and whether each chunk comes back byte by byte.

        Chunks that white space doesn't end are encoded as one text, blocks of them
        at a time: its bytes tell where each of them begins.
        """
        ids: list[np.ndarray] = []
        n, good = np.zeros(len(chunks), np.int64), np.ones(len(chunks), bool)
        open_ = np.fromiter((c[-1:].isspace() or not c for c in chunks), bool, len(chunks))
        alone = np.flatnonzero(open_) if self.apart else np.arange(len(chunks))
        order = []
        if self.apart:
            sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
            together = np.flatnonzero(~open_)
            block = np.cumsum(sizes[together]) // BLOCK
            for own in np.split(together, np.flatnonzero(np.diff(block)) + 1) if len(together) else []:
                text = " ".join([chunks[i] for i in own.tolist()])
                got = np.array(side.encode([text])[0], np.int64)
                data = np.frombuffer(f" {text}".encode(), np.uint8)
                ends = np.cumsum(side.lens[got])
                stops = np.cumsum(np.fromiter((len(chunks[i].encode()) + 1 for i in own.tolist()), np.int64, len(own)))
                if len(got) and ends[-1] == len(data) and np.array_equal(gather(side.bytes, side.starts[got], side.lens[got]), data):
                    ids.append(got)
                    n[own] = np.diff(np.searchsorted(ends, stops, "right"), prepend=0)
                    order.append(own)
                else:
                    alone = np.append(alone, own)
        lists = side.encode([chunks[i] for i in alone.tolist()]) if len(alone) else []
        for i, own in zip(alone.tolist(), lists, strict=True):
            good[i] = b"".join(map(side.pieces.__getitem__, own)) == f" {chunks[i]}".encode()
            n[i] = len(own)
        got, _ = _flat(lists)
        ids, order = np.concatenate([*ids, got]), np.concatenate([*order, alone])
        back = np.argsort(order)
        lens = n[order]
        return gather(ids, (np.cumsum(lens) - lens)[back], n), n, good

    def _learn(self, chunks: list[str]) -> None:
        (a, na, good), (b, nb, good_b) = (self._tokens(side, chunks) for side in (self.a, self.b))
        good &= good_b
        a, b, na, nb = a[np.repeat(good, na)], b[np.repeat(good, nb)], np.where(good, na, 0), np.where(good, nb, 0)
        a0, b0 = groups(self.a.lens[a], self.b.lens[b])
        ga, gb = np.diff(np.append(a0, len(a))), np.diff(np.append(b0, len(b)))
        chunk = np.repeat(np.arange(len(chunks)), na)[a0]
        n_groups = np.bincount(chunk, minlength=len(chunks))
        links = np.zeros(len(chunks), np.int64)
        np.add.at(links, chunk, ga * gb)
        # Pairs of small groups one by one, of wide ones by their distinct ids.
        left, right, of, times = [], [], [], []
        small = np.flatnonzero(ga * gb <= WIDE)
        many = ga[small] * gb[small]
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(small, many)
        left.append(a[a0[at] + k // gb[at]])
        right.append(b[b0[at] + k % gb[at]])
        of.append(chunk[at])
        times.append(np.ones(len(at), np.int64))
        for g in np.flatnonzero(ga * gb > WIDE).tolist():
            x, nx = np.unique(a[a0[g] : a0[g] + ga[g]], return_counts=True)
            y, ny = np.unique(b[b0[g] : b0[g] + gb[g]], return_counts=True)
            left.append(np.repeat(x, len(y)))
            right.append(np.tile(y, len(x)))
            of.append(np.full(len(x) * len(y), chunk[g]))
            times.append(np.outer(nx, ny).ravel())
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        pairs = ((np.concatenate(left) << self.bits) | np.concatenate(right))[order]
        lens = np.bincount(of, minlength=len(chunks))
        self.starts = np.append(self.starts, len(self.pairs) + np.cumsum(lens) - lens)
        self.lens = np.append(self.lens, lens)
        self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, np.concatenate(times)[order])
        both = [_joined(side.names.take(pa.array(x)), n, ",") for side, x, n in ((self.a, a, ga), (self.b, b, gb))]
        self.text = pa.concat_arrays([self.text, _joined(pc.binary_join_element_wise(*both, "|"), n_groups, ";")])
        self.n = np.concatenate([self.n, np.stack([na, nb, n_groups, links, good], axis=1)])

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks of ``texts`` in a row, and how many each text has."""
        split = pc.split_pattern(texts, " ")
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, w = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        # A piece goes on with the one before if that ends in white space, or if it is empty: no cut is sure there.
        open_ = np.fromiter((not x or x[-1].isspace() for x in words), bool, len(words))
        blank = np.fromiter((not x for x in words), bool, len(words))
        joined = np.append(False, open_[w[:-1]])[: len(w)] | blank[w]
        if not self.apart:
            joined[:] = True
        joined[(np.cumsum(n) - n)[n > 0]] = False
        if joined.any():
            of, begins = np.repeat(np.arange(len(n)), n), np.flatnonzero(~joined)
            sizes = np.diff(np.append(begins, len(w)))
            out = w[begins]
            for i in np.flatnonzero(sizes > 1).tolist():
                out[i] = len(words)
                words.append(" ".join([words[j] for j in w[begins[i] : begins[i] + sizes[i]].tolist()]))
            n, w = np.bincount(of[begins], minlength=len(n)), out
        used = np.unique(w)
        if len(used) < len(words):
            w, words = np.searchsorted(used, w), [words[i] for i in used.tolist()]
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(self.n) + len(new) > self.limit:
            self._clear()
            new = np.arange(len(words))
        if len(new):
            at[new] = len(self.n) + np.arange(len(new))
            chosen = [words[i] for i in new.tolist()]
            self.at.update(zip(chosen, at[new].tolist(), strict=True))
            self._learn(chosen)
        return at[w], n

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.ListArray, pa.ListArray]:
        """Of each text the numbers of tokens of A and B, groups and links, its groups as text, its distinct pairs of ids, and how often each is linked.

        Texts that either side doesn't give back byte by byte, and empty ones, have none of these.
        """
        w, n = self._chunks(texts)
        ends = np.cumsum(n)
        good = np.diff(np.append(0, np.cumsum(self.n[w, 4]))[ends], prepend=0) == n
        good &= pc.not_equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        keep = np.repeat(good, n)
        w, n = w[keep], np.where(good, n, 0)
        ends = np.cumsum(n)
        sums = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.n[w, :4], axis=0)])[ends], axis=0, prepend=np.zeros((1, 4), np.int64))
        lens = self.lens[w]
        pair, times = gather(self.pairs, self.starts[w], lens), gather(self.times, self.starts[w], lens)
        of = np.repeat(np.repeat(np.arange(len(n)), n), lens)
        order = np.lexsort((pair, of))
        pair, of, times = pair[order], of[order], times[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]))[: len(pair)])
        upto = pa.array(np.append(0, np.cumsum(np.bincount(of[first], minlength=len(n)))).astype(np.int32))
        total = np.add.reduceat(times, first) if len(first) else times
        return sums, _joined(self.text.take(pa.array(w)), n, ";"), pa.ListArray.from_arrays(upto, pa.array(pair[first])), pa.ListArray.from_arrays(upto, pa.array(total))


@lru_cache(maxsize=2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(byte_level(path_a), sentence_pieces(path_b))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups, pairs and times array<long>: one row for each row of ``docs``.

    A text is taken with a blank before it. ``groups`` is ``a1,a2|b1;a3|b2,b3``, ids
    in order; with ``digest`` the lowercase hex of its SHA-256, for a text without
    tokens the empty string. ``pairs`` are the distinct pairs of linked ids,
    ascending, as a's id times 2^``pair_bits`` plus b's; ``times`` how often each is
    linked. Null and empty texts, and those that the joined bytes of either token
    list differ from, have no tokens: zeros and empty values. A text's memory follows
    its own length and the distinct pairs in it. Repeated rows and ids stay; no rows
    give none; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for at, to in steps(pc.utf8_length(texts).to_pylist(), STEP):
                sums, made, pairs, times = aligner(texts[at:to])
                if digest:
                    made = pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in made.cast(pa.binary()).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id")[at:to], *[pa.array(sums[:, k].copy()) for k in range(4)], made, pairs, times], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_bits(path_b: str) -> int:
    """The bits that B's id takes in a pair."""
    from sentencepiece import SentencePieceProcessor

    return max(1, SentencePieceProcessor(model_file=path_b).get_piece_size() - 1).bit_length()


def pair_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """pair, n, best: in how many rows of ``aligned`` a pair of ids is linked, and whether no pair with the same id of A is in more; ties are all best."""
    counts = common.stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    # One row for each id of A's vocabulary at most.
    most = counts.groupBy(F.shiftright("pair", bits).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.shiftright("pair", bits) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", resolution: int = RESOLUTION) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs``, as ``align`` takes them.

    A pair's count is the number of rows that hold it linked. ``n_best`` are the
    links whose count is the highest of all pairs with their id of A, ``count_sum``
    adds up the counts of all links.
    """
    rows = align(docs, path_a, path_b, id_col, text_col, digest=True).withColumn("row", F.monotonically_increasing_id())
    rows = common.stage(rows, "aligned")
    counts = common.stage(pair_counts(rows, pair_bits(path_b)), "counted-pairs")
    often = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // resolution))
    frequent = F.broadcast(counts.where(F.col("n") >= often))
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    rest = links.join(frequent, "pair", "left_anti").join(counts.where(F.col("n") < often), "pair")
    both = links.join(frequent, "pair").unionByName(rest)
    sums = both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), F.col("groups").alias("groups_sha256")
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Null and empty texts, and those that don't come back byte by byte, have zeros and
    the empty string; repeated rows and ids count as often as they occur; no
    documents give no rows; other columns are ignored.
    """
    rows = link_counts(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return rows.withColumnRenamed("id", "doc_id")
