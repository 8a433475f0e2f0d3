"""Byte-pair encoding and decoding with a public vocabulary, by batched numpy merge rounds.

The symbols of many words lie in one flat array. In a round, every neighbouring
pair's key is looked up by binary search in the sorted keys of all merges; each
word joins the occurrences of its lowest-ranked pair, from left to right; words
without a pair leave. Rounds go on until no word is left, so a batch of a
hundred thousand words takes some tens of rounds, whatever it holds.

The vocabulary is read by each Python worker from a path that is a parameter; it
must be a byte-level BPE with word ends (``</w>``), lower case, as in
``word_bpe_49k.json``.

Words are cut by the vocabulary's own pattern. Some characters are letters or marks
to the tokenizers library and not to Python, whose tables are of other Unicode
versions, or the other way round; the library's normalizer and pre-tokenizer are
asked to cut the words that hold such characters. For all others the tables agree,
which tests show for every code point there is.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordpool import PieceCache, WordPool, steps

#: Characters of text that one numpy step works on.
STEP = 3_000_000
#: Words, and pieces of words, that a worker remembers: its memory, beside those of what else runs in it.
WORDS, PIECES = 400_000, 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def unsettled(path: str) -> re.Pattern:
    """Any character that Python's tables and the library's may tell apart.

    Those are the ones Python has no entry for, and the marks and parts of
    composed letters that the library's normalizer doesn't order or compose alike.
    """
    # A flag for each code point: a set of the nearly a million that have no entry would take a worker 60 MB.
    normal, codes, page = library(path).normalizer.normalize_str, np.zeros(0x110000, bool), 0x1000
    for first in range(0, len(codes), page):
        own = list(map(chr, range(first, first + page)))
        kinds = "".join(map(unicodedata.category, own))
        codes[first : first + page] |= np.frombuffer(kinds.encode(), "S2") == b"Cn"
        if not kinds.replace("Cn", "").replace("Co", ""):
            continue
        for c in (c for c, kind in zip(own, kinds[::2], strict=True) if kind == "M"):
            if unicodedata.combining(c):
                # The mark of the first string has the highest class but one, that of the second the lowest.
                alike = [normal(x) == unicodedata.normalize("NFC", x).lower() for x in (f"\u0345{c}", f"{c}\u0334")]
                codes[ord(c)] |= not all(alike)
        for c, parts in zip(own, map(unicodedata.decomposition, own), strict=True):
            if parts and parts[0] != "<" and not (unicodedata.category(c)[0] == "M" and unicodedata.combining(c)):
                whole = "".join(chr(int(x, 16)) for x in parts.split())
                codes[[ord(c), *map(ord, whole)]] |= normal(whole) != unicodedata.normalize("NFC", whole).lower()
    codes = np.flatnonzero(codes)
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return re.compile("[" + "".join(f"\\U{x[0]:08x}-\\U{x[-1]:08x}" for x in runs) + "]")


class Bpe:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or spec["decoder"] is not None or spec["post_processor"] is not None or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain word-end BPE vocabulary")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.arrow_tokens = pa.array(self.tokens, pa.string())
        self.words = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self.specials = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters()
        self.byte_of = {x: i for i, x in enumerate(letters)}
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.end] for x in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        rank = np.arange(len(pairs))
        born = np.full(len(self.tokens), -1)
        np.maximum.at(born, made, rank)
        # Joining all occurrences at once equals joining one by one only if no merge uses a token that a later one makes.
        if not (np.all(born[a] < rank) and np.all(born[b] < rank)):
            raise ValueError(f"{path}: merges are not in the order in which their tokens arise")
        self.size = len(self.tokens)
        keys = a * self.size + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], rank[order], made[order]

    def cut(self, words: list[str]) -> list[str | int]:
        """The pieces of blank-separated words and the ids of special tokens in a row, with a line break after each word.

        All words go through normalization and pattern as one text with a line break after each.
        """
        text = "\n".join([*words, ""])
        if self.specials and self.specials.search(text):
            out: list = []
            for w in words:
                for part in self.specials.split(w):
                    out += [self.special[part]] if part in self.special else self.cut([part])[:-1]
                out.append("\n")
            return out
        # A pattern of single characters: each that occurs is asked about once, as it is slow over a whole text.
        if not text.isascii() and (strange := unsettled(self.path)).search("".join(set(text))):
            return [p for w in words for p in [*(self._asked(w) if strange.search(w) else self.cut([w])[:-1]), "\n"]]
        # One letter at a time: a capital sigma never becomes a final one.
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.words.findall(low)

    def _asked(self, word: str) -> list[str]:
        """A word's pieces as the library cuts it; it gives them as letters that stand for bytes."""
        own = library(self.path)
        cut = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(word))
        return [bytes(self.byte_of[x] for x in piece).decode() for piece, _ in cut]

    def merge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        pieces = [t.encode() for t in texts]
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sym, ends = self.first[data], np.cumsum(lens)
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), lens)
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], self.size * 2), self.size * 2)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            joined = (rank == np.repeat(best, sizes)) & (rank < self.size * 2)
            # Of overlapping occurrences (a a a) every second one, from the left, within a run.
            i = np.flatnonzero(joined)
            if len(i) > 1:
                run = np.maximum.accumulate(np.where(np.diff(i, prepend=-2) == 1, 0, np.arange(len(i))))
                i = i[(np.arange(len(i)) - run) % 2 == 0]
            stay = np.repeat(best < self.size * 2, sizes)
            sym[i] = self.made[at[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            out = ~stay
            done_sym.append(sym[out])
            done_word.append(word[out])
            keep &= stay
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate([*done_sym, np.empty(0, np.int64)]), np.concatenate([*done_word, np.empty(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(pieces))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens' strings joined by one space, as a vocabulary without a decoder gives them."""
        picked = pa.ListArray.from_arrays(ids.offsets, self.arrow_tokens.take(ids.values))
        return pc.binary_join(picked, " ")


@lru_cache(maxsize=2)
def _bpe(path: str) -> tuple[Bpe, WordPool]:
    bpe = Bpe(path)
    return bpe, WordPool(PieceCache(bpe.cut, bpe.merge, PIECES), WORDS)


def _ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    _, pool = _bpe(path)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for start, end in steps(pc.utf8_length(texts).to_pylist(), STEP):
            flat, n = pool(texts[start:end])
            yield batch.slice(start, end - start), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, ids array<int> and, if asked for, decoded string: one row for each input row.

    A null or empty text has the empty array and decodes to the empty string.
    Repeated ids and rows are kept. Text is worked on in steps of ``STEP``
    characters, so memory follows the longest text, not the batch. Other columns
    are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _ids(batches, path):
            cols = [part.column("id"), ids, *([_bpe(path)[0].decode(ids)] if decoded else [])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "decoded"][: len(cols)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """id and decoded, from id and ids; null ids decode to the empty string, unknown ids raise."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _bpe(path)
        for batch in batches:
            ids = batch.column("ids")
            ids = pa.ListArray.from_arrays(ids.offsets, ids.values) if ids.offset == 0 else pa.array(ids.to_pylist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), bpe.decode(ids)], ["id", "decoded"])

    filled = encoded.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return filled.mapInArrow(run, f"id {kind}, decoded string")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on this machine, and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


def op6_numpy_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of every text's ids and of what they decode to.

    Null and empty texts have no ids and decode to the empty string; repeated rows
    and ids stay; no documents give no rows; other columns are ignored.
    """
    rows = encode(common.documents(spark, sf_dir), vocabulary(), decoded=True)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
