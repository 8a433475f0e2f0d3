"""Token ids of many texts by way of their distinct words, in bounded memory.

A tokenizer that never joins or looks across blanks gives a text the ids of its
blank-separated words, one after the other. So each distinct word is encoded once
per batch (and kept for later batches up to a limit), and a text's ids are
gathered from a flat pool with numpy. The blanks are space, tab, line feed and
carriage return, which every tokenizer here takes for white space and which take
part in no composition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and pieces of words, that a worker remembers unless told otherwise: its memory, beside those of what else runs in it.
WORDS, PIECES = 300_000, 400_000


def steps(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; a larger row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def gather(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The pieces of ``pool`` with these starts and lengths, in a row."""
    ends = np.cumsum(lens)
    return pool[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


def strings(words: pa.Array) -> list[str]:
    """The strings of an array without nulls and line breaks: cut from one long string, which is much faster than one by one."""
    if not len(words):
        return []
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(row, "\n")[0].as_py().split("\n")


class _Known:
    """The ids of keys that were met, in one flat array. ``used`` tells which were met again after they were learned."""

    def __init__(self, limit: int):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict = {}
        self.ids, self.starts, self.lens, self.used = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def _learn(self, keys: list, ids: np.ndarray, lens: np.ndarray) -> None:
        self.at.update(zip(keys, range(len(self.at), len(self.at) + len(keys)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lens) - lens)
        self.ids, self.lens, self.used = np.concatenate([self.ids, ids]), np.append(self.lens, lens), np.append(self.used, np.zeros(len(keys), bool))

    def _forget(self) -> None:
        """Keeps what was met again, as most keys of a large corpus are met once; nothing where that is over half the limit."""
        keep = np.flatnonzero(self.used)
        if len(keep) > self.limit // 2:
            return self._clear()
        # Keys lie in the dictionary in the order of their places.
        keys = list(compress(self.at, self.used.tolist()))
        ids, lens = gather(self.ids, self.starts[keep], self.lens[keep]), self.lens[keep]
        _Known._clear(self)
        self._learn(keys, ids, lens)


class PieceCache(_Known):
    """Encodes words by way of their distinct pieces, of which there are fewer; pieces are kept up to a limit."""

    def __init__(self, cut: Callable[[list[str]], list], encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = PIECES):
        """``cut`` gives the pieces of all words in a row with a line break after each word; a number is an id already. ``encode`` takes the others."""
        self.cut, self.encode = cut, encode
        super().__init__(limit)

    def _clear(self) -> None:
        super()._clear()
        # The line break that ends a word has no ids.
        self._learn(["\n"], np.empty(0, np.int32), np.zeros(1, np.int64))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        pieces = self.cut(words)
        p = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.used[p[p >= 0]] = True
        fresh = [pieces[i] for i in np.flatnonzero(p < 0).tolist()]
        new = list(dict.fromkeys(fresh))
        if len(self.at) + len(new) > self.limit:
            self.used[0] = True
            self._forget()
            p = np.fromiter(map(self.at.get, pieces, repeat(-1)), np.int64, len(pieces))
            fresh = [pieces[i] for i in np.flatnonzero(p < 0).tolist()]
            new = list(dict.fromkeys(fresh))
        if new:
            plain, numbers = [x for x in new if not isinstance(x, int)], [x for x in new if isinstance(x, int)]
            ids, lens = self.encode(plain) if plain else (np.empty(0, np.int32), np.empty(0, np.int64))
            self._learn([*plain, *numbers], np.append(ids, np.array(numbers, np.int32)), np.append(lens, np.ones(len(numbers), np.int64)))
            p[p < 0] = np.fromiter(map(self.at.__getitem__, fresh), np.int64, len(fresh))
        lens = self.lens[p]
        return gather(self.ids, self.starts[p], lens), np.diff(np.cumsum(lens)[p == 0], prepend=0)


class WordPool(_Known):
    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = WORDS):
        """``encode`` turns words into (all their ids in a row, how many each has)."""
        self.encode = encode
        super().__init__(limit)

    def __call__(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has. Only distinct words become Python strings."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        words = strings(coded.dictionary)
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        self.used[at[at >= 0]] = True
        if len(self.at) + np.count_nonzero(at < 0) > self.limit:
            self._forget()
            at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            at[new] = len(self.at) + np.arange(len(new))
            fresh = [words[i] for i in new.tolist()]
            self._learn(fresh, *self.encode(fresh))
        w = at[coded.indices.to_numpy()]
        lens = self.lens[w]
        upto = np.append(0, np.cumsum(lens))[np.cumsum(n)]
        return gather(self.ids, self.starts[w], lens), np.diff(upto, prepend=0)
