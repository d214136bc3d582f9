"""Encoding with the tokenizers library, each different chunk once.

Texts are cut where no token can cross. Chunks are told apart by a 64-bit hash of their bytes,
computed for a whole slice of texts at once; a chunk is made a Python string and given to the
library only when its hash is new to this worker. New chunks are encoded many at a time with
a marker between them. The memory of a worker is bounded by REMEMBERED chunks and ids.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable

import numpy as np

from .common import lower_ascii, word_hashes, words

#: Chunks that a worker remembers before it starts again, and chunks in one call of the library.
REMEMBERED, TOGETHER = 1_000_000, 2_048


class ChunkCache:
    """``ids(hashes, text_of)``: (ids of all chunks one after another, number of ids of each)."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], dtype, remembered: int = REMEMBERED):
        self.encode, self.dtype, self.remembered = encode, dtype, remembered
        self.reset()

    def reset(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return at, (self.known[at] == hashes) if len(self.known) else np.zeros(len(hashes), bool)

    def _add(self, hashes: np.ndarray, chunks: list[str]) -> None:
        start, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int32)
        for lo in range(0, len(chunks), TOGETHER):
            for k, ids in enumerate(self.encode(chunks[lo : lo + TOGETHER]), lo):
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.dtype)])
                self.pool[self.used : self.used + len(ids)] = ids
                start[k], size[k] = self.used, len(ids)
                self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = (np.insert(x, at, y) for x, y in ((self.known, hashes), (self.start, start), (self.size, size)))

    def ids(self, hashes: np.ndarray, text_of: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.remembered or self.used > 8 * self.remembered:
            self.reset()
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, hit = self._find(different)
        if not hit.all():
            self._add(different[~hit], [text_of(i) for i in first[~hit].tolist()])
            at, _ = self._find(different)
        sizes = self.size[at].astype(np.int64)[which]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at][which] - (ends - sizes), sizes)
        return self.pool[where], sizes


def split_ids(ids: list[int], separator: int, n: int) -> list[np.ndarray]:
    """The runs between separators."""
    flat = np.array(ids, np.int64)
    cuts = np.flatnonzero(flat == separator)
    if len(cuts) != n - 1:
        raise ValueError("a separator was lost")
    edges = np.concatenate([[-1], cuts, [len(flat)]])
    return [flat[a + 1 : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _unfold(folded: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
    """Gives words beyond ASCII their letters back: the file composes before it folds, and some marks compose with one case only."""
    high = np.concatenate([[0], np.cumsum(data >= 0x80)])
    has = high[end] > high[start]
    if has.any():
        edge = np.zeros(len(data) + 1, np.int8)
        edge[start[has]] += 1
        edge[end[has]] -= 1
        own = np.cumsum(edge[:-1], dtype=np.int8) > 0
        folded[own] = data[own]


def _without_stops(folded: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a last . , ; : ! or ? right after an ASCII letter or digit as two chunks, so that fewer are different."""
    last, ahead = folded[end - 1], folded[np.maximum(end - 2, 0)]
    at = np.flatnonzero((end - start > 1) & _STOP[last] & _PLAIN[ahead])
    cut = end[at] - 1
    return np.insert(start, at + 1, cut), np.insert(end, at, cut), np.insert(row, at + 1, row[at])


_STOP, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[*b".,;:!?"]] = True
_PLAIN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


class WordEncoder:
    """Ids under a tokenizer file that folds case, drops white space and parts letters, digits and other signs before it looks for words.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``. A text that may hold the
    string of a special token is given to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.special = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = "\x01"
        (self.separator,) = self._plain(self.mark)
        self.cache = ChunkCache(self._encode, self.dtype)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        if any(self.mark in c for c in chunks):
            return [np.array(self._plain(c), np.int64) for c in chunks]
        return split_ids(self._plain(f" {self.mark} ".join(chunks)), self.separator, len(chunks))

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """An array of ids for each text."""
        folded = lower_ascii(data)
        start, end, row = words(offsets, folded)
        _unfold(folded, data, start, end)
        start, end, row = _without_stops(folded, start, end, row)
        ids, sizes = self.cache.ids(word_hashes(folded, start, end), lambda i: folded[start[i] : end[i]].tobytes().decode())
        edges = np.concatenate([[0], np.cumsum(np.bincount(row, sizes, len(offsets) - 1))]).astype(np.int64)
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        raw = data.tobytes()
        for mark in set(self.special):
            at = raw.find(mark)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(mark) <= offsets[i + 1]:
                    out[i] = np.array(self._plain(raw[offsets[i] : offsets[i + 1]].decode()), self.dtype)
                at = raw.find(mark, max(at + 1, int(offsets[i + 1])))
        return out


_ENCODERS: dict = {}


def release() -> None:
    """Gives back what encoders remember; for workers that go on to other stages."""
    for x in _ENCODERS.values():
        x.cache.reset()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def encoder(path: str, kind=WordEncoder):
    """The worker's own encoder for a file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = kind(path)
    return _ENCODERS[path, kind]
