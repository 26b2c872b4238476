"""Encode a batch of texts through a dictionary of their white-space-led chunks.

A chunk is a run of separators and the run of other bytes after it. Tokenizers
that never let a piece run from a non-separator into a separator give a text the
concatenation of what they give its chunks, so each distinct chunk is encoded
once per worker and the rest is array arithmetic over the batch's UTF-8 buffer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes of a chunk that its key mixes by position (longer ones are keyed by their bytes); bytes of chunks looked up at a time.
SPAN, BLOCK = 96, 1 << 21
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, size=(SPAN, 256), dtype=np.uint64)
_CHECK = np.random.default_rng(20250301).integers(0, 2**32, size=(SPAN, 256), dtype=np.uint32)


_RESIDENT: dict = {}


def resident(key, make: Callable):
    """What ``make`` gives, kept in this worker until another key is asked for: one large cache a worker, not one for each model."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (nulls empty) and its n + 1 offsets."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of chunks, and the number of the first chunk of each text (n + 1)."""
    gap = separator[data]
    first = np.zeros(len(data) + 1, bool)
    if len(data):
        first[1:-1] = gap[1:] & ~gap[:-1]
    first[offsets[:-1]] = True
    first[-1] = False
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


class ChunkCache:
    """What ``encode`` gives each distinct chunk: uint32 values flat in one pool, and how many for each."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], separators: bytes, most: int = 300_000):
        self.encode, self.most = encode, most
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.check = np.zeros(1 << 16, np.uint32)  # of the chunks that are found by key

    def _add(self, chunks: list[bytes]) -> None:
        got, sizes = self.encode(chunks)
        total, n = len(got), len(sizes)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + n > len(self.start):
            self.start, self.size, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.check))
        self.pool[self.used : self.used + total] = got
        self.size[self.known : self.known + n] = sizes
        self.start[self.known : self.known + n] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = self.used + total, self.known + n

    def lookup(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk its number in the pool's tables; the first chunk of each text."""
        if self.known > self.most:
            self._clear()
        starts, firsts = split(data, offsets, self.separator)
        if not len(starts):
            return np.zeros(0, np.int64), firsts
        ends = np.append(starts[1:], len(data))
        edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), BLOCK)), len(starts)))
        return np.concatenate([self._numbers(data, starts[a:b], ends[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]), firsts

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), -1, np.int64)
        sizes = ends - starts
        short = np.flatnonzero(sizes <= SPAN)
        if len(short):
            size = sizes[short]
            begin = np.cumsum(size) - size
            at = np.arange(int(size.sum())) - np.repeat(begin, size)
            byte = data[at + np.repeat(starts[short], size)]
            keys = np.add.reduceat(_TABLE[at, byte], begin) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            checks = np.add.reduceat(_CHECK[at, byte], begin, dtype=np.uint32)
            distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
            get = self.index.get
            numbers = np.array([get(k, -1) for k in distinct.tolist()], np.int64)
            new = np.flatnonzero(numbers < 0)
            if len(new):
                some = short[where[new]]
                first = self.known
                self._add([data[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
                numbers[new] = first + np.arange(len(new))
                self.check[numbers[new]] = checks[where[new]]
                self.index.update(zip(distinct[new].tolist(), numbers[new].tolist(), strict=True))
            found = numbers[back]
            same = (self.check[found] == checks)  # another chunk of equal key goes by its bytes
            out[short[same]] = found[same]
        named = {i: data[starts[i] : ends[i]].tobytes() for i in np.flatnonzero(out < 0).tolist()}
        missing = [c for c in dict.fromkeys(named.values()) if c not in self.index]
        if missing:
            first = self.known
            self._add(missing)
            self.index.update((c, first + i) for i, c in enumerate(missing))
        for i, c in named.items():
            out[i] = self.index[c]
        return out

    def flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pool values of the given chunks one after another, and where each begins (n + 1)."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.start[numbers] - (ends - sizes), sizes)
        return self.pool[places], np.concatenate([[0], ends]).astype(np.int64)
