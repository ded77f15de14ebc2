"""Words, lines and rolling hashes of whole Arrow batches in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All functions work on the
bytes of many texts at once; no function looks at one word at a time.  Hashes are 64-bit:
a polynomial of the bytes modulo 2^64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every span."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold ``most`` bytes, or one text if that is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > begin and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    """Words of many texts: where they are in ``data``, and the text each one belongs to."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first word of every text, and the number of words

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def _edges(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of ``keep``; runs never cross a text's border."""
    size = len(keep)
    opens, shuts = keep.copy(), keep.copy()
    opens[1:] &= ~keep[:-1]
    shuts[:-1] &= ~keep[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < size)]
    opens[inner] = keep[inner]
    shuts[inner - 1] = keep[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(shuts) + 1


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    starts, ends = _edges(~_SPACE[data], offsets)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; lines are cut at newlines only, none is left out."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    rows = np.arange(len(offsets) - 1)
    by_start = np.lexsort((starts, np.concatenate([rows, row])))
    by_end = np.lexsort((ends, np.concatenate([row, rows])))
    return starts[by_start], ends[by_end], np.concatenate([rows, row])[by_start]


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``n`` words of one text, and the word that it starts at."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(size, np.uint64)
    for i in range(n):
        total *= _BASE
        total += hashes[i : i + size]
    last = np.repeat(first[1:], np.diff(first))[:size]
    inside = np.flatnonzero(np.arange(size) + n <= last)
    return mix(total[inside]), inside


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after another."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(before[-1]) + np.repeat(starts - before[:-1], sizes)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once."""
    ordered = np.sort(keys)
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return ordered[fresh]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return member(keys, distinct(twice))


def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    bits = max(10, int(len(known) * 16).bit_length())
    shift = np.uint64(64 - min(bits, 26))
    table = np.zeros(1 << min(bits, 26), bool)
    table[(known.astype(np.uint64) >> shift).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(keys.astype(np.uint64) >> shift).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
    found = np.zeros(len(keys), bool)
    found[maybe[known[at] == keys[maybe]]] = True
    return found


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` words from one of ``starts``."""
    change = np.zeros(size + n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return np.cumsum(change)[:size] > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive positions of ``first``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a code point."""
    return (data & 0xC0) != 0x80
