"""Parts of texts that tokenizers never look across, each distinct one known once.

A part is numbered by a 64-bit hash of its bytes.  What is worked out for a part (ids, groups) is
kept under its number, so a task works once on each distinct part and joins the outcome back by
position.  The table is forgotten between slices when it has grown past its bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from truthloom.llm.words import member, ranges, span_hashes

#: Distinct parts, and their bytes, that a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
REMEMBERED_BYTES = 32 << 20
#: Parts that are worked out at a time.
LEARNT = 8192
#: Bytes that are hashed, or gathered, at a time.
STRETCH = 4 << 20


def stretches(stops: np.ndarray, most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive spans that hold ``most`` bytes, or one span if that is longer."""
    begin = 0
    while begin < len(stops):
        before = stops[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(stops, before + most, side="right")))
        yield begin, end
        begin = end


def part_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of consecutive spans; the working memory does not grow with the text."""
    found = np.zeros(len(starts), np.uint64)
    for lo, hi in stretches(ends):
        base = starts[lo]
        found[lo:hi] = span_hashes(data[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base)
    return found


class ChunkTable:
    """Row numbers of distinct parts; ``learn`` works out new ones and appends them in order."""

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None]):
        self.learn, self.forget = learn, forget
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.forget()

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of every part; rows hold until the next call."""
        keys = part_hashes(data, starts, ends)
        fresh, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(fresh) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._clear()
        new = ~member(fresh, self.keys)
        begin, end = starts[first[new]], ends[first[new]]
        for lo in range(0, len(begin), LEARNT):
            self.learn([data[a:b].tobytes() for a, b in zip(begin[lo : lo + LEARNT].tolist(), end[lo : lo + LEARNT].tolist())])
        if len(begin):
            at = np.searchsorted(self.keys, fresh[new])
            self.rows = np.insert(self.rows, at, np.arange(len(self.keys), len(self.keys) + len(begin)))
            self.keys = np.insert(self.keys, at, fresh[new])
            self.held += int((end - begin).sum())
        return self.rows[np.searchsorted(self.keys, fresh)][which]


class Flat:
    """Lists of numbers or bytes, one per row, end to end."""

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self._values, self._sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        self._stops: np.ndarray | None = None

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._values.append(values.astype(self.kind))
        self._sizes.append(sizes.astype(np.int64))
        self._stops = None

    @property
    def stops(self) -> np.ndarray:
        """Where each list begins, and the end of the last one."""
        if self._stops is None:
            self._values, self._sizes = [np.concatenate(self._values)], [np.concatenate(self._sizes)]
            self._stops = np.concatenate([[0], np.cumsum(self._sizes[0])])
        return self._stops

    @property
    def values(self) -> np.ndarray:
        _ = self.stops  # joins what was added
        return self._values[0]

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.stops[rows + 1] - self.stops[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The lists of ``rows``, one after another."""
        sizes = self.sizes(rows)
        return self._values[0][ranges(self._stops[rows], sizes)]
