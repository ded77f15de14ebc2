"""Questions about hashed items of many slices of texts, answered in one shuffle.

A slice (some megabytes of text in one task) sends each distinct 64-bit item once, packed with
others into one blob per bucket of the hash space, six bytes or so per item instead of a row.  A
bucket task sees all occurrences of its items and sends blobs back to the slices.  Items that occur
often are sent once per slice, so that no item makes a bucket large.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text, or of hashes, that one bucket stands for.
BUCKET_BYTES = 32 << 20


def bucket_count(total: int | None) -> int:
    return max(8, -(-int(total or 0) // BUCKET_BYTES))


def text_bytes_of(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def slice_ids():
    """Numbers for the slices of a task; a task that runs again gives the same ones."""
    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Border of every bucket in the sorted ``keys``, and each key's 32 bits inside its bucket."""
    width = np.uint64(((1 << 64) - 1) // buckets + 1)
    number = np.minimum(keys // width, np.uint64(buckets - 1))
    borders = np.searchsorted(number, np.arange(buckets + 1, dtype=np.uint64))
    inside = keys - number * width
    shift = np.uint64(max(0, int(width).bit_length() - 32))
    return borders, (inside >> shift).astype(np.uint32)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return starts, np.diff(np.append(starts, len(ordered)))


def pack(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def unpack(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of the blobs, and how many each had."""
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(blobs), kind), np.array([len(b) // size for b in blobs], np.int64)
