"""Repeatable random draws: a hash of a text key instead of a random generator.

A draw depends only on its key, so a lost task recomputes exactly the same values.
"""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*key: Column | str) -> Column:
    """Whole number in [0, 2^32) from the md5 of the key parts joined with ``|``."""
    parts = [part if isinstance(part, Column) else F.lit(part) for part in key]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(low: Column | float, high: Column | float, *key: Column | str) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return low + (high - low) * (draw(*key) / F.lit(float(2**32)))


def seeded_index(size: Column, seed: int, words: int = 64) -> Column:
    """Zero-based position that ``random.Random(seed).choice`` picks in a list of ``size``.

    Python takes the top ``bit_length(size)`` bits of successive 32-bit words until one is
    below ``size``; the words come from Python's own generator, the rest is an expression.
    """
    source = random.Random(seed)
    stream = F.array(*[F.lit(source.getrandbits(32)).cast("bigint") for _ in range(words)])
    bits = F.length(F.bin(size.cast("bigint")))
    candidates = F.transform(
        stream, lambda word: F.floor(word / F.pow(F.lit(2.0), 32 - bits)).cast("bigint")
    )
    return F.when(size <= 1, F.lit(0).cast("bigint")).otherwise(
        F.element_at(F.filter(candidates, lambda pick: pick < size), 1)
    )


def seeded_place(size: int, seed: int, words: int = 64) -> int:
    """:func:`seeded_index` of one size, outside of Spark's expressions."""
    if size <= 1:
        return 0
    source, shift = random.Random(seed), 32 - size.bit_length()
    return next(pick for pick in (source.getrandbits(32) >> shift for _ in range(words)) if pick < size)
