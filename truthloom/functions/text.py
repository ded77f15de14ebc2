"""Character-count vectors of values and the similarities built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_weights(value: Column) -> Column:
    """``array<struct<ch, w>>``: the character counts of a value, scaled to length 1.

    Two values then have cosine similarity ``sum(w1 * w2)`` over their common characters.
    The empty string has no characters and similarity 0 to everything.
    """
    counts = F.transform(
        F.array_distinct(F.filter(F.split(value, ""), lambda ch: ch != "")),
        lambda ch: F.struct(
            ch.alias("ch"),
            (F.length(value) - F.length(F.replace(value, ch, F.lit("")))).cast("double").alias("w"),
        ),
    )
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
    return F.transform(counts, lambda e: F.struct(e["ch"].alias("ch"), (e["w"] / norm).alias("w")))


def weights_dot(left: Column, right: Column) -> Column:
    """Dot product of an ``array<struct<ch, w>>`` with a ``map<ch, w>``."""
    return F.aggregate(
        left,
        F.lit(0.0),
        lambda acc, e: acc + e["w"] * F.coalesce(F.try_element_at(right, e["ch"]), F.lit(0.0)),
    )


def number_of(value: Column) -> Column:
    """The number that a value spells; null if it spells none."""
    return value.try_cast("double")


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 / |a - b|; equal numbers give 1, a value that is no number gives 0."""
    gap = F.abs(a - b)
    return F.when(gap.isNull(), F.lit(0.0)).when(gap == 0, F.lit(1.0)).otherwise(1 / F.nullif(gap, F.lit(0.0)))
