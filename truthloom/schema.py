"""Table shapes shared by every job.

``claims``  object, property, value, source   one row per (object, property, source)
``truth``   object, property, value           one row per (object, property)

A data item is the pair ``(object, property)``; the two columns are never concatenated,
so ``("a", "bc")`` and ``("ab", "c")`` stay different items.  Values are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = ["object", "property"]
FACT = ["object", "property", "value"]
CLAIM = ["object", "property", "value", "source"]

CLAIMS_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in CLAIM])
TRUTH_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in FACT])


def as_claims(df: DataFrame) -> DataFrame:
    """Keep the four claim columns as strings; a claim without a value says nothing."""
    typed = df.select(*[F.col(name).cast("string").alias(name) for name in CLAIM])
    return typed.dropna(subset=CLAIM)


def as_truth(df: DataFrame) -> DataFrame:
    """One true value per item: of rows that contradict each other the greatest value counts."""
    typed = df.select(*[F.col(name).cast("string").alias(name) for name in FACT]).dropna(subset=FACT)
    return typed.groupBy(*ITEM).agg(F.max("value").alias("value")).select(*FACT)


def dedupe_claims(claims: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One value per (object, property, source): the greatest ``(*order_by, value)``."""
    if not order_by:
        return claims.groupBy(*ITEM, "source").agg(F.max("value").alias("value")).select(*CLAIM)
    newest = F.max_by("value", F.struct(*order_by, "value"))
    return claims.groupBy(*ITEM, "source").agg(newest.alias("value")).select(*CLAIM)


def _thinned(wide: DataFrame, hot: DataFrame, newest: dict[str, Column], order_by: list[str]) -> DataFrame:
    """The same rows, but of hot objects only the newest value of each property and source, in a row of its own."""
    found = wide.join(hot, "object", "left_semi").groupBy("object", "source").agg(*[best.alias(name) for name, best in newest.items()])
    nothing = F.lit(None).cast("string")
    alone = [
        F.struct(*[F.col(name)[c].alias(c) for c in order_by], *[(F.col(n)[n] if n == name else nothing).alias(n) for n in newest])
        for name in newest
    ]
    return wide.join(hot, "object", "left_anti").unionByName(found.select("object", "source", F.inline(F.array(*alone))))


def claims_from_wide(
    df: DataFrame,
    object_col: str,
    source_col: str,
    properties: dict[str, Column],
    order_by: list[str] | None = None,
    tasks: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Turn a wide table into claims, one property per entry of ``properties``.

    With ``order_by`` the newest non-null value per (object, source) is taken for all
    properties in a single aggregation *before* the unpivot, so the shuffle carries one
    row per (object, source) instead of one per claim.

    With ``tasks`` the rows are dealt to so many tasks by object before all else, as they are: groups
    then need no shuffle of their own, nor do groups of claims by object, item or fact. ``hot`` names the
    objects with very many rows; of these only the newest values are dealt. Objects have few sources.
    """
    if tasks and hot is None:
        df = df.repartition(tasks, F.col(object_col).cast("string"))
    keys = [F.col(object_col).cast("string").alias("object"),
            F.col(source_col).cast("string").alias("source")]
    values = [expr.cast("string").alias(name) for name, expr in properties.items()]
    names = list(properties)
    wide = df.select(*keys, *[F.col(c) for c in order_by or []], *values)
    wide = wide.dropna(subset=["object", "source"])
    if order_by:
        newest = {name: F.max(F.when(F.col(name).isNotNull(), F.struct(*order_by, name))) for name in names}
        if hot is not None:
            wide = _thinned(wide, hot, newest, order_by).repartition(tasks, "object")
        wide = wide.groupBy("object", "source").agg(*[newest[name][name].alias(name) for name in names])
    if tasks:  # Spark forgets by an unpivot how rows are dealt
        cells = F.array(*[F.struct(F.lit(name).alias("property"), F.col(name).alias("value")) for name in names])
        long = wide.select("object", "source", F.inline(cells))
    else:
        long = wide.unpivot(["object", "source"], names, "property", "value")
    return long.where(F.col("value").isNotNull()).select(*CLAIM)
