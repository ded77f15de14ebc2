"""Readers and writers for claims, ground truth and the partition report.

CSV files are split: a line is a row, so any number of tasks read one file.  A field that holds a line
break, or that begins with ``MARK``, is written as ``MARK`` and the text with its backslashes and line breaks
escaped; every other field is written as it is, so files without line breaks keep the exchange format.
Files of other origin with line breaks inside quotes need ``multi_line=True``, and one task per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from truthloom.schema import CLAIM, as_claims, as_truth

# Every text comes back as it was: blanks at the edges, quotes, line breaks, the empty text.
# An empty field without quotes is null.
CSV = {
    "header": True, "escape": '"', "nullValue": "\u0001", "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
MARK = "\u0002"  # begins a field with escapes
ESCAPES = {"\\": "\\b", "\n": "\\n", "\r": "\\r"}  # each backslash is followed by its letter, so undoing is plain


def escaped(text: Column) -> Column:
    """One line that ``unescaped`` turns back into ``text``."""
    line = text
    for plain, written in ESCAPES.items():
        line = F.replace(line, F.lit(plain), F.lit(written))
    odd = F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r")) | F.startswith(text, F.lit(MARK))
    return F.when(odd, F.concat(F.lit(MARK), line)).otherwise(text)


def unescaped(field: Column) -> Column:
    text = F.substring(field, 2, 2**31 - 1)
    for plain, written in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.when(F.startswith(field, F.lit(MARK)), text).otherwise(field)


def _read(spark: SparkSession, path: str, fmt: str, multi_line: bool) -> DataFrame:
    """CSV rows with too few or too many fields are an error, not a loss, whichever columns are asked for."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = spark.read.options(**CSV, multiLine=multi_line, mode="FAILFAST", columnPruning=False).csv(path)
    return raw.select(*[unescaped(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def _write_csv(out: DataFrame, path: str, mode: str) -> None:
    fields = [escaped(F.col(c).cast("string")).alias(c) for c in out.columns]
    out.select(*fields).write.mode(mode).options(**(CSV | {"emptyValue": '""', "quoteAll": True})).csv(path)


def read_claims(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Claims from a headed CSV (``ID,Object,Property,Value,Source``) or a parquet table."""
    raw = _read(spark, path, fmt, multi_line)
    lowered = raw.select(*[F.col(c).alias(c.lower()) for c in raw.columns if c.lower() in CLAIM])
    return as_claims(lowered)


def wrong_values_text(values: Column) -> Column:
    """A list of wrong values on one line: whole numbers bare, as in the exchange format, else JSON strings."""
    number = F.forall(values, lambda v: F.coalesce(F.regexp_like(v, F.lit("^(0|-?[1-9][0-9]*)$")), F.lit(False)))
    bare = F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))
    return F.when(number, bare).otherwise(F.to_json(values, {"ignoreNullFields": "false"}))


def wrong_values(text: Column) -> Column:
    """The list that a line holds, with quotes of either kind; a line that holds none is an error."""
    listed = F.from_json(text, "array<string>", {"mode": "FAILFAST"})
    broken = F.raise_error(F.concat(F.lit("no list of wrong values: "), F.substring(text, 1, 200)))
    return F.when(text.isNotNull() & listed.isNull(), broken.cast("array<string>")).otherwise(listed)


def read_truth(spark: SparkSession, path: str, fmt: str = "csv", with_false: bool = False, multi_line: bool = False) -> DataFrame:
    """Ground truth; ``with_false`` also parses the list of wrong values of each item."""
    raw = _read(spark, path, fmt, multi_line)
    lowered = raw.select(*[F.col(f"`{c}`").alias(c.lower()) for c in raw.columns])
    if not with_false:
        return as_truth(lowered)
    if "false_values" in lowered.columns:  # tables with typed columns hold the list itself
        return lowered.select("object", "property", "value", "false_values")
    return lowered.select("object", "property", "value", wrong_values(F.col("`false`").cast("string")).alias("false_values"))


def write_claims(claims: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """CSV keeps the column names and the constant ``ID`` column of the exchange format."""
    if fmt != "csv":
        claims.select(*CLAIM).write.mode(mode).format(fmt).save(path)
        return
    out = claims.select(
        F.lit(0).alias("ID"),
        *[F.col(name).alias(name.capitalize()) for name in CLAIM],
    )
    _write_csv(out, path, mode)


def write_truth(truth: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    if fmt != "csv":
        truth.write.mode(mode).format(fmt).save(path)
        return
    out = truth.select(
        F.col("object").alias("Object"),
        F.col("property").alias("Property"),
        F.col("value").alias("Value"),
    )
    if "false_values" in truth.columns:
        out = truth.select(
            F.col("object").alias("Object"),
            F.col("property").alias("Property"),
            F.col("value").alias("Value"),
            wrong_values_text(F.col("false_values")).alias("False"),
        )
    _write_csv(out, path, mode)


def write_partition_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One ``;``-separated line per partition.

    The file format repeats the precision in the slot of the oracle accuracy.
    """
    blocks = F.transform(
        "partition",
        lambda block: F.concat(F.lit("['"), F.array_join(block, "', '"), F.lit("']")),
    )
    line = report.select(
        F.concat(F.lit("["), F.array_join(blocks, ", "), F.lit("]")).alias("partition"),
        "accuracy_max", "accuracy_avg", F.col("precision").alias("accuracy_oracle"),
        "precision", "recall", "accuracy", "f1_score",
    )
    line.write.mode(mode).option("sep", ";").csv(path)
