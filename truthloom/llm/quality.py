"""Repetition rules (operator 10).

Rolling hashes of several n-gram lengths measure, per text, the share of its word characters
that lie inside n-grams found twice or more, and inside lines equal to an earlier line.  A text
fails when one share is over the limit of its length.

Null or empty texts have no words and fail; duplicated rows are judged alike; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.words import (
    chunks, code_points, covered, ngrams, repeated, span_hashes, split_lines, split_words, sums,
)

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Greatest share of word characters inside duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Greatest share of word characters inside lines equal to an earlier line.
LINE_LIMIT = 0.20
#: Greatest share of symbols among word characters.
SYMBOL_LIMIT = 0.05

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"
)


def measure(texts: pa.Array, limits: Mapping[int, float] = NGRAM_LIMITS) -> dict[str, np.ndarray]:
    """All figures of every text."""
    words = split_words(texts)
    row, first = words.row, words.first
    hashes = words.hashes()
    points = np.concatenate([[0], np.cumsum(code_points(words.data))])
    chars = points[words.ends] - points[words.starts]
    salted = hashes ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found = {"n_words": words.counts, "word_chars": sums(chars, first)}
    symbols = np.isin(words.data, np.frombuffer(SYMBOLS, np.uint8))
    found["n_symbols"] = sums(symbols, words.offsets)

    starts, ends, line_row = split_lines(words.data, words.offsets)
    held = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = held[1] > held[0]
    starts, ends, line_row, held = starts[full], ends[full], line_row[full], (held[0][full], held[1][full])
    keys = span_hashes(words.data, starts, ends) ^ (line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    rows = len(words.offsets) - 1
    found["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = np.bincount(line_row[again], (total[held[1]] - total[held[0]])[again], minlength=rows)
    whole = np.maximum(found["word_chars"], 1)
    found["dup_line_share"] = line_chars / whole

    worst = np.zeros(rows)
    verdict = (found["dup_line_share"] <= LINE_LIMIT) & (found["n_symbols"] / whole <= SYMBOL_LIMIT)
    for n in sorted({5, *limits}):
        grams, at = ngrams(salted, first, n)
        inside = covered(at[repeated(grams)], n, len(hashes))
        if n == 5:
            found["n_repeat_words"] = sums(inside, first)
        if n in limits:
            share = sums(chars * inside, first) / whole
            worst = np.maximum(worst, share)
            verdict &= share <= limits[n]
    found["dup_ngram_share"] = worst
    found["base_failed"] = (found["n_words"] < MIN_WORDS) | (
        100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"]
    )
    found["kept"] = ~found["base_failed"] & verdict
    return found


def quality_rules(docs: DataFrame, limits: Mapping[int, float] = NGRAM_LIMITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, shares, and whether the text is kept."""
    limits = dict(limits)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = measure(part.column("text"), limits)
                columns = {"doc_id": part.column("doc_id")}
                for name in SCHEMA.split(", ")[1:]:
                    column, kind = name.split(" ")
                    to = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[kind]
                    columns[column] = pa.array(found[column]).cast(to)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, SCHEMA)
