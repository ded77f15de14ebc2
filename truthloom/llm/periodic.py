"""Periodic runs of words (operator 12).

A run is a stretch of words with smallest period q, at least ``shortest`` and 2q words long, that no
neighbouring word extends.  Every word of a run occurs in it twice at least.  So a word that occurs
once in its segment is in no run and splits the segment; the counts inside the parts are lower, and
splitting goes on until nothing changes (or SPLITS times: what is left then is longer to scan, not
lost).  Segments shorter than ``shortest`` go.

The surviving segments of many texts are scanned together, lag by lag.  A run of period q is a stretch
of at least s = max(shortest - q, q) words each equal to the word q later, and every such stretch holds
a position divisible by s: only these are compared, n / s for lag q and n log n in all.  Positions that
agree are extended to both sides by binary search over prefix hashes; each run found is compared
word by word, and hashes that lied lead to direct extension.  Equal stretches with several lags are
one run, of the smallest lag.

Words are runs of bytes other than space and 0x09-0x0D.  Null or empty texts have no words, no runs and
an empty collapsed text; ties for the longest run go to the smallest start, then period; repeated rows
are judged each; extra columns are ignored; an empty table gives an empty result.  Texts are scanned
whole: memory is some 60 bytes per word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.chunktable import part_hashes, stretches
from truthloom.llm.words import chunks, mix, ranges, split_words

SHORTEST = 12
#: Rounds of splitting.
SPLITS = 32
#: Positions that agree with a later one, extended at a time.
BATCH = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
FOUND = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def codes(keys: np.ndarray) -> np.ndarray:
    """Small numbers for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def split_segments(words: np.ndarray, row: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the segments that may hold runs; ``words`` are numbers, ``row`` the text of each."""
    at, part = np.arange(len(words)), row.astype(np.int64)
    starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number in range(SPLITS + 1):
        if not len(at):
            break
        own = codes(part * (int(words.max()) + 1) + words[at])
        held = (np.bincount(own) > 1)[own] if number < SPLITS else np.ones(len(at), bool)
        kept, before = at[held], part[held]
        if not len(kept):
            break
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (kept[1:] != kept[:-1] + 1) | (before[1:] != before[:-1])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(kept)))
        long = size >= shortest
        # a segment that kept all its words is done
        whole = np.bincount(part)[before[begin]] == size
        done = long & (whole | (number == SPLITS))
        starts.append(kept[begin[done]])
        sizes.append(size[done])
        going = long & ~done
        at = kept[np.repeat(going, size)]
        part = np.repeat(np.arange(int(going.sum())), size[going])
    return np.concatenate(starts), np.concatenate(sizes)


class Extender:
    """How far words agree with those ``lag`` later, to the right and to the left of a position.

    ``line`` begins and ends with a number that occurs nowhere else.
    """

    def __init__(self, line: np.ndarray, longest: int):
        self.line, self.levels = line, longest.bit_length() + 1
        power = np.full(longest + 2, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        steps = np.full(len(line), _BASE, np.uint64)
        steps[0] = 1
        self.prefix = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(mix(line + 1) * np.multiply.accumulate(steps), out=self.prefix[1:])

    def _same(self, at: np.ndarray, lag: np.ndarray, size: int) -> np.ndarray:
        ahead = at + lag
        return (self.prefix[at + size] - self.prefix[at]) * self.power[lag] == self.prefix[ahead + size] - self.prefix[ahead]

    def right(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Number of positions from ``at`` on that agree."""
        found = np.zeros(len(at), np.int64)
        for level in reversed(range(self.levels)):
            size = 1 << level
            fits = np.flatnonzero(at + found + lag + size <= len(self.line))
            found[fits[self._same(at[fits] + found[fits], lag[fits], size)]] += size
        return found

    def left(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Number of positions before ``at`` that agree."""
        found = np.zeros(len(at), np.int64)
        for level in reversed(range(self.levels)):
            size = 1 << level
            fits = np.flatnonzero(at - found - size >= 0)
            found[fits[self._same(at[fits] - found[fits] - size, lag[fits], size)]] += size
        return found


class DirectExtender(Extender):
    """The same by comparing words."""

    def __init__(self, line: np.ndarray):
        self.line = line

    def _count(self, at: int, lag: int, step: int) -> int:
        found, size = 0, 64
        while True:
            lo, hi = (at + found, at + found + size) if step > 0 else (at - found - size, at - found)
            lo, hi = max(lo, 0), min(hi, len(self.line) - lag)
            differs = np.flatnonzero(self.line[lo:hi] != self.line[lo + lag : hi + lag])
            if len(differs):
                return found + (int(differs[0]) if step > 0 else hi - lo - 1 - int(differs[-1]))
            if hi - lo < size:
                return found + hi - lo
            found, size = found + size, min(2 * size, 1 << 20)

    def right(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        return np.array([self._count(i, q, 1) for i, q in zip(at.tolist(), lag.tolist())], np.int64)

    def left(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        return np.array([self._count(i, q, -1) for i, q in zip(at.tolist(), lag.tolist())], np.int64)


def agreeing(line: np.ndarray, stops: np.ndarray, sizes: np.ndarray, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of positions of ``line`` that agree with the word ``lag`` later and lie in a long enough stretch, perhaps.

    ``stops`` are the ends of the segments, whose ``sizes`` descend.
    """
    found, held = [], 0
    around = np.array([-3, -2, -1, 1, 2, 3])

    def batch() -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([a for a, _ in found])
        lag = np.repeat([q for _, q in found], [len(a) for a, _ in found])
        # the stretch has 6 positions or more: 3 beside this one, on one side
        near = np.clip(at[:, None] + around, 0, len(line) - 1)
        ahead = np.clip(at[:, None] + around + lag[:, None], 0, len(line) - 1)
        same = line[near] == line[ahead]
        likely = same[:, :3].all(1) | same[:, 3:].all(1)
        return at[likely], lag[likely]

    for lag in range(1, int(sizes[0]) // 2 + 1):
        held_by = int(np.searchsorted(-sizes, -max(shortest, 2 * lag), side="right"))
        if not held_by:
            break
        end, step = int(stops[held_by - 1]), max(shortest - lag, lag)
        ahead = line[lag:end:step]
        at = np.flatnonzero(line[:end:step][: len(ahead)] == ahead) * step
        if len(at):
            found.append((at, lag))
            held += len(at)
        if held >= BATCH:
            yield batch()
            found, held = [], 0
    if found:
        yield batch()


def scan(line: np.ndarray, stops: np.ndarray, sizes: np.ndarray, extender: Extender, shortest: int) -> np.ndarray:
    """Rows of start, end and period of every run of ``line``."""
    runs = np.zeros((0, 3), np.int64)
    for at, lag in agreeing(line, stops, sizes, shortest):
        begin = at - extender.left(at, lag)
        end = at + lag + extender.right(at, lag)
        long = end - begin >= np.maximum(shortest, 2 * lag)
        runs = np.concatenate([runs, np.column_stack([begin, end, lag])[long]])
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        fresh = np.ones(len(runs), bool)
        fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)  # of several periods the smallest
        runs = runs[fresh]
    return runs


def proven(line: np.ndarray, runs: np.ndarray) -> bool:
    """Whether every run has its period and ends where the period does."""
    for begin, end, lag in runs.tolist():
        if line[begin - 1] == line[begin - 1 + lag] or line[end] == line[end - lag]:
            return False
        if (line[begin : end - lag] != line[begin + lag : end]).any():
            return False
    return True


def find_runs(words: np.ndarray, row: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows of start, length and period of all runs, by start and period; starts count all words."""
    if shortest < 12:
        raise ValueError("runs of fewer than 12 words are not supported")
    starts, sizes = split_segments(words, row, shortest)
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((starts, -sizes))
    starts, sizes = starts[order], sizes[order]
    part = np.repeat(np.arange(len(starts)), sizes)
    own = codes(part * (int(words.max()) + 1) + words[ranges(starts, sizes)])
    # a mark of its own before, between and after the segments
    place = np.arange(len(own)) + part + 1
    line = np.full(len(own) + len(starts) + 1, -1, np.int64)
    line[place] = own
    marks = np.flatnonzero(line < 0)
    line[marks] = len(own) + np.arange(len(marks))
    stops = np.cumsum(sizes + 1)
    longest = int(sizes[0])
    runs = scan(line, stops, sizes, Extender(line, longest), shortest)
    if not proven(line, runs):
        runs = scan(line, stops, sizes, DirectExtender(line), shortest)
    origin = np.zeros(len(line), np.int64)
    origin[place] = ranges(starts, sizes)
    found = np.column_stack([origin[runs[:, 0]], runs[:, 1] - runs[:, 0], runs[:, 2]])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``size`` words are in no run after its first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:size] == 0


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words with one space after each."""
    out = []
    sizes = ends - starts + 1
    for lo, hi in stretches(np.cumsum(sizes)):
        held = data[np.minimum(ranges(starts[lo:hi], sizes[lo:hi]), len(data) - 1)]
        held[np.cumsum(sizes[lo:hi]) - 1] = 32
        out.append(held.tobytes())
    return b"".join(out)


def judge_texts(texts: pa.Array, shortest: int = SHORTEST) -> list[pa.Array]:
    """All columns of FOUND but the first."""
    words = split_words(texts)
    row, first = words.row, words.first
    salted = part_hashes(words.data, words.starts, words.ends) ^ mix(row.astype(np.uint64))
    runs = find_runs(codes(salted), row, shortest)
    size = len(first) - 1
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    stops = np.searchsorted(owner, np.arange(size + 1))
    kept = kept_words(len(words.starts), runs)
    shown = joined(words.data, words.starts[kept], words.ends[kept])
    bytes_before = np.concatenate([[0], np.cumsum(np.where(kept, words.ends - words.starts + 1, 0))])[first]
    texts = [shown[a : b - 1].decode() if b > a else "" for a, b in zip(bytes_before[:-1].tolist(), bytes_before[1:].tolist())]
    own = runs.copy()
    own[:, 0] -= first[owner]
    by_rank = np.lexsort((own[:, 2], own[:, 0], -own[:, 1], owner))
    best = by_rank[np.minimum(stops[:-1], max(len(runs) - 1, 0))] if len(runs) else np.zeros(size, np.int64)
    none = stops[1:] == stops[:-1]

    def column(values: np.ndarray) -> pa.Array:
        return pa.array(values[best] if len(runs) else np.zeros(size, np.int64), pa.int64(), mask=none)

    milli = 1000 * own[:, 1] // np.maximum(own[:, 2], 1)
    fields = [pa.array(own[:, i], pa.int64()) for i in range(3)]
    lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(np.diff(stops), pa.int64()), *[column(own[:, i]) for i in range(3)], column(milli), lists, pa.array(texts, pa.string())]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): all runs, the longest one, and the text with one period of each run kept."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split(" ")[0] for field in FOUND.split(", ")[:6]] + ["runs", "collapsed"]
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *judge_texts(part.column("text"), shortest)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(judge, FOUND)


def plant_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a repeated stretch in the rows whose hash of the id is divisible by ten.

    With h = crc32 of the id, g = h / 10 and n words, the words from g % n on become repetitions of
    their first 1 + (n - g % n) / (3 + g % 8).
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    cut = ids.select("*", g.alias("g"), words.alias("words"))
    n, a = F.size("words"), (F.col("g") % F.size("words")).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    unit = F.slice("words", a + 1, p)
    rest = (n - a) % p
    planted = F.concat(F.slice("words", F.lit(1), a), F.flatten(F.array_repeat(unit, F.floor((n - a) / p).cast("int"))),
                       F.slice("words", a + 1, rest))
    return cut.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The runs and the collapsed text as digests."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]).alias("line"))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return periodic_runs(docs, shortest).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.encode(told, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )
