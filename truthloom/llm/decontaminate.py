"""Benchmark decontamination (operator 6).

Windows of a document as long as a benchmark item get a 64-bit SimHash of their words.  A
multi-index finds all items of this length within ``RADIUS`` bits: fingerprints are cut into
``BLOCKS`` blocks, two within the radius differ by at most ``RADIUS // BLOCKS`` bits in some
block, and every item is filed under all block values that near.  Hits are verified by exact
similarity of weighted five-word shingles (sum of least over sum of greatest counts), at least
0.75.

Before a window is hashed it must hold enough shingles of the benchmark, of any item: a window of
S shingles needs 2 * 0.75 / 1.75 * S of them, else no item can be that similar.  So no result is
lost, and hashing is left to the few stretches that matter.

Pairs of windows and items are looked at in stretches of ``PAIRS``, and of the matches only the best
window of each text and item is kept, so a text that holds the whole benchmark needs no more memory
than a text that holds one item.

Items are brought to the tasks in blocks of bounded size, however many there are.  Letters A-Z are
lower-cased.  Items and documents with fewer than five words count as one shingle; without words
they match nothing.  A document shorter than an item is one window.  Null ids are kept as null,
duplicated rows give a row each per item, extra columns are ignored by ``find_leaks`` and kept by
``drop_leaks``; an empty table on either side gives no leaks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.words import Words, chunks, distinct, member, mix, ngrams, ranges, split_words

WIDTH = 5
LEAST = 0.75
RADIUS = 23
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
#: Items and code points of one broadcast block of the benchmark.
ITEMS, ITEM_CHARS = 20_000, 32_000_000
#: Pairs of windows and items, and shingles of windows, that are looked at together.
PAIRS = 1 << 20
LEAK = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"


def _near() -> np.ndarray:
    """All block differences of few enough bits."""
    masks = [0]
    for flips in range(1, RADIUS // BLOCKS + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(BLOCK_BITS), flips)]
    return np.array(masks, np.uint8)


def simhash(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each window of words.  Only words inside windows are looked at."""
    used = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(used, starts, 1)
    np.add.at(used, starts + sizes, -1)
    inside = np.cumsum(used[:-1]) > 0
    place = np.concatenate([[0], np.cumsum(inside)])
    mixed = mix(hashes[inside])
    step = max(1, min(64, 4 * PAIRS // max(len(mixed), 1)))  # bits at a time
    positive = np.zeros((len(starts), 64), bool)
    for low in range(0, 64, step):
        shifts = np.arange(low, min(low + step, 64), dtype=np.uint64)
        total = np.zeros((len(mixed) + 1, len(shifts)), np.int32)
        np.cumsum((mixed[:, None] >> shifts & np.uint64(1)).astype(np.int8) * 2 - 1, axis=0, out=total[1:])
        positive[:, low : low + len(shifts)] = total[place[starts] + sizes] > total[place[starts]]
    return np.packbits(positive, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def coded(grams: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Shingles with their count so far in their owner mixed in: what two multisets have in common
    is then what two sets of codes have."""
    order = np.lexsort((grams, owner))
    gram, own = grams[order], owner[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(fresh)
    again = np.arange(len(gram)) - np.repeat(first, np.diff(np.append(first, len(gram))))
    codes = np.empty_like(grams)
    codes[order] = np.where(again > 0, mix(gram ^ mix(again)), gram)
    return codes


def stretches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive entries with about ``PAIRS`` in all, or one entry that is larger."""
    total = np.cumsum(sizes)
    if len(total):
        cuts = np.searchsorted(total, np.arange(PAIRS, total[-1] + 1, PAIRS), "left") + 1
        edges = np.unique(np.concatenate([[0], cuts, [len(total)]])).tolist()
        yield from zip(edges[:-1], edges[1:])


def best_windows(found: np.ndarray) -> np.ndarray:
    """The first row of each (text, item): most alike, then nearest, then leftmost."""
    found = found[np.lexsort((found["n"], found["start"], found["bits"], -found["alike"], found["item"], found["row"]))]
    first = np.ones(len(found), bool)
    first[1:] = (found["row"][1:] != found["row"][:-1]) | (found["item"][1:] != found["item"][:-1])
    return found[first]


MATCH = np.dtype([("row", "i8"), ("item", "i8"), ("start", "i8"), ("n", "i8"), ("bits", "i4"), ("alike", "f8")])


@dataclass
class Index:
    """Items of one block of the benchmark, by number of words."""

    ids: list[int | None]
    sizes: np.ndarray
    prints: np.ndarray
    codes: np.ndarray  # coded shingles of all items, in order
    held: np.ndarray  # item and place of the code in ``codes``, as one number, in order
    known: dict[int, np.ndarray]  # shingles by width
    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # by number of words: block values and items

    @staticmethod
    def of(ids: list[int | None], texts: list[str | None]) -> Index:
        words = split_words(pa.array(texts, pa.string()), lower=True)
        flat = words.hashes()
        full = np.flatnonzero(words.counts)
        ids, sizes = [ids[i] for i in full.tolist()], words.counts[full]
        first = np.concatenate([[0], np.cumsum(sizes)])
        prints = simhash(flat, first[:-1], sizes)
        widths = np.minimum(sizes, WIDTH)
        known, codes, owners = {}, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for width in np.unique(widths).tolist():
            grams, at = ngrams(flat, first, width)
            item = np.searchsorted(first, at, "right") - 1
            own = widths[item] == width
            known[width] = distinct(grams[own])
            codes.append(coded(grams[own], item[own]))
            owners.append(item[own])
        code, item = np.concatenate(codes), np.concatenate(owners)
        codes = distinct(code)
        held = np.sort(item * len(codes) + np.searchsorted(codes, code))
        near, tables = _near(), {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            tables[size] = []
            for part in prints[own, None].view(np.uint8).T:  # BLOCK_BITS are a byte
                keys = (part[:, None] ^ near[None, :]).ravel()
                order = np.argsort(keys, kind="stable")
                tables[size].append((keys[order], np.repeat(own, len(near))[order].astype(np.int32)))
        return Index(ids, sizes, prints, codes, held, known, tables)

    def within(self, prints: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and items of ``size`` words whose fingerprints differ by RADIUS bits at most, in
        stretches of windows."""
        blocks = prints[:, None].view(np.uint8).T
        low = np.array([np.searchsorted(keys, part, "left") for (keys, _), part in zip(self.tables[size], blocks)])
        high = np.array([np.searchsorted(keys, part, "right") for (keys, _), part in zip(self.tables[size], blocks)])
        for a, b in stretches((high - low).sum(axis=0)):
            found = []
            for block, (_, items) in enumerate(self.tables[size]):
                counts = high[block, a:b] - low[block, a:b]
                item = items[ranges(low[block, a:b], counts)]
                window = np.repeat(np.arange(a, b), counts)
                near = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
                found.append(window[near] * len(self.sizes) + item[near])
            pairs = distinct(np.concatenate(found))
            if len(pairs):
                yield pairs // len(self.sizes), pairs % len(self.sizes)

    def _common(self, codes: np.ndarray, begin: np.ndarray, counts: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many of the codes (places in ``codes``, or -1) of each range its item has."""
        both = np.zeros(len(item), np.int64)
        for a, b in stretches(counts):
            code = codes[ranges(begin[a:b], counts[a:b])]
            pair = np.repeat(np.arange(a, b), counts[a:b])[code >= 0]
            keys = item[pair] * len(self.codes) + code[code >= 0]
            at = np.minimum(np.searchsorted(self.held, keys), len(self.held) - 1)
            both[a:b] = np.bincount(pair[self.held[at] == keys] - a, minlength=b - a)
        return both

    def alike(self, grams: np.ndarray, starts: np.ndarray, spans: np.ndarray, window: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Similarity of windows and items, which come ordered by window; 0 where it is below LEAST.

        A window that may lack m of its shingles has one of any m + 1 of them in common with the item:
        pairs without are left out before all shingles are counted.
        """
        result = np.zeros(len(window))
        used, place = np.unique(window, return_inverse=True)
        spans_of = self.sizes - np.minimum(self.sizes, WIDTH) + 1
        for a, b in stretches(spans[used]):
            low, high = np.searchsorted(place, [a, b])
            each = spans[used[a:b]]
            begin = np.cumsum(each) - each
            code = coded(grams[ranges(starts[used[a:b]], each)], np.repeat(np.arange(b - a), each))
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            code = np.where(self.codes[at] == code, at, -1)
            own, its = place[low:high] - a, item[low:high]
            total = each[own] + spans_of[its]
            need = np.ceil(total * LEAST / (1 + LEAST) - 1e-9).astype(np.int64)
            some = np.flatnonzero(need <= np.minimum(each[own], spans_of[its]))
            some = some[self._common(code, begin[own[some]], each[own[some]] - need[some] + 1, its[some]) > 0]
            both = self._common(code, begin[own[some]], each[own[some]], its[some])
            share = both / (total[some] - both)
            result[low + some] = np.where(share >= LEAST, share, 0.0)
        return result

    @staticmethod
    def windows(words: Words, size: int, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows for items of ``size`` words that hold enough of the known shingles, which start
        at the words ``hits``: start and length."""
        span = size - min(size, WIDTH) + 1
        share = LEAST / (1 + LEAST)
        need = int(np.ceil(2 * span * share - 1e-9))
        starts = np.zeros(0, np.int64)
        if len(hits) >= need:
            first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
            close = last - first < span
            low, high = np.maximum(last[close] - span + 1, 0), first[close]
            starts = distinct(ranges(low, high - low + 1))
            row = np.searchsorted(words.first, starts, "right") - 1
            held = np.searchsorted(hits, starts + span) - np.searchsorted(hits, starts)
            starts = starts[(starts + size <= words.first[row + 1]) & (held >= need)]
        rows = np.unique(np.searchsorted(words.first, hits, "right") - 1)
        rows = rows[words.counts[rows] < size]
        whole, sizes = words.first[rows], words.counts[rows]
        spans = np.maximum(sizes - min(size, WIDTH) + 1, 1)
        held = np.searchsorted(hits, whole + sizes) - np.searchsorted(hits, whole)
        enough = held >= (spans + span) * share - 1e-9
        return np.concatenate([starts, whole[enough]]), np.concatenate([np.full(len(starts), size), sizes[enough]])

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, float]]:
        """The best window of every (text, item): row, item, start, words, distance, similarity."""
        words = split_words(texts, lower=True)
        hashes = words.hashes()
        hits, at_word = {}, {}
        for width, known in self.known.items():
            grams, at = ngrams(hashes, words.first, width)
            hits[width] = at[member(grams, known)]
            at_word[width] = np.zeros(len(hashes), np.uint64)
            at_word[width][at] = grams
        every = [np.zeros(0, MATCH)]
        for size in self.tables:
            width = min(size, WIDTH)
            starts, sizes = self.windows(words, size, hits[width])
            if not len(starts):
                continue
            prints = simhash(hashes, starts, sizes)
            owners = np.searchsorted(words.first, starts, "right") - 1
            best = np.zeros(0, MATCH)
            for window, item in self.within(prints, size):
                alike = self.alike(at_word[width], starts, sizes - width + 1, window, item)
                window, item, alike = window[alike > 0], item[alike > 0], alike[alike > 0]
                if len(window):
                    found = np.zeros(len(window), MATCH)
                    found["row"], found["item"], found["alike"] = owners[window], item, alike
                    found["start"], found["n"] = starts[window] - words.first[owners[window]], sizes[window]
                    found["bits"] = np.bitwise_count(prints[window] ^ self.prints[item])
                    best = best_windows(np.concatenate([best, found]))
            every.append(best)
        found = best_windows(np.concatenate(every))
        return list(zip(*(found[name].tolist() for name in MATCH.names)))


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull())
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = int(max(-(-n // ITEMS), -(-chars // ITEM_CHARS)))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        rows = rows.sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Index.of(rows["item_id"].to_pylist(), rows["text"].to_pylist())


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and benchmark item found in it, with the best window."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for index in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    ids = part.column("doc_id").to_pylist()
                    rows = held.value.leaks(part.column("text"))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()),
                        "item_id": pa.array([held.value.ids[r[1]] for r in rows], pa.int64()),
                        "start_word": pa.array([r[2] for r in rows], pa.int64()),
                        "n_words": pa.array([r[3] for r in rows], pa.int64()),
                        "distance": pa.array([r[4] for r in rows], pa.int32()),
                        "similarity": pa.array([r[5] for r in rows], pa.float64()),
                    })

        found.append(texts.mapInArrow(search, LEAK))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], LEAK)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    place = docs.columns.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    for index in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch):
                    stays = np.ones(part.num_rows, bool)
                    stays[[r[0] for r in held.value.leaks(part.column(place))]] = False
                    yield part.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
