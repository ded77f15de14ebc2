"""Sum-of-squares packing (operator 7).

Every text is tokenized whole and cut into pieces of at most ``capacity`` tokens.  A packer takes
its pieces from the longest to the shortest; among the bins that a piece fits into, it goes where
the sum over residual gaps of (open bins with this gap)^2 becomes smallest (ties: the fullest
bin); a new bin is opened only where no bin has room.

Pieces, not texts, are shuffled: a row of some 50 bytes each.  Packers take equal shares of the
pieces by hash, about ``share`` pieces each, so their number grows with the corpus and their
memory doesn't; each leaves less than a bin or two unfilled.

Null texts count as empty (one token: the end mark); duplicated rows are packed each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.words import chunks, member, span_hashes, split_words
from truthloom.plans.workspace import Workspace

CAPACITY = 2048
END_ID = 0
SHARE = 60_000
#: Parts of texts whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
PIECE = "doc_id long, copy int, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:0xC0] = _LETTER[0xC3] = True  # C3 80 to C3 BF: the letters of Latin-1,
_LETTER[[0x97, 0xB7]] = False  # without the signs for times and divided by
_TRAIL = np.zeros(256, bool)
_TRAIL[list(b".,;:!?")] = True


class WordTokenizer:
    """Ids of texts through ids of their words, for lower-casing tokenizers that drop white space.

    In these vocabularies white space, and the border between letters and punctuation, always end
    a token.  So a text's ids are those of its parts, one after another, and each distinct part is
    tokenized once: words of letters (lower-cased, so that fewer are distinct), the punctuation
    after them, and all other words as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        names = self.inner.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known parts,
        self.begins = self.sizes = np.zeros(0, np.int64)  # and where their ids are in flat
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words of letters, which are one run of tokens each."""
        lines = [" ".join(parts[i : i + 500]) for i in range(0, len(parts), 500)]
        ids = np.array([i for line in self._encode(lines) for i in line], np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(stops) != len(parts):
            raise ValueError("the vocabulary does not mark word ends; this tokenizer is not supported")
        return ids, np.diff(stops, prepend=0)

    def _learn(self, keys: np.ndarray, parts: list[str], letters: np.ndarray) -> None:
        plain, sizes = self._encode_letters([w for w, yes in zip(parts, letters.tolist()) if yes])
        other = self._encode([w for w, yes in zip(parts, letters.tolist()) if not yes])
        size = np.zeros(len(parts), np.int64)
        size[letters], size[~letters] = sizes, [len(x) for x in other]
        begin = np.zeros(len(parts), np.int64)
        begin[letters] = np.cumsum(sizes) - sizes
        begin[~letters] = len(plain) + np.cumsum(size[~letters]) - size[~letters]
        rest = np.array([i for x in other for i in x], np.uint32)
        at = np.searchsorted(self.keys, keys)
        self.begins = np.insert(self.begins, at, begin + len(self.flat))
        self.sizes = np.insert(self.sizes, at, size)
        self.keys = np.insert(self.keys, at, keys)
        self.flat = np.concatenate([self.flat, plain, rest])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text begins."""
        words = split_words(texts)
        data, starts, ends = words.data, words.starts, words.ends
        cores = ends.copy()
        going = np.arange(len(ends))
        while len(going):
            going = going[(cores[going] > starts[going]) & _TRAIL[data[cores[going] - 1]]]
            cores[going] -= 1
        odd = np.concatenate([[0], np.cumsum(~_LETTER[data])])
        letters = (odd[cores] == odd[starts]) & (cores > starts)
        split = letters & (cores < ends)
        low = data.copy()
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[letters]] = 1
        inside[cores[letters]] -= 1
        upper = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & (data >= 65) & (data <= 90)
        low[upper] += 32
        # one part for each word, and one for the punctuation cut off
        place = np.arange(len(starts)) + np.cumsum(split) - split
        total = len(starts) + int(split.sum())
        part_start, part_end, plain = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
        part_start[place], part_end[place], plain[place] = starts, np.where(letters, cores, ends), letters
        part_start[place[split] + 1], part_end[place[split] + 1] = cores[split], ends[split]

        keys = span_hashes(low, part_start, part_end)
        fresh, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(fresh) > REMEMBERED:
            self._forget()
        new = ~member(fresh, self.keys)
        raw = low.tobytes()
        begin, end = part_start[first[new]].tolist(), part_end[first[new]].tolist()
        self._learn(fresh[new], [raw[a:b].decode() for a, b in zip(begin, end)], plain[first[new]])
        known = np.searchsorted(self.keys, fresh)[which]
        sizes = self.sizes[known]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        where = np.arange(stops[-1]) + np.repeat(self.begins[known] - stops[:-1], sizes)
        return self.flat[where], stops[np.append(place, total)[words.first]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All pieces of all documents.  ``copy`` tells rows with the same doc_id apart."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer)
        for batch in batches:
            for part in chunks(batch):
                ids, begins = words.ids(part.column("text"))
                rows = []
                for copy, (doc, lo, hi) in enumerate(zip(part.column("doc_id").to_pylist(), begins[:-1].tolist(), begins[1:].tolist())):
                    own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        held = own[start : start + capacity]
                        rows.append((doc, copy, piece, start, len(held), zlib.crc32(held.tobytes())))
                names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, PIECE)


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size; sizes are taken in the given order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual gap
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        gap, least = 0, None
        if count[size]:
            gap, least = size, 1 - 2 * count[size]
        wider = count[size + 1 : capacity]
        room = np.flatnonzero(wider)
        if len(room):
            change = 2 * (count[1 : capacity - size][room] - wider[room]) + 2
            best = int(change.argmin())
            if least is None or change[best] < least:
                gap = size + 1 + int(room[best])
        if gap:
            count[gap] -= 1
            bins[i] = open_bins[gap].pop()
            offsets[i] = capacity - gap
        else:
            gap, bins[i], used = capacity, used, used + 1
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(int(bins[i]))
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    cut = Workspace(docs.sparkSession).keep(pieces(docs, tokenizer, capacity), "pieces")
    packers = max(1, round(cut.count() / share))
    key = F.pmod(F.xxhash64("doc_id", "copy", "piece", "ids_crc32"), F.lit(packers)).cast("int")

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("copy", "ascending")])
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        packer = table["packer"].to_numpy().astype(np.int64)
        columns = {name: table[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return pa.table(columns | {"sequence_id": packer << 32 | bins, "offset": offsets})

    return cut.withColumn("packer", key).groupBy("packer").applyInArrow(place, PLACED)
