"""Alignment of the tokens of two tokenizers, with corpus-wide counts of linked pairs (operator 11).

Offsets where both tokenizers end a token cut a text into groups; every token A of a group is linked
with every token B of it.  Neither tokenizer looks across the border before a space that follows another
character than a space (see ``borders``), so each distinct part between such borders is encoded and
aligned once in a task, and joined back by position.

How many documents hold a pair is counted outside memory:

1. A slice of some megabytes of text sorts its (pair, document) records by A id, B id and document and
   cuts them by radix, a hash of the A id, into runs of zstd blocks: a *head* (pairs and their number of documents)
   and a *body* (documents and multiplicities).  All runs are written to a table in the shared folder.
2. The heads of a radix are merged by a k-way heap, side by side in order of the A id, adding up
   the counts of equal pairs.  A radix with many bytes is cut into pieces by slice; merged heads are
   merged again, FAN_IN at a time, until one is left per radix.  As all pairs of an A id meet
   there, its highest count is known at once.
3. Each piece streams its runs once more, looks its pairs up in the counts of its radix, and sends one
   block per run back to the run's slice: the sums of each document.

Hot ids: however many documents hold a pair, a head has it once per slice.  A final head has a pair of ids at most once, so its
size is bounded by the vocabularies.  Nothing is dropped.  Blocks hold a few kilobytes and are never more than
slices x RADIXES.

Null or empty texts, and texts whose tokens don't give back their bytes, have no tokens: zeros and ''.  Ties for an A id's highest
count all count as best; repeated rows are documents of their own; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.chunktable import ChunkTable, Flat, stretches
from truthloom.llm.exchange import slice_ids
from truthloom.llm.pieces import PieceTokenizer
from truthloom.llm.words import chunks, ranges, text_bytes
from truthloom.plans.workspace import Workspace

#: Bytes of text of a slice.
SLICE_BYTES = 2 << 20
#: Bytes of text whose groups are written out at a time.
STRETCH_BYTES = 512 << 10
#: Parts that the records are cut into by A id.
RADIXES = 128
#: Compressed bytes of the runs that one task reads.
PIECE_BYTES = 8 << 20
#: Tokens of both sides in a group above which its distinct ids are counted before they are paired.
MANY = 64
#: Heads merged by one task.
FAN_IN = 64

SPILLED = (
    "slice long, radix int, head binary, body binary, at int, doc_id long, n_a long, n_b long, n_groups long, "
    "n_links long, groups_sha256 string, groups string"
)
MERGED = "radix int, piece int, head binary"
SENT = "slice long, sums binary"
TOLD = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
)


# --- parts ---

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True  # visible ASCII
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xF5] = True  # first bytes of characters beyond U+00BF
_LEAD[0xE1:0xE4] = False  # except those under which white space is found


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the parts: each text's first byte, and spaces that begin a token of both tokenizers.

    B never joins a marker to a character before it.  A's pattern ends a token before a space when
    the character before it is no white space, or the one after it.
    """
    border = np.zeros(len(data), bool)
    if len(data) > 2:
        before, after = data[:-2], data[2:]
        border[1:-1] = (data[1:-1] == 32) & (before != 32) & (_PLAIN[after] | _LEAD[after] | (_PLAIN[before] & (after != 32)))
    border[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(border)


def spaced(texts: pa.Array) -> pa.Array:
    """A space and the text; nothing for empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
    return pc.binary_join_element_wise(prefix, texts, pa.scalar("", pa.large_string()))


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and back."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def decimals(size: int) -> Flat:
    """The decimal digits of every number below ``size``, and room for a separator."""
    shown = Flat(np.uint8)
    text = [f"{i};".encode() for i in range(size)]
    shown.add(np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text]))
    return shown


def first_of(sizes: np.ndarray) -> np.ndarray:
    """Where each of the consecutive lists of these sizes begins."""
    return np.cumsum(sizes) - sizes


class Aligner:
    """Groups and linked pairs of texts through those of their distinct parts."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), PieceTokenizer(path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=False)
        held = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            held[i] = bytes(letters[c] for c in name)
        self.surface = Flat(np.uint8)
        self.surface.add(np.frombuffer(b"".join(held), np.uint8), np.array([len(h) for h in held]))
        self.decimals = decimals(max(len(held), self.b.inner.get_piece_size()))
        if len(self.decimals.stops) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 ids are not supported")
        self.pairs, self.times, self.shown, self.figures = Flat(np.uint32), Flat(np.int64), Flat(np.uint8), Flat(np.int64)
        self.table = ChunkTable(self._learn, self._forget)

    def _forget(self) -> None:
        for flat in (self.pairs, self.times, self.shown, self.figures):
            flat.clear()

    def _learn(self, parts: list[bytes]) -> None:
        ids, sizes = [], []
        for found in ([e.ids for e in self.a.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)], self.b.segment(parts)):
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int64, int(sizes[-1].sum())))
        good = self._whole(parts, ids, sizes)
        if not good.all():  # these have no tokens
            ids = [own[np.repeat(good, size)] for own, size in zip(ids, sizes)]
            sizes = [np.where(good, size, 0) for size in sizes]
        group_sizes, group_part = self._groups(ids, sizes)
        figures = np.zeros((len(parts), 5), np.int64)
        figures[:, 0], figures[:, 1], figures[:, 2] = good, *sizes
        figures[:, 3] = np.bincount(group_part, minlength=len(parts))
        np.add.at(figures[:, 4], group_part, group_sizes[0] * group_sizes[1])
        self.figures.add(figures.ravel(), np.full(len(parts), 5))
        self._add_shown(ids, group_sizes, group_part, len(parts))
        keys, times = linked(ids, group_sizes, group_part)
        self.pairs.add((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(parts)))
        self.times.add(times, np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(parts)))

    def _whole(self, parts: list[bytes], ids: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """Which parts are given back by the tokens of both sides."""
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        data, good = np.frombuffer(b"".join(parts), np.uint8), np.ones(len(parts), bool)
        for surface, own, size in zip((self.surface, self.b.surface), ids, sizes):
            row = np.repeat(np.arange(len(parts)), size)
            held = np.zeros(len(parts), np.int64)
            np.add.at(held, row, surface.sizes(own))
            same = held == length
            shown, want = surface.take(own[same[row]]), data[np.repeat(same, length)]
            same[np.repeat(np.flatnonzero(same), length[same])[shown != want]] = False
            good &= same
        return good

    def _groups(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Number of tokens of every group on both sides, and its part; groups in order of their bytes."""
        ends = [np.cumsum(surface.sizes(own)) for surface, own in zip((self.surface, self.b.surface), ids)]
        shared = [np.isin(ends[0], ends[1], assume_unique=True), np.isin(ends[1], ends[0], assume_unique=True)]
        stops = [np.flatnonzero(own) + 1 for own in shared]
        part = np.repeat(np.arange(len(sizes[0])), sizes[0])[stops[0] - 1]
        return [np.diff(own, prepend=0) for own in stops], part

    def _add_shown(self, ids: list[np.ndarray], group_sizes: list[np.ndarray], group_part: np.ndarray, parts: int) -> None:
        """The groups as text: ids of A with commas, a bar, ids of B with commas, a semicolon."""
        sizes_a, sizes_b = group_sizes
        merged = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        mark = np.full(len(merged), ord(","), np.uint8)
        begin = first_of(sizes_a + sizes_b)
        merged[ranges(begin, sizes_a)] = ids[0]
        merged[ranges(begin + sizes_a, sizes_b)] = ids[1]
        mark[begin + sizes_a - 1], mark[begin + sizes_a + sizes_b - 1] = ord("|"), ord(";")
        width = self.decimals.sizes(merged)
        shown = self.decimals.take(merged)
        shown[np.cumsum(width) - 1] = mark
        held = np.zeros(parts, np.int64)
        np.add.at(held, np.repeat(group_part, sizes_a + sizes_b), width)
        self.shown.add(shown, held)

    def align(self, texts: pa.Array, with_groups: bool = False) -> dict:
        """Per text the figures and the digest; sorted (pair, text, times) records of all texts."""
        data, offsets = text_bytes(spaced(texts))
        starts = borders(data, offsets)
        ends = np.append(starts, len(data))[1:]
        first = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        totals, good = np.zeros((len(texts), 4), np.int64), np.ones(len(texts), bool)
        hashes, told = [sha256() for _ in range(len(texts))], [[] for _ in range(len(texts))]
        records = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi in stretches(ends, STRETCH_BYTES):
            rows, own = self.table.lookup(data, starts[lo:hi], ends[lo:hi]), row[lo:hi]
            figures = self.figures.values.reshape(-1, 5)[rows]
            good[own[figures[:, 0] == 0]] = False
            np.add.at(totals, own, figures[:, 1:])
            held, begin = self.shown.take(rows).tobytes(), np.concatenate([[0], np.cumsum(self.shown.sizes(rows))])
            turns = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            for x, y in zip(turns[:-1].tolist(), turns[1:].tolist()):
                hashes[own[x]].update(shown := held[begin[x] : begin[y] - (y + lo == first[own[x] + 1])])
                if with_groups:
                    told[own[x]].append(shown)
            both, often = np.unique(own.astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64), return_counts=True)
            part, text = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
            sizes = self.pairs.sizes(part)
            keys = self.pairs.take(part).astype(np.uint64) << np.uint64(32) | np.repeat(text, sizes)
            for kept, fresh in zip(records, added(keys, self.times.take(part) * np.repeat(often, sizes))):
                kept.append(fresh)
        keys, times = added(np.concatenate(records[0]), np.concatenate(records[1]))
        text = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        held = good[text]
        totals[~good] = 0
        has = good & (totals[:, 0] > 0)
        return {
            "figures": totals, "sha": [h.hexdigest() if yes else "" for h, yes in zip(hashes, has.tolist())],
            "groups": [b"".join(t).decode() if yes else "" for t, yes in zip(told, has.tolist())],
            "pairs": (keys[held] >> np.uint64(32)).astype(np.uint32), "texts": text[held], "times": times[held],
        }


def linked(ids: list[np.ndarray], group_sizes: list[np.ndarray], group_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys part << 32 | A << 16 | B of all links of the groups, in order, and how often each occurs."""
    many = np.flatnonzero(np.minimum(*group_sizes) > MANY)  # long runs of few ids: count the ids first
    few = np.ones(len(group_part), bool)
    few[many] = False
    begin = [first_of(own) for own in group_sizes]
    turn = np.repeat(np.arange(len(few)), group_sizes[0])  # the group of every token A
    wide = np.where(few, group_sizes[1], 0)[turn]
    a = np.repeat(ids[0], wide)
    b = ids[1][ranges(begin[1][turn], wide)]
    part = np.repeat(group_part[turn], wide)
    keys, times = [part << 32 | a << 16 | b], [np.ones(len(a), np.int64)]
    for group in many.tolist():
        own = [np.unique(ids[i][begin[i][group] : begin[i][group] + group_sizes[i][group]], return_counts=True) for i in (0, 1)]
        keys.append((int(group_part[group]) << 32 | own[0][0][:, None] << 16 | own[1][0]).ravel())
        times.append((own[0][1][:, None] * own[1][1]).ravel())
    return added(np.concatenate(keys).astype(np.uint64), np.concatenate(times))


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(values, begin)


# --- blocks ---

def block(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes one after another, as one zstd frame."""
    size = np.array([len(columns[0])], "<i8").tobytes()
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(size + b"".join(planes))


def unblock(frame: bytes, *kinds: str) -> list[np.ndarray]:
    held = zstandard.ZstdDecompressor().decompress(frame)
    size, at, found = int(np.frombuffer(held[:8], "<i8")[0]), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(held[at : at + size * width], np.uint8).reshape(width, size)
        found.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * width
    return found


HEAD, BODY, FINAL, SUMS = ("<u4", "<i8"), ("<u4", "<i8"), ("<u4", "<i8", "u1"), ("<u4", "<i8", "<i8")


def radix_of(pairs: np.ndarray) -> np.ndarray:
    side = (pairs >> np.uint32(16)).astype(np.uint32)
    return (side * np.uint32(0x9E3779B1)) >> np.uint32(32 - RADIXES.bit_length() + 1)


def cut_runs(pairs: np.ndarray, texts: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Radix, head and body of every run of one slice; the records are sorted by pair and text."""
    radix = radix_of(pairs)
    order = np.argsort(radix, kind="stable")
    radix, pairs, texts, times = radix[order], pairs[order], texts[order], times[order]
    begin = np.searchsorted(radix, np.arange(RADIXES + 1))
    for r in np.flatnonzero(np.diff(begin)).tolist():
        own = pairs[begin[r] : begin[r + 1]]
        fresh = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        head = block(own[fresh], np.diff(np.append(fresh, len(own))).astype("<i8"))
        yield r, head, block(texts[begin[r] : begin[r + 1]].astype("<u4"), times[begin[r] : begin[r + 1]].astype("<i8"))


def merge_heads(heads: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of one A id after another, in order, off a heap with the next A id of every head."""
    stops, heap = [], []
    for number, (pairs, _) in enumerate(heads):
        side = pairs >> np.uint32(16)
        begin = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        stops.append(np.append(begin, len(pairs)).tolist())
        heap.append((int(side[0]), number, 0))
    heapq.heapify(heap)
    while heap:
        side, same = heap[0][0], []
        while heap and heap[0][0] == side:
            _, number, at = heap[0]
            lo, hi = stops[number][at], stops[number][at + 1]
            same.append((heads[number][0][lo:hi], heads[number][1][lo:hi]))
            if hi < len(heads[number][0]):
                heapq.heapreplace(heap, (int(heads[number][0][hi] >> np.uint32(16)), number, at + 1))
            else:
                heapq.heappop(heap)
        yield same[0] if len(same) == 1 else added(np.concatenate([p for p, _ in same]), np.concatenate([c for _, c in same]))


# --- jobs ---

def spill(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Rows of documents (radix -1) and runs of linked pairs of every slice."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, ids = Aligner(path_a, path_b), slice_ids()
        schema = pa.schema([(f.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[f.split(" ")[1]])
                            for f in SPILLED.split(", ")])

        def rows(number: int, columns: dict) -> pa.RecordBatch:
            size = len(columns["radix"])
            columns |= {"slice": [number] * size}
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)

        for batch in batches:
            for part in chunks(batch, most=SLICE_BYTES):
                number, found = next(ids), both.align(part.column("text"), with_groups)
                names = ("n_a", "n_b", "n_groups", "n_links")
                yield rows(number, {
                    "radix": [-1] * part.num_rows, "at": list(range(part.num_rows)), "doc_id": part.column("doc_id").to_pylist(),
                    "groups_sha256": found["sha"], "groups": found["groups"], **{n: found["figures"][:, i] for i, n in enumerate(names)},
                })
                cut = list(cut_runs(found["pairs"], found["texts"], found["times"]))
                if cut:
                    yield rows(number, {"radix": [r for r, _, _ in cut], "head": [h for _, h, _ in cut], "body": [b for _, _, b in cut]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(write, SPILLED)


def _merge(last: bool):
    def merge(table: pa.Table) -> pa.Table:
        heads = [unblock(head, *HEAD) for head in table["head"].to_pylist()]
        pairs, counts, best = [], [], []
        for own, count in merge_heads(heads):
            pairs.append(own)
            counts.append(count)
            best.append((count == count.max()).astype(np.uint8))
        columns = [np.concatenate(pairs), np.concatenate(counts).astype("<i8")] + ([np.concatenate(best)] if last else [])
        return pa.table({"radix": table["radix"][:1], "piece": table["piece"][:1], "head": pa.array([block(*columns)], pa.binary())})

    return merge


def _send(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """Per run the sums of its documents."""
    known, count, best = unblock(counts["head"][0].as_py(), *FINAL) if runs.num_rows else (None,) * 3
    sums = []
    for head, body in zip(runs["head"], runs["body"]):
        pairs, n_docs = unblock(head.as_py(), *HEAD)
        docs, times = unblock(body.as_py(), *BODY)
        at = np.repeat(np.searchsorted(known, pairs), n_docs)
        held, which = np.unique(docs, return_inverse=True)
        total = np.zeros((2, len(held)), np.int64)
        np.add.at(total[0], which, times * best[at])
        np.add.at(total[1], which, times * count[at])
        sums.append(block(held, total[0], total[1]))
    return pa.table({"slice": runs["slice"], "sums": pa.array(sums, pa.binary())})


def _told(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of one slice with their sums."""
    total = np.zeros((2, docs.num_rows), np.int64)
    for frame in sums["sums"]:
        held, best, count = unblock(frame.as_py(), *SUMS)
        total[0][held] += best
        total[1][held] += count
    at = docs["at"].to_numpy()
    own = {"n_best": pa.array(total[0][at], pa.int64()), "count_sum": pa.array(total[1][at], pa.int64())}
    names = [f.split(" ")[0] for f in TOLD.split(", ")]
    return pa.table({name: own.get(name, docs[name] if name in docs.column_names else None) for name in names})


def align_tokens(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): tokens, groups, links and the corpus-wide counts of its links.

    ``groups`` holds the groups themselves if ``with_groups``, else ''.
    """
    work = Workspace(docs.sparkSession)
    spilled = work.keep(spill(docs, path_a, path_b, with_groups), "spilled")
    runs = spilled.where("radix >= 0").select("slice", "radix", "head", "body")
    size = F.sum((F.octet_length("head") + F.octet_length("body")).cast("long"))
    pieces = work.keep(runs.groupBy("radix").agg(F.ceil(size / PIECE_BYTES).cast("int").alias("pieces")), "pieces")
    piece = F.pmod(F.xxhash64("slice"), "pieces").cast("int").alias("piece")
    cut = runs.join(F.broadcast(pieces), "radix")  # a row per radix
    most = pieces.agg(F.max("pieces")).first()[0] or 1
    heads = cut.select("radix", piece, "head")
    while True:
        last = most == 1
        heads = work.keep(heads.groupBy("radix", "piece").applyInArrow(_merge(last), MERGED), "counts")
        if last:
            break
        most = -(-most // FAN_IN)
        heads = heads.select("radix", F.pmod(F.col("piece"), F.lit(most)).alias("piece"), "head")
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    counts = heads.join(F.broadcast(pieces), "radix").select("radix", every, "head")
    own = cut.select("radix", piece, "slice", "head", "body")
    sums = own.groupBy("radix", "piece").cogroup(counts.groupBy("radix", "piece")).applyInArrow(_send, SENT)
    told = spilled.where("radix < 0").drop("radix", "head", "body")
    return told.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(_told, TOLD)


def alignment_digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return align_tokens(docs, path_a, path_b).drop("groups")
