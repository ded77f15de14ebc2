"""Substring dedup with sharded FM-indexes (operator 8).

A word goes if a window of 20 consecutive words over it also starts earlier: in a document with a
smaller id, or earlier in the same one.

1. Each window's least 5-gram (by hash, leftmost) is its anchor; neighbouring windows share one, so
   a text falls into segments, one per anchor.  Equal windows have equal anchors.  Anchors are
   counted over all texts; windows whose anchor occurs once are unique and done with.
2. Segments of the other anchors go to the shard of their anchor: one row per distinct segment of a
   slice, its earliest.  Anchors found in very many slices, or with very many words in all, are cut
   into single windows, dealt by the window's own hash, so that no anchor fills a shard.
3. A shard builds a compressed FM-index of its distinct segments.  Every segment is streamed through
   it by backward search over the wavelet matrix; the matching statistics give, per window, the rows
   that match 20 words, and the earliest place among them.  The shard answers which windows are
   first; all other windows of step 2 are repeats.
4. Texts are read again, repeats marked, covered words dropped.

Null and empty texts have no words and stay as they are; texts under 20 words have no window;
null ids come before all others; rows that repeat id and text are one document and are treated
alike; of rows with one id but different texts a window at the same place in both stays in one;
extra columns are ignored; an empty table gives an empty result.  Hashes have 64 bits; segments
are told apart by the hashes of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.exchange import bucket_count, by_bucket, pack, runs, slice_ids, text_bytes_of, unpack
from truthloom.llm.fmindex import FMIndex
from truthloom.llm.words import Words, _edges, chunks, covered, distinct, ngrams, ranges, split_words
from truthloom.plans.workspace import Workspace

WINDOW = 20
ANCHOR = 5
#: Anchors in at least this many slices are cut into windows.
HOT_SLICES = 256
#: Anchors that could send this many words to their shard, from all slices, are cut as well.
HOT_WORDS = 1 << 17
#: Words of the longest segment: all of its windows hold the anchor.
SEGMENT_WORDS = 2 * WINDOW - ANCHOR
#: Text of one shard, relative to what a bucket of hashes stands for.
SHARDS_PER_BUCKET = 32


@dataclass
class Segments:
    """Runs of windows with one anchor: first window, number of windows, anchor's hash, text."""

    starts: np.ndarray
    windows: np.ndarray
    anchors: np.ndarray
    first: np.ndarray  # first segment of every text, and the end


def segments(words: Words, hashes: np.ndarray) -> Segments:
    grams, at = ngrams(hashes, words.first, ANCHOR)
    least = np.full(len(hashes), ~np.uint64(0))
    least[at] = grams
    by_word = least.copy()
    place = np.arange(len(hashes))
    span = 1
    while span < WINDOW - ANCHOR + 1:  # 16 grams of a window, by doubling
        step = min(span, WINDOW - ANCHOR + 1 - span)
        left = least[:-step] <= least[step:]
        place = np.where(left, place[:-step], place[step:])
        least = np.where(left, least[:-step], least[step:])
        span += step
    row = words.row
    ends = words.first[1:][row] if len(row) else row
    valid = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[: len(least)])
    place = place[valid]
    starts, sizes = runs(place)  # an anchor belongs to one text, its windows follow one another
    begin = valid[starts]
    return Segments(begin, sizes, by_word[place[starts]] if len(starts) else by_word[:0], np.searchsorted(begin, words.first))


# --- 1: anchors that occur again ------------------------------------------------------------

_ASK = "bucket int, slice long, keys binary, owners binary, groups binary, about binary"
_ABOUT = np.dtype([("doc", "<i8"), ("null", "u1"), ("text", "<i8"), ("segments", "<u4")])
_NONE = 0xFFFFFFFF


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _questions(texts: DataFrame, buckets: int) -> DataFrame:
    """For each slice and bucket its distinct anchors; their segment where there is only one."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_ids()
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column("text"))
                found = segments(words, words.hashes())
                order = np.argsort(found.anchors, kind="stable")
                keys = found.anchors[order]
                starts, sizes = runs(keys)
                number = next(numbers)
                owners = np.where(sizes == 1, order[starts], _NONE)
                about = np.zeros(part.num_rows, _ABOUT)
                ids = part.column("doc_id")
                about["doc"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
                about["null"] = ids.is_null().to_numpy(zero_copy_only=False)
                about["text"] = part.column("mark").to_numpy()
                about["segments"] = np.diff(found.first)
                known = np.ones(len(order), bool)
                known[order] = np.repeat(sizes > 1, sizes)
                home = about.tobytes() + np.packbits(known).tobytes()
                borders, inside = by_bucket(keys[starts], buckets)
                spans = list(zip(borders[:-1].tolist(), borders[1:].tolist()))
                # anchors that occur twice here are named too: an answer may call them hot
                twice = [order[ranges(starts[a:b][sizes[a:b] > 1], sizes[a:b][sizes[a:b] > 1])] for a, b in spans]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(buckets), pa.int32()), pa.array([number] * buckets, pa.int64()),
                    pa.array([pack(inside[a:b], "<u4") for a, b in spans], pa.binary()),
                    pa.array([pack(owners[a:b], "<u4") for a, b in spans], pa.binary()),
                    pa.array([pack(sizes[a:b], "<u4") + pack(t, "<u4") for (a, b), t in zip(spans, twice)], pa.binary()),
                    pa.array([home + len(about).to_bytes(8, "little") if i == number % buckets else None for i in range(buckets)], pa.binary()),
                ], ["bucket", "slice", "keys", "owners", "groups", "about"])

    return texts.mapInArrow(ask, _ASK)


def _answer(hot_slices: int, hot_words: int = HOT_WORDS):
    def answer(table: pa.Table) -> pa.Table:
        """One bucket: for each slice the segments whose anchor occurs again, and those with a hot one."""
        keys, sizes = unpack(table["keys"].to_pylist(), "<u4")
        owners, _ = unpack(table["owners"].to_pylist(), "<u4")
        order = np.argsort(keys, kind="stable")
        starts, lengths = runs(keys[order])
        seen_in = np.zeros(len(keys), np.int64)
        seen_in[order] = np.repeat(lengths, lengths)
        counted = [np.frombuffer(g, "<u4")[:n] for n, g in zip(sizes.tolist(), table["groups"].to_pylist())]
        counted = np.concatenate([np.zeros(0, "<u4"), *counted]).astype(np.int64)
        total = np.add.reduceat(counted[order], starts) if len(starts) else starts
        heat = np.zeros(len(keys), bool)
        heat[order] = np.repeat((lengths >= hot_slices) | (total * SEGMENT_WORDS >= hot_words), lengths)
        again, hot, at = [], [], 0
        for n, groups in zip(sizes.tolist(), table["groups"].to_pylist()):
            own, seen, warm = owners[at : at + n], seen_in[at : at + n], heat[at : at + n]
            groups = np.frombuffer(groups, "<u4")
            counts, twice = groups[:n].astype(np.int64), groups[n:]
            single = own != _NONE
            again.append(pack(own[single & (seen > 1)], "<u4"))
            hot.append(pack(np.concatenate([own[single & warm], twice[np.repeat(warm[~single], counts[~single])]]), "<u4"))
            at += n
        return pa.table({
            "slice": table["slice"], "again": pa.array(again, pa.binary()), "hot": pa.array(hot, pa.binary()), "about": table["about"],
        })

    return answer


def _flag_slice(table: pa.Table) -> pa.Table:
    """One slice: per text with repeated anchors, bits of its repeated and of its hot segments."""
    home = next(b for b in table["about"].to_pylist() if b is not None)
    rows = int.from_bytes(home[-8:], "little")
    about = np.frombuffer(home[: rows * _ABOUT.itemsize], _ABOUT)
    total = int(about["segments"].sum())
    again = np.unpackbits(np.frombuffer(home[rows * _ABOUT.itemsize : -8], np.uint8), count=total)
    again[unpack(table["again"].to_pylist(), "<u4")[0]] = 1
    hot = np.zeros(total, np.uint8)
    hot[unpack(table["hot"].to_pylist(), "<u4")[0]] = 1
    borders = np.concatenate([[0], np.cumsum(about["segments"].astype(np.int64))])
    some = [i for i in range(rows) if again[borders[i] : borders[i + 1]].any()]
    return pa.table({
        "doc_id": pa.array(about["doc"][some], pa.int64(), mask=about["null"][some].astype(bool)), "mark": pa.array(about["text"][some], pa.int64()),
        "again": pa.array([np.packbits(again[borders[i] : borders[i + 1]]).tobytes() for i in some], pa.binary()),
        "hot": pa.array([np.packbits(hot[borders[i] : borders[i + 1]]).tobytes() for i in some], pa.binary()),
    })


def _bits(blobs: list[bytes | None], first: np.ndarray) -> np.ndarray:
    """The flags of all segments of a slice; texts without a blob have none."""
    out = np.zeros(int(first[-1]), bool)
    for blob, a, b in zip(blobs, first[:-1].tolist(), first[1:].tolist()):
        if blob is not None and b > a:
            out[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a)
    return out


# --- 2 and 3: shards --------------------------------------------------------------------------

_SENT = "bucket int, docs binary, nulls binary, marks binary, starts binary, sizes binary, data binary"


def _send(flagged: DataFrame, buckets: int) -> DataFrame:
    """Distinct repeated segments of each slice, packed by shard."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column("text"))
                hashes = words.hashes()
                found = segments(words, hashes)
                again = _bits(part.column("again").to_pylist(), found.first)
                hot = _bits(part.column("hot").to_pylist(), found.first)
                plain = np.flatnonzero(again & ~hot)
                cut = np.flatnonzero(again & hot)
                windows = ranges(found.starts[cut], found.windows[cut])
                whole, at = ngrams(hashes, words.first, WINDOW) if len(windows) else (hashes[:0], windows)
                starts = np.concatenate([found.starts[plain], windows])
                spans = np.concatenate([found.windows[plain] + WINDOW - 1, np.full(len(windows), WINDOW)])
                keys = np.concatenate([found.anchors[plain], whole[np.searchsorted(at, windows)]])
                if len(starts):
                    yield _packed(part, words, hashes, starts, spans, keys, buckets)

    return flagged.mapInArrow(send, _SENT)


def _sequence_hash(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run of words, from the hashes of its words and their places in it."""
    flat = ranges(starts, sizes)
    place = (flat - np.repeat(starts, sizes)).astype(np.uint64)
    salted = (hashes[flat] + place * np.uint64(0x9E3779B97F4A7C15)) * ((place << np.uint64(1)) + np.uint64(0xD6E8FEB86659FD93))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted ^ (salted >> np.uint64(29)))])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _earliest(content: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The earliest of all segments with the same content, for each content."""
    order = np.lexsort((starts, docs, sizes, content))
    same = (content[order][1:] == content[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])
    return np.sort(order[np.concatenate([[True], ~same])]) if len(order) else order


def _packed(part, words, hashes, starts, spans, keys, buckets) -> pa.RecordBatch:
    row = np.searchsorted(words.first, starts, "right") - 1
    ids = part.column("doc_id")
    null = ids.is_null().to_numpy(zero_copy_only=False)[row]
    docs = np.where(null, np.iinfo(np.int64).min, ids.fill_null(0).to_numpy(zero_copy_only=False)[row])
    marks = part.column("mark").to_numpy()[row]
    local = starts - words.first[row]
    one = _earliest(_sequence_hash(hashes, starts, spans), docs, local, spans)
    one = one[np.argsort(keys[one], kind="stable")]
    borders, _ = by_bucket(keys[one], buckets)
    first, last = words.starts[starts[one]], words.ends[starts[one] + spans[one] - 1]
    rows = []
    for bucket in np.flatnonzero(np.diff(borders)).tolist():
        a, b = borders[bucket], borders[bucket + 1]
        own = one[a:b]
        data = words.data[ranges(first[a:b], last[a:b] - first[a:b])]
        rows.append((
            bucket, pack(docs[own], "<i8"), pack(null[own], "u1"), pack(marks[own], "<i8"), pack(local[own], "<u4"),
            pack(last[a:b] - first[a:b], "<u4"), data.tobytes(),
        ))
    names = [x.split(" ")[0] for x in _SENT.split(", ")]
    kinds = [pa.int32()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_FIRST = "doc_id long, mark long, firsts binary"


def _search(table: pa.Table) -> pa.Table:
    """One shard: per text, the windows that are the first with their words."""
    pa.default_memory_pool().release_unused()
    docs, _ = unpack(table["docs"].to_pylist(), "<i8")
    null, _ = unpack(table["nulls"].to_pylist(), "u1")
    marks, _ = unpack(table["marks"].to_pylist(), "<i8")
    starts = unpack(table["starts"].to_pylist(), "<u4")[0].astype(np.int64)
    sizes, _ = unpack(table["sizes"].to_pylist(), "<u4")
    data, _ = unpack(table["data"].to_pylist(), "u1")
    offsets = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    words = _words_of(data, offsets)
    hashes = words.hashes()
    one = _earliest(_sequence_hash(hashes, words.first[:-1], words.counts), docs, starts, words.counts)
    lengths = words.counts[one]
    known = distinct(hashes)
    flat = np.searchsorted(known, hashes[ranges(words.first[one], lengths)]) + 1
    # segments one after another, each followed by a separator 0
    first = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    text[ranges(first, lengths)] = flat
    index = FMIndex(text, len(known) + 1, WINDOW)

    owner = np.repeat(np.arange(len(one)), lengths + 1)
    place = starts[one][owner] + np.arange(len(text)) - first[owner]
    rows_doc, rows_place = docs[one][owner][index.suffixes], place[index.suffixes]
    del owner, place, text
    borders = np.flatnonzero(np.diff(index.group, prepend=-1))
    least_doc = np.minimum.reduceat(rows_doc, borders)
    rows_place[rows_doc != least_doc[index.group]] = np.iinfo(np.int64).max
    least_place = np.minimum.reduceat(rows_place, borders)
    del rows_doc, rows_place

    low, high = index.matches(flat, np.concatenate([[0], np.cumsum(lengths)]))
    window = np.flatnonzero(high > low)
    of = np.repeat(np.arange(len(one)), lengths)[window]
    at = starts[one][of] + window - (np.cumsum(lengths) - lengths)[of]
    group = index.group[low[window]]
    is_first = (least_doc[group] == docs[one][of]) & (least_place[group] == at)
    of, at = one[of[is_first]], at[is_first]

    order = np.lexsort((at, marks[of], docs[of]))
    of, at = of[order], at[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (docs[of][1:] != docs[of][:-1]) | (marks[of][1:] != marks[of][:-1])
    begin = np.flatnonzero(fresh)
    ends = np.append(begin[1:], len(of))
    return pa.table({
        "doc_id": pa.array(docs[of[begin]], pa.int64(), mask=null[of[begin]].astype(bool)),
        "mark": pa.array(marks[of[begin]], pa.int64()),
        "firsts": pa.array([pack(at[a:b], "<u4") for a, b in zip(begin, ends)], pa.binary()),
    })


def _words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    blanks = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends = _edges(~blanks, offsets)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


# --- 4: the texts again -------------------------------------------------------------------------

def repeated_words(words: Words, again: np.ndarray, found: Segments, firsts: list[list[bytes] | None]) -> np.ndarray:
    """Which words lie in a repeated window."""
    repeat = ranges(found.starts[again], found.windows[again])
    keep = [
        np.concatenate([np.frombuffer(b, "<u4") for b in blobs]).astype(np.int64) + begin
        for blobs, begin in zip(firsts, words.first[:-1].tolist()) if blobs
    ]
    if keep:
        repeat = repeat[~np.isin(repeat, np.concatenate(keep))]
    return covered(repeat, WINDOW, len(words.starts))


def _strip(marked: DataFrame, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split_words(part.column("text"))
                found = segments(words, words.hashes())
                again = _bits(part.column("again").to_pylist(), found.first)
                gone = repeated_words(words, again, found, part.column("firsts").to_pylist())
                raw = words.data.tobytes()
                total = np.concatenate([[0], np.cumsum(gone)])
                texts = []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    own = np.arange(a, b)[~gone[a:b]] if total[b] > total[a] else np.arange(a, b)
                    texts.append(b" ".join([raw[i:j] for i, j in zip(words.starts[own].tolist(), words.ends[own].tolist())]))
                columns = {
                    "doc_id": part.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()),
                    "n_removed": pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                }
                if with_text:
                    columns["kept"] = pa.array([t.decode() for t in texts], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return marked.mapInArrow(strip, schema)


def _beside(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """Texts with their notes; a text may have none.

    Notes are a small part of the texts' size: they are hashed in each task, texts stream by unsorted.
    """
    keyed = notes.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"}).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    return texts.join(keyed, same, "left").drop("_doc", "_mark")


def drop_repeats(docs: DataFrame, hot_slices: int = HOT_SLICES, with_text: bool = False, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_removed, kept_sha256, and the kept words if wanted."""
    work = Workspace(docs.sparkSession)
    texts = _texts(docs)
    buckets = bucket_count(text_bytes_of(texts))
    answers = _questions(texts, buckets).groupBy("bucket").applyInArrow(
        _answer(hot_slices, hot_words), "slice long, again binary, hot binary, about binary")
    flags = answers.groupBy("slice").applyInArrow(_flag_slice, "doc_id long, mark long, again binary, hot binary")
    flags = work.keep(flags.dropDuplicates(["doc_id", "mark"]), "flags")
    flagged = _beside(texts, flags).where("again IS NOT NULL")
    found = _send(flagged, buckets * SHARDS_PER_BUCKET).groupBy("bucket").applyInArrow(_search, _FIRST)
    firsts = found.groupBy("doc_id", "mark").agg(F.collect_list("firsts").alias("firsts"))
    notes = flags.select("doc_id", "mark", "again").join(
        firsts.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"}),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left",
    ).select("doc_id", "mark", "again", "firsts")
    return _strip(_beside(texts, work.keep(notes, "notes")), with_text)


# DuckDB: the first place of every window's words, then the words covered by other places.
SUBSTRING_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i AS start, md5(array_to_string(w[i + 1:i + 20], ' ')) AS content
  FROM words, unnest(range(0, greatest(len(w) - 19, 0))) AS t(i)
), repeats AS (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, start) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT start + k) AS gone FROM repeats, unnest(range(0, 20)) AS t(k) GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(gone, []) AS gone FROM words LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)), ' ')) AS kept_sha256
FROM kept
"""
