"""N-gram Jaccard join with a prefix tree (operator 9).

The set of a text is its distinct 5-word shingles; two texts link when their sets have a Jaccard
similarity of 0.75 or more.  The result is the connected component of every text.

1. Texts with equal sets form a class.  Shingles below the middle of the hash space are counted
   over all texts: a text too few of whose shingles occur elsewhere cannot link and goes no further.
2. The remaining sets are ordered by frequency, rarest shingles first; shingles of one set only are
   left out (they never match).  Two linked sets share a shingle among the first n - ceil(0.75 n) + 1.
   Sets with a common shingle there, and sizes that allow a link, fall into one shard.
3. In each shard the ordered sets are inserted into a prefix tree.  A set goes down the tree and
   carries its overlap along, so that sets with a common beginning are compared once; a subtree is
   left when the overlap so far and the lengths that remain cannot reach the threshold, or when
   all of its sets are in the same component already.
4. Shards with more than ``BLOCK`` classes are cut.  Each piece also holds the shard's first class;
   classes that a piece does not connect with it ('loose') are then compared with the other pieces,
   two pieces a task, and only classes that share a shingle of both beginnings are sent there.

No link between different sets is lost, no pair of texts is written.  Shingles are 64-bit hashes
and sets are named by 128 bits; two different sets of one corpus share a name with a probability
of about 2^-128 a pair.

Null and empty texts have no shingles and link with nothing; texts with fewer words are one
shingle; repeated rows are equal texts; null ids never name a component unless it has no other;
extra columns are ignored by ``jaccard_components`` and kept by ``keep_one``; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.exchange import bucket_count, by_bucket, pack, runs, slice_ids, text_bytes_of, unpack
from truthloom.llm.graph import Union, components
from truthloom.llm.words import chunks, mix, ngrams, split_words
from truthloom.plans.workspace import Workspace

WIDTH = 5
# The threshold 0.75 as a fraction.
UP, DOWN = 3, 4
HALF = np.uint64(1 << 63)
#: Classes of one tree.
BLOCK = 4000
ORDER_BITS = np.uint64(56)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, and where each text begins."""
    words = split_words(texts, lower=True)
    hashes, row = words.hashes(), words.row
    grams, at = ngrams(hashes, words.first, WIDTH)
    keys, rows = [grams], [row[at]]
    for width in range(1, WIDTH):
        of_width = np.flatnonzero(words.counts == width)
        total = np.full(len(of_width), np.uint64(width))
        for i in range(width):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[words.first[of_width] + i])
        keys.append(total)
        rows.append(of_width)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[fresh], np.searchsorted(rows[fresh], np.arange(len(words.offsets)))


def signatures(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for every set, as 16 bytes each."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(salt)))])
        out[:, i] = mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64))
    return out


def _names(marks: np.ndarray) -> list[bytes]:
    raw = marks.astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def spare(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set may be missing from a set it links with."""
    return n * (DOWN - UP) // DOWN


# --- 1: which texts can link at all -------------------------------------------------------

_ASK = "bucket int, slice long, keys binary, owners binary, about binary"
_ABOUT = np.dtype([("doc", "<i8"), ("null", "u1"), ("mark", "<i8"), ("n", "<u4"), ("asked", "<u4"), ("known", "<u4"), ("a", "<u8"), ("b", "<u8")])
_SIGNED = "doc_id long, mark long, n long, sig binary, candidate boolean"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _questions(texts: DataFrame, buckets: int) -> DataFrame:
    """For each slice and bucket the sampled shingles that occur once in the slice, with their texts."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_ids()
        for batch in batches:
            for part in chunks(batch):
                for at in range(0, part.num_rows, 60_000):  # a text's number takes 16 bits
                    yield _ask(part.slice(at, 60_000), next(numbers))

    def _ask(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        keys, first = shingle_sets(part.column("text"))
        rows = np.repeat(np.arange(part.num_rows), np.diff(first))
        low = keys < HALF
        keys_low, owner = keys[low] << np.uint64(1), rows[low]
        order = np.argsort(keys_low, kind="stable")
        keys_low, owner = keys_low[order], owner[order]
        starts, sizes = runs(keys_low)
        again = np.repeat(sizes > 1, sizes)
        about = np.zeros(part.num_rows, _ABOUT)
        ids = part.column("doc_id")
        about["doc"], about["null"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        about["mark"] = part.column("mark").to_numpy()
        about["n"], about["asked"] = np.diff(first), np.bincount(owner, minlength=part.num_rows)
        about["known"] = np.bincount(owner[again], minlength=part.num_rows)
        marks = signatures(keys, first)
        about["a"], about["b"] = marks[:, 0], marks[:, 1]
        owner = np.where(again, 0xFFFF, owner)[starts]  # an item found again here is sent once, for others
        borders, inside = by_bucket(keys_low[starts], buckets)
        spans = list(zip(borders[:-1].tolist(), borders[1:].tolist()))
        home = number % buckets
        return pa.RecordBatch.from_arrays([
            pa.array(range(buckets), pa.int32()), pa.array([number] * buckets, pa.int64()),
            pa.array([pack(inside[a:b], "<u4") for a, b in spans], pa.binary()),
            pa.array([pack(owner[a:b], "<u2") for a, b in spans], pa.binary()),
            pa.array([about.tobytes() if i == home else None for i in range(buckets)], pa.binary()),
        ], ["bucket", "slice", "keys", "owners", "about"])

    return texts.mapInArrow(ask, _ASK)


def _found_again(table: pa.Table) -> pa.Table:
    """One bucket: for each slice the texts, repeated, that own items found in other slices or again."""
    keys, sizes = unpack(table["keys"].to_pylist(), "<u4")
    owners, _ = unpack(table["owners"].to_pylist(), "<u2")
    order = np.argsort(keys, kind="stable")
    starts, lengths = runs(keys[order])
    again = np.zeros(len(keys), bool)
    again[order] = np.repeat(lengths > 1, lengths)
    again &= owners != 0xFFFF
    borders = np.concatenate([[0], np.cumsum(sizes)])
    back = [pack(owners[a:b][again[a:b]], "<u2") for a, b in zip(borders[:-1], borders[1:])]
    return pa.table({"slice": table["slice"], "owners": pa.array(back, pa.binary()), "about": table["about"]})


def _judge_slice(table: pa.Table) -> pa.Table:
    """One slice: every text with its set's size and name, and whether it can link."""
    about = np.frombuffer(b"".join(b for b in table["about"].to_pylist() if b is not None), _ABOUT)
    owners, _ = unpack(table["owners"].to_pylist(), "<u2")
    matched = np.bincount(owners, minlength=len(about))[: len(about)] + about["known"]
    n = about["n"].astype(np.int64)
    candidate = (n > 0) & (matched >= about["asked"].astype(np.int64) - spare(n))
    names = _names(np.stack([about["a"], about["b"]], axis=1))
    return pa.table({
        "doc_id": pa.array(about["doc"], pa.int64(), mask=about["null"].astype(bool)),
        "mark": pa.array(about["mark"], pa.int64()), "n": pa.array(n, pa.int64()),
        "sig": pa.array(names, pa.binary()), "candidate": pa.array(candidate, pa.bool_()),
    })


def signed_texts(texts: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n, sig (name of the set), candidate; ``texts`` has doc_id, mark, text."""
    asked = _questions(texts, bucket_count(text_bytes_of(texts)))
    answers = asked.groupBy("bucket").applyInArrow(_found_again, "slice long, owners binary, about binary")
    return answers.groupBy("slice").applyInArrow(_judge_slice, _SIGNED)


# --- 2: ordered sets and shards -------------------------------------------------------------

def _picked(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """text, wanted: the texts that stand for candidate classes, with the names of these."""
    wanted = classes.where("candidate").select(F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("rep_mark"), F.col("sig").alias("wanted"))
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))
    return texts.join(wanted.hint("shuffle_hash"), same).select("text", "wanted")


def _classes(signed: DataFrame) -> DataFrame:
    """sig, doc_id (the least), rep (id and text hash of one row), candidate."""
    rep = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "mark"))
    return signed.where("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), rep.alias("rep"), F.max("candidate").alias("candidate"),
    )


def _sets(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Slices of candidate sets: names, sizes and shingles, packed.

    Ids may be null or repeated, so the row that stands for a class is named by its id and its text's hash.
    """
    picked = _picked(texts, classes)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_ids()
        for batch in batches:
            for part in chunks(batch):
                keys, first = shingle_sets(part.column("text"))
                names = _names(signatures(keys, first))
                # two texts of one id may share a hash
                stays = [i for i, (a, b) in enumerate(zip(names, part.column("wanted").to_pylist())) if a == b]
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([next(numbers)], pa.int64()),
                    "names": pa.array([b"".join(names[i] for i in stays)], pa.binary()),
                    "sizes": pa.array([pack(np.diff(first)[stays], "<u4")], pa.binary()),
                    "keys": pa.array([b"".join(keys[first[i] : first[i + 1]].tobytes() for i in stays)], pa.binary()),
                })

    return picked.mapInArrow(build, "slice long, names binary, sizes binary, keys binary")


def _frequencies(sets: DataFrame, buckets: int) -> DataFrame:
    """For each slice and bucket a byte per distinct shingle: 0 if it is in one set only, else its rank by frequency."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("keys").to_pylist()):
                keys = np.sort(np.frombuffer(blob, np.uint64))
                starts, counts = runs(keys)
                borders, inside = by_bucket(keys[starts], buckets)
                spans = list(zip(borders[:-1].tolist(), borders[1:].tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(buckets), pa.int32()), pa.array([number] * buckets, pa.int64()),
                    pa.array([pack(inside[a:b], "<u4") for a, b in spans], pa.binary()),
                    pa.array([pack(np.minimum(counts[a:b], 0xFFFF), "<u2") for a, b in spans], pa.binary()),
                ], ["bucket", "slice", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys, sizes = unpack(table["keys"].to_pylist(), "<u4")
        counts, _ = unpack(table["counts"].to_pylist(), "<u2")
        order = np.argsort(keys, kind="stable")
        starts, lengths = runs(keys[order])
        total = np.add.reduceat(counts[order].astype(np.int64), starts) if len(starts) else starts
        rank = np.zeros(len(keys), np.uint8)
        level = np.where(total > 1, np.minimum(255, 4 * np.log2(np.maximum(total, 1)) - 3), 0).astype(np.uint8)
        rank[order] = np.repeat(level, lengths)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        back = [rank[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:])]
        return pa.table({"slice": table["slice"], "bucket": table["bucket"], "ranks": pa.array(back, pa.binary())})

    asked = sets.mapInArrow(ask, "bucket int, slice long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(answer, "slice long, bucket int, ranks binary")


_ORDERED = "sig binary, n long, prefix int, tokens binary"


def _order_slice(sets: pa.Table, ranks: pa.Table) -> pa.Table:
    """One slice: each set's repeated shingles by (frequency rank, hash), as 64-bit numbers."""
    names, sizes_of, tokens, prefix = [], [], [], []
    if sets.num_rows:
        ranks = ranks.sort_by("bucket")
        level, _ = unpack(ranks["ranks"].to_pylist(), "u1")
        raw, blob = sets["names"][0].as_py(), sets["keys"][0].as_py()
        keys, sizes = np.frombuffer(blob, np.uint64), np.frombuffer(sets["sizes"][0].as_py(), "<u4").astype(np.int64)
        ordered = np.sort(keys)
        distinct = ordered[runs(ordered)[0]]
        own = level[np.searchsorted(distinct, keys)].astype(np.uint64)
        ranked = own << ORDER_BITS | keys >> np.uint64(8)
        borders = np.concatenate([[0], np.cumsum(sizes)])
        for i, n in enumerate(sizes.tolist()):
            mine = np.sort(ranked[borders[i] : borders[i + 1]])
            mine = mine[np.searchsorted(mine, np.uint64(1) << ORDER_BITS) :]
            left = n // DOWN + 1 - (n - len(mine))  # of n - ceil(0.75 n) + 1 first shingles
            if left > 0:
                names.append(raw[16 * i : 16 * i + 16])
                sizes_of.append(n)
                prefix.append(left)
                tokens.append(mine.tobytes())
    return pa.table({
        "sig": pa.array(names, pa.binary()), "n": pa.array(sizes_of, pa.int64()),
        "prefix": pa.array(prefix, pa.int32()), "tokens": pa.array(tokens, pa.binary()),
    })


def _posts(sets: DataFrame, *carried: str) -> DataFrame:
    """token, band and the ``carried`` columns of every shingle in the beginning of a set.

    Sizes are filed in bands a ratio of 3/4 wide, and each set under its own band and the next,
    so that sets whose sizes allow a link meet.
    """

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            prefix = batch.column("prefix").to_numpy().astype(np.int64)
            blobs = batch.column("tokens").to_pylist()
            flat = np.concatenate([np.frombuffer(b, "<i8")[:p] for b, p in zip(blobs, prefix.tolist())]) if blobs else np.zeros(0, "<i8")
            taken = np.array([min(p, len(b) // 8) for b, p in zip(blobs, prefix.tolist())], np.int64)
            band = np.floor(np.log(sizes) / np.log(DOWN / UP) + 1e-9).astype(np.int32)
            which = np.repeat(np.arange(len(sizes)), taken)
            for step in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat, pa.int64()), pa.array(band[which] + step, pa.int32()), *[batch.column(c).take(pa.array(which)) for c in carried]],
                    ["token", "band", *carried],
                )

    kinds = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in carried)
    return sets.mapInArrow(post, f"token long, band int, {kinds}")


def _star_edges(ordered: DataFrame) -> DataFrame:
    """Sets that share a shingle of both beginnings, tied to the least set with this shingle."""
    posts = _posts(ordered, "sig")
    stars = posts.groupBy("token", "band").agg(F.min("sig").alias("a"), F.max("sig").alias("last")).where("a <> last")
    return posts.join(stars, ["token", "band"]).where("sig <> a").select("a", F.col("sig").alias("b")).distinct()


# --- 3: the prefix tree ---------------------------------------------------------------------

@dataclass
class Node:
    """``label`` leads here; ``least`` and ``longest`` bound the sets below; ``one`` stands for
    them all if they were in one component when last seen."""

    label: np.ndarray
    least: int
    longest: int
    one: int | None
    ends: list[int] = field(default_factory=list)
    below: dict[int, Node] = field(default_factory=dict)


class PrefixTree:
    """Ordered sets, with the components of all sets linked so far."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        self.sizes, self.sets = sizes, sets
        self.up = list(range(len(sets)))
        self.root = Node(np.zeros(0, np.int64), 1 << 60, 0, None)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def insert(self, i: int) -> None:
        rest, size, root = self.sets[i], int(self.sizes[i]), self.find(i)
        node, tail = self.root, len(self.sets[i])
        first = not (node.ends or node.below)
        while True:
            same = first or (node.one is not None and self.find(node.one) == root)
            node.one = i if same else None
            node.least, node.longest = min(node.least, size), max(node.longest, tail)
            if not len(rest):
                node.ends.append(i)
                return
            child = node.below.get(int(rest[0]))
            if child is None:
                node.below[int(rest[0])] = Node(rest, size, 0, i, [i])
                return
            shared = min(len(rest), len(child.label))
            apart = np.flatnonzero(rest[:shared] != child.label[:shared])
            shared = int(apart[0]) if len(apart) else shared
            if shared < len(child.label):  # the label is cut in two
                inner = Node(child.label[:shared], child.least, child.longest + len(child.label) - shared, child.one)
                inner.below[int(child.label[shared])] = child
                child.label = child.label[shared:]
                node.below[int(rest[0])] = child = inner
            rest, node, tail, first = rest[shared:], child, tail - shared, False

    def links(self, i: int) -> Iterator[int]:
        """Sets that ``i`` links with, without those in one component with it already.  The caller
        joins what it is given."""
        own, size = self.sets[i], int(self.sizes[i])
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            if node.one is not None and self.find(node.one) == self.find(i):
                continue
            if len(node.label):
                place = np.searchsorted(own[at:], node.label) + at
                inside = place < len(own)
                overlap += int((own[place[inside]] == node.label[inside]).sum())
                at = int(place[-1])
            need = -(-UP * (size + max(node.least, 1)) // (UP + DOWN))
            if overlap + min(len(own) - at, node.longest) < need:
                continue
            for other in node.ends:
                linked = (UP + DOWN) * overlap >= UP * (size + int(self.sizes[other]))
                if linked and self.find(other) != self.find(i):
                    yield other
            stack.extend((child, overlap, at) for child in node.below.values())


def _local(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    blobs = table["tokens"].to_pylist()
    flat = np.frombuffer(b"".join(blobs), np.uint64)
    ordered = np.sort(flat)
    ranks = np.searchsorted(ordered[runs(ordered)[0]], flat)
    borders = np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])]).astype(np.int64)
    return table["sig"].to_pylist(), table["n"].to_numpy(), [ranks[a:b] for a, b in zip(borders[:-1], borders[1:])]


def join_shards(table: pa.Table) -> pa.Table:
    """All shards of one task: the local component of every set, named by its least set."""
    out = []
    shards = table["shard"].to_pylist()
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = 0
    while at < len(order):
        stop = at
        while stop < len(order) and shards[order[stop]] == shards[order[at]]:
            stop += 1
        part = table.take(pa.array(order[at:stop])).sort_by("sig")  # the least set is set 0
        names, sizes, sets = _local(part)
        tree = PrefixTree(sizes, sets)
        for i in range(len(sets)):
            for other in tree.links(i):
                tree.join(i, other)
            tree.insert(i)
        out += [(part["shard"][0].as_py(), names[i], names[tree.find(i)]) for i in range(len(sets))]
        at = stop
    columns = list(zip(*out)) if out else [(), (), ()]
    return pa.table({k: pa.array(c, pa.binary()) for k, c in zip(("shard", "sig", "label"), columns)})


def join_pieces(table: pa.Table) -> pa.Table:
    """Sets of one piece of a large shard and loose sets of another: components that link."""
    names, sizes, sets = _local(table)
    labels, probe = table["label"].to_pylist(), table["probe"].to_pylist()
    tree, union, found = PrefixTree(sizes, sets), Union(), set()
    heads: dict[bytes, int] = {}
    for i in range(len(sets)):
        tree.join(i, heads.setdefault(labels[i], i))
    for i in range(len(sets)):
        if not probe[i]:
            tree.insert(i)
    for i in range(len(sets)):
        if probe[i]:
            for other in tree.links(i):
                tree.join(i, other)
                if union.find(labels[i]) != union.find(labels[other]):
                    union.join(labels[i], labels[other])
                    found.add((labels[i], labels[other]))
    columns = list(zip(*sorted(found))) if found else [(), ()]
    return pa.table({k: pa.array(c, pa.binary()) for k, c in zip(("a", "b"), columns)})


def _meetings(large: DataFrame) -> DataFrame:
    """Copies of the sets of cut shards for each ``piece`` and each ``asker`` whose loose sets probe it.

    Sets that link share a shingle of both beginnings.  So a loose set goes only to pieces that hold
    such a shingle, and a piece shows an asker only sets that have one of a loose set there.  Two
    loose sets meet once, in the task of the lower piece.
    """
    posts = _posts(large, "sig", "piece", "loose")

    def pieces(loose: bool):
        return F.array_sort(F.collect_set(F.when(F.col("loose") == F.lit(loose), F.col("piece"))))

    places = posts.groupBy("token", "band").agg(pieces(True).alias("loose_in"), pieces(False).alias("tied_in"))
    places = places.where(F.size(F.array_union("loose_in", "tied_in")) > 1).where(F.size("loose_in") > 0)

    def either(name: str):
        return F.array_distinct(F.flatten(F.collect_set(name))).alias(name)

    seen = posts.select("token", "band", "sig").join(places, ["token", "band"])
    seen = large.join(seen.groupBy("sig").agg(either("loose_in"), either("tied_in")), "sig").drop("prefix")
    lower = F.filter("loose_in", lambda p: p < F.col("piece"))
    asked = seen.withColumn("asker", F.explode("loose_in")).where("asker <> piece AND (NOT loose OR asker > piece)")
    asking = seen.where("loose").withColumn("asker", F.col("piece")).withColumn("piece", F.explode(F.array_union("tied_in", lower)))
    both = asked.withColumn("probe", F.lit(False)).unionByName(asking.where("asker <> piece").withColumn("probe", F.lit(True)))
    return both.select("shard", "piece", "asker", "probe", "sig", "n", "tokens", "label")


def _join(ordered: DataFrame, shards: DataFrame, work: Workspace, block: int) -> DataFrame:
    """sig, label for all sets in shards; sets with one label are one component."""
    sizes = shards.groupBy(F.col("component").alias("shard")).agg(F.count(F.lit(1)).alias("members"))
    sizes = sizes.withColumn("pieces", F.ceil(F.col("members") / block).cast("int"))
    placed = shards.select(F.col("node").alias("sig"), F.col("component").alias("shard")).join(sizes, "shard").drop("members")
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("sig"), F.col("pieces")).cast("int"))
    placed = work.keep(placed.join(ordered, "sig"), "shards")
    total, most = placed.agg(F.count(F.lit(1)), F.max("pieces")).first()
    groups = max(8, int(total) // 500)
    task = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64("shard"), F.lit(groups))).otherwise(F.xxhash64("shard", "piece"))
    heads = placed.where("pieces > 1 AND sig = shard")
    heads = heads.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    heads = heads.join(placed.where("pieces > 1").select("sig", "piece"), ["sig", "piece"], "left_anti")
    members = placed.unionByName(heads.select(placed.columns)).withColumn("task", task).drop("prefix")
    joined = members.groupBy("task").applyInArrow(join_shards, "shard binary, sig binary, label binary")
    joined = work.keep(joined.distinct(), "joined")
    if (most or 1) == 1:
        return joined.select("sig", "label")
    # classes not tied to their shard's first class are compared with the other pieces
    large = placed.where("pieces > 1").join(joined.drop("shard"), "sig").withColumn("loose", F.col("label") != F.col("shard"))
    ties = _meetings(large).groupBy("shard", "piece", "asker").applyInArrow(join_pieces, "a binary, b binary")
    names = components(ties, work)
    merged = joined.join(names, joined["label"] == names["node"], "left")
    return merged.select("sig", F.coalesce("component", "label").alias("label"))


def jaccard_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    work = Workspace(docs.sparkSession)
    texts = _texts(docs)
    signed = work.keep(signed_texts(texts), "signed")
    classes = work.keep(_classes(signed), "classes")
    sets = work.keep(_sets(texts, classes), "sets")
    total = sets.agg(F.sum(F.octet_length("keys").cast("long"))).first()[0]
    ranks = _frequencies(sets, bucket_count(total))
    ordered = sets.groupBy("slice").cogroup(ranks.groupBy("slice")).applyInArrow(_order_slice, _ORDERED)
    ordered = work.keep(ordered, "ordered")
    shards = work.keep(components(_star_edges(ordered), work), "components")
    labels = _join(ordered, shards, work, block)
    labelled = classes.join(labels, "sig", "left").select("sig", "doc_id", F.coalesce("label", "sig").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(least, "label").select("sig", "component_id")
    linked = signed.where("n > 0").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; all columns stay.

    Rows that share an id stay or go together; rows without an id stay.
    """
    gone = jaccard_components(docs, block).where("doc_id <> component_id").select("doc_id").distinct()
    gone = Workspace(docs.sparkSession).keep(gone, "gone")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


# DuckDB: all pairs that share a shingle, then reachability.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = doc_id) AS component_id FROM sets
"""
