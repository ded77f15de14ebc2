"""Rounds on packed groups of items: one stage a round, whatever the number of blocks.

With few sources the state of a round (a factor per pair of sources and block) is small and the facts are many.
Facts are then dealt by item once and packed, one row of arrays per group of items.  A round sends every group
the factors (one broadcast row), works out scores, softmax and winners of all its blocks in numpy, and gives
back sums per source and per pair of sources.  No fact, supporter set or score is written or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truthloom.functions.draws import seeded_place
from truthloom.schema import FACT, ITEM

#: Facts from which the rounds of a model are packed; below, starting Python costs more than it saves.
PACKED_FACTS = 100_000
#: Sources that fit the bit masks of facts, and pairs of sources of all blocks that a task counts.
MOST_SOURCES = 256
MOST_PAIRS = 1_000_000
#: Claims of a group, and numbers that are worked on at a time.
GROUP_CLAIMS = 150_000
STRETCH = 2_000_000

PACKED = """group_id int, names array<string>, item_names binary, starts binary, at binary, masks binary,
    objects array<string>, values array<string>"""
NUMBERED = f"{PACKED}, numbers array<double>"
SUMS = "block int, s1 int, s2 int, n bigint, total double, n_common bigint, n_same bigint, n_true bigint"
JUDGED = "block int, tp bigint, fp bigint, fn bigint, tn bigint, n_unmatched bigint"
FACTS = "block int, object string, property string, value string, confidence double, votes bigint"


@dataclass(frozen=True)
class Rule:
    """What a round makes of the scores of supporter sets.

    ``rho``    weight of the similar values of the item, by their characters or ``numeric``; ``None``: they don't count
    ``theta``  if given, scores become the confidence of TruthFinder; else the weights of claims are a softmax
    ``seed``   if given, a seeded choice among the tied values of an item; else the smallest one
    """

    rho: float | None = None
    theta: float | None = None
    numeric: bool = False
    seed: int | None = None

    @property
    def reads(self) -> list[str]:
        """The packed column that similarity needs."""
        return [] if self.rho is None else ["numbers" if self.numeric else "values"]

    def confidence(self, score: np.ndarray, item: np.ndarray, starts: np.ndarray, read: pa.Array | None) -> np.ndarray:
        if self.rho is not None:
            score = implied_by_numbers(score, starts, read, self.rho) if self.numeric else implied(score, item, read, self.rho)
        return score if self.theta is None else 1 / (1 + np.exp(-self.theta * score))


def group_of(n_groups: int) -> Column:
    """The group of an item."""
    return F.pmod(F.xxhash64(*ITEM), F.lit(n_groups)).cast("int")


def words(n_sources: int) -> int:
    return -(-n_sources // 64)


def mask_columns(number: Column, n_sources: int) -> list[Column]:
    """Aggregates that put the numbers of the sources of a group into bit masks."""
    def bit(word: int) -> Column:
        inside = F.when(F.floor(number / 64) == word, F.call_function("shiftleft", F.lit(1).cast("bigint"), (number % 64).cast("int")))
        return F.bit_or(F.coalesce(inside, F.lit(0).cast("bigint"))).alias(f"mask{word}")

    return [bit(word) for word in range(words(n_sources))]


def one_list(strings: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings)


def ranked(strings: pa.Array) -> np.ndarray:
    """The place of each string among the distinct ones in order; only these are compared as strings."""
    coded = strings.dictionary_encode()
    ranks = np.empty(len(coded.dictionary), np.int64)
    ranks[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(ranks))
    return ranks[coded.indices.to_numpy()]


def pack_group(key: tuple, table: pa.Table) -> pa.Table:
    """One row for a group: items in order, their values in order, and the distinct supporter sets."""
    ranks = [ranked(table.column(c).combine_chunks()) for c in FACT]
    order = np.lexsort(ranks[::-1])
    table = table.take(pa.array(order)).combine_chunks()
    columns = {c: table.column(c).combine_chunks() for c in FACT}
    items = np.stack(ranks[:2])[:, order]
    first = np.flatnonzero(np.concatenate(([True], (items[:, 1:] != items[:, :-1]).any(0))))
    coded = columns["property"].dictionary_encode()
    masks = np.stack([table.column(c).to_numpy() for c in table.column_names if c.startswith("mask")], 1).astype("<i8")
    if masks.shape[1] == 1:
        masks, at = np.unique(masks[:, 0], return_inverse=True)
    else:
        masks, at = np.unique(masks, axis=0, return_inverse=True)
    numbers = {"numbers": one_list(table.column("x").combine_chunks())} if "x" in table.column_names else {}
    return pa.table({
        "group_id": pa.array([key[0].as_py()], pa.int32()),
        "names": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
        "item_names": pa.array([coded.indices.to_numpy()[first].astype("<i4").tobytes()], pa.binary()),
        "starts": pa.array([first.astype("<i4").tobytes()], pa.binary()),
        "at": pa.array([at.reshape(-1).astype("<i4").tobytes()], pa.binary()),
        "masks": pa.array([masks.tobytes()], pa.binary()),
        "objects": one_list(columns["object"].take(pa.array(first))),
        "values": one_list(columns["value"]),
        **numbers,
    })


def bits_of(masks: np.ndarray, n_sources: int) -> np.ndarray:
    """One row of 0 and 1 per mask, a column per source."""
    return np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little")[:, :n_sources]


def set_scores(bits: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Per set: the sum over its sources of the product of their factors for all sources of the set.

    With a third axis of ``factors`` for every matrix along it: sets of a size look up all of them at once.
    """
    n_sources, more = bits.shape[1], factors.shape[2:]
    flat = np.ascontiguousarray(factors).reshape(n_sources * n_sources, *more)
    sizes = bits.sum(1, dtype=np.int64)
    scores = np.zeros((len(bits), *more))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for low, high in zip(edges[:-1], edges[1:]):
        k = int(sizes[order[low]])
        step = max(1, STRETCH // max(1, k * k * int(np.prod(more))))
        for begin in range(low, high if k else low, step):
            rows = order[begin:min(high, begin + step)]
            own = np.nonzero(bits[rows])[1].reshape(len(rows), k).T
            scores[rows] = flat.take(own[:, None] * n_sources + own[None], 0).prod(1).sum(0)
    return scores


def pairs_within(bits: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Per pair of sources: the total weight of the rows that hold both; whole numbers, exact in doubles, small ones in floats too."""
    total = np.zeros((bits.shape[1],) * 2)
    exact = np.float32 if (len(bits) if weights is None else weights.sum()) < 1 << 24 else np.float64
    for begin in range(0, len(bits), step := max(1, STRETCH // max(1, bits.shape[1]))):
        part = bits[begin:begin + step].astype(exact)
        total += (part if weights is None else part * weights[begin:begin + step, None].astype(exact)).T @ part
    return total


def implied(score: np.ndarray, item: np.ndarray, values: pa.Array, rho: float) -> np.ndarray:
    """Scores with ``rho`` times those of the item's other values, weighed by the cosine of their character counts.

    As in :func:`truthloom.operators.similarity.implied_scores`: a dot product with one vector per item.
    """
    lengths = pc.utf8_length(values).to_numpy()
    chars = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    spelled, counts = np.unique(np.repeat(np.arange(len(score)), lengths) << 21 | chars, return_counts=True)
    fact, char = spelled >> 21, spelled & ((1 << 21) - 1)
    weight = counts / np.sqrt(np.bincount(fact, counts.astype(float) ** 2, len(score)))[fact]
    _, slot = np.unique(item[fact] << 21 | char, return_inverse=True)
    vector = np.bincount(slot, weight * score[fact])
    dot = np.bincount(fact, weight * vector[slot], len(score))
    return np.where(lengths > 0, score + rho * (dot - score), score)


def implied_by_numbers(score: np.ndarray, starts: np.ndarray, numbers: pa.Array, rho: float) -> np.ndarray:
    """Scores with ``rho`` times those of the item's other values, weighed by 1 / gap; a value that is no number has no weight.

    As in :func:`truthloom.functions.text.numeric_similarity`.  Items with as many values are worked on together, a stretch of pairs at a time.
    """
    x, known = numbers.to_numpy(zero_copy_only=False), numbers.is_valid().to_numpy(zero_copy_only=False)
    lengths, others = np.diff(starts, append=len(score)), np.zeros(len(score))
    for k in np.unique(lengths[lengths > 1]):
        begins, place = starts[lengths == k], np.arange(k)
        for own in np.array_split(place, min(k, -(-k * k // STRETCH))):
            step = max(1, STRETCH // (k * len(own)))
            for at in range(0, len(begins), step):
                left, right = begins[at:at + step, None] + own, begins[at:at + step, None] + place
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap = np.abs(x[left][:, :, None] - x[right][:, None, :])
                    near = np.where(gap == 0, 1.0, 1 / gap)
                counted = known[left][:, :, None] & known[right][:, None, :] & (own[:, None] != place)
                others[left] = np.where(counted, near * score[right][:, None, :], 0.0).sum(2)
    return score + rho * others


@dataclass
class Group:
    """Facts of one group, those of the properties that the same blocks have: value order within items, items in order."""

    item: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    bits: np.ndarray
    rows: np.ndarray
    items: np.ndarray

    def votes(self) -> np.ndarray:
        return self.bits.sum(1, dtype=np.int64)[self.at]

    def scores(self, factors: list[np.ndarray], rule: Rule, read: pa.Array | None = None) -> Iterator[np.ndarray]:
        """Of every fact, by one matrix of factors after another.  ``read`` has what similarity needs of all facts of the packed row."""
        own = None if read is None else read.take(pa.array(self.rows))
        step = max(1, STRETCH // max(1, len(self.bits)))
        for begin in range(0, len(factors), step):
            for score in np.ascontiguousarray(set_scores(self.bits, np.stack(factors[begin:begin + step], 2)).T):
                yield rule.confidence(score[self.at], self.item, self.starts, own)

    def winners(self, score: np.ndarray, rule: Rule) -> np.ndarray:
        """The fact of each item that is chosen among those whose score equals the highest one to nine places."""
        top = np.rint(np.fmax.reduceat(score, self.starts) * 1e9)[self.item]
        tied = np.flatnonzero((np.rint(score * 1e9) == top) | np.isnan(top))
        first = np.flatnonzero(np.diff(self.item[tied], prepend=-1))
        if rule.seed is None:
            return tied[first]
        sizes, which = np.unique(np.diff(first, append=len(tied)), return_inverse=True)
        return tied[first + np.array([seeded_place(int(n), rule.seed) for n in sizes])[which]]


class Unpacked:
    """One packed row as arrays."""

    def __init__(self, row: dict, n_sources: int):
        read = lambda name: np.frombuffer(row[name].as_py(), "<i4")
        self.names, self.item_names, self.starts, self.at = row["names"].as_py(), read("item_names"), read("starts"), read("at")
        self.masks = np.frombuffer(row["masks"].as_py(), "<i8").reshape(-1, words(n_sources))
        self.bits = bits_of(self.masks, n_sources)
        self.lengths = np.diff(self.starts, append=len(self.at))
        self.votes = self.bits.sum(1, dtype=np.int64)[self.at]

    def part(self, properties: set[str] | None) -> Group | None:
        inside = np.array([properties is None or name in properties for name in self.names], bool)[self.item_names]
        items = np.flatnonzero(inside)
        if not len(items):
            return None
        lengths, rows = self.lengths[items], np.flatnonzero(np.repeat(inside, self.lengths))
        present = np.zeros(len(self.masks), bool)
        present[self.at[rows]] = True
        at = (np.cumsum(present) - 1)[self.at[rows]]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return Group(np.repeat(np.arange(len(items)), lengths), starts, at, self.bits[present], rows, items)

    def parts(self, blocks: dict) -> Iterator[tuple[tuple, Group]]:
        """The facts in parts that the same ones of ``blocks`` (number: properties, ``None``: all) hold, with the numbers of these.

        What does not depend on the block is worked out once for all blocks of a part.
        """
        held: dict = {}
        for name in self.names:
            held.setdefault(tuple(b for b, own in blocks.items() if own is None or name in own), set()).add(name)
        for numbers, properties in held.items():
            if numbers:
                yield numbers, self.part(properties)


def parameters(row: dict, n_sources: int) -> tuple[dict, dict]:
    """Properties of every block (``None``: all), and the matrix of factors of the blocks that have some."""
    members = row["members"].values.flatten() if row["members"].is_valid else None
    blocks: dict = {}
    if members is None:
        blocks[0] = None
    else:
        for block, name in zip(members[0].to_pylist(), members[1].to_pylist()):
            blocks.setdefault(block, set()).add(name)
    found: dict = {}
    if row["factors"].is_valid and len(row["factors"].values):
        block, s1, s2, factor = (x.to_numpy(zero_copy_only=False) for x in row["factors"].values.flatten())
        for number in np.unique(block):
            own = block == number
            matrix = np.ones((n_sources, n_sources))
            matrix[s1[own], s2[own]] = factor[own]
            found[int(number)] = matrix
    return blocks, found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(i)[at] for i, name in enumerate(batch.schema.names)}


def _sums(n_sources: int, first: bool, rule: Rule):
    """Sums per block and source (s2 is -1), and per block and pair of sources, of a whole task."""
    def sums(batches):
        totals: dict = {}
        known = None
        for row in _rows(batches):
            blocks, factors = known = known or parameters(row, n_sources)
            group = Unpacked(row, n_sources)
            for numbers, facts in group.parts(blocks if first else {b: blocks[b] for b in factors}):
                size, bits = len(facts.bits), facts.bits.astype(float)
                n = np.bincount(facts.at, minlength=size)
                pairs = [np.zeros((n_sources, n_sources))] * 2
                if first:
                    claimed = bits_of(np.bitwise_or.reduceat(group.masks[group.at[facts.rows]], facts.starts, axis=0), n_sources)
                    pairs = [pairs_within(claimed), pairs_within(facts.bits, n)]
                scores = [facts.votes().astype(float)] if first else facts.scores(
                    [factors[b] for b in numbers], rule, *[row[c].values for c in rule.reads])
                for at, score in enumerate(scores):
                    weight = score
                    if rule.theta is None:
                        weight = np.exp(score - np.maximum.reduceat(score, facts.starts)[facts.item])
                        weight /= np.add.reduceat(weight, facts.starts)[facts.item]
                    n_true = np.bincount(facts.at[facts.winners(score, rule)], minlength=size)
                    new = [n @ bits, np.bincount(facts.at, weight, size) @ bits, *pairs, pairs_within(facts.bits, n_true)]
                    for block in numbers if first else numbers[at:at + 1]:
                        totals[block] = [a + b for a, b in zip(totals[block], new)] if block in totals else new
        out: dict = {name: [] for name in ("block", "s1", "s2", "n", "total", "n_common", "n_same", "n_true")}

        def add(block, s1, s2, *numbers):
            for name, column in zip(out, (np.full(len(s1), block), s1, s2, *numbers)):
                out[name].append(column)

        for block, (n, total, common, same, true) in totals.items():
            seen = np.flatnonzero(n)
            none = np.zeros(len(seen))
            add(block, seen, np.full(len(seen), -1), n[seen], total[seen], none, none, none)
            s1, s2 = np.nonzero(np.triu(common + same + true, 1))
            none = np.zeros(len(s1))
            add(block, s1, s2, none, none, common[s1, s2], same[s1, s2], true[s1, s2])
        kinds = [pa.int32()] * 3 + [pa.int64(), pa.float64()] + [pa.int64()] * 3
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out.values()]
        yield pa.record_batch([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=list(out))

    return sums


def _facts(n_sources: int, best: bool, rule: Rule):
    """The facts of all blocks with their scores, or the winner of each item."""
    def facts(batches):
        known = None
        for row in _rows(batches):
            blocks, factors = known = known or parameters(row, n_sources)
            group = Unpacked(row, n_sources)
            objects, values = row["objects"].values, row["values"].values
            names = pa.array(group.names, pa.string())
            for numbers, own in group.parts({b: blocks[b] for b in factors}):
                scores = own.scores([factors[b] for b in numbers], rule, *[row[c].values for c in rule.reads])
                votes = own.votes()
                for block, score in zip(numbers, scores):
                    chosen = own.winners(score, rule) if best else np.arange(len(score))
                    items = own.items[own.item[chosen]]
                    yield pa.record_batch([
                        pa.array(np.full(len(chosen), block, np.int32)), objects.take(pa.array(items)),
                        names.take(pa.array(group.item_names[items])), values.take(pa.array(own.rows[chosen])),
                        pa.array(score[chosen]), pa.array(votes[chosen]),
                    ], names=["block", *FACT, "confidence", "votes"])

    return facts


def smallest_hashes(sources: list[str]):
    """Per item of packed rows the value of the claim with the smallest MD5 of ``object|property|source``; equal ones go to the smaller source."""
    names = [source.encode() for source in sources]

    def first(batches):
        for row in _rows(batches):
            group = Unpacked(row, len(names))
            supporters = [[names[number] for number in np.flatnonzero(own)] for own in group.bits]
            objects, values, at = row["objects"].values, row["values"].values, group.at.tolist()
            properties = pa.array(group.names, pa.string()).take(pa.array(group.item_names))
            ends, chosen = [*group.starts[1:].tolist(), len(at)], []
            for name, property_name, begin, end in zip(objects.to_pylist(), properties.to_pylist(), group.starts.tolist(), ends):
                item, least, by, found = f"{name}|{property_name}|".encode(), None, b"", begin
                for fact in range(begin, end):
                    for source in supporters[at[fact]]:
                        key = md5(item + source, usedforsecurity=False).digest()
                        if least is None or key < least or (key == least and source < by):
                            least, by, found = key, source, fact
                chosen.append(found)
            yield pa.record_batch([objects, properties, values.take(pa.array(chosen, pa.int64()))], names=FACT)

    return first


def true_facts(columns: list[str]):
    """A packed row with ``columns`` and, per item, the place of its true value among the facts.

    -1: nobody claims the true value, -2: the item has no truth.  Of truths that contradict each other the greatest
    value counts, as in :func:`truthloom.schema.as_truth`.
    """
    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks()
        true = [pa.array([], pa.binary())]
        if left.num_rows:
            row = {name: left.column(name)[0] for name in left.column_names}
            starts, item_names = (np.frombuffer(row[c].as_py(), "<i4") for c in ("starts", "item_names"))
            values, names = row["values"].values, pa.array(row["names"].as_py(), pa.string())
            coded = row["objects"].values.dictionary_encode()
            item = coded.indices.to_numpy().astype(np.int64) * len(names) + item_names
            at = [pc.index_in(right.column(c).combine_chunks(), value_set=known).fill_null(-1).to_numpy().astype(np.int64)
                  for c, known in zip(ITEM, (coded.dictionary, names))]
            told = np.flatnonzero((at[0] >= 0) & (at[1] >= 0))
            wanted, texts = (at[0] * len(names) + at[1])[told], right.column("value").combine_chunks().take(pa.array(told))
            order = np.lexsort((ranked(texts), wanted))
            last = order[np.flatnonzero(np.diff(wanted[order], append=-1))]
            place = np.searchsorted(wanted[last], item)
            has = np.concatenate((wanted[last], [-1]))[place] == item
            own = np.repeat(np.arange(len(item)), np.diff(starts, append=len(values)))
            claimed = pc.equal(values, texts.take(pa.array(last)).take(pa.array(place[own], mask=~has[own])))
            found, facts = np.where(has, -1, -2).astype("<i4"), np.flatnonzero(claimed.fill_null(False).to_numpy(zero_copy_only=False))
            found[own[facts]] = facts
            true = [pa.array([found.tobytes()], pa.binary())]
        return left.select(columns).append_column("true", pa.chunked_array(true))

    return find


def _confusion(n_sources: int, rule: Rule):
    """Sums of votes per block of a whole task; see :func:`truthloom.operators.quality.confusion`."""
    def judged(batches):
        totals: dict = {}
        known = None
        for row in _rows(batches):
            blocks, factors = known = known or parameters(row, n_sources)
            group, true = Unpacked(row, n_sources), np.frombuffer(row["true"].as_py(), "<i4")
            for numbers, own in group.parts({b: blocks[b] for b in factors}):
                votes, wanted = own.votes(), true[own.items]
                everything, matched = np.add.reduceat(votes, own.starts), wanted >= -1
                of_true = np.where(wanted >= 0, group.votes[wanted], 0)
                scores = own.scores([factors[b] for b in numbers], rule, *[row[c].values for c in rule.reads])
                for block, score in zip(numbers, scores):
                    chosen = own.winners(score, rule)
                    right, of_found = own.rows[chosen] == wanted, votes[chosen]
                    wrong = matched & ~right
                    others = everything - of_true - np.where(right, 0, of_found)
                    totals[block] = totals.get(block, 0) + np.array([
                        of_true[matched & right].sum(), of_found[wrong].sum(), of_true[wrong].sum(), others[matched].sum(), everything[~matched].sum()])
        table = np.array([[block, *sums] for block, sums in totals.items()], np.int64).reshape(-1, 6)
        names = ["block", "tp", "fp", "fn", "tn", "n_unmatched"]
        yield pa.record_batch([pa.array(c.astype(np.int32 if n == "block" else np.int64)) for n, c in zip(names, table.T)], names=names)

    return judged


def small(table: DataFrame) -> DataFrame:
    """A table of sources, pairs or blocks as one partition: its joins with others of the kind are one stage, without broadcasts.

    For one join only: Spark takes the size of the result for the product of both, and then deals it anew.
    """
    return table.coalesce(1).hint("shuffle_hash")


@dataclass
class Packed:
    """Packed groups with the numbers of sources and blocks.

    ``groups``   one row per group of items
    ``sources``  an array of the names of the sources in the order of their numbers
    ``blocks``   block_id, block, property; ``None``: one block of all properties
    ``rule``     what a round makes of the scores of sets
    """

    groups: DataFrame
    sources: Column
    n_sources: int
    blocks: DataFrame | None
    factors: DataFrame | None = None
    rule: Rule = field(default_factory=Rule)

    def _run(self, work, columns: list[str], schema: str) -> DataFrame:
        one = self.groups.sparkSession.range(1).select(F.lit(0).alias("one"))
        if self.blocks is None:
            members = one.select(F.lit(None).cast("array<struct<block:int,property:string>>").alias("members"))
        else:
            members = self.blocks.coalesce(1).agg(F.collect_list(F.struct("block", "property")).alias("members"))
        if self.factors is None:
            factors = one.select(F.lit(None).cast("array<struct<block:int,s1:int,s2:int,factor:double>>").alias("factors"))
        else:
            factors = self.factors.agg(F.collect_list(F.struct("block", "s1", "s2", "factor")).alias("factors"))
        sent = self.groups.select(*columns).crossJoin(F.broadcast(members)).crossJoin(F.broadcast(factors))
        return sent.mapInArrow(work, schema)

    def _numbers(self) -> DataFrame:
        """``block_id, block``."""
        return F.broadcast(self.blocks.coalesce(1).select("block_id", "block").distinct())

    def _named(self, rows: DataFrame) -> DataFrame:
        """Rows with the id of their block in place of its number."""
        if self.blocks is None:
            return rows.withColumn("block_id", F.lit(0)).drop("block")
        return rows.join(self._numbers(), "block").drop("block")

    def _source(self, number: str) -> Column:
        return F.get(self.sources, F.col(number))

    def _number(self, source: str) -> Column:
        return (F.array_position(self.sources, F.col(source)) - 1).cast("int")

    def with_factors(self, factors: DataFrame, work, name: str) -> Packed:
        """``factors`` has block_id, s1, s2, factor; blocks without any are left out."""
        coded = factors.coalesce(1)
        coded = coded.withColumn("block", F.lit(0)) if self.blocks is None else coded.join(self._numbers(), "block_id")
        kept = coded.select("block_id", "block", self._number("s1").alias("s1"), self._number("s2").alias("s2"), "factor")
        return replace(self, factors=work.keep(kept, name).coalesce(1))

    def where(self, blocks: Column) -> Packed:
        return replace(self, factors=self.factors.where(blocks))

    def unionByName(self, other: Packed) -> Packed:
        return replace(self, factors=self.factors.unionByName(other.factors))

    def sums(self, work, name: str) -> tuple[DataFrame, DataFrame]:
        """``block_id, source, n, total`` and ``block_id, s1, s2, n_common, n_same, n_true`` of a round.

        Without factors: of the majority vote.  Common and same pairs are counted only then.
        """
        columns = ["names", "item_names", "starts", "at", "masks", *self.rule.reads]
        made = self._run(_sums(self.n_sources, self.factors is None, self.rule), columns, SUMS)
        summed = made.groupBy("block", "s1", "s2").agg(*[F.sum(c).alias(c) for c in ("n", "total", "n_common", "n_same", "n_true")])
        kept = work.keep(self._named(summed).coalesce(1), name).coalesce(1)
        single = kept.where("s2 < 0").select("block_id", self._source("s1").alias("source"), "n", "total")
        pairs = kept.where("s2 >= 0").select(
            "block_id", self._source("s1").alias("s1"), self._source("s2").alias("s2"), "n_common", "n_same", "n_true")
        return single, pairs

    def _listed(self, best: bool) -> DataFrame:
        columns = list(dict.fromkeys(["names", "item_names", "starts", "at", "masks", "objects", "values", *self.rule.reads]))
        return self._named(self._run(_facts(self.n_sources, best, self.rule), columns, FACTS)).select("block_id", *FACT, "confidence", "votes")

    def truths(self) -> DataFrame:
        return self._listed(True)

    def confidence(self) -> DataFrame:
        return self._listed(False).drop("votes")

    def confusion(self, truth: DataFrame, dealing: tuple[int, int], work) -> DataFrame:
        """``block_id, tp, fp, fn, tn, n_unmatched`` of the truths, which are not listed for it.

        The truth goes to the groups of its items, once for all blocks; ``dealing``: see ``ClaimBase.dealing``.
        """
        n_groups, tasks = dealing
        columns = list(dict.fromkeys(["names", "item_names", "starts", "at", "masks", *self.rule.reads]))
        known = truth.select(*[F.col(c).cast("string").alias(c) for c in FACT]).dropna()
        known = known.select(group_of(n_groups).alias("group_id"), *FACT).repartition(tasks, "group_id")
        read = list(dict.fromkeys(["group_id", *columns, "objects", "values"]))
        groups = self.groups.select(*read).repartition(tasks, "group_id").groupBy("group_id").cogroup(known.groupBy("group_id"))
        kinds = {f.name: f.dataType.simpleString() for f in self.groups.schema}
        schema = ", ".join([*[f"{c} {kinds[c]}" for c in columns], "true binary"])
        placed = replace(self, groups=work.keep(groups.applyInArrow(true_facts(columns), schema), "placed-truth"))
        made = placed._run(_confusion(self.n_sources, self.rule), [*columns, "true"], JUDGED)
        return self._named(made.groupBy("block").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "n_unmatched")]))
