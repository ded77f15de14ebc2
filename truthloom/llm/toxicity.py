"""Toxicity by multiple-instance learning (operator 1).

A document is a bag of sentences.  A sentence's probability is logistic in its hashed words; the
document's is the noisy-or of its sentences, 1 - prod(1 - p).  Only documents have labels: the
gradient of the document's likelihood passes through the noisy-or to the sentences, so that the
fitted model also tells which sentences offend: those that would be toxic as a text of their own.
A document has a bias of its own, -``LENGTH`` times the logarithm of its number of sentences, in
fitting and in scoring alike, so that the odds of clean sentences add up much more slowly than their
number; a bound on them for texts of any length this is not.

The model is fitted on at most ``sample`` labelled documents (the lowest hashes of doc_id, as many
as fit into ``most_bytes``), which is all that reaches the driver; every document is scored.  Null and empty texts are one sentence
without words, scored by the bias; rows without a label, and labels without a document, are not
learnt from; of repeated labels the highest counts; duplicated rows are scored alike; without any
labels every sentence is clean and every score 0; extra columns are ignored by ``score_documents``
and kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truthloom.llm.words import chunks, distinct, ranges, span_hashes, split_words

BITS = 18
#: Leading bytes of a word that are features of their own, beside the whole word.
PREFIXES = (4, 5, 6)
FOLDS, HELD_OUT = 3, 1
#: Greatest number of labelled documents that the model is fitted on.
SAMPLE = 8000
#: Bytes of all texts that the model is fitted on.
SAMPLE_BYTES = 32 << 20
#: Fall of a sentence's logit with the logarithm of the number of sentences in its document.
LENGTH = 0.55
THRESHOLD = 0.7
START_BIAS = -5.0
#: Bias of a model that was fitted on nothing: all its probabilities are 0.
NOTHING = -700.0
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]{}*|")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def fold(doc_id):
    """crc32 of the id as text, modulo ``FOLDS``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


@dataclass
class Bags:
    """Word features of many documents; every sentence and document is a range."""

    features: np.ndarray
    sentences: np.ndarray  # first feature of each sentence, and the end
    documents: np.ndarray  # first sentence of each document, and the end
    places: np.ndarray  # first and last code point (exclusive) of each sentence


def bags(texts: pa.Array, bits: int = BITS) -> Bags:
    """Sentences end at . ! ? and newlines.  A document without words is one empty sentence."""
    words = split_words(texts, lower=True)
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        starts += (starts < ends - 1) & _TRIM[words.data[np.minimum(starts, len(words.data) - 1)]]
        ends -= (starts < ends - 1) & _TRIM[words.data[ends - 1]]
    n = len(starts)
    fresh = np.zeros(n, bool)
    if n:
        breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
        fresh[1:] = _STOP[words.data[words.ends[:-1] - 1]] | (breaks[words.starts[1:]] > breaks[words.ends[:-1]])
        fresh[words.first[:-1][words.counts > 0]] = True
    begin = np.flatnonzero(fresh)
    per_doc = np.searchsorted(begin, words.first)
    empty = np.flatnonzero(words.counts == 0)  # one sentence without words for each of these
    sentences = np.insert(begin, per_doc[empty], words.first[empty])
    shift = np.concatenate([[0], np.cumsum(words.counts == 0)])
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    bounds = np.append(begin, n)
    owner = np.repeat(np.arange(len(sentences)), np.diff(np.append(sentences, n)))
    found = [_features(words.data, starts, ends, owner, bits)]
    for size in PREFIXES:
        long = ends - starts > size
        found.append(_features(words.data, starts[long], starts[long] + size, owner[long], bits))
    features = distinct(np.concatenate(found))  # each feature counts once in a sentence
    row = words.row
    base = points[words.offsets]
    places = np.zeros((len(sentences), 2), np.int64)
    full = np.ones(len(sentences), bool)
    full[per_doc[empty] + np.arange(len(empty))] = False
    places[full, 0] = points[words.starts[begin]] - base[row[begin]]
    places[full, 1] = points[words.ends[bounds[1:] - 1]] - base[row[begin]]
    inner = np.searchsorted(features, np.arange(len(sentences) + 1) << bits)
    return Bags(features & ((1 << bits) - 1), inner, per_doc + shift, places)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, bits: int) -> np.ndarray:
    """Hashed spans below the number of their sentence."""
    return owner << bits | (span_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)


def _sentence_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, NOTHING, 30)))


@dataclass
class NoisyOr:
    """``cut`` is the probability that becomes the score ``THRESHOLD``; scores rise with probabilities."""

    weights: np.ndarray
    bias: float
    cut: float = THRESHOLD

    def logits(self, found: Bags) -> np.ndarray:
        """Logit of every sentence as a text of its own."""
        return _sentence_sums(self.weights[found.features], found.sentences) + self.bias

    def sentences(self, found: Bags) -> np.ndarray:
        """Probability of every sentence within its document."""
        counts = np.diff(found.documents)
        return _logistic(self.logits(found) - np.repeat(LENGTH * np.log(counts), counts))

    def documents(self, found: Bags) -> np.ndarray:
        return 1.0 - np.exp(_sentence_sums(np.log1p(-self.sentences(found)), found.documents))

    def scores(self, found: Bags) -> np.ndarray:
        return np.interp(self.documents(found), [0.0, self.cut, 1.0], [0.0, THRESHOLD, 1.0])


def fit(found: Bags, labels: np.ndarray, steps: int = 1200, rate: float = 0.3, decay: float = 5e-4,
        batch: int = 192, bits: int = BITS, bias: float = START_BIAS, seed: int = 7) -> NoisyOr:
    """AdaGrad on the likelihood of the documents' labels, with an L1 shrinkage of the weights."""
    model = NoisyOr(np.zeros(1 << bits), bias)
    if not len(labels):
        model.bias = NOTHING
        return model
    seen, seen_bias = np.full(1 << bits, 1e-2), 1e-2
    order = np.random.default_rng(seed)
    parts = max(1, len(labels) // batch)
    for _ in range(-(-steps // parts)):
        for docs in np.array_split(order.permutation(len(labels)), parts):
            part = _take(found, docs)
            p = model.sentences(part)
            stay = np.exp(_sentence_sums(np.log1p(-p), part.documents))
            pull = np.where(labels[docs] == 1, -stay / np.maximum(1 - stay, 1e-6), 1.0)
            slope = p * np.repeat(pull, np.diff(part.documents)) / len(docs)
            used, where = np.unique(part.features, return_inverse=True)
            grad = np.bincount(where, np.repeat(slope, np.diff(part.sentences)), minlength=len(used))
            seen[used] += grad**2
            moved = model.weights[used] - rate * grad / np.sqrt(seen[used])
            model.weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - decay, 0)
            seen_bias += slope.sum() ** 2
            model.bias -= rate * 0.3 * slope.sum() / np.sqrt(seen_bias)
    return model


def _take(found: Bags, docs: np.ndarray) -> Bags:
    sentences = ranges(found.documents[docs], np.diff(found.documents)[docs])
    sizes = np.diff(found.sentences)[sentences]
    return Bags(
        found.features[ranges(found.sentences[sentences], sizes)],
        np.concatenate([[0], np.cumsum(sizes)]),
        np.concatenate([[0], np.cumsum(np.diff(found.documents)[docs])]),
        found.places[sentences],
    )


def best_cut(found: Bags, labels: np.ndarray, part: int = 4) -> float:
    """The cut with the best F1 on a quarter of the documents, by a model of the others."""
    checked = np.arange(len(labels)) % part == 0
    if len(set(labels[checked])) < 2 or len(set(labels[~checked])) < 2:
        return THRESHOLD
    model = fit(_take(found, np.flatnonzero(~checked)), labels[~checked])
    given, truth = model.documents(_take(found, np.flatnonzero(checked))), labels[checked]
    cuts = np.arange(0.1, 0.91, 0.05)
    hits = np.array([((given >= c) & (truth == 1)).sum() for c in cuts])
    f1 = 2 * hits / (np.array([(given >= c).sum() for c in cuts]) + truth.sum())
    return float(np.median(cuts[f1 == f1.max()]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``sample`` labelled texts outside the held-out fold: (doc_id, toxic, text).

    By hash of doc_id, each text that still fits into ``most_bytes`` is taken, however long it is.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    sizes = found.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    left, over = most_bytes, []
    for row in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if row["size"] <= left:
            left -= row["size"]
        else:
            over.append(row.doc_id)
    return found.where(~F.col("doc_id").isin(over)) if over else found


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> NoisyOr:
    """Fit on the sample.  The driver receives word features of the sampled documents only."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = bags(part.column("text"))
                rows = []
                for doc in range(part.num_rows):
                    own = _take(found, np.array([doc]))
                    rows.append((own.features.astype("<u4").tobytes(), np.diff(own.sentences).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "toxic": part.column("toxic"),
                    "features": pa.array([r[0] for r in rows], pa.binary()),
                    "sizes": pa.array([r[1] for r in rows], pa.binary()),
                })

    schema = "doc_id long, toxic int, features binary, sizes binary"
    rows = labelled_sample(docs, labels, sample, most_bytes).mapInArrow(extract, schema).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return NoisyOr(np.zeros(1 << BITS), NOTHING)
    features = np.frombuffer(b"".join(rows["features"].to_pylist()), "<u4").astype(np.int64)
    sizes = [np.frombuffer(s, "<u4").astype(np.int64) for s in rows["sizes"].to_pylist()]
    inner = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    outer = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
    found = Bags(features, inner, outer, np.zeros((len(inner) - 1, 2), np.int64))
    labels = rows["toxic"].to_numpy()
    model = fit(found, labels)
    model.cut = best_cut(found, labels)
    return model


def score_documents(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: its score, the prediction, and the offending sentences as ``start:end`` in code points."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.cut))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOr(held.value[0].astype(np.float64), *held.value[1:])
        for batch in batches:
            for part in chunks(batch):
                found = bags(part.column("text"))
                each, scores = _logistic(own.logits(found)), own.scores(found)
                offends = [
                    ",".join(f"{a}:{b}" for a, b in found.places[lo:hi][each[lo:hi] >= own.cut].tolist())
                    for lo, hi in zip(found.documents[:-1].tolist(), found.documents[1:].tolist())
                ]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "score": pa.array(np.clip(scores, 0.0, 1.0), pa.float64()),
                    "sentences": pa.array(offends, pa.string()),
                })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(judge, "doc_id long, score double, sentences string")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences",
    )


def drop_toxic(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.cut))
    place = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOr(held.value[0].astype(np.float64), *held.value[1:])
        for batch in batches:
            for part in chunks(batch):
                scores = own.scores(bags(part.column(place)))
                yield part.filter(pa.array(scores < threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(keep, docs.withColumn("text", F.col("text").cast("string")).schema)
