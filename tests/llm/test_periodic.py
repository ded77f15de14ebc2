"""Periodic runs of words against a plain scan of all lags."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import plain
from truthloom.llm import periodic, registry
from truthloom.llm.periodic import DirectExtender, Extender, find_runs, periodic_runs, plant_runs, run_digest

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def sequences(count, seed):
    draw = random.Random(seed)
    for _ in range(count):
        n, letters = draw.randint(0, 120), draw.choice([1, 2, 2, 3, 5, 40])
        own = [draw.randrange(letters) for _ in range(n)]
        if n and draw.random() < 0.5:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(2, 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
        if draw.random() < 0.2:  # Fibonacci words are full of runs
            own = [0, 1]
            while len(own) < n:
                own = [x for c in own for x in ((0, 1) if c == 0 else (0,))]
            own = own[:n]
        yield own


@pytest.mark.parametrize("splits, batch", [(32, 1 << 18), (0, 5), (1, 1 << 18)])
def test_runs_of_many_texts_at_once(monkeypatch, splits, batch):
    monkeypatch.setattr(periodic, "SPLITS", splits)
    monkeypatch.setattr(periodic, "BATCH", batch)
    texts = list(sequences(400, seed=splits))
    flat = np.array([w for own in texts for w in own], np.int64)
    sizes = np.array([len(own) for own in texts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    want = [(int(first[i]) + a, b, c) for i, own in enumerate(texts) for a, b, c in plain.runs(own)]
    assert [tuple(r) for r in find_runs(flat, np.repeat(np.arange(len(texts)), sizes)).tolist()] == want


def test_hashes_that_lie_are_found_out():
    """The words of two Thue-Morse sequences of 4096 have the same hash and are not the same."""
    bits = np.array([bin(i).count("1") % 2 for i in range(4096)])
    line = np.concatenate([[9], bits, 1 - bits, bits, [8]])
    at, lag = np.array([1]), np.array([4096])
    assert DirectExtender(line).right(at, lag)[0] == 0 and Extender(line, 4096).right(at, lag)[0] > 0
    own = np.concatenate([[9], bits, 1 - bits, [7], bits, bits])
    found = {tuple(r) for r in find_runs(own, np.zeros(len(own), int)).tolist()}
    assert (8194, 8192, 4096) in found and not any(period == 4096 and start < 8194 for start, _, period in found)


def test_a_long_periodic_text_is_one_run():
    own = np.tile(np.arange(700), 300)
    assert find_runs(own, np.zeros(len(own), int)).tolist() == [[0, len(own), 700]]
    assert find_runs(np.zeros(100_000, int), np.zeros(100_000, int)).tolist() == [[0, 100_000, 1]]


def test_runs_of_edge_rows(spark):
    texts = plain.edge_texts() + plain.random_texts(80, vocabulary=3) + ["a b " * 6, "a b " * 5 + "a", "x " * 11, "x " * 12, ("a " * 12 + "b ") * 3]
    texts = [t if t is None or len(t) < 20_000 else t[:2000] for t in texts]
    docs = plain.frame(spark, texts)
    found = [(r.doc_id, tuple(r[c] for c in COLUMNS)) for r in run_digest(plant_runs(docs)).collect()]
    want = [(r.doc_id, plain.run_row(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert run_digest(plant_runs(docs.limit(0))).collect() == []


def test_runs_and_collapsed_texts_are_returned(spark):
    docs = spark.createDataFrame([(3, "so " * 12 + "it goes")], "doc_id long, text string")
    row = periodic_runs(docs).first()
    assert row.collapsed == "so it goes" and [tuple(r) for r in row.runs] == [(0, 12, 1)] and row.exponent_milli == 12000


def test_runs_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registry.op12_periodic(spark, SMALL).collect()}
    assert len(found) == len(rows)
    for row in rows:
        if len(row.text or "") < 15_000:
            assert found[row.doc_id] == plain.run_row(row.doc_id, row.text)
