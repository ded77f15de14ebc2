"""Operators that compare texts with each other: shingle joins, benchmark windows, repeated windows."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from truthloom.llm import decontaminate, jaccard, substrings
from truthloom.llm.decontaminate import drop_leaks, find_leaks
from truthloom.llm.fmindex import FMIndex
from truthloom.llm.graph import components
from truthloom.llm.jaccard import PrefixTree, jaccard_components, keep_one
from truthloom.llm.substrings import drop_repeats
from truthloom.plans.workspace import Workspace


def near_copies(count=70, seed=9):
    """One large group of near copies, chains of edits, and a passage that unlike texts share."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(45)]
    texts = []
    for i in range(count):
        own = list(base)
        if i % 3 == 0:
            own[draw.randrange(60)] = f"edit{i}"
        elif i % 3 == 1:
            cut = draw.randrange(8)
            own = own[cut:] + [f"t{i}_{k}" for k in range(draw.randrange(8))]
        else:
            own = passage + [f"u{i}_{k}" for k in range(draw.randint(4, 30))]
        texts.append(" ".join(own))
    chain = [f"c{i}" for i in range(50)]
    for i in range(12):
        texts.append(" ".join(chain[2 * i :] + [f"d{k}" for k in range(2 * i)]))
    return texts


@pytest.mark.parametrize("block", [4000, 4])
@pytest.mark.parametrize("texts", [plain.random_texts(count=110), near_copies(), plain.edge_texts()], ids=["random", "near", "edge"])
def test_components_against_all_pairs(spark, texts, block):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, block).collect()}
    assert found == plain.components(list(enumerate(texts)))


def shared_passages(count=240, seed=4):
    """Unlike texts put together from a few passages: one shard, few links."""
    draw = random.Random(seed)
    passages = [[f"p{i}_{k}" for k in range(25)] for i in range(12)]
    texts = []
    for i in range(count):
        own = [w for p in draw.sample(passages, 3) for w in p]
        texts.append(" ".join(own + [f"u{i}_{k}" for k in range(draw.randint(0, 3))]))
    return texts


def test_pieces_of_shared_passages_stay_small(spark, monkeypatch):
    block, inner = 20, jaccard.join_pieces

    def join_pieces(table):
        assert table.num_rows <= 4 * block, f"{table.num_rows} sets in one task"
        return inner(table)

    monkeypatch.setattr(jaccard, "join_pieces", join_pieces)
    texts = shared_passages()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, block).collect()}
    assert found == plain.components(list(enumerate(texts)))


def test_rows_with_one_id_are_not_paired_with_each_other(spark, monkeypatch):
    texts = near_copies(40)
    rows = [(None, t) for t in texts] + [(7, t + " end") for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs, inner = [], type(docs).mapInArrow

    def mapInArrow(frame, func, schema, *more):
        if "wanted" in frame.columns:
            pairs.append(frame.count())
        return inner(frame, func, schema, *more)

    monkeypatch.setattr(type(docs), "mapInArrow", mapInArrow)
    found = jaccard_components(docs)
    assert 0 < pairs[0] <= len(rows)
    plain_rows = plain.components([(i, t) for i, (_, t) in enumerate(rows)])
    members = {}
    for i, (_, component) in plain_rows.items():
        members.setdefault(component, []).append(rows[i][0])
    want = sorted((str(rows[i][0]), n, str(max(members[c], key=lambda d: d or 0))) for i, (n, c) in plain_rows.items())
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == want


def test_components_of_odd_rows(spark):
    docs = plain.frame(spark, plain.edge_texts())
    rows = jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = plain.components(list(enumerate(plain.edge_texts())))
    assert sorted(set(ids)) == [i for i, (_, c) in want.items() if i == c]
    assert jaccard_components(spark.createDataFrame([], plain.COLUMNS)).count() == 0


def test_prefix_tree_against_all_pairs():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 30, draw.integers(1, 25))) for _ in range(150)]
    sets += [np.setdiff1d(np.arange(30), draw.integers(0, 30, 3)) for _ in range(80)]
    extra = draw.integers(0, 2, len(sets))  # shingles that nothing else has
    sizes = np.array([len(s) for s in sets]) + extra
    tree = PrefixTree(sizes, sets)
    for i in range(len(sets)):
        for other in tree.links(i):
            tree.join(i, other)
        tree.insert(i)
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (sizes[a] + sizes[b] - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert [tree.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_graph_components(spark):
    draw = random.Random(8)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(draw.randrange(300, 360), draw.randrange(300, 360)) for _ in range(40)]
    rows = [(f"{a:04d}".encode(), f"{b:04d}".encode()) for a, b in pairs if a != b]
    found = {r.node: r.component for r in components(spark.createDataFrame(rows, "a binary, b binary").repartition(5), Workspace(spark)).collect()}
    up = {n: n for row in rows for n in row}
    for _ in up:
        for a, b in rows:
            up[a] = up[b] = min(up[a], up[b])
    assert {bytes(k): bytes(v) for k, v in found.items()} == up


def edit(text, at, word="CHANGED"):
    own = plain.words(text)
    own[at % len(own)] = word
    return " ".join(own)


def test_leaks_against_all_windows(spark):
    draw = random.Random(6)
    items = [" ".join(f"q{draw.randrange(400)}" for _ in range(draw.randint(5, 50))) for _ in range(14)] + ["two words", None, "", items_repeat()]
    texts = plain.edge_texts() + plain.random_texts(count=15)
    for i, item in enumerate(items):
        if item:
            around = [f"z{draw.randrange(90)}" for _ in range(30)]
            for passage in (item, edit(item, 3), edit(edit(item, 5), 6), item.upper(), edit(edit(item, 2), 20), " ".join(plain.words(item)[4:])):
                cut = draw.randrange(30)
                texts.append(" ".join([*around[:cut], passage, *around[cut:]]))
            texts.append(item)
    docs = plain.frame(spark, texts)
    bench = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(docs, bench).collect()}
    want = {}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            alike = plain.leaks(text, item) if len(text or "") < 20_000 else 0
            if alike >= 0.75:
                want[(i, 100 + j)] = alike
    assert found == pytest.approx(want)
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    gone = {i for i, _ in want}
    assert sorted(r.doc_id for r in kept.dropDuplicates(["doc_id"]).collect() if r.doc_id is not None) == [i for i in range(len(texts)) if i not in gone]


def items_repeat():
    return "la la la la la la la la na na hey hey good bye " * 2


def test_page_with_the_whole_benchmark():
    draw = random.Random(16)
    items = [" ".join(f"w{draw.randrange(20_000)}" for _ in range(13)) for _ in range(4000)]
    texts = pa.array([" ".join(items), "w1 w2", " ".join(edit(item, 0) for item in items[:50])])
    index = decontaminate.Index.of(list(range(len(items))), items)
    tracemalloc.start()
    found = index.leaks(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [row[:5] for row in found[:4000]] == [(0, i, 13 * i, 13, 0) for i in range(4000)]
    assert [row[:2] for row in found[4000:]] == [(2, i) for i in range(50)]
    assert peak < 200 << 20


@pytest.mark.parametrize("pairs", [1, 5, 100])
def test_leaks_in_many_stretches(monkeypatch, pairs):
    draw = random.Random(pairs)
    items = [" ".join(f"q{draw.randrange(6)}" for _ in range(draw.choice([1, 3, 5, 9, 9, 9, 30]))) for _ in range(40)]
    texts = [" ".join(draw.choice(items) for _ in range(draw.randint(0, 5))) for _ in range(25)] + [None, ""] + items
    index = decontaminate.Index.of(list(range(len(items))), items)
    whole = index.leaks(pa.array(texts))
    for i, text in enumerate(texts):
        assert {row[1]: row[5] for row in whole if row[0] == i} == pytest.approx(
            {j: alike for j, item in enumerate(items) if (alike := plain.leaks(text, item)) >= 0.75})
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    assert decontaminate.Index.of(list(range(len(items))), items).leaks(pa.array(texts)) == whole


def test_leaks_of_empty_tables(spark):
    none, items = spark.createDataFrame([], plain.COLUMNS), spark.createDataFrame([], "item_id long, text string")
    some = plain.frame(spark, plain.edge_texts())
    assert find_leaks(some, items).count() == 0 and drop_leaks(some, items).count() == some.count()
    assert find_leaks(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_matching_statistics_against_search():
    draw = np.random.default_rng(5)
    lengths = [25, 40, 3, 20, 60, 21]
    parts = [draw.integers(1, 4, n) for n in lengths]
    parts[3] = parts[0][2:22].copy()
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = FMIndex(text, 4, 20)
    queries = [parts[0], draw.integers(1, 4, 30), np.concatenate([parts[4][10:45], draw.integers(1, 4, 10)]), parts[1][:19]]
    flat, first = np.concatenate(queries), np.concatenate([[0], np.cumsum([len(q) for q in queries])])
    low, high = index.matches(flat, first)
    for q, begin in zip(queries, first):
        for at in range(len(q)):
            want = [i for i in range(len(text) - 19) if at + 20 <= len(q) and (text[i : i + 20] == q[at : at + 20]).all()]
            assert sorted(index.suffixes[low[begin + at] : high[begin + at]].tolist()) == want


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("texts", [plain.random_texts(count=90), near_copies(), plain.edge_texts(), ["a " * 50, "b a " * 30, "a " * 21]], ids=["random", "near", "edge", "cycle"])
def test_repeats_against_all_windows(spark, texts, hot):
    draw = random.Random(1)
    ids = draw.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, [1] * len(ids))), "doc_id long, text string, mark int").repartition(4)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeats(docs, hot).collect()}
    assert rows == plain.strip(list(zip(ids, texts)))


def test_anchors_with_many_words_are_hot():
    # two slices; anchor 5 has 1 and 2 segments, anchor 9 has 3000 in each
    blobs = {"keys": ([5, 9], [5, 9]), "owners": ([0, substrings._NONE], [substrings._NONE, substrings._NONE]),
             "groups": ([1, 3000, *range(1, 3001)], [2, 3000, *range(3002)])}
    table = pa.table({k: pa.array([np.array(b, "<u4").tobytes() for b in v], pa.binary()) for k, v in blobs.items()} | {
        "slice": pa.array([1, 2], pa.int64()), "about": pa.array([b"", b""], pa.binary())})
    hot = [np.frombuffer(b, "<u4").tolist() for b in substrings._answer(256)(table)["hot"].to_pylist()]
    assert hot == [list(range(1, 3001)), list(range(2, 3002))]


def test_templated_lines_against_all_windows(spark):
    texts = [" ".join(["every line begins like this", *(f"w{(i * 7 + k) % 50}" for k in range(24))]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeats(docs, hot_words=350).collect()}
    assert rows == plain.strip(list(enumerate(texts)))


def test_repeats_of_odd_rows(spark):
    docs = plain.frame(spark, plain.edge_texts())
    rows = drop_repeats(docs, with_text=True).collect()
    assert len(rows) == docs.count()
    want = plain.strip(list(enumerate(plain.edge_texts())))
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id is not None} == {i: w[1] for i, w in want.items()}
    assert drop_repeats(spark.createDataFrame([], plain.COLUMNS)).count() == 0
