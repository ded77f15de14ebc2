"""Rounds on packed groups: the same results as plain loops, and nothing of the size of the facts is written."""

import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from truthloom import accuracy_model, truth_finder
from truthloom.functions.draws import seeded_place
from truthloom.plans import packed
from truthloom.plans.claimbase import ClaimBase
from truthloom.plans.exhaustive import partition_report
from truthloom.plans.workspace import Workspace

SCHEMA = "object string, property string, value string, source string"


def claims(n_sources, items=150):
    return [(f"o{i}", f"p{i % 3}", f"v{(i * 7 + s * s) % 4}", f"s{s}") for i in range(items) for s in range(n_sources) if (i + s) % 5]


@pytest.fixture
def many(spark, monkeypatch):
    monkeypatch.setattr(packed, "PACKED_FACTS", 1)
    rows = claims(7)
    return spark.createDataFrame(rows, SCHEMA), rows


def found(result):
    return {(r.object, r.property): r.value for r in result.truths.collect()}


@pytest.mark.parametrize("algo", ["DEPEN", "ACCU"])
def test_packed_rounds(many, algo):
    trust, truths = plain.accuracy(many[1], algo, 2)
    base = ClaimBase.of(many[0], deduped=True)
    assert base.packed().groups.count() > 8
    result = accuracy_model(base, algo, max_iterations=2, threshold=0.0)
    assert {r.source: r.trust for r in result.trust.collect()} == pytest.approx(trust, abs=1e-9)
    assert found(result) == truths


def test_packed_truth_finder(spark, many):
    rows = [(o, p, ("" if v == "v3" else v * 2 + "\U0001f600é"), s) for o, p, v, s in many[1]]
    trust, truths = plain.truth_finder(rows, 2)[:2]
    result = truth_finder(spark.createDataFrame(rows, SCHEMA), max_iterations=2, threshold=0.0, deduped=True)
    assert {r.source: r.trust for r in result.trust.collect()} == pytest.approx(trust, abs=1e-9)
    assert found(result) == truths


@pytest.fixture
def only_packed(monkeypatch):
    monkeypatch.setattr(ClaimBase, "scored_facts", lambda *_: 1 / 0)


def test_packed_accusim(spark, many, only_packed):
    rows = [(o, p, v * 2 + "x" * (i % 3), s) for i, (o, p, v, s) in enumerate(many[1])]
    trust, truths = plain.accuracy(rows, "ACCUSIM", 2)
    result = accuracy_model(spark.createDataFrame(rows, SCHEMA), "ACCUSIM", max_iterations=2, threshold=0.0, deduped=True)
    assert {r.source: r.trust for r in result.trust.collect()} == pytest.approx(trust, abs=1e-9)
    assert found(result) == truths


@pytest.mark.parametrize("stretch", [2, 2_000_000])
def test_packed_numbers(spark, many, only_packed, monkeypatch, stretch):
    texts = ["1", "1.0", "2.5", "none", "", "-3e1", " 7 "]
    rows = [(o, p, texts[(i * 5 + int(s[1])) % 7], s) for i, (o, p, v, s) in enumerate(many[1])]
    trust, truths = plain.truth_finder(rows, 2, sim=plain.numeric)
    score = truth_finder(spark.createDataFrame(rows, SCHEMA), similarity="numeric", max_iterations=2, threshold=0.0, deduped=True)
    assert {r.source: r.trust for r in score.trust.collect()} == pytest.approx(trust, abs=1e-9)
    assert found(score) == truths
    monkeypatch.setattr(packed, "STRETCH", stretch)
    starts, x = np.array([0, 1, 4]), pa.array([5.0, 1.0, None, 3.0, 2.0, 2.0, 4.0])
    wanted = [1, 2 + 0.5 * 4 / 2, 3, 4 + 0.5 * 2 / 2, 5 + 0.5 * (6 + 7 / 2), 6 + 0.5 * (5 + 7 / 2), 7 + 0.5 * (5 + 6) / 2]
    assert packed.implied_by_numbers(np.arange(1.0, 8.0), starts, x, 0.5) == pytest.approx(wanted)


def test_packed_seeded_ties(spark, many, monkeypatch):
    tied = [(f"t{i}", "p0", f"w{s}", f"s{s}") for i in range(9) for s in range(2 + i % 2)]
    data = spark.createDataFrame(many[1] + tied, SCHEMA)
    options = dict(tie="seeded", seed=0, max_iterations=2, threshold=0.0, deduped=True)
    monkeypatch.setattr(packed, "PACKED_FACTS", 10**6)
    other = accuracy_model(data, "DEPEN", **options)
    wanted, trust = found(other), {r.source: r.trust for r in other.trust.collect()}
    assert wanted != found(accuracy_model(data, "DEPEN", **{**options, "tie": "min"}))
    monkeypatch.setattr(packed, "PACKED_FACTS", 1)
    monkeypatch.setattr(ClaimBase, "scored_facts", lambda *_: 1 / 0)
    result = accuracy_model(data, "DEPEN", **options)
    assert found(result) == wanted
    assert {r.source: r.trust for r in result.trust.collect()} == pytest.approx(trust, abs=1e-9)


@pytest.mark.parametrize("seed", [0, 4, 10])
def test_seeded_place_follows_python(seed):
    for size in range(1, 300):
        assert seeded_place(size, seed) == random.Random(seed).choice(range(size))


def test_masks_of_two_words(spark, many):
    rows = claims(70, 6)
    result = accuracy_model(spark.createDataFrame(rows, SCHEMA), "ACCU", max_iterations=1, threshold=0.0, deduped=True)
    trust, truths = plain.accuracy(rows, "ACCU", 1)
    assert {r.source: r.trust for r in result.trust.collect()} == pytest.approx(trust, abs=1e-9)
    assert found(result) == truths


def test_packed_blocks(spark, many):
    members = [("one", "p0"), ("two", "p1"), ("two", "p2"), ("all", "p0"), ("all", "p1"), ("all", "p2")]
    base = ClaimBase.of(many[0], spark.createDataFrame(members, "block_id string, property string"), deduped=True)
    result = accuracy_model(base, "ACCU", max_iterations=2, threshold=1e-3)
    truths, trust = result.truths.collect(), result.trust.collect()
    for block in ("one", "two"):
        own = [r for r in many[1] if (block, r[1]) in members]
        alone = accuracy_model(spark.createDataFrame(own, SCHEMA), "ACCU", max_iterations=2, threshold=1e-3, deduped=True)
        assert {(r.object, r.property): r.value for r in truths if r.block_id == block} == found(alone)
        assert {r.source: r.trust for r in trust if r.block_id == block} == pytest.approx(
            {r.source: r.trust for r in alone.trust.collect()}, abs=1e-9)


def test_rounds_write_no_facts(spark, many, monkeypatch):
    written, keep = {}, Workspace.keep

    def spy(self, df, name):
        kept = keep(self, df, name)
        written[name] = kept.count()
        return kept

    members = [(f"b{i}", f"p{p}") for i in range(6) for p in range(3)]
    base = ClaimBase.of(many[0], spark.createDataFrame(members, "block_id string, property string"), deduped=True)
    base.packed()
    monkeypatch.setattr(Workspace, "keep", spy)
    monkeypatch.setattr(Workspace, "keep_bucketed", lambda *_: 1 / 0)
    accuracy_model(base, "DEPEN", max_iterations=2, threshold=0.0)
    sources = base.sources.count()
    assert any(name.startswith("sums-") for name in written)
    assert max(n for name, n in written.items() if name[-1].isdigit()) <= 6 * sources * (sources + 1)


def test_scores_of_sets():
    rng = np.random.default_rng(1)
    bits, factors = rng.integers(0, 2, (50, 9)).astype(np.uint8), rng.random((9, 9))
    wanted = [sum(np.prod([factors[a, b] for b in np.flatnonzero(row)]) for a in np.flatnonzero(row)) for row in bits]
    assert packed.set_scores(bits, factors) == pytest.approx(wanted)


@pytest.mark.parametrize("number, value", [("MOST_SOURCES", 6), ("MOST_PAIRS", 48), ("PACKED_FACTS", 10**6)])
def test_not_packed(spark, monkeypatch, number, value):
    monkeypatch.setattr(packed, "PACKED_FACTS", 1)
    monkeypatch.setattr(packed, number, value)
    rows = claims(7)
    base = ClaimBase.of(spark.createDataFrame(rows, SCHEMA), deduped=True)
    assert base.packed() is None
    trust, _ = plain.accuracy(rows, "ACCU", 1)
    result = accuracy_model(base, "ACCU", max_iterations=1, threshold=0.0)
    assert {r.source: r.trust for r in result.trust.collect()} == pytest.approx(trust, abs=1e-9)


def test_claims_are_shuffled_once(spark, many, monkeypatch):
    """Facts, items and packed groups are made where the claims were dealt."""
    shuffles, keep = {}, Workspace.keep

    def spy(self, df, name):
        shuffles[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        return keep(self, df, name)

    monkeypatch.setattr(Workspace, "keep", spy)
    base = ClaimBase.of(many[0], deduped=True)
    base.packed()
    assert base.items.count() == 150 and base.packed_groups().count() > 8
    assert shuffles["items"] == 0 and shuffles["packed"] == 0


def report_truth(spark, items=150):
    """Truth that is claimed, that nobody claims, that contradicts itself or is null, and of items without claims."""
    rows = [(f"o{i}", f"p{i % 3}", f"v{(i * 7 + i % 2) % 4}" if i % 7 else "none") for i in range(items) if i % 5]
    rows += [("o1", "p1", "v0"), ("o2", "p2", "zz"), ("o3", "p0", None), ("o0", "p2", "v1"), ("elsewhere", "p0", "v1"), ("o4", "p9", "v1")]
    return spark.createDataFrame(rows, "object string, property string, value string")


@pytest.mark.parametrize("limit", [None, 3])
def test_report_lists_no_truths(spark, many, monkeypatch, limit):
    """Truths of all blocks are judged in the groups; they were listed and joined with the truth before."""
    truth = report_truth(spark)
    monkeypatch.setattr(packed, "PACKED_FACTS", 10**6)
    wanted = {r.partition_id: r for r in partition_report(many[0], truth, limit=limit, deduped=True).collect()}
    monkeypatch.setattr(packed, "PACKED_FACTS", 1)
    monkeypatch.setattr(packed, "_facts", lambda *_: lambda batches: 1 / 0)
    report = partition_report(many[0], truth, limit=limit, deduped=True).collect()
    assert len(report) == len(wanted) == (limit or 5) and any(r.fp and r.fn and r.tp and r.tn and r.n_unmatched for r in report)
    for row in report:
        other = wanted[row.partition_id]
        assert row.partition == other.partition
        assert row[2:] == pytest.approx(other[2:], abs=1e-9)


def test_factors_of_many_blocks():
    """Sets look up the factors of all blocks at once; each block's scores are those of its own matrix."""
    rng = np.random.default_rng(2)
    bits, factors = rng.integers(0, 2, (40, 7)).astype(np.uint8), rng.random((7, 7, 5))
    found = packed.set_scores(bits, factors)
    assert found.shape == (40, 5)
    for block in range(5):
        assert found[:, block] == pytest.approx(packed.set_scores(bits, factors[:, :, block]))


def test_majority_is_counted_once_per_property(spark, many, monkeypatch):
    """Of seven blocks of three properties: the vote and its pairs do not depend on the block."""
    masks = np.array([[3], [6], [5], [3]])
    row = dict(names=pa.scalar(["p0", "p1", "p2"]), masks=pa.scalar(masks.astype("<i8").tobytes()))
    for name, numbers in dict(item_names=[0, 1, 2], starts=[0, 1, 2], at=[0, 1, 2, 3]).items():
        row[name] = pa.scalar(np.array(numbers, "<i4").tobytes())
    pairs = [(b, f"p{p}") for b in range(1, 8) for p in range(3) if b >> p & 1]
    row["members"] = pa.scalar([dict(block=b, property=p) for b, p in pairs], pa.list_(pa.struct([("block", pa.int32()), ("property", pa.string())])))
    row["factors"] = pa.scalar(None, pa.list_(pa.int32()))
    calls, winners = [], packed.Group.winners
    monkeypatch.setattr(packed.Group, "winners", lambda self, *a: calls.append(1) or winners(self, *a))
    batch = pa.RecordBatch.from_arrays([pa.array([v.as_py()], v.type) for v in row.values()], names=list(row))
    sums = next(packed._sums(3, True, packed.Rule())([batch]))
    assert len(calls) == 3
    n = {}
    for block, s2, count in zip(*[sums.column(c).to_pylist() for c in ("block", "s2", "n")]):
        n[block] = n.get(block, 0) + (count if s2 < 0 else 0)
    claims_of = [2, 2, 4]
    assert n == {b: sum(claims_of[p] for p in range(3) if b >> p & 1) for b in range(1, 8)}


def test_few_sources_have_no_hot_items(spark, many, monkeypatch):
    """No item has more values than there are sources, so items are not counted to see whether one is hot."""
    monkeypatch.setattr(ClaimBase, "items", property(lambda self: 1 / 0))
    base = ClaimBase.of(many[0], deduped=True)
    assert base.packed() is not None
    groups, tasks = base.dealing
    assert tasks % spark.sparkContext.defaultParallelism == 0 and groups >= 4 * tasks


def test_small_tables_of_a_round_are_one_stage(spark, many, monkeypatch):
    """Trust, pairs and sources were joined by broadcasts, each a job: 27 jobs a round, 198 in a report of ten partitions."""
    exchanges, keep = {}, Workspace.keep

    def spy(self, df, name):
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        return keep(self, df, name)

    monkeypatch.setattr(Workspace, "keep", spy)
    members = [(f"b{i}", f"p{p}") for i in range(6) for p in range(3)]
    base = ClaimBase.of(many[0], spark.createDataFrame(members, "block_id string, property string"), deduped=True)
    result = accuracy_model(base, "DEPEN", max_iterations=2, threshold=0.0)
    assert exchanges["trust-2"] == 0 and exchanges["factors-2"] <= 4
    assert not any(name.startswith(("dependence", "source")) for name in exchanges)
    assert result.dependence.count() == 6 * 7 * 6


def test_names_of_sources_are_looked_up_in_order(spark, many):
    """Numbers follow the names as Spark sorts them, by their bytes."""
    names = ["é", "Z", "a", "￮", "\U0001f600", "A|"]
    rows = [("o", "p", str(i % 2), name) for i, name in enumerate(names)]
    base = ClaimBase.of(spark.createDataFrame(rows, SCHEMA), deduped=True)
    assert base.source_names == [r.source for r in spark.createDataFrame(rows, SCHEMA).sort("source").collect()]
    assert {r.source: r.number for r in base.sources.collect()} == {name: at for at, name in enumerate(base.source_names)}


@pytest.mark.parametrize("n_sources", [7, 70])
def test_truth_is_picked_in_the_groups(spark, many, n_sources):
    """The claims were sorted by item and shuffled once more for it."""
    from __spark_entry__ import chosen_truth, truth_of
    rows = [(f"{o}é" if o[-1] == "1" else o, p, v, s) for o, p, v, s in claims(n_sources, 40)]
    data = spark.createDataFrame(rows, SCHEMA)
    truth = truth_of(ClaimBase.of(data, deduped=True))
    assert "Exchange" not in truth._jdf.queryExecution().executedPlan().toString()
    assert sorted(truth.collect()) == sorted(chosen_truth(data).collect())
