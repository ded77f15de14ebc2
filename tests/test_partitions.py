import math
import random
from functools import partial
from hashlib import md5

import plain
import pytest
from pyspark.sql import functions as F

from truthloom import accuracy_model, majority_vote, truth_finder
from truthloom.operators.cluster import best_blocks, best_k, kmeans_starts, kmeans_sweep, labels_to_partition, silhouette_by_k
from truthloom.operators.matrix import property_distance, property_names, property_table, truth_matrix
from truthloom.operators.partitions import (
    AIMS, best_partition_of, completions, partition_blocks, partition_lists, partitions_at, set_partitions, subset_splits,
)
from truthloom.plans.claimbase import ClaimBase
from truthloom.plans.clustered import clustered_truth
from truthloom.plans import exhaustive
from truthloom.plans.exhaustive import best_partitions, continue_report, partition_report
from truthloom.plans.rounds import convergence
from truthloom.plans.workspace import Workspace

SCHEMA = "object string, property string, value string, source string"


def distances(spark, claims, found):
    work = Workspace(spark)
    names = work.keep(property_table(claims), "names")
    return work.keep(property_distance(truth_matrix(claims, found), names, work), "d"), names, work


def test_matrix_and_distance(spark, example):
    found = majority_vote(example)
    ones = {r.property: r["count"] for r in truth_matrix(example, found).groupBy("property").count().collect()}
    assert ones == {"p1": 6, "p2": 5, "p3": 6}
    d2 = {(r.p, r.q): r.d2 for r in distances(spark, example, found)[0].collect()}
    assert (d2["p1", "p2"], d2["p1", "p3"], d2["p2", "p3"]) == (9, 4, 5)
    assert d2["p2", "p1"] == 9 and d2["p1", "p1"] == 0 and len(d2) == 9


@pytest.mark.parametrize("labels,score", [((0, 0, 1), -.195992), ((0, 1, 0), .146302), ((0, 1, 1), .049690)])
def test_silhouette(spark, example, labels, score):
    d, names, _ = distances(spark, example, majority_vote(example))
    rows = [(2, r.property, c) for r, c in zip(names.orderBy("property").collect(), labels)]
    assigned = spark.createDataFrame(rows, "k int, property string, cluster int")
    assert silhouette_by_k(assigned, d).first().silhouette == pytest.approx(score, abs=1e-6)


def test_best_blocks(spark, example):
    d, names, work = distances(spark, example, majority_vote(example))
    assert sorted(map(tuple, best_blocks(d, names, work).collect())) == [("p1", "p1"), ("p1", "p3"), ("p2", "p2")]
    lists = labels_to_partition(kmeans_sweep(d, names, work))
    assert lists.first().partition == [["p1", "p3"], ["p2"]]


def test_two_properties_stay_together(spark, example):
    claims = example.where("property <> 'p3'")
    d, names, work = distances(spark, claims, majority_vote(claims))
    assert sorted(map(tuple, best_blocks(d, names, work).collect())) == [("p1", "p1"), ("p1", "p2")]


def lloyd(points, seeds, max_iter):
    """k-means with coordinates, to check the version that only knows distances."""
    def nearest(p, centres):
        return min(centres, key=lambda c: (round(math.dist(points[p], centres[c]) ** 2, 9), c))

    label = {p: nearest(p, {i: points[s] for i, s in enumerate(seeds)}) for p in points}
    for _ in range(max_iter):
        centres = {}
        for c in set(label.values()):
            inside = [points[p] for p in points if label[p] == c]
            centres[c] = [sum(x) / len(inside) for x in zip(*inside)]
        label = {p: nearest(p, centres) for p in points}
    return label


def test_kmeans_against_coordinates(spark):
    draw = random.Random(5)
    points = {f"p{i}": [draw.gauss(3 * (i % 3), 1) for _ in range(4)] for i in range(9)}
    rows = [(p, q, math.dist(x, y) ** 2) for p, x in points.items() for q, y in points.items()]
    d = spark.createDataFrame(rows, "p string, q string, d2 double").cache()
    got = {(r.k, r.property): r.cluster for r in kmeans_sweep(d, d.select(d.p.alias("property")).distinct(), Workspace(spark), k_max=5).collect()}
    seeds = ["p0"]
    while len(seeds) < 5:
        rest = [p for p in points if p not in seeds]
        seeds.append(min(rest, key=lambda p: (-min(math.dist(points[p], points[s]) for s in seeds), p)))
    for k in range(2, 6):
        want = lloyd(points, seeds[:k], 10)
        assert {p: got[k, p] for p in points} == want


def drawn_seeds(points, start, count, seed="7"):
    def u(cluster, p):
        return (int(md5(f"{seed}|{start}|{cluster}|{p}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    seeds = [min(points, key=lambda p: (u(0, p), p))]
    for cluster in range(1, count):
        weight = {p: min(math.dist(points[p], points[s]) ** 2 for s in seeds) for p in points if p not in seeds}
        seeds.append(min(weight, key=lambda p: (-math.log(u(cluster, p)) / weight[p] if weight[p] else math.inf, p)))
    return seeds


@pytest.mark.parametrize("max_iter", [300, 1])
def test_kmeans_with_drawn_starts(spark, max_iter):
    """Seeds, rounds and the choice among the starts, with coordinates and plain loops."""
    draw = random.Random(8)
    points = {f"p{i}": [draw.gauss(2 * (i % 4), 1) for _ in range(3)] for i in range(12)}
    points["p12"] = points["p0"]  # no weight beside p0
    rows = [(p, q, math.dist(x, y) ** 2) for p, x in points.items() for q, y in points.items()]
    d = spark.createDataFrame(rows, "p string, q string, d2 double").cache()
    names = spark.createDataFrame([(p,) for p in points], "property string")
    found = kmeans_starts(d, names, Workspace(spark), k_max=6, starts=4, seed="7", max_iter=max_iter).collect()
    for k in range(2, 7):
        ends = []
        for start in range(4):
            label = lloyd(points, drawn_seeds(points, start, k), 30 if max_iter > 30 else max_iter)
            spent = 0.0
            for c in set(label.values()):
                inside = [points[p] for p in points if label[p] == c]
                centre = [sum(x) / len(inside) for x in zip(*inside)]
                spent += sum(math.dist(x, centre) ** 2 for x in inside)
            ends.append((round(spent, 9), start, label))
        spent, start, label = min(ends, key=lambda e: e[:2])
        own = [r for r in found if r.k == k]
        assert {r.start for r in own} == {start} and own[0].inertia == pytest.approx(spent)
        assert {r.property: r.cluster for r in own} == label


def test_clustering_with_drawn_starts(spark, example):
    d, names, work = distances(spark, example, majority_vote(example))
    assert sorted(map(tuple, best_blocks(d, names, work, starts=3).collect())) == [("p1", "p1"), ("p1", "p3"), ("p2", "p2")]
    assert kmeans_starts(d, names.where("property = 'p1'"), work).first().cluster == 0


def test_many_properties(spark):
    """A table of names: nothing in the plan grows with their number."""
    claims = spark.range(3000).select(F.lit("o").alias("object"), F.concat(F.lit("p"), "id").alias("property"), F.lit("v").alias("value"),
                                      F.concat(F.lit("s"), F.col("id") % 50).alias("source"))
    work = Workspace(spark)
    names = work.keep(property_table(claims), "names")
    found = property_distance(truth_matrix(claims, claims.select("object", "property", "value")), names, work)
    assert len(found._jdf.queryExecution().logical().toString()) < 20_000
    assert found.count() == 9_000_000
    assert found.where("p <> q AND d2 = 0").count() == 3000 * 59 and found.where("d2 = 2").count() == 9_000_000 - 3000 * 60
    with pytest.raises(ValueError):
        property_names(claims, 100)


def test_best_k_prefers_the_smallest(spark):
    rows = [(2, 0.5), (3, 0.5 + 1e-12), (4, 0.4)]
    assert best_k(spark.createDataFrame(rows, "k int, silhouette double")).first().k == 2


@pytest.mark.parametrize("n,bell", [(1, 1), (2, 2), (3, 5), (5, 52), (6, 203)])
def test_set_partitions(spark, n, bell):
    names = [f"p{i}" for i in range(n)]
    parted = set_partitions(spark, names)
    blocks = partition_blocks(parted, names)
    lists = [tuple(map(tuple, r.partition)) for r in partition_lists(blocks).collect()]
    assert len(set(lists)) == len(lists) == bell
    assert all(sorted(p for block in part for p in block) == names for part in lists)
    assert blocks.select("block_id").distinct().count() == 2**n - 1


def all_labels(n):
    grown = [[0]]
    for _ in range(n - 1):
        grown = [[*labels, following] for labels in grown for following in range(max(labels) + 2)]
    return grown


@pytest.mark.parametrize("n", [1, 2, 4, 7, 11])
def test_numbers_are_turned_into_labels(spark, n):
    """Partition i has the i-th list of labels; ids sort like labels, also with labels of two digits."""
    names = [f"p{i:02d}" for i in range(n)]
    total = completions(n, 0)
    numbers = list(range(total)) if n < 9 else [0, 1, 500, 77_777, total // 2, total - 2, total - 1]
    rows = partitions_at(spark.createDataFrame([(i,) for i in numbers], "id long"), names).collect()
    found, ids = {}, {}
    for row in rows:
        found.setdefault(row.number, {})[row.property] = row.label
        ids[row.number] = row.partition_id
    labels = [[found[i][p] for p in names] for i in numbers]
    assert labels == sorted(labels) and [ids[i] for i in numbers] == sorted(ids.values())
    if n < 9:
        assert labels == all_labels(n)
    assert labels[0] == [0] * n and labels[-1] == list(range(n))


def test_partition_limits(spark):
    assert set_partitions(spark, list("abcd"), limit=4).select("partition_id").distinct().count() == 4
    with pytest.raises(ValueError):
        set_partitions(spark, [f"p{i}" for i in range(13)])
    with pytest.raises(ValueError):
        set_partitions(spark, [f"p{i}" for i in range(26)], limit=1)
    names = [f"p{i:02d}" for i in range(25)]
    first = set_partitions(spark, names, limit=10)
    assert first.count() == 250  # 4.6e18 partitions, of which ten are formed
    assert first.where("property < 'p21'").select("label").distinct().count() == 1


def test_subsets_are_split_once(spark):
    rows = [(r.whole, r.first, r.rest) for r in subset_splits(spark, 5).collect()]
    assert len(set(rows)) == len(rows) == (3**5 - 1) // 2
    assert all(a & b == 0 and a | b == whole and a & (whole & -whole) for whole, a, b in rows)


@pytest.mark.parametrize("n, places", [(1, 12), (3, 1), (5, 12), (5, 1), (6, 1)])
def test_best_partition_against_all(spark, n, places):
    """Rounded to one place, scores tie very often: the smallest id wins."""
    draw = random.Random(n * 100 + places)
    score = {block: round(draw.random(), places) for block in range(1, 1 << n)}
    table = spark.createDataFrame(list(score.items()), "block_id long, score double")
    work = Workspace(spark)
    value = {"mean": lambda v: sum(v) / len(v), "greatest": max, "sum": sum}
    for aim in AIMS:
        ranked = []
        for labels in all_labels(n):
            own = [score[sum(1 << i for i in range(n) if labels[i] == k)] for k in range(max(labels) + 1)]
            ranked.append((-round(value[aim](own) * 1e9), labels, len(own), value[aim](own)))
        _, labels, n_blocks, best = min(ranked)
        row = best_partition_of(table, n, work, aim).first()
        assert (row.labels, row.n_blocks, row.value) == (labels, n_blocks, pytest.approx(best, abs=1e-9))
    with pytest.raises(ValueError):
        best_partition_of(table, n, work, "least")


def test_best_partition_of_twelve_properties(spark):
    """The best split is planted: three blocks score 1, all others less."""
    planted = [0b000000001111, 0b000011110000, 0b111100000000]
    rows = [(b, 1.0 if b in planted else 0.5 + b / 100_000) for b in range(1, 1 << 12)]
    row = best_partition_of(spark.createDataFrame(rows, "block_id long, score double"), 12, Workspace(spark)).first()
    assert row.partition_id == "00-00-00-00-01-01-01-01-02-02-02-02" and row.value == pytest.approx(1.0)


def test_blocks_are_independent(spark, example, example_rows):
    """Each block in a grouped run ends as if it had been run alone."""
    blocks = spark.createDataFrame(
        [(1, "p1"), (1, "p2"), (2, "p3"), (3, "p2"), (3, "p3")], "block_id int, property string").cache()
    result = accuracy_model(ClaimBase.of(example, blocks, deduped=True), "ACCU", max_iterations=2, threshold=0.0)
    trust = {(r.block_id, r.source): r.trust for r in result.trust.collect()}
    for block, names in {1: ("p1", "p2"), 2: ("p3",), 3: ("p2", "p3")}.items():
        alone, _ = plain.accuracy([r for r in example_rows if r[1] in names], "ACCU", 2)
        assert {s: t for (b, s), t in trust.items() if b == block} == pytest.approx(alone, abs=1e-9)


def test_blocks_stop_on_their_own(spark, example):
    """A block that has converged keeps its state while the others go on."""
    blocks = spark.createDataFrame([(1, "p1"), (2, "p2"), (2, "p3")], "block_id int, property string").cache()
    options = {"max_iterations": 6, "threshold": 5e-3, "stop": "max_abs_delta"}
    both = accuracy_model(ClaimBase.of(example, blocks, deduped=True), "ACCU", **options)
    trust = {(r.block_id, r.source): r.trust for r in both.trust.collect()}
    rounds = []
    for block, names in {1: ["p1"], 2: ["p2", "p3"]}.items():
        alone = accuracy_model(example.where(example.property.isin(names)), "ACCU", deduped=True, **options)
        rounds.append(alone.rounds)
        assert {s: t for (b, s), t in trust.items() if b == block} == pytest.approx(
            {r.source: r.trust for r in alone.trust.collect()}, abs=1e-12)
    assert both.rounds == max(rounds)
    assert both.truths.count() == 6


def test_cosine_stop(spark, example, example_rows):
    """The rule compares the cosine of one round with that of the round before."""
    cosines, before = [], 1.0
    for r in range(1, 6):
        one = truth_finder(example, max_iterations=r, threshold=0.0, deduped=True)
        cosines.append(convergence(one.trust, []).first().cosine)
    changes = [abs(a - b) for a, b in zip([1.0, *cosines], cosines)]
    threshold = (changes[1] + changes[2]) / 2 if changes[2] < changes[1] else changes[0] * 1.01
    expected = next((i + 1 for i, c in enumerate(changes) if c < threshold), 5)
    assert truth_finder(example, threshold=threshold, deduped=True).rounds == expected


def test_clustered_truth(spark, example, example_rows):
    model = partial(accuracy_model, algo="ACCU", max_iterations=2, threshold=0.0)
    found = clustered_truth(example, model, deduped=True)
    assert found.rounds == 1  # the truths do not change, so neither does the partition
    want = {}
    for names in (("p1", "p3"), ("p2",)):
        want.update(plain.accuracy([r for r in example_rows if r[1] in names], "ACCU", 2)[1])
    assert {(r.object, r.property): r.value for r in found.truths.collect()} == want


def test_partition_report(spark, example, example_truth, example_rows):
    model = partial(accuracy_model, algo="DEPEN", max_iterations=1, threshold=0.0)
    report = {tuple(map(tuple, r.partition)): r for r in
              partition_report(example, example_truth, model, deduped=True).collect()}
    assert len(report) == 5
    truth = {(r.object, r.property): r.value for r in example_truth.collect()}
    for partition, row in report.items():
        found, trusts = {}, []
        for block in partition:
            trust, truths = plain.accuracy([r for r in example_rows if r[1] in block], "DEPEN", 1)
            found.update(truths)
            trusts.append(sum(trust.values()) / len(trust))
        assert row.accuracy_max == pytest.approx(max(trusts), abs=1e-9)
        assert row.accuracy_avg == pytest.approx(sum(trusts) / len(trusts), abs=1e-9)
        assert [row.tp, row.fp, row.fn, row.tn, row.n_unmatched] == plain.confusion(example_rows, truth, found)


def test_partition_report_without_truth(spark, example):
    model = partial(accuracy_model, algo="DEPEN", max_iterations=1)
    rows = partition_report(example, None, model, limit=2, deduped=True).collect()
    assert len(rows) == 2 and all(r.precision is None and r.accuracy_avg > 0 for r in rows)


ONE_ROUND = partial(accuracy_model, algo="DEPEN", max_iterations=1, threshold=0.0)


def report_of(rows):
    return sorted((tuple(r[c] for c in exhaustive.REPORT) for r in rows), key=str)


def test_best_rows_of_the_report(spark, example, example_truth):
    rows = partition_report(example, example_truth, ONE_ROUND, deduped=True).collect()
    found = {r.aim: r for r in best_partitions(example, example_truth, ONE_ROUND, ("accuracy_avg", "accuracy_max", "accuracy"), deduped=True).collect()}
    for aim in exhaustive.AIMS:
        best = min(rows, key=lambda r: (-round(r[aim], 9), r.partition_id))
        assert report_of([found[aim]]) == report_of([best])
    with pytest.raises(ValueError):
        best_partitions(example, None, ONE_ROUND, ("accuracy",), deduped=True)


def test_report_is_taken_up_where_it_ended(spark, example, example_truth, tmp_path, monkeypatch):
    whole = report_of(partition_report(example, example_truth, ONE_ROUND, deduped=True).collect())
    folder, resolved, inner = str(tmp_path / "report"), [], exhaustive.block_outcomes

    def outcomes(base, blocks, truth, model):
        resolved.extend(r.block_id for r in blocks.select("block_id").distinct().collect())
        return inner(base, blocks, truth, model)

    monkeypatch.setattr(exhaustive, "block_outcomes", outcomes)
    first = continue_report(example, folder, example_truth, ONE_ROUND, share=2, deduped=True)
    assert report_of(first.collect()) == whole[:2] and len(resolved) == 3
    # the run ends after the blocks of a share are written and before its report rows are
    monkeypatch.setattr(exhaustive, "report_rows", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        continue_report(example, folder, example_truth, ONE_ROUND, share=2, deduped=True)
    monkeypatch.undo()
    monkeypatch.setattr(exhaustive, "block_outcomes", outcomes)
    # and another loses a row of the report that was written already
    rows = spark.createDataFrame(spark.read.parquet(f"{folder}/report").where("number <> 0").collect(), spark.read.parquet(f"{folder}/report").schema)
    rows.write.parquet(f"{folder}/held")
    spark.read.parquet(f"{folder}/held").write.mode("overwrite").parquet(f"{folder}/report")
    while (rows := continue_report(example, folder, example_truth, ONE_ROUND, share=2, deduped=True)).count() < 5:
        pass
    assert report_of(rows.collect()) == whole
    assert sorted(resolved) == list(range(1, 8))  # no block twice
    assert report_of(continue_report(example, folder, example_truth, ONE_ROUND, deduped=True).collect()) == whole
    with pytest.raises(ValueError, match="other properties"):
        continue_report(example.where("property <> 'p1'"), folder, example_truth, ONE_ROUND, deduped=True)
