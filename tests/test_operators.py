import random
from itertools import combinations

import plain
import pytest
from pyspark.sql import functions as F

from truthloom import (
    as_claims, claims_from_wide, coverage, dedupe_claims, evaluate, majority_vote, value_similarity, vote_counts,
)
from truthloom.functions.draws import seeded_index
from truthloom.functions.scores import log_bucket, log_of_buckets, scaled_exp
from truthloom.functions.text import char_weights, weights_dot
from truthloom.operators.quality import source_stats
from truthloom.operators.sets import distinct_sets, pair_counts, set_members, units_with_sets
from truthloom.operators.votes import best_values, restrict_properties, tied_values
from truthloom.plans.workspace import Workspace
from truthloom.schema import FACT, ITEM


def test_majority_vote_and_evaluation(example, example_truth, example_rows):
    found = majority_vote(example)
    assert {(r.object, r.property): r.value for r in found.collect()} == plain.vote(example_rows)
    row = evaluate(example, example_truth, found).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.n_unmatched) == (11, 6, 3, 9, 0)
    assert row.precision == pytest.approx(.647059, abs=1e-6)
    assert row.recall == pytest.approx(.785714, abs=1e-6)
    assert row.accuracy == pytest.approx(.689655, abs=1e-6)
    assert row.f1_score == pytest.approx(.709677, abs=1e-6)


def test_items_without_truth_are_counted(example, example_truth, example_rows):
    partial_truth = example_truth.where("property <> 'p3'")
    row = evaluate(example, partial_truth, majority_vote(example)).first()
    truth = {(r.object, r.property): r.value for r in partial_truth.collect()}
    assert list(row)[:5] == plain.confusion(example_rows, truth, plain.vote(example_rows))
    assert row.n_unmatched == 10


def test_evaluation_without_any_match(example, example_truth):
    row = evaluate(example, example_truth.where("false"), majority_vote(example)).first()
    assert (row.tp, row.n_unmatched, row.precision, row.f1_score) == (0, 29, 0.0, 0.0)


def test_coverage(example):
    row = coverage(example).first()
    assert (row.n_objects, row.n_claims, row.n_slots) == (2, 29, 30)
    assert row.coverage == pytest.approx(.966667, abs=1e-6)


def test_vote_counts_repeat_claims_of_one_source(spark):
    rows = [("o", "p", "a", "s1"), ("o", "p", "a", "s1"), ("o", "p", "b", "s2")]
    claims = spark.createDataFrame(rows, "object string, property string, value string, source string")
    assert {r.value: r.votes for r in vote_counts(claims).collect()} == {"a": 2, "b": 1}
    assert {r.value: r.votes for r in vote_counts(dedupe_claims(claims)).collect()} == {"a": 1, "b": 1}


def test_items_are_never_concatenated(spark):
    rows = [("a", "bc", "1", "s1"), ("ab", "c", "2", "s1"), ("ab", "c", "2", "s2")]
    claims = spark.createDataFrame(rows, "object string, property string, value string, source string")
    assert majority_vote(claims).count() == 2


def test_ties(spark):
    rows = [("o", "p", v, f"s{i}") for i, v in enumerate(["c", "a", "b", "a", "c", "d"])]
    claims = spark.createDataFrame(rows, "object string, property string, value string, source string")
    tied = tied_values(vote_counts(claims)).orderBy("value").collect()
    assert [(r.value, r.votes, r.n_tied) for r in tied] == [("a", 2, 2), ("c", 2, 2)]
    assert majority_vote(claims).first().value == "a"
    random.seed(10)
    assert majority_vote(claims, tie="seeded").first().value == random.choice(["a", "c"])
    with pytest.raises(ValueError):
        majority_vote(claims, tie="other")


@pytest.mark.parametrize("seed", [10, 3])
def test_seeded_index_follows_python(spark, seed):
    sizes = list(range(1, 70)) + [1000, 12345, 10**6]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = {r.n: r.i for r in df.select("n", seeded_index(F.col("n"), seed).alias("i")).collect()}
    want = {}
    for n in sizes:
        random.seed(seed)
        want[n] = random.choice(range(n))
    assert got == want


def test_similarity(example):
    sims = {(r.v1, r.v2): r.sim for r in value_similarity(example).collect()}
    expected = {("abc", "abd"): 2 / 3, ("xya", "xyz"): 2 / 3, ("10", "11"): .707107, ("10", "20"): .5,
                ("11", "20"): 0, ("30", "31"): .5, ("u", "w"): 0, ("m", "n"): 0}
    for (a, b), sim in expected.items():
        assert sims[a, b] == pytest.approx(sim, abs=1e-6) and sims[b, a] == sims[a, b]
    assert len(sims) == 2 * len(expected)
    numeric = {(r.v1, r.v2): r.sim for r in value_similarity(example, "numeric").collect()}
    assert numeric["10", "20"] == pytest.approx(0.1) and numeric["u", "w"] == 0
    with pytest.raises(ValueError):
        value_similarity(example, "other")


@pytest.mark.parametrize("a,b", [("abca", "aabb"), ("é1", "ÉÀ"), ("", "a"), ("😀a", "😀b"), ("a.b", "..")])
def test_character_cosine(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    dot = weights_dot(char_weights(F.col("a")), F.map_from_entries(char_weights(F.col("b"))))
    assert df.select(dot).first()[0] == pytest.approx(plain.char_cosine(a, b))


def test_log_of_buckets_beyond_the_double_range(spark):
    rows = [(1, 2000.0), (1, 2000.0), (1, 1990.0), (2, -5.0), (2, 3.0), (3, 510.0), (3, 514.0)]
    df = spark.createDataFrame(rows, "k int, x double")
    parts = df.groupBy("k", log_bucket(F.col("x")).alias("bucket")).agg(F.sum(scaled_exp(F.col("x"))).alias("mass"))
    logs = parts.groupBy("k").agg(log_of_buckets(F.collect_list(F.struct("bucket", "mass"))).alias("y"))
    import math
    got = {r.k: r.y for r in logs.collect()}
    for k in (1, 2, 3):
        xs = [x for key, x in rows if key == k]
        want = max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
        assert got[k] == pytest.approx(want, rel=1e-12)


def test_pairs_from_distinct_sets(spark):
    draw = random.Random(1)
    units = {u: draw.sample("abcdef", draw.randint(1, 5)) for u in range(60)}
    df = spark.createDataFrame([(u, m) for u, ms in units.items() for m in ms], "unit int, member string").cache()
    weights = distinct_sets(units_with_sets(df, ["unit"], "member"), ["unit"])
    members = set_members(df, weights, ["unit"], "member")
    got = {(r.m1, r.m2): r.n for r in pair_counts(members, weights, "member", []).collect()}
    want = {}
    for ms in units.values():
        for pair in combinations(sorted(ms), 2):
            want[pair] = want.get(pair, 0) + 1
    assert got == want
    assert members.count() == sum(len(s) for s in {tuple(sorted(ms)) for ms in units.values()})


def test_wide_claims(spark):
    rows = [(1, "x", 1, "a", None), (1, "x", 2, None, "9"), (1, "y", 1, "b", "8"), (None, "y", 5, "q", "q")]
    wide = spark.createDataFrame(rows, "part int, shop string, day int, color string, size string")
    columns = {"color": F.col("color"), "size": F.col("size")}
    newest = claims_from_wide(wide, "part", "shop", columns, ["day"])
    assert sorted(map(tuple, newest.collect())) == [
        ("1", "color", "a", "x"), ("1", "color", "b", "y"), ("1", "size", "8", "y"), ("1", "size", "9", "x")]
    assert claims_from_wide(wide, "part", "shop", columns).count() == 4


def test_dedupe_keeps_the_newest(spark):
    rows = [("o", "p", "a", "s", 2), ("o", "p", "z", "s", 1), ("o", "p", "b", "s", 2)]
    df = spark.createDataFrame(rows, "object string, property string, value string, source string, day int")
    assert dedupe_claims(df, ["day"]).first().value == "b"
    assert dedupe_claims(df).first().value == "z"


def test_claims_are_strings_without_nulls(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (1, 2, None, 5)], "object int, property int, value int, source int")
    assert [tuple(r) for r in as_claims(df).collect()] == [("1", "2", "3", "4")]


def test_property_subset_and_source_stats(spark, example):
    assert restrict_properties(example, ["p1"]).count() == 10
    subset = spark.createDataFrame([("p1",), ("p2",)], "property string")
    assert restrict_properties(example, subset).count() == 19
    stats = {r.source: (r.n_claims, r.n_objects) for r in source_stats(example).collect()}
    assert stats["s5"] == (5, 2) and stats["s1"] == (6, 2)


def test_vote_ignores_row_order(example):
    one = sorted(map(tuple, majority_vote(example).collect()))
    other = sorted(map(tuple, majority_vote(example.orderBy(F.rand(3)).repartition(5)).collect()))
    assert one == other


def test_evaluation_keeps_votes_dealt_by_item(spark, example, example_truth, example_rows):
    """Votes in buckets of their items are judged where they are, also values that nobody claims."""
    truth = example_truth.unionByName(spark.createDataFrame([("o3", "p1", "x")], "object string, property string, value string"))
    truth = truth.withColumn("value", F.when(F.col("property") == "p3", "unclaimed").otherwise(F.col("value")))
    votes = vote_counts(example)
    found = majority_vote(example).select(*FACT)
    work = Workspace(spark)
    dealt = work.keep_bucketed(votes, "votes", 5, *ITEM)
    judged = evaluate(dealt, truth, best_values(dealt))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "value" in line.split("hashpartitioning")[1]]
    assert judged.collect() == evaluate(example, truth, found).collect()
    row, true = judged.first(), {(r.object, r.property): r.value for r in truth.collect()}
    assert [row.tp, row.fp, row.fn, row.tn, row.n_unmatched] == plain.confusion(example_rows, true, plain.vote(example_rows))
    work.drop()
