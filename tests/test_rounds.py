"""Rounds on facts that are dealt by item once: no later step shuffles them."""

import plain
import pytest

from truthloom import accuracy_model, truth_finder
from truthloom.plans import accuracy, claimbase, truthfinder
from truthloom.plans.claimbase import ClaimBase
from truthloom.plans.rounds import with_outcome


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fact_shuffles(df):
    """Exchanges of a plan besides the one that sends scores to the groups and broadcasts."""
    lines = [line for line in plan_of(df).splitlines() if "Exchange" in line and "Broadcast" not in line]
    return [line for line in lines if "REPARTITION_BY_NUM" not in line]


@pytest.fixture
def many(spark):
    """Claims of 7 sources on 600 items; every value is claimed by several."""
    rows = [(f"o{i}", f"p{i % 3}", f"v{(i * 7 + s * s) % 4}", f"s{s}") for i in range(600) for s in range(7) if (i + s) % 5]
    return spark.createDataFrame(rows, "object string, property string, value string, source string"), rows


@pytest.mark.parametrize("algo", ["DEPEN", "ACCU", "ACCUSIM"])
def test_item_step_does_not_shuffle_facts(spark, many, monkeypatch, algo):
    judged = []

    def spy(facts, *options):
        judged.append(with_outcome(facts, *options))
        return judged[-1]

    monkeypatch.setattr(accuracy, "with_outcome", spy)
    result = accuracy_model(many[0], algo, max_iterations=2, threshold=0.0, deduped=True)
    rounds = [df for df in judged if "group_id" in df.columns]
    assert len(rounds) == 2 and all("Window" in plan_of(df) and not fact_shuffles(df) for df in rounds)
    if algo != "ACCUSIM":  # its facts are written each round
        assert not fact_shuffles(result.truths) and not fact_shuffles(result.confidence)


def test_character_similarity_does_not_shuffle_facts(spark, many, monkeypatch):
    made, inner = [], truthfinder.implied_scores
    monkeypatch.setattr(truthfinder, "implied_scores", lambda *a, **k: made.append(inner(*a, **k)) or made[-1])
    truth_finder(many[0], max_iterations=1, threshold=0.0, deduped=True)
    assert "Window" in plan_of(made[0]) and not fact_shuffles(made[0])


@pytest.mark.parametrize("rows, groups", [(200_000, 16), (50, 1), (7, 3)])
def test_number_of_buckets_does_not_change_results(spark, many, monkeypatch, rows, groups):
    monkeypatch.setattr(claimbase, "PLACED_ROWS", rows)
    monkeypatch.setattr(claimbase, "GROUPS_PER_TASK", groups)
    trust, truths = plain.accuracy(many[1], "ACCU", 2)
    base = ClaimBase.of(many[0], deduped=True)
    result = accuracy_model(base, "ACCU", max_iterations=2, threshold=0.0)
    assert {r.source: r.trust for r in result.trust.collect()} == pytest.approx(trust, abs=1e-9)
    assert {(r.object, r.property): r.value for r in result.truths.collect()} == truths
    assert base.placed().tasks == max(8, -(-base.size.facts // rows))
    tables = list(base.work._tables)
    result.work.drop()
    assert tables and not any(spark.catalog.tableExists(t) for t in tables)


def test_sets_of_a_group_are_numbered_from_one(spark, many):
    placed = ClaimBase.of(many[0], deduped=True).placed()
    numbers = {}
    for row in placed.sets.collect():
        numbers.setdefault(row.group_id, []).append(row["at"])
    assert all(sorted(own) == list(range(1, len(own) + 1)) for own in numbers.values())


def test_no_claims(spark):
    none = spark.createDataFrame([], "object string, property string, value string, source string")
    result = accuracy_model(none, "ACCU", max_iterations=1)
    assert result.truths.collect() == [] and result.trust.collect() == []
