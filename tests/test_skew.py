"""Models on lopsided claims, with and without the paths for hot keys, against plain loops."""

import random
from datetime import datetime
from hashlib import md5
from itertools import groupby

import plain
import pytest

from pyspark.sql import functions as F

from truthloom import accuracy_model, truth_finder
from truthloom.operators import dependence, skew
from truthloom.operators.selection import at_positions
from truthloom.operators.votes import best_values
from truthloom.plans.claimbase import ClaimBase
from truthloom.plans.workspace import Workspace
from truthloom.sources import write_truth

SCHEMA = "object string, property string, value string, source string"


def lopsided():
    """One item claimed by everybody with many values, one source that claims everything."""
    draw = random.Random(7)
    sources = [f"s{i:02d}" for i in range(30)]
    claims = {("hot", "p1", s): f"v{draw.randrange(12)}" for s in sources}
    for o in range(25):
        for p in ("p1", "p2", "p3"):
            claims[f"o{o}", p, "s00"] = draw.choice(["aa", "ab", "12"])
            for s in draw.sample(sources[1:], 3):
                claims[f"o{o}", p, s] = draw.choice(["aa", "ab", "bc", "12", "13"])
    return sorted((o, p, v, s) for (o, p, s), v in claims.items())


CLAIMS = lopsided()


@pytest.fixture(params=["ordinary", "hot"])
def keys(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(skew, "FLOOR", 2)
        monkeypatch.setattr(skew, "SHARE", 10**9)
        monkeypatch.setattr(skew, "PAIR_CUT", 4)
    return request.param


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(CLAIMS, SCHEMA).cache()


def found(result):
    return (
        {r.source: r.trust for r in result.trust.collect()},
        {(r.object, r.property): r.value for r in result.truths.collect()},
    )


@pytest.mark.parametrize("algo", ["ACCU", "ACCUSIM"])
def test_accuracy(table, keys, algo):
    base = ClaimBase.of(table, deduped=True)
    trust, truths = found(accuracy_model(base, algo, max_iterations=2, threshold=0.0))
    want_trust, want_truths = plain.accuracy(CLAIMS, algo, 2)
    assert trust == pytest.approx(want_trust, abs=1e-9)
    assert truths == want_truths
    if keys == "hot":
        assert None not in (base.hot_pairs, base.hot_items, base.hot_fact_sets, base.hot_member_sets, base.hot_facts)


@pytest.mark.parametrize("kind,sim", [("char", plain.char_cosine), ("numeric", plain.numeric)])
def test_truth_finder(table, keys, kind, sim):
    base = ClaimBase.of(table, deduped=True)
    trust, truths = found(truth_finder(base, max_iterations=2, threshold=0.0, similarity=kind))
    want_trust, want_truths = plain.truth_finder(CLAIMS, 2, sim=sim)
    assert trust == pytest.approx(want_trust, abs=1e-9)
    assert truths == want_truths
    if keys == "hot":
        assert base.hot_sources is not None


def test_pair_counts(table, keys):
    """Agreements and shared items of every pair of sources."""
    base = ClaimBase.of(table, deduped=True)
    _, counts = plain.judge(CLAIMS, plain.vote(CLAIMS), {c[3]: 0.8 for c in CLAIMS})
    rows = {(r.s1, r.s2): (r.n_same, r.n_common) for r in base.pairs.collect()}
    assert rows == {
        pair: (kt + kf, kt + kf + kd) for pair, (kt, kf, kd) in counts.items() if pair[0] < pair[1]
    }


def test_hot_list_is_bounded(spark):
    """No more than SHARE keys can be hot, whatever the sizes."""
    sizes = spark.range(5000).selectExpr("id as key", "id % 7 + 1 as n")
    total = sizes.agg({"n": "sum"}).first()[0]
    hot = skew.hot_keys(lambda: sizes, ["key"], "n", total, share=2000, floor=1)
    assert hot is None or hot.count() <= 2000


def test_hot_pairs_count_sets(spark, monkeypatch):
    """A pair is hot by the sets it meets in, not by the facts that have these sets."""
    monkeypatch.setattr(skew, "FLOOR", 3)
    claims = [(f"x{i}", "p", "v", s) for i in range(100) for s in ("a", "b")]
    claims += [(f"y{i}", "p", "v", s) for i in range(10) for s in ("c", "d", f"e{i}")]
    base = ClaimBase.of(spark.createDataFrame(claims, SCHEMA), deduped=True)
    assert sorted((r.s1, r.s2) for r in base.hot_pairs.collect()) == [("c", "d"), ("d", "c")]


def largest_groups(df, keys):
    """Rows that meet in one task at most, were every join key a task of its own."""
    return max(r["count"] for r in df.groupBy(*keys).count().collect())


def test_a_hub_source_is_cut(spark, monkeypatch):
    """One source shares an item with each of 120 others, which share none among themselves."""
    claims = [(f"x{i}", "p", v, s) for i in range(120) for v, s in (("a", "hub"), ("a" if i % 3 else "b", f"s{i:03d}"))]
    frame = spark.createDataFrame(claims, SCHEMA)
    want_trust, want_truths = plain.accuracy(claims, "ACCU", 2)
    joined, inner = [], skew.spread_join

    def spy(big, small, keys, hot, hot_on, by, how="inner"):
        if hot is not None and hot_on in (["s1"], ["s2"]):
            pieces = F.coalesce(F.col("pieces"), F.lit(1))
            joined.append(big.join(hot, hot_on, "left").withColumn("piece", F.pmod(F.xxhash64(by), pieces)).select(*hot_on, "piece"))
        return inner(big, small, keys, hot, hot_on, by, how)

    monkeypatch.setattr(skew, "FLOOR", 20)
    monkeypatch.setattr(dependence, "spread_join", spy)
    base = ClaimBase.of(frame, deduped=True)
    trust, truths = found(accuracy_model(base, "ACCU", max_iterations=2, threshold=0.0))
    assert trust == pytest.approx(want_trust, abs=1e-9) and truths == want_truths
    assert [(r.s1, r.pieces) for r in base.hub_sources.collect()] == [("hub", 6)]
    assert len(joined) >= 6 and all(largest_groups(rows, rows.columns) <= 40 for rows in joined)


@pytest.mark.parametrize("floor", [10**6, 50])
def test_row_at_a_position(spark, monkeypatch, floor):
    """Places in groups of very different sizes, and the sizes of what is ranked."""
    monkeypatch.setattr(skew, "FLOOR", floor)
    sizes = {"big": 3000, "mid": 70, "one": 1, "two": 2}
    rows = [(k, f"v{i:05d}", (n * 7) // 10) for k, n in sizes.items() for i in range(n)] + [(None, "v", 0), ("none", "v", 5)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, value string, position long").where("key IS NOT NULL")
    got = at_positions(frame, ["key"], "value", "position", Workspace(spark))
    assert {r.key: r.value for r in got.collect()} == {k: f"v{n * 7 // 10:05d}" for k, n in sizes.items()}
    assert got.columns == frame.columns


def test_an_item_with_very_many_tied_values(spark, monkeypatch):
    """A million values with one vote each: ranges are counted, one of them is ranked."""
    claims = spark.range(1_000_000).select(F.lit("o").alias("object"), F.lit("p").alias("property"),
                                           F.format_string("v%07d", "id").alias("value"), F.col("id").cast("string").alias("source"))
    row = best_values(claims.select("object", "property", "value", F.lit(1).alias("votes")), tie="seeded").collect()
    assert [r.value for r in row] == [f"v{random.Random(10).choice(range(1_000_000)):07d}"]


def test_a_model_needs_a_round(table):
    with pytest.raises(ValueError, match="round"):
        truth_finder(table, max_iterations=0)
    with pytest.raises(ValueError, match="round"):
        accuracy_model(table, "ACCU", max_iterations=0)


def test_seeded_ties(spark, monkeypatch):
    """Among tied values the one that Python's seeded choice picks, also on hot items."""
    claims = [(f"o{i}", "p", f"v{j:02d}", f"s{j}") for i in range(3) for j in range(2 + 5 * i)]
    frame = spark.createDataFrame(claims, SCHEMA)
    want = {f"o{i}": random.Random(10).choice([f"v{j:02d}" for j in range(2 + 5 * i)]) for i in range(3)}
    for floor in (10**6, 2):
        monkeypatch.setattr(skew, "FLOOR", floor)
        found = truth_finder(frame, max_iterations=1, rho=0.0, tie="seeded").truths
        assert {r.object: r.value for r in found.collect()} == want
    with pytest.raises(ValueError, match="tie"):
        accuracy_model(frame, "ACCU", max_iterations=1, tie="other")


@pytest.fixture(scope="module")
def lined(spark, tmp_path_factory):
    """Lines, suppliers and texts: one part has most lines, dates and whole orders repeat, keys, dates and flags are missing."""
    draw, folder = random.Random(4), tmp_path_factory.mktemp("lines")
    days = [None, *[datetime(1995 + i, 3, 1) for i in range(3)]]
    lines = [(draw.randrange(6), draw.choice([7] * 30 + [None, *range(40)]), draw.randrange(12), draw.randrange(2), draw.choice([None, 0.04, 0.1]),
              draw.choice([0.0, 0.05]), draw.choice([None, "A", "N", "R"]), draw.choice(["F", "O"]), draw.choice(days)) for _ in range(3000)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "supplier": ([(i, None if i == 3 else i % 4) for i in range(11)], "s_suppkey long, s_nationkey int"),
        "documents": ([(1, 'a "b"\n[c]', "en", "web"), (2, None, "de", "web")], "doc_id long, text string, lang string, source string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    claimed = {}
    for order, part, supplier, number, discount, tax, flag, status, day in lines:
        if part is None or supplier in (3, 11):
            continue
        values = {"returnflag": flag, "linestatus": status, "discount": discount and f"{discount:.2f}", "tax": f"{tax:.2f}", "shipyear": day and str(day.year)}
        for name, value in values.items():
            if value is not None:
                key = str(part), name, str(supplier % 4)
                claimed[key] = max(claimed.get(key, ((), "")), ((day is not None, day or 0, order, number), value))
    return str(folder), sorted((o, p, value, s) for (o, p, s), (_, value) in claimed.items())


@pytest.mark.parametrize("floor", [10**6, 100])
def test_claims_dealt_by_part(spark, lined, monkeypatch, floor):
    """All lines of a part lie in one task; of a part with very many lines only the newest values do."""
    import __spark_entry__ as entry
    monkeypatch.setattr(skew, "FLOOR", floor)
    monkeypatch.setattr(skew, "KEY_HASHES", 3)
    monkeypatch.setattr(entry, "LINES_PER_TASK", 100)
    folder, want = lined
    dealing = entry.dealing(spark, folder, Workspace(spark))
    assert dealing["tasks"] == 32 and [r.object for r in dealing["hot"].collect()] == ["7"] if floor == 100 else dealing["hot"] is None
    assert sorted(map(tuple, entry.claims_of(spark, folder).collect())) == want
    assert sorted(map(tuple, entry.claims_of(spark, folder, **dealing).collect())) == want


@pytest.mark.parametrize("floor", [10**6, 100])
def test_truth_with_wrong_values_moves_lines_once(spark, lined, monkeypatch, floor):
    """Claims were worked out twice, in four shuffles, with a copy of the order per property."""
    import __spark_entry__ as entry
    monkeypatch.setattr(skew, "FLOOR", floor)
    monkeypatch.setattr(entry, "use_all_cores", lambda rows, *_: rows)
    written = []

    def spy(truth, path):
        written.append(truth)
        write_truth(truth, path)

    monkeypatch.setattr(entry, "write_truth", spy)
    folder, claims = lined
    found = sorted(map(tuple, entry.truth_false_roundtrip(spark, folder).collect()))
    want = [("1", "text", "en", 'a "b"\n[c]\x1fweb\x1f')]
    for item, own in groupby(claims, key=lambda claim: claim[:2]):
        own = list(own)
        true = min((md5("|".join((*item, source)).encode()).digest(), source, value) for *_, value, source in own)[2]
        want.append((*item, true, "\x1f".join(sorted({value for *_, value, _ in own} - {true}))))
    assert found == sorted(want)
    # a part with very many lines: its newest values are found first, and move once more
    exchanges = [line for line in written[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == (1 if floor > 100 else 2)
