import random

import plain
import pytest
from pyspark.sql import functions as F

from truthloom import accu, evaluate, majority_vote
from truthloom.plans.claimbase import ClaimBase
from truthloom.operators.dependence import agreement, dependence
from truthloom.plans.accuracy import majority_sets
from truthloom.plans.claimbase import BLOCK
from truthloom.plans.workspace import Workspace, shared_folder
from truthloom.schema import CLAIM, FACT, as_truth
from truthloom.sources import (
    assign_sources, generate_claims, generate_truth, read_claims, read_truth, split_properties,
    write_claims, write_partition_report, write_truth,
)
from truthloom.sources.generate import Accuracy, named_range

PROPERTIES = [f"Property{i}" for i in range(1, 7)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_claims_csv(spark, example, tmp_path):
    write_claims(example, str(tmp_path / "claims"))
    assert rows(read_claims(spark, str(tmp_path / "claims"))) == rows(example.select(*CLAIM))


def test_claims_csv_with_commas_and_quotes(spark, tmp_path):
    odd = spark.createDataFrame([("a,b", "p", 'say "x"', "s,1")], "object string, property string, value string, source string")
    write_claims(odd, str(tmp_path / "odd"))
    assert rows(read_claims(spark, str(tmp_path / "odd"))) == rows(odd)


def split_small(spark, size=4096):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    """Lines break inside values, quotes hold separators, and still every task finds its own rows."""
    claims = spark.range(3000).select(
        F.concat(F.lit("o\n"), "id").alias("object"), F.when(F.col("id") % 7 == 0, 'p,"\r\n').otherwise("p").alias("property"),
        F.concat(F.lit('say "'), "id", F.lit('"\n\\n,\r')).alias("value"), F.lit("\n").alias("source"))
    write_claims(claims.coalesce(1), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    truth = claims.select(*FACT, F.array(F.col("value"), F.lit("x, y"), F.lit("]")).alias("false_values"))
    write_truth(truth.coalesce(1), str(tmp_path / "truth"))
    try:
        split_small(spark)
        for back, out in ((read_claims(spark, str(tmp_path / "one")), claims), (read_truth(spark, str(tmp_path / "truth"), with_false=True), truth)):
            assert back.rdd.getNumPartitions() > 8
            assert back.count() == 3000 and back.exceptAll(out).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_breaks_in_quotes_need_multi_line(spark, tmp_path):
    path = tmp_path / "foreign.csv"
    path.write_text('ID,Object,Property,Value,Source\n0,O1,P1,"two\nlines",S1\n0,O2,P1,C:\\new,S1\n')
    assert rows(read_claims(spark, str(path), multi_line=True)) == [("O1", "P1", "two\nlines", "S1"), ("O2", "P1", "C:\\new", "S1")]
    with pytest.raises(Exception, match="MALFORMED"):
        read_claims(spark, str(path)).collect()
    path.write_text('ID,Object,Property,Value,Source\n0,O1,P1,V1,"S\n1"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_claims(spark, str(path)).collect()


def test_files_without_line_breaks_keep_the_exchange_format(spark, example, tmp_path):
    write_claims(example.where("source = 's1' AND object = 'o1' AND property = 'p1'").coalesce(1), str(tmp_path / "plain"))
    written = [p.read_text() for p in (tmp_path / "plain").glob("*.csv")]
    assert [w for w in written if w] == ['"ID","Object","Property","Value","Source"\n"0","o1","p1","abc","s1"\n']


ODD = [" lead", "trail ", "x\ny", "", 'q"q', "a,b", "b\\", "\\", '"', '""', "\r\n", "a\rb", "\t", "'", "\\N", "null", "#c", "é", "\u0002", "\u0002x", "\\n", "\\b\\r", "\u0002\\b\n\\", "a\u2028b\x85c", "\n\n", "x\r"]


def test_claims_csv_keeps_every_text(spark, tmp_path):
    odd = spark.createDataFrame([(f"o{i}", v, v, "s") for i, v in enumerate(ODD)], "object string, property string, value string, source string")
    write_claims(odd, str(tmp_path / "odd"))
    assert rows(read_claims(spark, str(tmp_path / "odd"))) == rows(odd)
    truth = odd.select(*FACT)
    write_truth(truth, str(tmp_path / "truth"))
    assert rows(read_truth(spark, str(tmp_path / "truth"))) == rows(truth)


def test_malformed_csv_is_an_error(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("ID,Object,Property,Value,Source\n0,O1,P1\n0,O1,P1,3,S2\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_claims(spark, str(path)).collect()


def test_one_true_value_per_item(spark):
    claims = spark.createDataFrame([("o", "p", "a", "s")], "object string, property string, value string, source string")
    truth = spark.createDataFrame([("o", "p", "a"), ("o", "p", "a"), ("o", None, "x"), ("o", "q", "a"), ("o", "q", "b")], "object string, property string, value string")
    row = evaluate(claims, truth, majority_vote(claims)).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 0, 0, 0)
    assert rows(as_truth(truth)) == [("o", "p", "a"), ("o", "q", "b")]


def test_exchange_format(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("ID,Object,Property,Value,Source\n0,Object1,Property1,123456,Source1\n0,Object1,Property1,7,Source2\n")
    assert rows(read_claims(spark, str(path))) == [
        ("Object1", "Property1", "123456", "Source1"), ("Object1", "Property1", "7", "Source2")]
    path = tmp_path / "truth.csv"
    path.write_text('Object,Property,Value,False\nObject1,Property1,123456,"[500001, 600002]"\n')
    assert rows(read_truth(spark, str(path))) == [("Object1", "Property1", "123456")]
    assert read_truth(spark, str(path), with_false=True).first().false_values == ["500001", "600002"]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_other_formats(spark, example, example_truth, tmp_path, fmt):
    write_claims(example, str(tmp_path / "claims"), fmt)
    write_truth(example_truth, str(tmp_path / "truth"), fmt)
    assert rows(read_claims(spark, str(tmp_path / "claims"), fmt)) == rows(example.select(*CLAIM))
    assert rows(read_truth(spark, str(tmp_path / "truth"), fmt)) == rows(example_truth.select(*FACT))


def test_partition_report_file(spark, tmp_path):
    report = spark.createDataFrame(
        [([["a", "b"], ["c"]], 0.5, 0.25, 0.75, 0.5, 0.25, 0.375)],
        "partition array<array<string>>, accuracy_max double, accuracy_avg double, precision double, "
        "recall double, accuracy double, f1_score double")
    write_partition_report(report, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first().value == "[['a', 'b'], ['c']];0.5;0.25;0.75;0.75;0.5;0.25;0.375"


def test_generated_truth(spark):
    truth = generate_truth(named_range(spark, "Object", "object", 200), PROPERTIES).cache()
    assert truth.count() == 1200
    checks = truth.select(
        (F.col("value").cast("int").between(100000, 499998)).alias("v"),
        (F.size(F.array_distinct("false_values")) == 20).alias("n"),
        F.forall("false_values", lambda x: x.cast("int").between(500000, 999998)).alias("f"),
    ).distinct().collect()
    assert [tuple(r) for r in checks] == [(True, True, True)]
    again = generate_truth(named_range(spark, "Object", "object", 200).repartition(7), PROPERTIES)
    assert truth.exceptAll(again).isEmpty()
    assert not truth.exceptAll(generate_truth(named_range(spark, "Object", "object", 200), PROPERTIES, "1")).isEmpty()


def test_truth_file_with_false_values(spark, tmp_path):
    truth = generate_truth(named_range(spark, "Object", "object", 5), PROPERTIES)
    write_truth(truth, str(tmp_path / "truth"))
    back = read_truth(spark, str(tmp_path / "truth"), with_false=True)
    assert back.exceptAll(truth.select("object", "property", "value", "false_values")).isEmpty()


WRONG = [["red", "blue, dark"], ["x]"], ["it's", 'say "x"'], ["a\nb", "c\\"], [], None, ["1", "-20", "0"], ["007", "1"], ["1", None], ["1.0"], [""], ["123456789012345678901234567890"]]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_wrong_values_of_any_kind(spark, tmp_path, fmt):
    truth = spark.createDataFrame([(f"o{i}", "p", "v", w) for i, w in enumerate(WRONG)], "object string, property string, value string, false_values array<string>")
    write_truth(truth, str(tmp_path / "truth"), fmt)
    back = {r.object: r.false_values for r in read_truth(spark, str(tmp_path / "truth"), fmt, with_false=True).collect()}
    assert back == {f"o{i}": w for i, w in enumerate(WRONG)}


def test_wrong_values_of_other_origin(spark, tmp_path):
    path = tmp_path / "truth.csv"
    path.write_text("Object,Property,Value,False\nO1,P1,1,\"['red', 'blue, dark']\"\n")
    assert read_truth(spark, str(path), with_false=True).first().false_values == ["red", "blue, dark"]
    for broken in ("[red, blue]", "5", "[1, 2", '"x"'):
        path.write_text(f"Object,Property,Value,False\nO1,P1,1,\"{broken}\"\n")
        with pytest.raises(Exception, match="(?i)malformed|no list of wrong values"):
            read_truth(spark, str(path), with_false=True).collect()


@pytest.mark.parametrize("n_groups", [None, 1, 2, 4, 6])
def test_property_groups(spark, n_groups):
    groups = split_properties(spark, PROPERTIES, n_groups, "x").collect()
    assert sorted(r.property for r in groups) == PROPERTIES
    n = groups[0].n_groups
    assert n == n_groups if n_groups else 2 <= n <= 5
    for g in range(n):
        inside = [r for r in groups if r.group_id == g]
        assert sorted(r.place for r in inside) == list(range(len(inside)))
        assert {r.group_size for r in inside} == {len(inside)}


def test_sources_are_dealt(spark):
    dealt = assign_sources(named_range(spark, "Source", "source", 7), 3).orderBy("source_idx").collect()
    assert [r.source_group for r in dealt] == [0, 1, 2, 0, 1, 2, 0]
    assert [r.is_lead for r in dealt] == [True] * 3 + [False] * 4


def generated(spark, accuracy, n_objects=60, n_sources=10, n_groups=2):
    truth = generate_truth(named_range(spark, "Object", "object", n_objects), PROPERTIES)
    groups = split_properties(spark, PROPERTIES, n_groups)
    sources = named_range(spark, "Source", "source", n_sources)
    return truth, groups, generate_claims(truth, groups, sources, n_objects, accuracy)


def test_generated_claims(spark):
    truth, groups, claims = generated(spark, Accuracy(1.0, 0.0, 0.8))
    assert claims.count() == 60 * 6 * 10
    right = claims.join(truth.select(*FACT), FACT, "left_semi").join(groups, "property")
    shares = {(r.source, r.group_id): r["count"] / 180 for r in right.groupBy("source", "group_id").count().collect()}
    assert shares["Source1", 0] == 1.0 and shares["Source2", 1] == 1.0  # leaders on their own group
    assert ("Source1", 1) not in shares and ("Source2", 0) not in shares
    assert all(share <= 1 for share in shares.values())
    wrong = claims.join(truth.select(*FACT), FACT, "left_anti").join(truth.drop("value"), ["object", "property"])
    assert wrong.where(~F.array_contains("false_values", F.col("value"))).isEmpty()


def test_generated_claims_with_a_large_plan(spark, monkeypatch):
    from truthloom.sources import generate

    _, _, small = generated(spark, Accuracy(0.9, 0.3, 0.8))
    expected = rows(small)
    monkeypatch.setattr(generate, "BROADCAST_ROWS", 7)
    assert rows(generated(spark, Accuracy(0.9, 0.3, 0.8))[2]) == expected


def test_planted_copier(spark):
    """A source that repeats another one is found out.

    In generated claims every source is right on the same leading items, so honest sources
    look alike too and ACCU need not beat the vote; it must agree with the plain loops.
    """
    truth, _, claims = generated(spark, Accuracy(0.9, 0.5, 0.8), n_objects=30, n_sources=6)
    copied = claims.where("source = 'Source3'").withColumn("source", F.lit("Copier"))
    claims = claims.unionByName(copied).cache()
    base = ClaimBase.of(claims, deduped=True)
    trust = base.initial_trust(0.8)
    counts = agreement(base.pairs, base.true_pairs(majority_sets(base)), BLOCK)
    dep = {(r.s1, r.s2): r.dep for r in dependence(counts, trust, BLOCK).collect()}
    assert dep["Copier", "Source3"] > 0.999 and dep["Source3", "Copier"] > 0.999
    local = [tuple(r) for r in claims.select(*CLAIM).collect()]
    found = accu(base, max_iterations=3, threshold=0.0).truths
    assert {(r.object, r.property): r.value for r in found.collect()} == plain.accuracy(local, "ACCU", 3)[1]


def test_independent_errors_and_a_copied_liar(spark):
    """Four independent sources against one poor source that two others copy."""
    draw = random.Random(11)
    accuracies = {"a": 0.8, "b": 0.75, "c": 0.8, "d": 0.7, "liar": 0.3}
    claims, truth = [], []
    for i in range(300):
        truth.append((f"o{i}", "p", "t"))
        for source, share in accuracies.items():
            value = "t" if draw.random() < share else f"w{draw.randrange(20)}"
            claims.append((f"o{i}", "p", value, source))
            if source == "liar":
                claims += [(f"o{i}", "p", value, copy) for copy in ("copy1", "copy2")]
    claims = spark.createDataFrame(claims, "object string, property string, value string, source string").cache()
    truth = spark.createDataFrame(truth, "object string, property string, value string")
    voted = evaluate(claims, truth, majority_vote(claims)).first()
    judged = evaluate(claims, truth, accu(claims, n=20, deduped=True).truths).first()
    assert judged.accuracy > voted.accuracy


def test_workspace(spark, example):
    work = Workspace(spark)
    assert work.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = work.keep(example, "example")
    assert rows(kept) == rows(example)
    empty = work.keep(example.where("false"), "empty")
    assert empty.columns == example.columns and empty.count() == 0


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_tasks_of_generated_items_keep_their_size(spark, monkeypatch):
    """More objects are dealt to more tasks, with the same rows, so that no task holds more."""
    from truthloom.sources import generate

    objects = named_range(spark, "Object", "object", 60)
    expected = rows(generate_truth(objects, PROPERTIES))
    monkeypatch.setattr(generate, "ITEMS_PER_TASK", 10)
    truth = generate_truth(objects, PROPERTIES)
    assert truth.rdd.getNumPartitions() == 36
    assert rows(truth) == expected
