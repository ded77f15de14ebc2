import pytest

from truthloom import accuracy_model, truth_finder

# Expected values of the worked example, derived independently in plain Python and SQL.
TRUST = {
    ("TF", 1): [.614230, .623882, .609413, .609413, .616737],
    ("TF", 2): [.568982, .574850, .565175, .565175, .570532],
    ("DEPEN", 1): [.487210, .598360, .479667, .479667, .593490],
    ("DEPEN", 2): [.483149, .593903, .483736, .483736, .587391],
    ("ACCU", 1): [.579693, .746338, .419068, .419068, .795162],
    ("ACCU", 2): [.644344, .810828, .349884, .349884, .799464],
    ("ACCUSIM", 1): [.631436, .797863, .368405, .368405, .782611],
    ("ACCUSIM", 2): [.685059, .850239, .314082, .314082, .767434],
}
CONFIDENCE = {
    "TF": [.618416, .643394, .616786, .607232, .560062],
    "DEPEN": [1.702114, 2.580695, 1.702114, 1.7, 1.0],
    "ACCU": [10.198159, 15.462141, 10.198159, 10.185490, 5.991465],
    "ACCUSIM": [15.352206, 18.861527, 15.297139, 13.791083, 8.541004],
}


def run(claims, algo, rounds, **options):
    options = {"max_iterations": rounds, "threshold": 0.0, "deduped": True, **options}
    return truth_finder(claims, **options) if algo == "TF" else accuracy_model(claims, algo, **options)


@pytest.mark.parametrize("algo,rounds", list(TRUST))
def test_trust(example, algo, rounds):
    result = run(example, algo, rounds)
    trust = [r.trust for r in result.trust.orderBy("source").collect()]
    assert trust == pytest.approx(TRUST[algo, rounds], abs=1e-6)
    truths = {(r.object, r.property): r.value for r in result.truths.collect()}
    assert truths == {("o1", "p1"): "abd", ("o1", "p2"): "10", ("o1", "p3"): "u",
                      ("o2", "p1"): "xyz", ("o2", "p2"): "31", ("o2", "p3"): "m"}


@pytest.mark.parametrize("algo", list(CONFIDENCE))
def test_confidence(example, algo):
    rows = run(example, algo, 1).confidence.where("object = 'o1' and property in ('p1', 'p2')")
    found = [r.confidence for r in rows.orderBy("property", "value").collect()]
    assert found == pytest.approx(CONFIDENCE[algo], abs=1e-6)
