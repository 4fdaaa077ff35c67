import math

from loomgrid.operators import metrics
from loomgrid.operators.report import as_section, assemble, deltas, render, schema_peek

SCHEMA = "target string, truth double, pred double"


def score(spark, pairs, f, name):
    df = spark.createDataFrame([("t", a, b) for a, b in pairs], SCHEMA)
    return f(df, ["target"]).first()[name]


def rho(spark, pairs):
    return score(spark, pairs, metrics.spearman, "spearman")


def r2(spark, pairs):
    return score(spark, pairs, metrics.r_squared, "r2")


def test_spearman(spark):
    nan, inf = float("nan"), float("inf")
    assert rho(spark, [(i, i * 2.0) for i in map(float, range(4))]) is None
    assert abs(rho(spark, [(i, i * 2.0) for i in map(float, range(5))]) - 1) < 1e-12
    assert rho(spark, [(float(i), 3.0) for i in range(6)]) is None
    assert abs(rho(spark, [(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, 5.0)]) - 9.5 / math.sqrt(95)) < 1e-9
    assert rho(spark, [(1.0, 1.0), (2.0, nan), (3.0, inf), (None, 4.0), (4.0, 4.0), (5.0, 5.0), (6.0, 6.0)]) is None


def test_r_squared(spark):
    assert r2(spark, [(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)]) == 0.0
    assert r2(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]) == 1.0
    assert r2(spark, [(2.0, 1.0), (2.0, 2.0)]) is None
    assert r2(spark, [(2.0, 1.0)]) is None


def test_undefined_targets_stay(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 1.0, 1.0)], SCHEMA)
    assert {r["target"]: r["n"] for r in metrics.spearman(df, ["target"]).collect()} == {"a": 0, "b": 1}


def test_summary(spark):
    s = metrics.summary(spark.createDataFrame([(0.1,), (-0.1,), (0.3,), (None,)], "v double"), "v").first()
    assert (s["mean"], s["median"], s["q25"], s["q75"], s["frac_positive"], s["n_scored"], s["n_undefined"]) == (0.1, 0.1, 0.0, 0.2, 0.6667, 3, 1)
    s = metrics.summary(spark.createDataFrame([(None,), (None,)], "v double"), "v").first()
    assert (s["mean"], s["median"], s["frac_positive"], s["n_scored"], s["n_undefined"]) == (None, None, None, 0, 2)


def test_deltas_and_report(spark):
    df = spark.createDataFrame([("c", "base", 0.2), ("c", "head", 0.25), ("c", "flat", 0.205), ("c", "none", None)], "task string, model string, spearman_mean double")
    got = {r["model"]: (r["delta"], r["verdict"]) for r in deltas(df, ["base"]).collect()}
    assert got == {"head": (0.05, "better"), "flat": (0.005, "same"), "none": (None, None)}
    one = spark.createDataFrame([(3, None)], "n int, x string")
    assert assemble(as_section("part", one)) == {"part": {"n": "3", "x": None}}
    text = render({"Part": {"key": list(range(9))}})
    assert "0, 1, 2, 3, 4, 5, ... (9 in all)" in text and text.splitlines()[2].startswith("key" + " " * 35)
    assert schema_peek(one).first()["n_columns"] == 2
