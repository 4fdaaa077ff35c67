import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators.impute import Field, fill_missing, filled_cells, fit_mixture, group_statistics
from loomgrid.sources.staging import stage

SCHEMA = "row_id long, donor string, sex string, age double"


def fields():
    return [Field("sex", F.col("sex")), Field("age", F.col("age"), numeric=True)]


def fill(spark, data, **kw):
    out = fill_missing(spark.createDataFrame(data, SCHEMA), "row_id", fields(), F.col("donor"), **kw)
    return {r["row_id"]: r for r in out.collect()}


def test_group_decides_and_marks(spark):
    data = [(1, "d1", "F", 40.0), (2, "d1", None, None), (3, "d2", "M", 60.0), (4, "d2", "M", 62.0), (5, "d2", "F", None), (6, None, "M", 61.0), (7, "d2", None, 61.0)]
    got = fill(spark, data)
    assert len(got) == len(data)
    assert got[2]["sex_filled"] == "F" and got[2]["sex_was_missing"] and abs(got[2]["age_filled"] - 40) < 8
    assert got[7]["sex_filled"] == "M"
    assert got[1]["age_filled"] == 40.0 and not got[1]["age_was_missing"]


def test_held_out_values(spark):
    rng = random.Random(1)
    data, truth = [], {}
    for i in range(600):
        donor = f"d{i % 60}"
        base = 20 + (i % 60)
        sex = "M" if (i % 60) % 2 else "F"
        age = base + rng.gauss(0, 1)
        if rng.random() < 0.15:
            truth[i] = (sex, age)
            sex = age = None
        data.append((i, donor, sex, age))
    got = fill(spark, data)
    assert sum(got[i]["sex_filled"] == s for i, (s, _) in truth.items()) >= 0.95 * len(truth)
    assert sum(abs(got[i]["age_filled"] - a) for i, (_, a) in truth.items()) / len(truth) < 1.5


def brute_force(groups, k, turns):
    """The same EM on dense arrays; ``groups``: per group its levels' counts and its numbers."""
    levels = sorted({x for c, _ in groups for x in c})
    counts = np.array([[c.get(x, 0) for x in levels] for c, _ in groups], dtype=float)
    m, s, q = (np.array([f(np.array(x)) if x else 0.0 for _, x in groups]) for f in (len, np.sum, lambda x: np.sum(x * x)))
    centre = s.sum() / m.sum()
    width = np.sqrt(q.sum() / m.sum() - centre**2)
    r = np.full((len(groups), k), 1 / k)
    for i, (_, x) in enumerate(groups):
        if x:
            b = min(k - 1, int(k / (1 + np.exp(-1.702 * (np.mean(x) - centre) / width))))
            r[i] = 0.3 / (k - 1)
            r[i, b] = 0.7
    for _ in range(turns):
        w = r.sum(axis=0) / r.sum()
        p = (r.T @ counts + 0.1) / ((r.T @ counts).sum(axis=1, keepdims=True) + 0.1 * len(levels))
        mu = (r.T @ s) / (r.T @ m)
        var = np.maximum((r.T @ q) / (r.T @ m) - mu**2, (1e-3 * width) ** 2)
        lj = np.log(w) + counts @ np.log(p).T - 0.5 * np.log(var) * m[:, None] - (q[:, None] - 2 * s[:, None] * mu + m[:, None] * mu**2) / (2 * var)
        r = np.exp(lj - lj.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
    return mu, var, dict(zip(levels, p.T)), r


def test_mixture_agrees_with_brute_force(spark):
    rng = random.Random(2)
    data, groups = [], {}
    for i in range(400):
        g = f"g{i % 90}"
        low = i % 90 < 40
        c = rng.choice("ab" if low else "bc") if rng.random() < 0.8 else None
        x = rng.gauss(-3 if low else 3, 1.5) if rng.random() < 0.8 else None
        data.append((g, c, x))
        own = groups.setdefault(g, ({}, []))
        if c is not None:
            own[0][c] = own[0].get(c, 0) + 1
        if x is not None:
            own[1].append(x)
    stats = stage(group_statistics(spark.createDataFrame(data, "g string, c string, x double"), "g", ["c"], ["x"]), "test")
    model = fit_mixture(stats, ["c"], ["x"], components=3, iterations=6, tolerance=-1.0)
    mu, var, p, r = brute_force(list(groups.values()), 3, 6)
    assert np.allclose(model.mean["x"], mu, atol=1e-8) and np.allclose(model.sd["x"], np.sqrt(var), atol=1e-8)
    got = {x["_group"]: [x[f"r{i}"] for i in range(3)] for x in model.responsibility.collect()}
    assert np.allclose([got[g] for g in groups], r, atol=1e-8)
    theta = {x["level"]: [math.exp(x[f"t{i}"]) for i in range(3)] for x in model.theta.filter("stat = 'c:c'").collect()}
    assert all(np.allclose(theta[x], p[x], atol=1e-8) for x in p)
    assert all(b >= a - 1e-6 for a, b in zip(model.log_likelihood, model.log_likelihood[1:]))  # EM never falls


def test_more_levels_than_a_table_on_the_driver_should_hold(spark):
    n = 18_531
    rows = spark.range(2 * n).select(F.concat(F.lit("g"), F.col("id") % n).alias("gene"), F.when(F.col("id") != 7, (F.col("id") % n) / n).alias("x"), "id")
    out = fill_missing(rows, "id", [Field("x", F.col("x"), numeric=True)], F.col("gene"), [Field("gene", F.col("gene"))], components=3, iterations=3)
    r = out.filter("x_was_missing").collect()
    assert len(r) == 1 and abs(r[0]["x_filled"] - 7 / n) < 0.05


def test_nothing_to_learn_from(spark):
    data = [(1, None, None, None), (2, "d", None, None)]
    got = fill(spark, data)
    assert all(r["sex_filled"] is None and r["sex_was_missing"] and r["age_was_missing"] for r in got.values())
    # what could not be filled is not reported as filled
    out = fill_missing(spark.createDataFrame(data, SCHEMA), "row_id", fields(), F.col("donor"))
    assert filled_cells(out, "t", "row_id", ["sex", "age"]).count() == 0
    assert fill(spark, []) == {}


def test_ties_are_filled_the_same_way_twice(spark):
    data = [(1, "d", "F", 1.0), (2, "d", "M", 1.0), (3, "d", None, 1.0)]
    assert fill(spark, data)[3]["sex_filled"] == fill(spark, data)[3]["sex_filled"] in ("F", "M")


def test_clashing_names_are_refused_and_others_kept(spark):
    df = spark.createDataFrame([(1, "d", "F", 1.0)], SCHEMA)
    with pytest.raises(ValueError):
        fill_missing(df.withColumn("SEX_FILLED", F.lit(1)), "row_id", fields(), F.col("donor"))
    with pytest.raises(ValueError):
        fill_missing(df.withColumn("_group", F.lit(1)), "row_id", fields(), F.col("donor"))
    assert "other" in fill_missing(df.withColumn("other", F.lit(1)), "row_id", fields(), F.col("donor")).columns


def test_filled_cells(spark):
    out = fill_missing(spark.createDataFrame([(1, "d", None, None), (2, "d", "F", 3.0)], SCHEMA), "row_id", fields(), F.col("donor"))
    assert sorted(tuple(r) for r in filled_cells(out, "t", "row_id", ["sex", "age"]).collect()) == [("t", 1, "age"), ("t", 1, "sex")]
