import numpy as np
from pyspark.sql import functions as F

from loomgrid.operators import linear

SCHEMA = "row_key string, fold int, grp string, x array<double>, y array<double>"


def data(n=60, p=6, t=2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, (n, p))
    x[:, -1] = 4.0  # a constant column
    return x, x[:, : p - 1] @ rng.normal(size=(p - 1, t)) + rng.normal(0, 0.1, (n, t))


def frame(spark, x, y):
    return spark.createDataFrame([(f"r{i}", i % 3, f"g{i // 2}", x[i].tolist(), y[i].tolist()) for i in range(len(x))], SCHEMA)


def long_truth(df):
    return df.select("row_key", F.posexplode("y").alias("pos", "truth"))


def scaled(x):
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd > 1e-9, sd, 1)


def closed(z, y, a):
    zc = z - z.mean(axis=0)
    coef = np.linalg.solve(zc.T @ zc + a * np.eye(z.shape[1]), zc.T @ (y - y.mean(axis=0)))
    return coef, y.mean(axis=0) - z.mean(axis=0) @ coef


def test_moments_and_ridge_agree_with_numpy(spark):
    x, y = data()
    by_fold = linear.moments(frame(spark, x, y))
    whole = by_fold[0] + by_fold[1] + by_fold[2]
    assert whole.n == 60 and np.allclose(whole.xy, x.T @ y)
    proj = linear.fit_projection(whole, None)
    assert np.allclose((x - proj.mean) @ proj.basis, scaled(x))
    for a in (1.0, 100.0):
        coef, icept = linear.fit_ridge(whole, proj, [a])[a]
        want = closed(scaled(x), y, a)
        assert np.allclose(coef, want[0]) and np.allclose(icept, want[1])
    # a fold's training rows are the whole without the fold
    rest = np.arange(60) % 3 != 1
    coef, icept = linear.fit_ridge(whole - by_fold[1], proj, [10.0])[10.0]
    want = closed(scaled(x)[rest], y[rest], 10.0)
    assert np.allclose(coef, want[0]) and np.allclose(icept, want[1])


def test_pca_agrees_with_svd_and_the_sample_route(spark):
    x, y = data()
    m = sum(list(linear.moments(frame(spark, x, y)).values())[1:], start=linear.moments(frame(spark, x, y))[0])
    proj = linear.fit_projection(m, 3)
    u, s, _ = np.linalg.svd(scaled(x), full_matrices=False)
    z = (x - proj.mean) @ proj.basis
    assert np.allclose(np.abs(z), np.abs(u[:, :3] * s[:3]))
    assert abs(proj.explained - (s[:3] ** 2).sum() / (s**2).sum()) < 1e-9
    gram = linear.sample_gram(spark.createDataFrame([(v.tolist(),) for v in scaled(x).T], "v array<double>"))
    assert np.allclose(gram, scaled(x) @ scaled(x).T)
    assert linear.fit_projection(m, 500).basis.shape[1] == 6


def test_cross_validation_picks_a_sensible_alpha(spark):
    x, y = data(n=90)
    df = frame(spark, x, y)
    fit = linear.ridge_cv(df, long_truth(df), None, [0.1, 1e6])
    assert fit.alpha == 0.1 and fit.at_boundary and len(fit.scores) == 2
    preds = linear.predict(df.withColumn("fold", F.lit(0)), {0: (fit.projection, {fit.alpha: (fit.coef, fit.intercept)})}).join(long_truth(df), ["row_key", "pos"])
    assert preds.select(F.corr("pred", "truth")).first()[0] > 0.99
    one = df.withColumn("fold", F.lit(0))
    assert linear.ridge_cv(one, long_truth(df), None, [1.0, 2.0, 3.0]).alpha == 2.0


def test_alpha_by_validation(spark):
    x, y = data(n=90)
    df = frame(spark, x, y)
    train, val = df.filter("fold <> 2"), df.filter("fold = 2")
    fit = linear.ridge_by_validation(train, val, long_truth(df), None, [0.1, 1e6])
    assert fit.alpha == 0.1 and len(fit.scores) == 2
    rest = np.arange(90) % 3 != 2
    proj = linear.fit_projection(linear.moments(train.withColumn("fold", F.lit(0)))[0], None)
    coef, icept = closed((x[rest] - proj.mean) @ proj.basis, y[rest], 0.1)
    assert np.allclose(fit.coef, coef) and np.allclose(fit.intercept, icept)
    factor = linear.factorise(linear.moments(train.withColumn("fold", F.lit(0)))[0], proj)
    for a, p in factor.predictions((x - proj.mean) @ proj.basis, [0.1, 1e6]):
        coef, icept = factor.at(a)
        assert np.allclose(p, (x - proj.mean) @ proj.basis @ coef + icept)


def test_best_alpha_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5), (3.0, None)], "alpha double, score double")
    assert [(r["alpha"], r["at_boundary"]) for r in linear.best_alpha(df).filter("chosen").collect()] == [(1.0, True)]


def test_effective_df():
    assert abs(linear.effective_df(np.array([1.0, 1.0]), 10, 10.0) - 1.0) < 1e-12


def test_network_beats_the_mean(spark):
    x, y = data(n=120)
    df = frame(spark, x, y)
    fit = linear.mlp_cv(df, long_truth(df), [0.01, 0.1], hidden=32)
    preds = linear.predict_mlp(df, fit).join(long_truth(df), ["row_key", "pos"])
    assert preds.select(F.corr("pred", "truth")).first()[0] > 0.8


def test_more_features_than_samples_take_the_sample_route(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (24, 40))
    x[:, 7] = 4.0  # a constant column
    y = x[:, :3] @ rng.normal(size=(3, 2)) + rng.normal(0, 0.1, (24, 2))
    df, new = frame(spark, x, y), rng.normal(3, 2, (5, 40))
    alphas = [0.1, 10.0, 1e5]
    by_fold = linear.moments(df)
    whole = by_fold[0] + by_fold[1] + by_fold[2]
    monkeypatch.setattr(linear, "moments", None)  # features squared are not asked for
    for components in (None, 4, 500):
        fit = linear.ridge_cv(df, long_truth(df), components, alphas)
        proj = linear.fit_projection(whole, components)
        models = {f: (proj, linear.fit_ridge(whole - m, proj, alphas)) for f, m in by_fold.items()}
        scored = linear.predict(df, models).join(long_truth(df), ["row_key", "pos"])
        per = linear.spearman(scored, ["alpha", "fold", "pos"]).groupBy("alpha", "fold").agg(F.avg("spearman").alias("score"))
        want = linear.best_alpha(per).orderBy("alpha").collect()
        assert np.allclose([s for _, s in fit.scores], [r["score"] for r in want])
        assert [fit.alpha] == [r["alpha"] for r in want if r["chosen"]]
        coef, icept = linear.fit_ridge(whole, proj, [fit.alpha])[fit.alpha]
        assert np.allclose((new - fit.projection.mean) @ fit.projection.basis @ fit.coef + fit.intercept, (new - proj.mean) @ proj.basis @ coef + icept)
        assert abs(fit.projection.explained - proj.explained) < 1e-9
        assert abs(linear.effective_df(fit.projection.variance, 24, 10.0) - linear.effective_df(proj.variance, 24, 10.0)) < 1e-6
        if components == 4:
            assert np.allclose(fit.projection.basis, proj.basis)


def test_alphas_are_scored_without_a_row_for_each_alpha_and_target(spark, monkeypatch):
    x, y = data(n=90, t=5)
    x[3], x[6] = x[0], x[0]  # equal predictions
    y[:, 4] = 1.0  # nothing to rank
    df = frame(spark, x, y)
    truth = long_truth(df).withColumn("truth", F.when((F.col("pos") == 1) & F.col("row_key").isin("r4", "r7"), None).otherwise(F.round("truth")))
    truth = truth.filter("pos <> 2 or row_key <> 'r5'").filter("pos <> 3 or row_key in ('r0', 'r1', 'r2')")
    alphas = [0.1, 10.0, 1e4]
    by_fold = linear.moments(df)
    whole = by_fold[0] + by_fold[1] + by_fold[2]
    proj = linear.fit_projection(whole, None)
    models = {f: (proj, linear.factorise(whole - m, proj), alphas) for f, m in by_fold.items()}

    def scores(found):
        return {(r["alpha"], r["fold"], r["pos"]): r["spearman"] for r in found.collect()}

    def close(a, b):
        return all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in b)

    want = scores(linear.spearman(linear.predict(df, models).join(truth, ["row_key", "pos"]), ["alpha", "fold", "pos"]))
    assert len(want) == 45 and sum(v is None for v in want.values()) == 18
    monkeypatch.setattr(linear, "SCORED_NUMBERS", 0)  # by Spark's sort
    assert close(scores(linear.alpha_scores(df, truth, models)), want)
    monkeypatch.setattr(linear, "SCORED_NUMBERS", 10**6)
    monkeypatch.setattr(linear, "SCORED_TARGETS", 2)
    monkeypatch.setattr(linear, "predict", None)
    assert close(scores(linear.alpha_scores(df, truth, models)), want)
    assert len(linear.ridge_cv(df, truth, None, alphas).scores) == 3
    assert len(linear.ridge_by_validation(df.filter("fold <> 2"), df.filter("fold = 2"), truth, None, alphas).scores) == 3


def test_the_driver_is_not_asked_to_broadcast_predictions(spark, monkeypatch):
    x, y = data()
    df = linear.stage(frame(spark, x, y), "samples")  # files, of whose size the optimizer thinks little
    truth = linear.stage(long_truth(df), "truth")
    by_fold = linear.moments(df)
    whole = by_fold[0] + by_fold[1] + by_fold[2]
    proj = linear.fit_projection(whole, None)
    models = {f: (proj, linear.factorise(whole - m, proj), [0.1, 10.0]) for f, m in by_fold.items()}

    def broadcasts(found):
        return "BroadcastExchange" in found._jdf.queryExecution().executedPlan().toString()

    assert broadcasts(linear.predict(df, models).join(truth, ["row_key", "pos"]))  # left to itself
    assert not broadcasts(linear.with_truth(linear.predict(df, models), truth))
    assert not broadcasts(linear.alpha_scores(df, truth, models))
    monkeypatch.setattr(linear, "SCORED_NUMBERS", 0)
    assert not broadcasts(linear.alpha_scores(df, truth, models))
