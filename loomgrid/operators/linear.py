"""Scaling, PCA, ridge and a small neural head on sample arrays, fitted from sums over the cluster.

A sample is ``row_key, fold, x array<double>, y array<double>`` with imputed
numbers.  Workers add up moments per fold; what reaches the driver is one
matrix of (features + targets) squared per fold, or, with more features than
samples, of samples squared (:func:`sample_gram`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid import config
from loomgrid.operators.metrics import best_alpha, spearman
from loomgrid.sources.staging import stage

# Targets that a task scores at once, and numbers of a fold that it may hold.
SCORED_TARGETS = 64
SCORED_NUMBERS = 16_000_000


@dataclass
class Moments:
    n: float
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    def __add__(self, o: Moments) -> Moments:
        return Moments(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.xx + o.xx, self.xy + o.xy)

    def __sub__(self, o: Moments) -> Moments:
        return Moments(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.xx - o.xx, self.xy - o.xy)


def moments(samples: DataFrame) -> dict[int, Moments]:
    """Sums per fold, added up in the workers and once more after them."""
    first = samples.select(F.size("x").alias("p"), F.size("y").alias("t")).first()
    if first is None:
        return {}
    p, t = first["p"], first["t"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for fold, rows in b.groupby("fold"):
                x = np.vstack(rows["x"].to_numpy())
                z = np.hstack([np.ones((len(x), 1)), x, np.vstack(rows["y"].to_numpy())]) if t else np.hstack([np.ones((len(x), 1)), x])
                g = z[:, : p + 1].T @ z
                sums[fold] = sums[fold] + g if fold in sums else g
        for fold, g in sums.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(p + 1), "row": list(g)})

    rows = samples.select("fold", "x", "y").mapInPandas(partial, "fold int, i int, row array<double>")
    long = _added(rows, ["fold", "i"]).toPandas()
    out = {}
    for fold, g in long.groupby("fold"):
        m = np.zeros((p + 1, 1 + p + t))
        m[g["i"].to_numpy()] = np.vstack(g["row"].to_numpy())
        out[int(fold)] = Moments(m[0, 0], m[0, 1 : p + 1], m[0, p + 1 :], m[1:, 1 : p + 1], m[1:, p + 1 :])
    return out


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of equal keys added up, a row of each partial sum at a time; numbers travel packed."""
    schema = ", ".join([f"{k} int" for k in keys] + ["row array<double>"])

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [v] for k, v in zip(keys, key)} | {"row": [np.vstack(part["row"].to_numpy()).sum(axis=0)]})

    return rows.groupBy(*keys).applyInPandas(add, schema)


def sample_gram(feature_rows: DataFrame) -> np.ndarray:
    """Samples x samples products summed over features: ``feature_rows`` has ``v array<double>``, a value per sample.

    The route for more features than samples; features are spread over the cluster.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                v = np.vstack(b["v"].to_numpy())
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    rows = feature_rows.select("v").mapInPandas(partial, "i int, row array<double>")
    long = _added(rows, ["i"]).toPandas().sort_values("i")
    return np.vstack(long["row"].to_numpy()) if len(long) else np.zeros((0, 0))


@dataclass
class Projection:
    """Scaling and, if components are asked for, PCA; applied as ``(x - mean) @ basis``."""

    mean: np.ndarray
    basis: np.ndarray
    explained: float
    variance: np.ndarray


def fit_projection(m: Moments, components: int | None) -> Projection:
    """Population spread, constant columns scaled by 1; PCA of the scaled columns, ``max(1, min(k, n - 1, p))`` of them."""
    mean = m.sx / m.n
    cov = m.xx / m.n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), sd, 1.0)
    scaled = cov / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(scaled)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if components is None:
        return Projection(mean, np.diag(1 / scale), 1.0, values)
    k = max(1, min(components, int(m.n) - 1, len(mean)))
    vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return Projection(mean, vectors / scale[:, None], float(values[:k].sum() / max(values.sum(), 1e-300)), values)


def project_by_samples(samples: DataFrame, components: int | None) -> tuple[Projection, pd.DataFrame]:
    """As :func:`fit_projection`, from samples squared: the route for more features than samples.

    Also returns ``row_key, fold, y, z``, the projected samples.  Without
    ``components`` the basis has all directions in which the samples differ, so
    that ridge on them is ridge on all scaled features.  Row keys are unique.
    """
    out = samples.select("row_key", "fold", "y").orderBy("row_key").toPandas()
    n = len(out)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("row_key", "v"))), lambda s: s["v"])
    columns = stage(samples.select("row_key", F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(packed.alias("v")), "feature-rows")

    def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, sd = v.mean(axis=1), v.std(axis=1)
        scale = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), sd, 1.0)
        return (v - mean[:, None]) / scale[:, None], mean, scale

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"v": list(scaled(np.vstack(b["v"].to_numpy()))[0])})

    values, vectors = np.linalg.eigh(sample_gram(columns.mapInPandas(rows, "v array<double>")))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    p = columns.count()
    differ = max(1, int((values > 1e-10 * max(values[0], 1e-300)).sum()))
    k = differ if components is None else min(max(1, min(components, n - 1, p)), differ)
    size = np.sqrt(values[:k])
    back = vectors[:, :k] / np.where(size > 0, size, np.inf)

    def loadings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z, mean, scale = scaled(np.vstack(b["v"].to_numpy()))
                yield pd.DataFrame({"pos": b["pos"], "mean": mean, "scale": scale, "w": list(z @ back)})

    found = columns.mapInPandas(loadings, "pos int, mean double, scale double, w array<double>").toPandas().sort_values("pos")
    w = np.vstack(found["w"].to_numpy())
    sign = np.where(w[np.abs(w).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    explained = 1.0 if components is None else float(values[:k].sum() / max(values.sum(), 1e-300))
    out["z"] = list(vectors[:, :k] * size * sign)
    return Projection(found["mean"].to_numpy(), w * sign / found["scale"].to_numpy()[:, None], explained, values / n), out


def _projected_moments(z: pd.DataFrame) -> dict[int, Moments]:
    out = {}
    for fold, rows in z.groupby("fold"):
        x, y = np.vstack(rows["z"].to_numpy()), np.vstack(rows["y"].to_numpy())
        out[int(fold)] = Moments(len(x), x.sum(axis=0), y.sum(axis=0), x.T @ x, x.T @ y)
    return out


@dataclass
class Factor:
    """A ridge fit before alpha is chosen: what all alphas share, as large as one of them."""

    centre: np.ndarray
    y_mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    inner: np.ndarray

    def at(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercept in projected space."""
        coef = self.vectors @ (self.inner / (self.values + alpha)[:, None])
        return coef, self.y_mean - self.centre @ coef

    def turned(self, z: np.ndarray) -> np.ndarray:
        return (z - self.centre) @ self.vectors

    def predictions(self, z: np.ndarray, alphas: list[float]) -> Iterator[tuple[float, np.ndarray]]:
        turned = self.turned(z)
        for a in alphas:
            yield a, (turned / (self.values + a)) @ self.inner + self.y_mean

    def of_target(self, turned: np.ndarray, j: int, alphas: list[float]) -> np.ndarray:
        """Predictions of one target, a column for each alpha."""
        return turned @ (self.inner[:, j, None] / (self.values[:, None] + np.array(alphas))) + self.y_mean[j]


def fit_ridge(m: Moments, proj: Projection, alphas: list[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    factor = factorise(m, proj)
    return {a: factor.at(a) for a in alphas}


def factorise(m: Moments, proj: Projection) -> Factor:
    """Ridge in projected space with an unpenalised intercept; one factorisation for all alphas."""
    shift = (m.sx - m.n * proj.mean) @ proj.basis
    centre = shift / m.n
    y_mean = m.sy / m.n
    xx = m.xx - np.outer(m.sx, proj.mean) - np.outer(proj.mean, m.sx) + m.n * np.outer(proj.mean, proj.mean)
    zz = proj.basis.T @ xx @ proj.basis - m.n * np.outer(centre, centre)
    zy = proj.basis.T @ (m.xy - np.outer(proj.mean, m.sy)) - m.n * np.outer(centre, y_mean)
    values, vectors = np.linalg.eigh(zz)
    return Factor(centre, y_mean, np.maximum(values, 0), vectors, vectors.T @ zy)


def effective_df(variance: np.ndarray, n: float, alpha: float) -> float:
    lam = variance * n
    return float((lam / (lam + alpha)).sum())


def predict(samples: DataFrame, models: dict[int, tuple]) -> DataFrame:
    """``row_key, alpha, fold, pos, pred``: each row by the model of its fold, for every alpha.

    A model is a projection with the coefficients and intercept of each alpha,
    or with a :class:`Factor` and the alphas, from which workers make them.
    """
    shared = samples.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for fold, rows in b.groupby("fold"):
                if int(fold) not in shared.value:
                    continue
                proj, *fit = shared.value[int(fold)]
                z = (np.vstack(rows["x"].to_numpy()) - proj.mean) @ proj.basis
                made = fit[0].predictions(z, fit[1]) if len(fit) == 2 else ((a, z @ coef + icept) for a, (coef, icept) in fit[0].items())
                for a, p in made:
                    yield pd.DataFrame({"row_key": rows["row_key"], "fold": rows["fold"], "alpha": a, "preds": list(p)})

    out = samples.select("row_key", "fold", "x").mapInPandas(run, "row_key string, fold int, alpha double, preds array<double>")
    return out.select("row_key", "fold", "alpha", F.posexplode("preds").alias("pos", "pred"))


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties get their average."""
    order = np.argsort(v)
    ordered = v[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[starts, len(v)])
    out = np.empty(len(v))
    out[order] = np.repeat(starts + (counts + 1) / 2, counts)
    return out


def rank_correlation(truth: np.ndarray, pred: np.ndarray, least: int = config.MIN_PAIRS) -> float:
    """As :func:`spearman` for the pairs of one target: NaN stands for its NULL."""
    ok = np.isfinite(truth) & np.isfinite(pred)
    truth, pred = truth[ok], pred[ok]
    if len(truth) < max(least, 1) or truth.min() == truth.max() or pred.min() == pred.max():
        return np.nan
    a, b = _ranks(truth), _ranks(pred)
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def alpha_scores(samples: DataFrame, truth: DataFrame, models: dict[int, tuple[Projection, Factor, list[float]]]) -> DataFrame:
    """``alpha, fold, pos, spearman``: the rank correlations of each row's prediction by the model of its fold, for every alpha.

    Predictions are made where they are ranked: a projected sample is shuffled
    for each block of targets, not a row for each alpha and target.  A task holds
    a fold and a block; folds too large for that are ranked by Spark's sort.
    """
    largest = samples.groupBy("fold").count().agg(F.max("count")).first()[0] or 0
    k, t = next(iter(models.values()))[1].inner.shape
    width = min(SCORED_TARGETS, SCORED_NUMBERS // max(largest, 1) - k)
    if width < 1:
        return spearman(with_truth(predict(samples, models), truth), ["alpha", "fold", "pos"]).drop("n")
    shared = samples.sparkSession.sparkContext.broadcast(models)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for fold, rows in b.groupby("fold"):
                if int(fold) not in shared.value:
                    continue
                proj, factor, _ = shared.value[int(fold)]
                z = factor.turned((np.vstack(rows["x"].to_numpy()) - proj.mean) @ proj.basis)
                dense = np.full((len(rows), t), np.nan)
                dense[np.repeat(np.arange(len(rows)), rows["pos"].map(len)), np.concatenate(rows["pos"].to_numpy())] = np.concatenate(rows["truth"].to_numpy())
                for block, at in enumerate(range(0, t, width)):
                    yield pd.DataFrame({"fold": rows["fold"].to_numpy(), "block": block, "z": list(z), "truth": list(dense[:, at : at + width])})

    def score(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fold, block = key
        _, factor, alphas = shared.value[int(fold)]
        z, own = np.vstack(part["z"].to_numpy()), np.vstack(part["truth"].to_numpy())
        out = []
        for j in range(own.shape[1]):
            ok, pos = np.isfinite(own[:, j]), block * width + j
            preds = factor.of_target(z[ok], pos, alphas)
            out += [(a, fold, pos, rank_correlation(own[ok, j], preds[:, i])) for i, a in enumerate(alphas)]
        return pd.DataFrame(out, columns=["alpha", "fold", "pos", "spearman"])

    cell = F.struct("pos", F.coalesce(F.col("truth").cast("double"), F.lit(float("nan"))).alias("truth"))
    cells = truth.groupBy("row_key").agg(F.collect_list(cell).alias("c")).select("row_key", "c.pos", "c.truth")
    held = samples.select("row_key", "fold", "x").join(cells.hint("merge"), "row_key").select("fold", "x", "pos", "truth")
    blocks = held.mapInPandas(spread, "fold int, block int, z array<double>, truth array<double>")
    out = blocks.groupBy("fold", "block").applyInPandas(score, "alpha double, fold int, pos int, spearman double")
    return out.withColumn("spearman", F.when(~F.isnan("spearman"), F.col("spearman")))


def with_truth(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with the truth of their cells, by a merge: the optimizer takes them for as small as the arrays they are exploded from and would have the driver broadcast them."""
    return preds.join(truth.hint("merge"), ["row_key", "pos"])


@dataclass
class RidgeFit:
    alpha: float
    scores: list[tuple[float, float]]
    at_boundary: bool
    projection: Projection
    coef: np.ndarray
    intercept: np.ndarray


def _projected(train: DataFrame, components: int | None) -> tuple[DataFrame, Projection, Projection, dict[int, Moments]]:
    """The training rows in the space in which they are fitted, the projection to it, the one within it, and moments by fold."""
    size = train.agg(F.count("*").alias("n"), F.count_distinct("row_key").alias("keys"), F.max(F.size("x")).alias("p")).first()
    if not size["n"] or not size["p"] > size["n"] == size["keys"]:
        by_fold = moments(train)
        proj = fit_projection(sum(list(by_fold.values())[1:], start=next(iter(by_fold.values()))), components)
        return train, proj, proj, by_fold
    proj, projected = project_by_samples(train, components)
    # the folds are fitted and scored on projected samples
    k = proj.basis.shape[1]
    inner = Projection(np.zeros(k), np.eye(k), proj.explained, proj.variance)
    rows = [(r.row_key, int(r.fold), r.z.tolist()) for r in projected.itertuples()]
    return train.sparkSession.createDataFrame(rows, "row_key string, fold int, x array<double>"), proj, inner, _projected_moments(projected)


def ridge_by_validation(train: DataFrame, val: DataFrame, truth: DataFrame, components: int | None, alphas: list[float] = config.RIDGE_ALPHAS) -> RidgeFit:
    """As :func:`ridge_cv`, alpha chosen by the mean rank correlation on ``val``; for scores on rows of neither."""
    _, proj, inner, by_fold = _projected(train, components)
    whole = sum(list(by_fold.values())[1:], start=next(iter(by_fold.values())))
    factor = factorise(whole, inner)
    per = alpha_scores(val.withColumn("fold", F.lit(0)), truth, {0: (proj, factor, alphas)}).groupBy("alpha").agg(F.avg("spearman").alias("score"))
    table = best_alpha(per).orderBy("alpha").collect()
    best = next(r for r in table if r["chosen"])
    coef, icept = factor.at(best["alpha"])
    return RidgeFit(best["alpha"], [(r["alpha"], r["score"]) for r in table], best["at_boundary"], proj, coef, icept)


def ridge_cv(train: DataFrame, truth: DataFrame, components: int | None, alphas: list[float] = config.RIDGE_ALPHAS) -> RidgeFit:
    """Scale, project, choose alpha by the folds of ``train`` and fit on all of it.

    ``truth``: ``row_key, pos, truth`` (raw, missing values NULL).  Scaling and
    PCA are fitted on all training rows before the folds, as the fold models
    differ in the ridge only.  A fold's score is the mean per-target rank
    correlation; fewer than two folds give the middle alpha.  With more features
    than samples, samples squared take the place of features squared.
    """
    train, proj, inner, by_fold = _projected(train, components)
    whole = sum(list(by_fold.values())[1:], start=next(iter(by_fold.values())))
    if len(by_fold) < 2:
        alpha, scores = alphas[len(alphas) // 2], []
        edge = False
    else:
        models = {f: (inner, factorise(whole - m, inner), alphas) for f, m in by_fold.items()}
        per = alpha_scores(train, truth, models).groupBy("alpha", "fold").agg(F.avg("spearman").alias("score"))
        table = best_alpha(per).orderBy("alpha").collect()
        scores = [(r["alpha"], r["score"]) for r in table]
        best = next(r for r in table if r["chosen"])
        alpha, edge = best["alpha"], best["at_boundary"]
    coef, icept = fit_ridge(whole, inner, [alpha])[alpha]
    return RidgeFit(alpha, scores, edge, proj, coef, icept)


def fit_mlp(x: np.ndarray, y: np.ndarray, groups: np.ndarray, alpha: float, hidden: int = 256, seed: int = 0, epochs: int = 200, patience: int = 10, batch: int = 64):
    """One hidden ReLU layer, Adam, squared loss with L2; stops early on a tenth of the groups."""
    rng = np.random.default_rng(seed)
    names = np.unique(groups)
    held = np.isin(groups, rng.permutation(names)[: max(1, len(names) // 10)])
    xt, yt, xv, yv = x[~held], y[~held], x[held], y[held]
    if not len(xt):
        xt, yt, xv, yv = x, y, x, y
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, y.shape[1])), yt.mean(axis=0)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    best, kept, waited = np.inf, [p.copy() for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(xt))
        for s in range(0, len(order), batch):
            i = order[s : s + batch]
            h = np.maximum(xt[i] @ w[0] + w[1], 0)
            err = (h @ w[2] + w[3] - yt[i]) / len(i)
            back = (err @ w[2].T) * (h > 0)
            grads = [xt[i].T @ back + alpha * w[0] / len(xt), back.sum(axis=0), h.T @ err + alpha * w[2] / len(xt), err.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 1e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        loss = float((((np.maximum(xv @ w[0] + w[1], 0) @ w[2]) + w[3] - yv) ** 2).mean())
        if loss < best - 1e-6:
            best, kept, waited = loss, [p.copy() for p in w], 0
        else:
            waited += 1
            if waited >= patience:
                break
    return kept


def mlp_predict(w, x: np.ndarray) -> np.ndarray:
    return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


@dataclass
class MlpFit:
    alpha: float
    scores: list[tuple[float, float]]
    at_boundary: bool
    mean: np.ndarray
    sd: np.ndarray
    weights: list[np.ndarray]


def _fit_scaled(fit: pd.DataFrame, alpha: float, hidden: int):
    x = np.vstack(fit["x"].to_numpy())
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    return mean, sd, fit_mlp((x - mean) / sd, np.vstack(fit["y"].to_numpy()), fit["grp"].to_numpy(), alpha, hidden)


def mlp_cv(train: DataFrame, truth: DataFrame, alphas: list[float] = config.MLP_ALPHAS, hidden: int = 256, max_rows: int = 200_000) -> MlpFit:
    """Choose alpha by the folds of ``train`` (``row_key, fold, grp, x, y``) and fit on all of it.

    Every (alpha, fold) is a task of its own, scaled by its own training rows.
    One network is fitted on one worker, so its training set has a bound: more
    than ``max_rows`` rows are refused, none is dropped.
    """
    n = train.count()
    if n > max_rows:
        raise ValueError(f"{n} training rows; a network takes up to {max_rows}")
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(train.select("row_key", "fold", "grp", "x", "y").orderBy("row_key").toPandas())
    folds = sorted(int(f) for f in shared.value["fold"].unique())

    def held_out(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, f = key
        d = shared.value
        out = d[d["fold"] == f]
        mean, sd, w = _fit_scaled(d[d["fold"] != f], a, hidden)
        p = mlp_predict(w, (np.vstack(out["x"].to_numpy()) - mean) / sd)
        return pd.DataFrame({"alpha": a, "fold": f, "row_key": out["row_key"].to_numpy(), "preds": list(p)})

    if len(folds) < 2:
        alpha, scores, edge = alphas[len(alphas) // 2], [], False
    else:
        grid = spark.createDataFrame([(float(a), f) for a in alphas for f in folds], "alpha double, fold int").repartition(len(alphas) * len(folds), "alpha", "fold")
        preds = grid.groupBy("alpha", "fold").applyInPandas(held_out, "alpha double, fold int, row_key string, preds array<double>")
        long = with_truth(preds.select("alpha", "fold", "row_key", F.posexplode("preds").alias("pos", "pred")), truth)
        per = spearman(long, ["alpha", "fold", "pos"]).groupBy("alpha", "fold").agg(F.avg("spearman").alias("score"))
        table = best_alpha(per).orderBy("alpha").collect()
        scores = [(r["alpha"], r["score"]) for r in table]
        best = next(r for r in table if r["chosen"])
        alpha, edge = best["alpha"], best["at_boundary"]

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            mean, sd, w = _fit_scaled(shared.value, alpha, hidden)
            parts = [mean, sd, *w]
            yield pd.DataFrame({"k": range(len(parts)), "shape": [list(np.atleast_1d(x).shape) for x in parts], "v": [np.ravel(x) for x in parts]})

    one = spark.range(1).coalesce(1).mapInPandas(whole, "k int, shape array<int>, v array<double>").orderBy("k").collect()
    parts = [np.array(r["v"]).reshape(r["shape"]) for r in one]
    return MlpFit(alpha, scores, edge, parts[0], parts[1], parts[2:])


def predict_mlp(samples: DataFrame, fit: MlpFit) -> DataFrame:
    """``row_key, pos, pred`` for any number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"row_key": b["row_key"], "preds": list(mlp_predict(fit.weights, (np.vstack(b["x"].to_numpy()) - fit.mean) / fit.sd))})

    out = samples.select("row_key", "x").mapInPandas(run, "row_key string, preds array<double>")
    return out.select("row_key", F.posexplode("preds").alias("pos", "pred"))
