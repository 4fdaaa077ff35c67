"""Filling missing values from similar records.

A mixture over numeric (Gaussian) and categorical fields is fitted by
expectation-maximisation to the groups of records.  Every density in it is of
the exponential family, so a group enters by its sufficient statistics alone:
its records, the count of each level, and count, sum and sum of squares of each
number.  With these as one sparse matrix of groups by statistics, an
expectation step multiplies it by the parameters and a maximisation step
multiplies its transpose by the responsibilities.  Both are a join and an
aggregate; no table of levels or groups has to fit anywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgrid.operators.lookup import salted_lookup
from loomgrid.sources.staging import release, stage

WEIGHT = "w"
SMOOTHING = 0.1  # of a record, added to every level


@dataclass
class Mixture:
    """``theta``: ``stat, level, t0..``, what a unit of each statistic adds to the log density of each component;
    ``responsibility``: ``_group, r0..``; the rest is of a size that depends on fields and components only."""

    components: int
    mean: dict[str, list[float]]
    sd: dict[str, list[float]]
    modes: dict[str, list[str]]
    theta: DataFrame
    responsibility: DataFrame
    log_likelihood: list[float]


def group_statistics(rows: DataFrame, group: str, categorical: list[str], numeric: list[str]) -> DataFrame:
    """``_group, stat, level, amount``: the sufficient statistics of each group; NULL values add nothing.

    ``stat`` is ``w`` (1), ``c:field`` (records of a level), ``m:field``,
    ``s:field``, ``q:field`` (count, sum, sum of squares).  Equal rows of a
    group are combined before the shuffle, so a hot group costs no more than its
    distinct categories.
    """
    numbers = []
    for f in numeric:
        x = F.col(f).cast("double")
        numbers += [F.count(x).cast("double").alias(f"_m_{f}"), F.sum(x).alias(f"_s_{f}"), F.sum(x * x).alias(f"_q_{f}")]
    patterns = rows.groupBy(F.col(group).alias("_group"), *categorical).agg(F.count("*").cast("double").alias("_n"), *numbers)
    entry = lambda stat, level, amount: F.struct(F.lit(stat).alias("stat"), level.cast("string").alias("level"), amount.alias("amount"))
    none = F.lit("")
    entries = [entry(WEIGHT, none, F.col("_n"))]
    entries += [F.when(F.col(f).isNotNull(), entry(f"c:{f}", F.col(f), F.col("_n"))) for f in categorical]
    entries += [F.when(F.col(f"_m_{f}") > 0, entry(f"{k}:{f}", none, F.col(f"_{k}_{f}"))) for f in numeric for k in "msq"]
    long = patterns.select("_group", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("_group", "e.*")
    # a group has one component, so its weight counts once
    return long.groupBy("_group", "stat", "level").agg(F.when(F.col("stat") == WEIGHT, 1.0).otherwise(F.sum("amount")).alias("amount"))


def _first_guess(stats: DataFrame, numeric: list[str], spread: dict[str, tuple[float, float]], k: int) -> DataFrame:
    """Responsibilities to start from: groups by the place of their mean of the first number, else all alike."""
    if numeric:
        f = numeric[0]
        mean, sd = spread[f]
        m, s = (F.sum(F.when(F.col("stat") == f"{x}:{f}", F.col("amount"))) for x in "ms")
        own = stats.groupBy("_group").agg((s / m).alias("_x"))
        place = 1 / (1 + F.exp(-1.702 * (F.col("_x") - mean) / (sd or 1.0)))
        own = own.withColumn("_b", F.least(F.lit(k - 1), F.floor(place * k)))
    else:
        own = stats.select("_group").distinct().withColumn("_b", F.pmod(F.xxhash64("_group"), F.lit(k)))
    rest = 0.3 / max(k - 1, 1)
    share = lambda i: F.when(F.col("_b").isNull(), 1.0 / k).when(F.col("_b") == i, 0.7 if k > 1 else 1.0).otherwise(rest)
    return own.select("_group", *[share(i).alias(f"r{i}") for i in range(k)], F.lit(0.0).alias("lse"))


# each iteration builds its plan anew, so its expressions are texts: a call to the JVM each instead of dozens


def _text(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _double(x: float) -> str:
    return f"{x!r}D"


def _expect(stats: DataFrame, theta: DataFrame, k: int) -> DataFrame:
    """``_group, r0.., lse``: responsibilities and the log density of each group."""
    sums = stats.join(theta, ["stat", "level"]).groupBy("_group").agg(*[F.expr(f"sum(amount * t{i}) AS l{i}") for i in range(k)])
    top = f"greatest({', '.join(f'l{i}' for i in range(k))})" if k > 1 else "l0"
    sums = sums.selectExpr("*", f"{top} AS _top")
    sums = sums.selectExpr("*", f"_top + ln({' + '.join(f'exp(l{i} - _top)' for i in range(k))}) AS lse")
    return sums.selectExpr("_group", *[f"exp(l{i} - lse) AS r{i}" for i in range(k)], "lse")


def _maximise(stats: DataFrame, responsibility: DataFrame, k: int) -> DataFrame:
    """``stat, level, s0.., lse``: statistics of each component."""
    sums = [F.expr(f"sum(amount * r{i}) AS s{i}") for i in range(k)]
    return stats.join(responsibility, "_group").groupBy("stat", "level").agg(*sums, F.expr(f"sum(CASE WHEN stat = '{WEIGHT}' THEN lse END) AS lse"))


def fit_mixture(stats: DataFrame, categorical: list[str], numeric: list[str], components: int = 6, iterations: int = 30, tolerance: float = 1e-3) -> Mixture:
    """Fit to staged :func:`group_statistics`; the records of a group share their component.

    Ends when an iteration raises the log likelihood by less than ``tolerance``
    of its size, or after ``iterations``.  Levels are smoothed by a tenth of a
    record, spreads are at least a thousandth of the field's.
    """
    k = components
    # both steps group by group: they share one exchange an iteration
    stats = stats.repartition("_group")
    rows = {r["stat"]: r["a"] for r in stats.groupBy("stat").agg(F.sum("amount").alias("a")).collect()}  # a row per field and statistic
    spread = {}
    for f in numeric:
        m = rows.get(f"m:{f}") or 0.0
        mean = rows[f"s:{f}"] / m if m else 0.0
        spread[f] = (mean, math.sqrt(max(rows[f"q:{f}"] / m - mean * mean, 0.0)) if m else 0.0)
    responsibility = _first_guess(stats, numeric, spread, k)
    theta, mean, sd, history = None, {}, {}, []
    for turn in range(iterations):
        sums, totals = _totalled(_maximise(stats, responsibility, k), list(rows), k)
        if theta is not None:
            release(theta_source)
        theta_source = sums
        theta, mean, sd = _parameters(sums, totals, categorical, numeric, spread, k)
        if turn:
            history.append(totals[WEIGHT]["lse"])
            if len(history) > 1 and history[-1] - history[-2] <= tolerance * abs(history[-2]):
                break
        if not totals:
            break
        responsibility = _expect(stats, theta, k)
    responsibility = stage(_expect(stats, theta, k), "responsibility")
    best = [F.min_by("level", F.struct(-F.col(f"t{i}"), "level")).alias(f"b{i}") for i in range(k)]
    modes = {r["stat"][2:]: [r[f"b{i}"] for i in range(k)] for r in theta.filter(F.col("stat").startswith("c:")).groupBy("stat").agg(*best).collect()}
    return Mixture(k, mean, sd, modes, theta, responsibility, history)


def _totalled(sums: DataFrame, names: list[str], k: int) -> tuple[DataFrame, dict[str, dict]]:
    """``sums`` as a staged table, and their totals by statistic, observed while it is written."""
    if not names:
        return stage(sums, "mixture"), {}
    seen, figures = Observation(), []
    for n, stat in enumerate(names):
        own = f"stat = {_text(stat)}"
        figures += [F.expr(f"sum(CASE WHEN {own} THEN {c} END) AS {c}_{n}") for c in [*[f"s{i}" for i in range(k)], "lse"]]
        figures.append(F.expr(f"count_if({own}) AS n_{n}"))
    staged = stage(sums.observe(seen, *figures), "mixture")
    got = seen.get
    return staged, {stat: {c: got[f"{c}_{n}"] for c in [*[f"s{i}" for i in range(k)], "lse", "n"]} for n, stat in enumerate(names)}


def _parameters(sums: DataFrame, totals: dict, categorical: list[str], numeric: list[str], spread: dict, k: int):
    """The natural parameters of each statistic and component, with means and spreads of the numbers."""
    fixed: dict[str, list[float]] = {}
    mean, sd = {}, {}
    if WEIGHT in totals:
        w = [totals[WEIGHT][f"s{i}"] + 1e-9 for i in range(k)]
        fixed[WEIGHT] = [math.log(x / sum(w)) for x in w]
    for f in numeric:
        if f"m:{f}" not in totals:
            mean[f], sd[f] = [], []
            continue
        centre, width = spread[f]
        floor = max(1e-3 * width, 1e-9)
        mean[f], sd[f] = [], []
        for i in range(k):
            m, s, q = (totals[f"{x}:{f}"][f"s{i}"] for x in "msq")
            used = m > 1e-6
            mu = s / m if used else centre
            mean[f].append(mu)
            sd[f].append(max(math.sqrt(max(q / m - mu * mu, 0.0)) if used else width, floor))
        fixed[f"m:{f}"] = [-math.log(d) - mu * mu / (2 * d * d) for mu, d in zip(mean[f], sd[f])]
        fixed[f"s:{f}"] = [mu / (d * d) for mu, d in zip(mean[f], sd[f])]
        fixed[f"q:{f}"] = [-1 / (2 * d * d) for d in sd[f]]
    columns = []
    for i in range(k):
        cases = [f"WHEN stat = {_text(stat)} THEN {_double(values[i])}" for stat, values in fixed.items()]
        for f in categorical:
            if (r := totals.get(f"c:{f}")) is not None:
                whole = _double(r[f"s{i}"] + SMOOTHING * r["n"])
                cases.append(f"WHEN stat = {_text(f'c:{f}')} THEN ln((s{i} + {_double(SMOOTHING)}) / {whole})")
        columns.append(f"CASE {' '.join(cases)} ELSE 0D END AS t{i}" if cases else f"0D AS t{i}")
    return sums.selectExpr("stat", "level", *columns), mean, sd


@dataclass(frozen=True)
class Field:
    """A field to be filled: ``clean`` is its usable value as an expression, NULL where it is missing."""

    name: str
    clean: Column
    numeric: bool = False


def fill_missing(rows: DataFrame, row_id: str, fields: list[Field], group: Column, context: list[Field] = (), components: int = 6, iterations: int = 30, tolerance: float = 1e-3) -> DataFrame:
    """``rows`` with each field's value filled as ``<name>_filled`` and marked by ``<name>_was_missing``.

    Values present are kept (as ``clean`` gives them).  A missing number becomes
    the mixture's conditional expectation for the group, to which the group's own
    records are added by the ratio of variances within and between groups.  A
    missing category becomes the mode of the group's counts plus the mixture's
    probabilities, so that the mixture decides ties; where the group has no
    value it is the mode of the group's most probable component.  A row with a
    NULL group is a group of its own.  Where no row has any value the fill stays
    NULL: the value is marked as missing, but it has not been filled.
    ``row_id`` must tell rows apart; equal rows with different ids each stay.
    ``context`` fields help the mixture and are not filled.  A column that has the
    name of one that is made here is a ValueError.
    """
    every = [*fields, *context]
    cat = [f.name for f in every if not f.numeric]
    num = [f.name for f in every if f.numeric]
    clean = {f.name: f.clean for f in every}
    taken = {c.lower() for c in rows.columns}
    made = ["_group", "_salt", *[c for f in fields for c in (f"{f.name}_filled", f"{f.name}_was_missing", f"_f_{f.name}")]]
    clash = [c for c in made if c.lower() in taken]
    if clash:
        raise ValueError(f"columns already exist: {clash}")
    key = F.coalesce(group.cast("string"), F.concat(F.lit("\x00"), F.col(row_id).cast("string")))
    stats = stage(group_statistics(rows.select(*[clean[n].alias(n) for n in clean], key.alias("_group")), "_group", cat, num), "statistics")
    model = fit_mixture(stats, cat, num, components, iterations, tolerance)

    lacking = F.lit(False)
    for f in fields:
        lacking = lacking | f.clean.isNull()
    complete = rows.filter(~lacking)
    for f in fields:
        complete = complete.withColumn(f"{f.name}_filled", f.clean.cast("double") if f.numeric else f.clean).withColumn(f"{f.name}_was_missing", F.lit(False))

    holes = rows.filter(lacking)
    fills = group_fills(stats, model, fields)
    keyed = salted_lookup(holes.withColumn("_group", key), fills, "_group", row_id)
    for f in fields:
        present = f.clean.cast("double") if f.numeric else f.clean
        keyed = keyed.withColumn(f"{f.name}_filled", F.coalesce(present, F.col(f"_f_{f.name}"))).withColumn(f"{f.name}_was_missing", f.clean.isNull())
    return complete.unionByName(keyed.select(*complete.columns))


def group_fills(stats: DataFrame, model: Mixture, fields: list[Field]) -> DataFrame:
    """``_group, _f_<name>``: what a record of the group gets for each field that it lacks."""
    k = model.components
    out = model.responsibility
    likeliest = F.array_position(F.array(*[F.col(f"r{i}") for i in range(k)]), F.greatest(*[F.col(f"r{i}") for i in range(k)]) if k > 1 else F.col("r0"))
    sums = []
    for f in fields:
        if f.numeric:
            sums += [F.sum(F.when(F.col("stat") == f"{x}:{f.name}", F.col("amount"))).alias(f"_{x}_{f.name}") for x in "msq"]
    shrink: dict[str, float] = {}
    if sums:
        numbers = stats.groupBy("_group").agg(*sums)
        shrink = _shrinkage(numbers, [f.name for f in fields if f.numeric])
        out = out.join(numbers, "_group", "left")
    names = [f.name for f in fields if not f.numeric]
    if names:
        votes = stats.filter(F.col("stat").isin([f"c:{n}" for n in names])).join(model.theta, ["stat", "level"]).join(model.responsibility, "_group")
        score = F.col("amount") + sum((F.col(f"r{i}") * F.exp(F.col(f"t{i}")) for i in range(k)), F.lit(0.0))
        order = F.struct((-score).alias("score"), F.col("level").alias("name"))
        modes = votes.groupBy("_group").agg(*[F.min_by("level", F.when(F.col("stat") == f"c:{n}", order)).alias(f"_v_{n}") for n in names])
        out = out.join(modes, "_group", "left")
    cols = []
    for f in fields:
        if f.numeric:
            if not model.mean.get(f.name):
                cols.append(F.lit(None).cast("double").alias(f"_f_{f.name}"))
                continue
            expected = sum((F.col(f"r{i}") * F.lit(mu) for i, mu in enumerate(model.mean[f.name])), F.lit(0.0))
            s, m, w = F.coalesce(F.col(f"_s_{f.name}"), F.lit(0.0)), F.coalesce(F.col(f"_m_{f.name}"), F.lit(0.0)), F.lit(shrink[f.name])
            cols.append(((s + w * expected) / (m + w)).alias(f"_f_{f.name}"))
        elif f.name in model.modes:
            cols.append(F.coalesce(F.col(f"_v_{f.name}"), F.element_at(F.array(*map(F.lit, model.modes[f.name])), likeliest.cast("int"))).alias(f"_f_{f.name}"))
        else:
            cols.append(F.lit(None).cast("string").alias(f"_f_{f.name}"))
    return out.select("_group", *cols)


def _shrinkage(numbers: DataFrame, numeric: list[str]) -> dict[str, float]:
    """Per number the variance within groups over that between them: the weight of the mixture in observations."""
    aggs = []
    for f in numeric:
        s, m, q = F.col(f"_s_{f}"), F.col(f"_m_{f}"), F.col(f"_q_{f}")
        aggs += [
            F.sum(F.when(m >= 2, q - s * s / m)).alias(f"w_{f}"), F.sum(F.when(m >= 2, m - 1)).alias(f"d_{f}"),
            F.var_pop(F.when(m >= 1, s / m)).alias(f"b_{f}"),
        ]
    r = numbers.agg(*aggs).first()
    out = {}
    for f in numeric:
        within = (r[f"w_{f}"] or 0.0) / max(r[f"d_{f}"] or 1, 1)
        between = r[f"b_{f}"] or 0.0
        out[f] = float(min(max(within / between if between > 0 else 1.0, 1e-6), 1e3))
    return out


def filled_cells(filled: DataFrame, table_name: str, row_id: str, names: list[str]) -> DataFrame:
    """``table_name, row_id, field_name`` of every value that was filled; one that stayed NULL was not."""
    marks = F.array_compact(F.array(*[F.when(F.col(f"{n}_was_missing") & F.col(f"{n}_filled").isNotNull(), F.lit(n)) for n in names]))
    some = F.lit(False)
    for n in names:
        some = some | F.col(f"{n}_was_missing")
    return filled.filter(some).select(F.lit(table_name).alias("table_name"), F.col(row_id).alias("row_id"), F.explode(marks).alias("field_name"))
