"""Per-target scores of predictions in long form: ``target, truth, pred`` (and further keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid import config


def _usable() -> Column:
    out = F.lit(True)
    for c in ("truth", "pred"):
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(out, F.lit(False))


def average_rank(value: str, keys: list[str]) -> Column:
    ties = W.partitionBy(*keys, value)
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0


def spearman(scored: DataFrame, keys: list[str], least: int = config.MIN_PAIRS) -> DataFrame:
    """``keys, n, spearman`` for every group: NULL with fewer than ``least`` pairs or a side without variation.

    Only pairs of finite numbers count, the others keep their group in the
    result.  Ties get average ranks.  All windows share one shuffle by group.
    """
    flagged = scored.select(*keys, F.col("truth").cast("double").alias("truth"), F.col("pred").cast("double").alias("pred")).withColumn("_ok", _usable())
    ranked = flagged.withColumn("_a", average_rank("truth", [*keys, "_ok"])).withColumn("_b", average_rank("pred", [*keys, "_ok"]))
    ok = F.col("_ok")
    a, b, t, p = (F.when(ok, F.col(c)) for c in ("_a", "_b", "truth", "pred"))
    sums = ranked.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), (F.min(t) < F.max(t)).alias("_va"), (F.min(p) < F.max(p)).alias("_vb"),
        F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"), F.sum(a).alias("_sa"), F.sum(b).alias("_sb"),
    )
    n = F.col("n")
    xy, xx, yy = F.col("_ab") - F.col("_sa") * F.col("_sb") / n, F.col("_aa") - F.col("_sa") * F.col("_sa") / n, F.col("_bb") - F.col("_sb") * F.col("_sb") / n
    rho = F.when((n >= least) & F.col("_va") & F.col("_vb"), xy / F.sqrt(xx * yy))
    return sums.select(*keys, "n", rho.alias("spearman"))


def r_squared(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, r2`` against the mean of the evaluated truth; NULL with fewer than 2 pairs or a constant truth."""
    flagged = scored.select(*keys, F.col("truth").cast("double").alias("truth"), F.col("pred").cast("double").alias("pred")).withColumn("_ok", _usable())
    pairs = flagged.withColumn("_m", F.avg("truth").over(W.partitionBy(*keys, "_ok")))
    ok = F.col("_ok")
    t, p, m = (F.when(ok, F.col(c)) for c in ("truth", "pred", "_m"))
    sums = pairs.groupBy(*keys).agg(F.count_if(ok).alias("n"), F.sum((t - p) * (t - p)).alias("_res"), F.sum((t - m) * (t - m)).alias("_tot"), (F.min(t) < F.max(t)).alias("_v"))
    r2 = F.when((F.col("n") >= 2) & F.col("_v") & (F.col("_tot") > 0), 1 - F.col("_res") / F.col("_tot"))
    return sums.select(*keys, "n", r2.alias("r2"))


def summary(scores: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Mean, median, quartiles, share above zero, targets scored and undefined; rounded to 4, NULL if none is scored."""
    v = F.col(value)
    return scores.groupBy(*keys).agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.round(F.percentile(v, 0.25), 4).alias("q25"),
        F.round(F.percentile(v, 0.75), 4).alias("q75"), F.round(F.avg((v > 0).cast("int")), 4).alias("frac_positive"),
        F.count(v).alias("n_scored"), F.count_if(v.isNull()).alias("n_undefined"),
    )


def best_alpha(scores: DataFrame) -> DataFrame:
    """``alpha, score, chosen, at_boundary``: mean score per alpha, the best and, of equals, the smallest chosen."""
    per = scores.groupBy("alpha").agg(F.avg("score").alias("score"))
    w = W.orderBy(F.desc_nulls_last("score"), "alpha")  # one row per alpha
    edges = W.partitionBy()
    out = per.withColumn("chosen", F.row_number().over(w) == 1)
    return out.withColumn("at_boundary", F.col("chosen") & ((F.col("alpha") == F.min("alpha").over(edges)) | (F.col("alpha") == F.max("alpha").over(edges))))
