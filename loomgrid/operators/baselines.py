"""Mean predictors and imputation, fitted on the training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid import config


def with_split(cells: DataFrame, splits: DataFrame, key: str = "row_key") -> DataFrame:
    """Cells with the split of their row; rows of no split are left out."""
    return cells.join(splits.select(F.col("model_id").alias(key), "split"), key)


def target_means(cells: DataFrame) -> DataFrame:
    """``col_key, global_mean`` over training cells; 0 where nothing is there."""
    return cells.filter("split = 'train'").groupBy("col_key").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("global_mean"))


def lineage_means(cells: DataFrame) -> DataFrame:
    """``lineage, col_key, lineage_mean`` over training cells; needs ``lineage``."""
    return cells.filter("split = 'train'").groupBy("lineage", "col_key").agg(F.avg("value").alias("lineage_mean"))


def predict_means(cells: DataFrame, evaluated: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """``row_key, target, truth, global_pred, lineage_pred`` for evaluated cells.

    ``cells``: ``row_key, col_key, value, split, lineage``.  A lineage unseen in
    training, or without a value for the target, falls back to the global mean.
    The means are one row per target and lineage, so they are joined, not carried.
    """
    held = cells.filter(F.col("split").isin(*evaluated))
    out = held.join(target_means(cells), "col_key", "left").join(lineage_means(cells), ["lineage", "col_key"], "left")
    fallback = F.coalesce("global_mean", F.lit(0.0))
    return out.select("row_key", F.col("col_key").alias("target"), F.col("value").alias("truth"), fallback.alias("global_pred"), F.coalesce("lineage_mean", fallback).alias("lineage_pred"))


def impute_train_mean(cells: DataFrame) -> DataFrame:
    """Adds ``imputed``: a value that is missing or not finite becomes the training mean of its column, 0 without one."""
    v = F.col("value").cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    train = cells.filter("split = 'train'").groupBy("col_key").agg(F.avg(F.when(ok, v)).alias("_mean"))
    return cells.join(train, "col_key", "left").withColumn("imputed", F.when(ok, v).otherwise(F.coalesce("_mean", F.lit(0.0)))).drop("_mean")


def standardize(cells: DataFrame) -> DataFrame:
    """Adds ``scaled`` by the training mean and population spread; a constant column has scale 1."""
    train = cells.filter("split = 'train'").groupBy("col_key").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    scale = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return cells.join(train, "col_key", "left").withColumn("scaled", (F.col("value") - F.coalesce("_mean", F.lit(0.0))) / scale).drop("_mean", "_sd")


def task_available(n_train: int, n_eval: int) -> bool:
    return n_train >= config.MIN_TRAIN_ROWS and n_eval >= config.MIN_EVAL_ROWS
