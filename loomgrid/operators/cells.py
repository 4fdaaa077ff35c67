"""Long matrices: ``row_key, col_key, value`` with NULL for missing, and filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid import config
from loomgrid.functions.ids import finite, loose_bool
from loomgrid.operators.quantiles import exact_quantiles


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; rows with a NULL key are one group.

    An aggregate, not a window: rows of a hot key are combined before the shuffle.
    """
    others = [c for c in rows.columns if c not in keys and c != order]
    packed = rows.groupBy(*keys).agg(F.min(F.struct(F.col(order), F.xxhash64(F.lit(0), *[F.col(c).cast("string") for c in others]).alias("_tie"), *others)).alias("_first"))
    return packed.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [order, *others]]).select(*rows.columns)


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def melt(rows: DataFrame, key: str, columns: list[str], value=None) -> DataFrame:
    """Wide to long in one pass: ``row_key, col_key, col_pos, value``; ``value(name)`` gives the number, by default the finite one."""
    value = value or (lambda c: finite(F.col(f"`{c}`")))
    cells = [F.struct(F.lit(c).alias("col_key"), F.lit(i).alias("col_pos"), value(c).alias("value")) for i, c in enumerate(columns)]
    return rows.select(F.col(key).alias("row_key"), F.explode(F.array(*cells)).alias("c")).select("row_key", "c.*")


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col_key").alias("row_key"), F.col("row_key").alias("col_key"), "value")


def orientation(labels: DataFrame, axis: str, label: str, order: str, prefix: str = config.MODEL_PREFIX, look: int = 50) -> DataFrame:
    """``axis, n_looked, n_prefixed, is_key``: an axis is the key axis if half of its first 50 labels have the prefix."""
    first = labels.withColumn("_r", F.row_number().over(W.partitionBy(axis).orderBy(order))).filter(F.col("_r") <= look)
    out = first.groupBy(axis).agg(F.count("*").alias("n_looked"), F.count_if(F.col(label).startswith(prefix)).alias("n_prefixed"))
    return out.withColumn("is_key", F.col("n_prefixed") >= F.greatest(F.lit(1), F.floor(F.col("n_looked") / 2)))


def flagged(rows: DataFrame, flag: str) -> DataFrame:
    """Rows whose loose boolean is true; all rows if there is no such column."""
    return rows.filter(loose_bool(F.col(flag))) if flag in rows.columns else rows


def keep_list(rows: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that are there, and the names of those that are not."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[have[w.lower()] for w in wanted if w.lower() in have]), [w for w in wanted if w.lower() not in have]


def non_numeric_columns(cells: DataFrame, raw: str = "raw") -> DataFrame:
    """``col_key, n_bad``: columns with a present text that is no number; long form keeps the test per cell."""
    text = F.trim(raw)
    bad = F.col(raw).isNotNull() & ~text.isin(config.NA_TOKENS) & text.try_cast("double").isNull()
    return cells.groupBy("col_key").agg(F.count_if(bad).alias("n_bad")).filter("n_bad > 0")


def all_zero_columns(cells: DataFrame) -> DataFrame:
    """Columns without any value other than zero; missing counts as zero."""
    return cells.groupBy("col_key").agg(F.max(F.coalesce(F.col("value") != 0, F.lit(False))).alias("_any")).filter(~F.col("_any")).select("col_key")


def low_variance_columns(cells: DataFrame, least: float) -> DataFrame:
    return cells.groupBy("col_key").agg(F.stddev_samp("value").cast("float").alias("sd")).filter(F.col("sd") < F.lit(least).cast("float")).select("col_key", F.col("sd").cast("double").alias("sd"))


def target_statistics(cells: DataFrame, n_rows: int | Column) -> DataFrame:
    """Per column the figures by which targets are selected; ``n_rows`` counts all rows, absent cells are missing."""
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    v = F.col("value")
    hit = v < config.DEPENDENCY_THRESHOLD
    return cells.groupBy("col_key").agg(
        (1 - F.count("value") / n).alias("missing_share"), F.count_if(hit).alias("n_dependent"),
        (F.count_if(hit) / F.greatest(n, F.lit(1))).alias("dependent_share"), F.stddev_samp("value").cast("float").alias("sd"),
    )


def exclusions() -> dict[str, Column]:
    """Why a target is not selective; the reasons overlap."""
    return {
        "too_many_missing": ~(F.col("missing_share") <= config.MAX_MISSING_SHARE),
        "never_dependent": ~(F.col("n_dependent") >= config.MIN_DEPENDENT_LINES),
        "always_dependent": ~(F.col("dependent_share") <= config.MAX_DEPENDENT_SHARE),
        "low_variance": ~F.coalesce(F.col("sd") >= F.lit(config.MIN_EFFECT_SD).cast("float"), F.lit(False)),
    }


def selective(statistics: DataFrame) -> DataFrame:
    out = F.lit(False)
    for test in exclusions().values():
        out = out | test
    return statistics.filter(~out)


def exclusion_report(statistics: DataFrame) -> DataFrame:
    """One row: targets considered, excluded for each reason, kept."""
    tests = exclusions()
    any_test = F.lit(False)
    for t in tests.values():
        any_test = any_test | t
    return statistics.agg(F.count("*").alias("considered"), *[F.count_if(t).alias(f"excluded_{k}") for k, t in tests.items()], F.count_if(~any_test).alias("kept"))


def keyword_mask(keyword: str, *columns: Column) -> Column:
    """True if any of the texts contains the keyword, whatever the case; NULL contains nothing."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False))
    return out


def clip_low(value: Column, low: float = 0.0) -> Column:
    """NULL stays NULL, which ``greatest`` would not keep."""
    return F.when(value < low, F.lit(low)).otherwise(value)


def matrix_statistics(cells: DataFrame) -> DataFrame:
    """One row over all cells: range, median, spread (population), missing share, infinities."""
    v = F.col("value").cast("double")
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    figures = cells.agg(
        F.min(ok).alias("min_value"), F.max(ok).alias("max_value"), F.stddev_pop(ok).alias("sd"),
        F.avg((v.isNull() | F.isnan(v)).cast("int")).alias("missing_share"), F.count_if(F.abs(v) == float("inf")).alias("n_infinite"),
    )
    return figures.join(overall_median(cells.select(ok.alias("value")), "value"), F.lit(True), "left").select("min_value", "max_value", "median", "sd", "missing_share", "n_infinite")


def overall_median(rows: DataFrame, value: str) -> DataFrame:
    """``median``, one row, none if there is no value: by counts of values and buckets, so that no task holds them all."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.lit(0).alias("_all"), F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    return exact_quantiles(counts, ["_all"], "_v", "_k", {"median": 0.5}).select("median")


def empty_rows(cells: DataFrame) -> DataFrame:
    """Rows without any value."""
    return cells.groupBy("row_key").agg(F.count("value").alias("n")).filter("n = 0").select("row_key")


def row_sums(cells: DataFrame) -> DataFrame:
    """``row_key, total``; one missing value makes the sum missing."""
    return cells.groupBy("row_key").agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias("total"))
