"""Joins against one-row-per-key tables that stay even under hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(rows: DataFrame, columns: DataFrame, salts: int = 32) -> DataFrame:
    """Every row with every column: the cells of a dense result.

    The rows are spread over ``salts`` keys by their hash and the columns, which
    are the features of a matrix, repeated for each, so that no task gets all
    and either side may be the larger.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    right = columns.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, "_salt").drop("_salt")


def salted_lookup(rows: DataFrame, keyed: DataFrame, key: str, spread: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Sort-merge join of ``rows`` with ``keyed`` (unique in ``key``).

    A key that holds a third of all rows is spread over ``salts`` partitions by
    the hash of ``spread``; ``keyed`` is repeated that often, so its size, not
    that of ``rows``, pays for it.  Both sides are co-partitioned, sorted and
    read once in step.  Keys must not be NULL in ``rows`` for an even spread.
    """
    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", salt)
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
