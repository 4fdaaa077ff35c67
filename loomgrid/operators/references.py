"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.lookup import salted_lookup


def parent_intervals(parents: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """One validity interval per key: from its first load to its first withdrawal.

    Rows without a key are left out.  NULL ``until`` means never withdrawn.
    """
    return (
        parents.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("ref_key"))
        .agg(F.min(since).alias("valid_from"), F.min(until).alias("valid_until"))
    )


def orphan_references(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """References without a parent valid at their time, with the kind of fault.

    ``refs``: ``table_name, row_id, ref_key, ref_time`` and anything else, one
    row per reference; a key that is no key of the parent table's form must
    still be a non-null text.  ``kind`` is ``missing`` (no parent row at all),
    ``late`` (the parent's first load came after the reference) or ``deleted``
    (withdrawn at or before it).  References with a NULL key are no references
    and are left out; with a NULL time only ``missing`` can be told.  Repeated
    rows each come out.  An empty parent table makes every reference missing.

    Both streams are hash-partitioned by key (salted, so that a key with a
    third of the references is spread), sorted, and merged in one pass.
    """
    merged = salted_lookup(refs.filter(F.col("ref_key").isNotNull()), intervals.withColumn("_known", F.lit(True)), "ref_key", "row_id")
    kind = (
        F.when(F.col("_known").isNull(), "missing")
        .when(F.col("valid_from") > F.col("ref_time"), "late")
        .when(F.col("valid_until") <= F.col("ref_time"), "deleted")
    )
    return merged.withColumn("kind", kind).filter(F.col("kind").isNotNull()).drop("_known", "valid_from", "valid_until")


def orphan_report(orphans: DataFrame, time: str = "ref_time") -> DataFrame:
    """Orphans per table, month and kind."""
    return (
        orphans.groupBy("table_name", F.date_format(F.date_trunc("month", time), "yyyy-MM").alias("period"), "kind")
        .agg(F.count("*").alias("n_rows"), F.countDistinct("ref_key").alias("n_keys"))
    )
