"""Pseudo-counts, target-id matrices and their row and column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.cells import clip_low, row_sums
from loomgrid.operators.gene_space import lookup_chain, parse_labels
from loomgrid.operators.lookup import grid


def pseudo_counts(cells: DataFrame) -> DataFrame:
    """``2**value - 1``, at least 0; missing stays missing."""
    return cells.withColumn("value", clip_low(F.pow(F.lit(2.0), F.col("value")) - 1))


def aligned_counts(counts: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts for all wanted rows and columns: a missing column is 0, a missing row missing."""
    have = counts.select("row_key").distinct().withColumn("_there", F.lit(True))
    every = grid(rows.select("row_key").distinct(), columns.select("col_key").distinct())
    out = every.join(counts.select("row_key", "col_key", F.col("value").alias("_v"), F.lit(True).alias("_cell")), ["row_key", "col_key"], "left").join(have, "row_key", "left")
    return out.select("row_key", "col_key", F.when(F.col("_cell"), F.col("_v")).when(F.col("_there"), F.lit(0.0)).alias("value"))


def to_targets(cells: DataFrame, labels: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells by target id, and a one-row report: mapped labels, unmapped ones, and those dropped as a target's later label."""
    chain = lookup_chain(labels, mapping)
    out = cells.join(chain.select(F.col("label").alias("col_key"), "target"), "col_key").select("row_key", "target", "value")
    known = parse_labels(labels).join(mapping.select("entrez").distinct().withColumn("_known", F.lit(True)), "entrez", "left")
    report = known.agg(F.count_if(F.col("_known").isNull()).alias("n_unmapped"), F.count_if(F.col("_known")).alias("n_mapped"))
    kept = chain.agg(F.count("*").alias("n_targets"))
    return out, report.select("n_unmapped", "n_mapped", F.lit(kept.first()["n_targets"]).alias("n_targets"))


def coordinates(cells: DataFrame) -> DataFrame:
    """Sparse form: cells other than zero; missing values are kept as they are not zero."""
    return cells.filter(F.col("value").isNull() | (F.col("value") != 0))


def row_table(cells: DataFrame, metadata: DataFrame, splits: DataFrame) -> DataFrame:
    """``row_key, n_counts, lineage, disease, subtype, split``; what is not known stays NULL."""
    meta = metadata.select(F.col("model_id").alias("row_key"), "lineage", "disease", "subtype")
    part = splits.select(F.col("model_id").alias("row_key"), "split")
    return row_sums(cells).withColumnRenamed("total", "n_counts").join(meta, "row_key", "left").join(part, "row_key", "left")
