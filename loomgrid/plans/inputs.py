"""The driver's tables as the engine's inputs: long cells, metadata, frozen splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.ids import donor_id, model_id, plain_number, usable_text
from loomgrid.functions.labels import entrez_of
from loomgrid.operators.cells import flagged, keep_first, melt
from loomgrid.plans.general_queries import gene_columns
from loomgrid.sources.tables import table


def effect_cells(spark: SparkSession, d: str) -> DataFrame:
    """First effect of each model and gene; impossible effects are missing."""
    t = table(spark, d, "crispr_gene_effect")
    rows = t.select("row_id", model_id(F.col("modelid")).alias("row_key"), entrez_of(F.col("gene")).alias("col_key"), F.when(F.col("effect").between(-10, 10), F.col("effect").cast("double")).alias("value"))
    return keep_first(rows.filter("row_key is not null and col_key is not null"), ["row_key", "col_key"], "row_id").select("row_key", "col_key", "value")


def default_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The first default profile of each model."""
    t = flagged(table(spark, d, "expression_profile"), "isdefaultentryformodel").withColumn("model_key", model_id(F.col("modelid")))
    genes = gene_columns(t.drop("model_key"))
    return keep_first(t.filter("model_key is not null").select("row_id", "model_key", *genes), ["model_key"], "row_id")


def expression_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the default profiles by entrez; values outside 0..20 and texts that are no numbers are missing."""
    rows = default_profiles(spark, d)
    kinds = dict(rows.dtypes)
    genes = [c for c in rows.columns if c.rpartition("_")[2].isdigit()]

    def value(c: str) -> Column:
        number = plain_number(F.col(c)) if kinds[c] == "string" else F.col(c).cast("double")
        return F.when(number.between(0, 20), number)

    cells = melt(rows, "model_key", genes, value)
    return cells.select("row_key", F.element_at(F.split("col_key", "_"), -1).alias("col_key"), "value")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each model."""
    t = table(spark, d, "depmap_model")
    rows = t.select(
        "row_id", model_id(F.col("modelid")).alias("model_id"), donor_id(F.col("patientid")).alias("patient_id"), F.initcap(usable_text(F.col("oncotreelineage"))).alias("lineage"),
        F.col("oncotreeprimarydisease").alias("disease"), F.col("oncotreesubtype").alias("subtype"),
    )
    return keep_first(rows.filter("model_id is not null"), ["model_id"], "row_id").drop("row_id")


def splits(spark: SparkSession, d: str) -> DataFrame:
    """The first valid split of each model."""
    name = F.lower(F.regexp_replace("split", r"\s", ""))
    rows = table(spark, d, "split_assignment").select("row_id", model_id(F.col("modelid")).alias("model_id"), name.alias("split"))
    return keep_first(rows.filter("model_id is not null").filter(F.col("split").isin("train", "val", "test")), ["model_id"], "row_id").select("model_id", "split")


def split_cells(spark: SparkSession, d: str) -> DataFrame:
    """Effect cells with split and lineage; a model of no split is left out, one without a lineage is ``Unknown``."""
    part = splits(spark, d).join(metadata(spark, d).select("model_id", "lineage"), "model_id", "left").select(F.col("model_id").alias("row_key"), "split", F.coalesce("lineage", F.lit("Unknown")).alias("lineage"))
    return effect_cells(spark, d).join(part, "row_key")


def effect_labels(spark: SparkSession, d: str) -> DataFrame:
    """``label, pos`` of the effect matrix, in the order of first appearance."""
    return table(spark, d, "crispr_gene_effect").filter("gene is not null").groupBy(F.col("gene").alias("label")).agg(F.min("row_id").alias("pos"))


def expression_labels(spark: SparkSession, d: str) -> DataFrame:
    """``label, pos`` of the expression matrix from its column names."""
    genes = gene_columns(table(spark, d, "expression_profile"))
    labels = [(f"{c.rpartition('_')[0].upper()} ({c.rpartition('_')[2]})" if c.rpartition("_")[2].isdigit() else c, i) for i, c in enumerate(genes)]
    return spark.createDataFrame(labels, "label string, pos long")
