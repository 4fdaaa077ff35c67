"""Reconciling feature identifiers across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.labels import canonical_label, entrez_of, symbol_of
from loomgrid.operators.lookup import grid


def parse_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``symbol`` and ``entrez``; both NULL where the label has another form."""
    return labels.withColumn("symbol", symbol_of(F.col(label))).withColumn("entrez", entrez_of(F.col(label)))


def _firsts(labels: DataFrame) -> DataFrame:
    """``entrez, symbol, label`` of the first label of each entrez by ``pos``."""
    parsed = parse_labels(labels).filter(F.col("entrez").isNotNull())
    return parsed.groupBy("entrez").agg(F.min_by(F.struct("symbol", "label"), F.struct("pos", "label")).alias("f")).select("entrez", "f.symbol", "f.label")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """``pos, entrez, symbol, label_a, label_b, canonical, conflict``: shared features by number of their entrez.

    ``a`` and ``b`` have ``label, pos``; the first label of an entrez counts and
    the symbol is that of ``a``.  The numbering sorts one row per shared
    feature, a table of bounded size.
    """
    left = _firsts(a).select("entrez", "symbol", F.col("label").alias("label_a"))
    right = _firsts(b).select("entrez", F.col("symbol").alias("_other"), F.col("label").alias("label_b"))
    both = left.join(right, "entrez")
    pos = F.row_number().over(W.orderBy(F.col("entrez").cast("bigint"), "entrez")) - 1
    return both.select(pos.alias("pos"), "entrez", "symbol", "label_a", "label_b", canonical_label(F.col("symbol"), F.col("entrez")).alias("canonical"), (F.col("symbol") != F.col("_other")).alias("conflict"))


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return _firsts(a).join(_firsts(b), "entrez", "left_anti").select("entrez")


def lookup_chain(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """``target, label, entrez, pos``: label to entrez to target id; unmapped labels go, the first label of a target wins."""
    # a map may list an entrez twice: its first target by name counts
    one = mapping.groupBy("entrez").agg(F.min("target").alias("target"))
    mapped = parse_labels(labels).filter(F.col("entrez").isNotNull()).join(one, "entrez")
    return mapped.groupBy("target").agg(F.min(F.struct("pos", "label", "entrez")).alias("f")).select("target", "f.label", "f.entrez", "f.pos")


def match_external(columns: DataFrame, canonical: DataFrame) -> DataFrame:
    """``pos, entrez, symbol, label, tier``: the external column for each canonical feature, NULL if there is none.

    ``columns``: ``label, pos``; ``canonical``: ``pos, entrez, symbol``.  Tier 1:
    a parsed label or bare number gives the entrez; tier 2, for features not yet
    matched: a label that is the symbol and nothing else, so that ``SYM (9)`` is
    never taken for another gene called SYM.  Within a tier the first column wins.
    """
    text = F.trim("label")
    number = F.coalesce(entrez_of(F.col("label")), F.when(text.rlike("^[0-9]+$"), text))
    first = columns.withColumn("entrez", number).filter("entrez is not null").groupBy("entrez").agg(F.min_by("label", "pos").alias("l1"))
    by_name = columns.filter(number.isNull()).withColumn("symbol", text).groupBy("symbol").agg(F.min_by("label", "pos").alias("l2"))
    out = canonical.join(first, "entrez", "left").join(by_name, "symbol", "left")
    tier = F.when(F.col("l1").isNotNull(), 1).when(F.col("l2").isNotNull(), 2)
    return out.select("pos", "entrez", "symbol", F.coalesce("l1", "l2").alias("label"), tier.alias("tier"))


def remap(cells: DataFrame, matched: DataFrame, fill: float = 0.0) -> DataFrame:
    """External cells in canonical columns; unmatched features are filled, missing values of matched ones stay missing."""
    found = matched.filter("label is not null").join(cells.withColumnRenamed("col_key", "label"), "label").select("row_key", "pos", "entrez", "value")
    rows = cells.select("row_key").distinct()
    gaps = matched.filter("label is null").select("pos", "entrez")
    # features without a column times rows: exactly the cells that the result must have
    filled = grid(rows, gaps).select("row_key", "pos", "entrez", F.lit(fill).alias("value"))
    return found.unionByName(filled)


def canonical_order(cells: DataFrame, space: DataFrame, label: Column | None = None) -> DataFrame:
    """Cells of features in the space, with their position and canonical label."""
    return cells.withColumnRenamed("col_key", "entrez").join(space.select("entrez", "pos", "canonical"), "entrez")
