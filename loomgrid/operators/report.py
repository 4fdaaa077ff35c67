"""Audit reports and comparisons of models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid import config


def as_section(name: str, figures: DataFrame) -> DataFrame:
    """A one-row table as rows ``section, key, value`` (value as text)."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in figures.columns]
    return figures.select(F.lit(name).alias("section"), F.explode(F.array(*pairs)).alias("p")).select("section", "p.key", "p.value")


def assemble(sections: DataFrame) -> dict[str, dict[str, str]]:
    """Rows of a report as a nested dict; a report is a few hundred rows."""
    out: dict[str, dict[str, str]] = {}
    for r in sections.orderBy("section", "key").collect():
        out.setdefault(r["section"], {})[r["key"]] = r["value"]
    return out


def render(report: dict[str, dict], width: int = 38, longest: int = 6) -> str:
    """Titled sections with padded keys; of a longer list its first entries and the total."""
    lines = []
    for title, body in report.items():
        lines += [title, "-" * len(title)]
        for key, value in body.items():
            if isinstance(value, (list, tuple)) and len(value) > longest:
                value = f"{', '.join(map(str, value[:longest]))}, ... ({len(value)} in all)"
            lines.append(f"{key:<{width}} {value}")
        lines.append("")
    return "\n".join(lines)


def first_examples(rows: DataFrame, column: str, n: int) -> DataFrame:
    """``n, examples``: how many there are, and the first ``n`` of them in order."""
    first = rows.select(column).orderBy(column).limit(n).agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ", ").alias("examples"))
    return rows.agg(F.count("*").alias("n")).join(first, F.lit(True), "left")  # a row each


def concat_columns(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Columns side by side: the rows that have the same place in the order of each side; the longer side ends with NULLs."""
    return numbered(left, order).drop(order).join(numbered(right, order).drop(order), "_place", "full").drop("_place")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``_place`` from 1 on, counted in ranges first so that no task holds all."""
    from loomgrid.sources.staging import stage

    ranged = stage(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    offsets = sizes.select("_part", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order))
    return ranged.join(offsets, "_part").withColumn("_place", F.col("_before") + inside).drop("_part", "_before")


def save_json(report: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(report, f, indent=2, default=str)


def deltas(results: DataFrame, references: list[str], value: str = "spearman_mean") -> DataFrame:
    """``task, model, reference, delta, verdict`` of each other model against each reference; NULL where one has no value."""
    ref = results.filter(F.col("model").isin(references)).select("task", F.col("model").alias("reference"), F.col(value).alias("_r"))
    out = results.filter(~F.col("model").isin(references)).join(ref, "task")
    delta = F.round(F.col(value) - F.col("_r"), 4)
    verdict = F.when(delta > config.VERDICT_MARGIN, "better").when(delta < -config.VERDICT_MARGIN, "worse").when(delta.isNotNull(), "same")
    return out.select("task", "model", "reference", delta.alias("delta"), verdict.alias("verdict"))


def schema_peek(df: DataFrame) -> DataFrame:
    """``n_columns, first_columns, last_columns, dtypes`` from the schema alone."""
    from collections import Counter

    kinds = Counter(t for _, t in df.dtypes)
    row = (len(df.columns), ", ".join(df.columns[:5]), ", ".join(df.columns[-3:]), "; ".join(f"{k}={v}" for k, v in sorted(kinds.items())))
    return df.sparkSession.createDataFrame([row], "n_columns int, first_columns string, last_columns string, dtypes string")
