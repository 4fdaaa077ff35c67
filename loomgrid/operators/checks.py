"""Integrity checks as rows: ``name, severity, passed, detail``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid import config
from loomgrid.operators.cells import matrix_statistics


def _rows(figures: DataFrame, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One row per check from a one-row table of figures; an undefined test has failed."""
    structs = [F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.coalesce(t, F.lit(False)).alias("passed"), F.coalesce(d.cast("string"), F.lit("")).alias("detail")) for n, s, t, d in checks]
    return figures.select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def integrity_checks(
    expression: DataFrame, effects: DataFrame, metadata: DataFrame, space: DataFrame, selective: DataFrame, splits: DataFrame | None = None, response: DataFrame | None = None
) -> DataFrame:
    """All checks of a built data set; sections without their table are skipped.

    ``expression``, ``effects``, ``response``: cells ``row_key, col_key, value``
    with repeated keys if there are any; ``metadata``: ``model_id, patient_id,
    lineage, disease, subtype``; ``space``: ``pos, entrez``; ``selective``:
    ``col_key``; ``splits``: ``model_id, split``.  A missing patient is a group
    of its own.
    """
    out = []
    n = F.col("n")
    col = F.col

    def at_least_one(df: DataFrame, name: str) -> None:
        out.append(_rows(_count(df, "n"), [(f"{name}_not_empty", "hard", n > 0, n)]))

    def unique(df: DataFrame, keys: list[str], name: str) -> None:
        figures = df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.count_if(col("k") > 1).alias("n"))
        out.append(_rows(figures, [(name, "hard", n == 0, n)]))

    def none_left(df: DataFrame, name: str, severity: str = "hard") -> None:
        out.append(_rows(_count(df, "n"), [(name, severity, n == 0, n)]))

    for df, name in ((expression, "expression"), (effects, "effects"), (metadata, "metadata")):
        at_least_one(df, name)
    unique(expression, ["row_key", "col_key"], "expression_cells_unique")
    unique(effects, ["row_key", "col_key"], "effect_cells_unique")
    unique(metadata, ["model_id"], "metadata_ids_unique")

    e_rows, c_rows = expression.select("row_key").distinct(), effects.select("row_key").distinct()
    e_cols, c_cols = expression.select("col_key").distinct(), effects.select("col_key").distinct()
    apart = e_rows.join(c_rows, "row_key", "left_anti").unionByName(c_rows.join(e_rows, "row_key", "left_anti"))
    none_left(apart, "same_rows")
    none_left(e_rows.join(metadata.select(col("model_id").alias("row_key")), "row_key", "left_anti"), "metadata_covers_rows")
    none_left(e_rows.filter(~col("row_key").startswith(config.MODEL_PREFIX)), "ids_have_prefix")
    canonical = space.select(col("entrez").alias("col_key"))
    none_left(e_cols.join(canonical, "col_key", "left_anti").unionByName(canonical.join(e_cols, "col_key", "left_anti")), "expression_columns_canonical")
    none_left(c_cols.join(canonical, "col_key", "left_anti"), "effect_columns_in_space")
    figures = space.agg(F.count("*").alias("n"), F.countDistinct("entrez").alias("e"), F.countDistinct("pos").alias("p"), F.max("pos").alias("m"))
    out.append(_rows(figures, [("positions_consistent", "hard", (col("p") == n) & (col("m") == n - 1), n), ("entrez_unique", "hard", col("e") == n, col("e"))]))

    inf = matrix_statistics(expression)
    out.append(
        _rows(
            inf,
            [
                ("expression_finite", "hard", col("n_infinite") == 0, col("n_infinite")),
                ("expression_missing_below_1_percent", "soft", col("missing_share") < 0.01, F.round("missing_share", 6)),
                ("expression_in_log_range", "soft", (col("min_value") >= -0.001) & (col("max_value") < 100), F.round("max_value", 4)),
            ],
        )
    )
    out.append(
        _rows(
            matrix_statistics(effects),
            [
                ("effects_finite", "hard", col("n_infinite") == 0, col("n_infinite")),
                ("effects_missing_below_5_percent", "soft", col("missing_share") < 0.05, F.round("missing_share", 6)),
                ("effects_in_range", "soft", (col("min_value") > -10) & (col("max_value") < 10), F.round("max_value", 4)),
                ("effects_median_near_zero", "soft", F.abs("median") < 0.25, F.round("median", 6)),
            ],
        )
    )
    none_left(expression.groupBy("row_key").agg(F.count("value").alias("k")).filter("k = 0"), "no_empty_expression_row")

    at_least_one(selective, "selective_targets")
    none_left(selective.select("col_key").join(c_cols, "col_key", "left_anti"), "selective_targets_exist")
    block = matrix_statistics(effects.join(selective.select("col_key"), "col_key", "left_semi"))
    out.append(_rows(block, [("selective_block_varies", "soft", col("sd") > 0.05, F.round("sd", 6))]))

    if splits is not None:
        valid = splits.filter(col("split").isin("train", "val", "test"))
        none_left(e_rows.join(splits.select(col("model_id").alias("row_key")), "row_key", "left_anti"), "all_rows_assigned")
        none_left(splits.filter(~F.coalesce(col("split").isin("train", "val", "test"), F.lit(False))), "split_names_valid")
        out.append(_rows(valid.agg(F.countDistinct("split").alias("n")), [("no_split_empty", "hard", n == 3, n)]))
        grp = F.coalesce("patient_id", "model_id")
        groups = valid.join(metadata.select("model_id", "patient_id"), "model_id", "left").groupBy(grp.alias("grp")).agg(F.countDistinct("split").alias("k")).filter("k > 1")
        none_left(groups, "no_patient_straddles")
    if response is not None:
        unique(response, ["row_key", "col_key"], "response_cells_unique")
        r_rows = response.select("row_key").distinct()
        none_left(r_rows.join(e_rows, "row_key", "left_anti"), "response_rows_in_core")
        out.append(_rows(_count(r_rows, "n"), [("response_has_50_rows", "soft", n >= 50, n)]))
    mask = F.coalesce(F.lower("disease").contains(config.DISEASE_KEYWORD), F.lit(False)) | F.coalesce(F.lower("subtype").contains(config.DISEASE_KEYWORD), F.lit(False))
    held = metadata.filter(mask).select(col("model_id").alias("row_key")).join(e_rows, "row_key", "left_semi")
    out.append(_rows(_count(held, "n"), [("disease_has_5_rows", "soft", n >= 5, n)]))
    table = out[0]
    for t in out[1:]:
        table = table.unionByName(t)
    return table


def hard_failures(checks: DataFrame) -> DataFrame:
    return checks.filter((F.col("severity") == "hard") & ~F.col("passed"))
