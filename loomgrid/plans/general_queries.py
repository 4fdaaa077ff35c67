"""Queries of the general problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.ids import donor_id, model_id, usable_text
from loomgrid.functions.labels import entrez_of
from loomgrid.operators.drift import alias_table, schema_drift, unified_table
from loomgrid.operators.lookup import salted_lookup
from loomgrid.operators.profile import ColumnRule, column_profile, load_findings, value_counts
from loomgrid.operators.references import orphan_references, orphan_report, parent_intervals
from loomgrid.sources.staging import stage
from loomgrid.sources.tables import table

PROFILE_META = ["row_id", "sequencingid", "modelconditionid", "modelid", "isdefaultentryformc", "isdefaultentryformodel", "sequenced_at", "load_id", "loaded_at"]
ACH = r"^ACH-[0-9]{6,}$"
MC = r"^MC-[0-9]{6,}(-alt[0-9]*)?$"


def gene_columns(profiles: DataFrame) -> list[str]:
    return [c for c in profiles.columns if c not in PROFILE_META]


def _profile(spark: SparkSession, d: str) -> DataFrame:
    profiles, effects = table(spark, d, "expression_profile"), table(spark, d, "crispr_gene_effect")
    of_profiles = {"modelid": ColumnRule(pattern=ACH), "modelconditionid": ColumnRule(pattern=MC)} | {g: ColumnRule(low=0.0, high=20.0) for g in gene_columns(profiles)}
    of_effects = {"modelid": ColumnRule(pattern=ACH), "effect": ColumnRule(low=-10.0, high=10.0)}
    counts = value_counts(profiles, "expression_profile", "load_id", of_profiles).unionByName(value_counts(effects, "crispr_gene_effect", "load_id", of_effects))
    rules = {("expression_profile", c): r for c, r in of_profiles.items()} | {("crispr_gene_effect", c): r for c, r in of_effects.items()}
    return column_profile(counts, rules, table(spark, d, "load_batch"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return load_findings(_profile(spark, d))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).select(
        "table_name", "column_name", "load_id", "n_rows", "n_missing", "n_distinct", "n_nonnumeric", "n_badly_formed", "n_nonconforming", "n_absorbed", "expression",
        "min_value", "max_value", F.round("median", 6).alias("median"), F.round("coverage", 6).alias("coverage"), F.round("coverage_change", 6).alias("coverage_change"),
    )


def _category(name: str) -> Column:
    return F.initcap(usable_text(F.col(name)))


def _held_out() -> Column:
    """About a sixteenth of all rows, by a hash of their id."""
    return F.md5(F.col("row_id").cast("string")).startswith("0")


def _model_values() -> dict[str, Column]:
    age = F.when(F.col("age").between(0, 120), F.col("age").cast("double"))
    return {"oncotreelineage": _category("oncotreelineage"), "sex": _category("sex"), "age": age}


def _model_group() -> Column:
    return F.coalesce(donor_id(F.col("patientid")), model_id(F.col("modelid")))


def _filled_models(spark: SparkSession, d: str, blank: Column | None = None) -> DataFrame:
    """Lineage, sex and age from rows of the same donor; without one, from those of the same model."""
    from loomgrid.operators.impute import Field, fill_missing

    fields = [Field(n, c if blank is None else F.when(~blank, c), numeric=n == "age") for n, c in _model_values().items()]
    return fill_missing(table(spark, d, "depmap_model"), "row_id", fields, _model_group())


def model_lineage(spark: SparkSession, d: str) -> DataFrame:
    """``model_key, lineage``: the lineage most of a model's rows give, ties by name."""
    models = table(spark, d, "depmap_model").select(model_id(F.col("modelid")).alias("model_key"), _category("oncotreelineage").alias("lineage"))
    votes = models.filter("model_key is not null and lineage is not null").groupBy("model_key", "lineage").agg(F.count("*").alias("n"))
    return votes.groupBy("model_key").agg(F.min_by("lineage", F.struct(-F.col("n"), "lineage")).alias("lineage"))


def _effect_value() -> Column:
    return F.when(F.col("effect").between(-10, 10), F.col("effect").cast("double"))


def _filled_effects(spark: SparkSession, d: str, blank: Column | None = None) -> DataFrame:
    """Effects from rows of the same gene and lineage."""
    from loomgrid.operators.impute import Field, fill_missing

    effects = table(spark, d, "crispr_gene_effect")
    key = F.coalesce(model_id(F.col("modelid")), F.concat(F.lit("?"), F.col("row_id").cast("string")))
    rows = salted_lookup(effects.withColumn("model_key", key), model_lineage(spark, d), "model_key", "row_id")
    # joined once: fitting reads it in every pass
    rows = stage(rows.select("row_id", "modelid", "gene", "effect", "lineage", entrez_of(F.col("gene")).alias("entrez")), "effects")
    effect = _effect_value() if blank is None else F.when(~blank, _effect_value())
    group = F.when(F.col("lineage").isNotNull() & F.col("entrez").isNotNull(), F.concat_ws("|", "entrez", "lineage"))
    context = [Field("entrez", F.col("entrez")), Field("lineage", F.col("lineage"))]
    return fill_missing(rows, "row_id", [Field("effect", effect, numeric=True)], group, context, components=8)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from loomgrid.operators.impute import filled_cells

    models = filled_cells(_filled_models(spark, d), "depmap_model", "row_id", ["oncotreelineage", "sex", "age"])
    return models.unionByName(filled_cells(_filled_effects(spark, d), "crispr_gene_effect", "row_id", ["effect"]))


def p3_models(spark: SparkSession, d: str) -> DataFrame:
    names = ["oncotreelineage", "sex", "age"]
    return _filled_models(spark, d).select("row_id", "modelid", *[c for n in names for c in (f"{n}_filled", f"{n}_was_missing")])


def p3_effects(spark: SparkSession, d: str) -> DataFrame:
    return _filled_effects(spark, d).select("row_id", "modelid", "gene", "effect_filled", "effect_was_missing")


def p3_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Filled categories of records whose group has one most frequent value."""
    values, names = _model_values(), ["oncotreelineage", "sex"]
    known = table(spark, d, "depmap_model").select(_model_group().alias("grp"), F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), values[n].alias("v")) for n in names])).alias("e"))
    votes = known.select("grp", "e.*").filter("v is not null and grp is not null").groupBy("grp", "field_name", "v").agg(F.count("*").alias("n"))
    most = votes.groupBy("grp", "field_name").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("n")).alias("all")).filter("size(filter(all, x -> x = n)) = 1")
    filled = _filled_models(spark, d).select("row_id", _model_group().alias("grp"), F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"{n}_was_missing").alias("was"), F.col(f"{n}_filled").alias("value")) for n in names])).alias("e"))
    return filled.select("row_id", "grp", "e.*").filter("was").join(most, ["grp", "field_name"], "left_semi").select("row_id", "field_name", "value")


def p3_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Known values blanked by a hash and filled again, per field: how many, and whether filling beats the overall mean or mode."""
    models, parts = _filled_models(spark, d, _held_out()), []
    for filled, values in ((models, _model_values()), (_filled_effects(spark, d, _held_out()), {"effect": _effect_value()})):
        for name, truth in values.items():
            own = filled.select(_held_out().alias("held"), truth.alias("truth"), F.col(f"{name}_filled").alias("fill")).filter("truth is not null")
            if name in ("age", "effect"):
                plain = own.filter("not held").agg(F.avg("truth").alias("plain")).first()["plain"]
                off = lambda c: F.abs(c - F.col("truth"))
            else:
                plain = own.filter("not held").groupBy("truth").count().agg(F.min_by("truth", F.struct(-F.col("count"), "truth")).alias("plain")).first()["plain"]
                off = lambda c: (c != F.col("truth")).cast("int")
            better = F.sum(off(F.col("fill"))) < F.sum(off(F.lit(plain)))
            parts.append(own.filter("held").agg(F.count("*").alias("n_blanked"), F.count("fill").alias("n_filled"), better.alias("better_than_overall")).select(F.lit(name).alias("field_name"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    def refs(name: str) -> DataFrame:
        t = table(spark, d, name)
        return t.filter(F.col("modelid").isNotNull()).select(F.lit(name).alias("table_name"), "row_id", F.coalesce(model_id(F.col("modelid")), F.col("modelid")).alias("ref_key"), F.col("loaded_at").alias("ref_time"))

    parents = table(spark, d, "depmap_model").withColumn("_key", model_id(F.col("modelid")))
    return orphan_references(refs("crispr_gene_effect").unionByName(refs("expression_profile")), parent_intervals(parents, "_key", "loaded_at", "withdrawn_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id", "kind")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def without_alternative(value: Column) -> Column:
    """A condition id without its number of alternative, which deliveries spell in several ways."""
    return F.regexp_replace(value, "^(mc-[0-9]+)-alt[0-9]*$", "$1")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift(table(spark, d, "raw_delivery"), normal=without_alternative).changes.select("file_name", "field_name", "change_kind")


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    drift = schema_drift(table(spark, d, "raw_delivery"), normal=without_alternative)
    return unified_table(drift, alias_table(drift))


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile, "p3_found": p3_found, "p3_models": p3_models, "p3_effects": p3_effects, "p3_by_group": p3_by_group, "p3_held_out": p3_held_out, "p4_found": p4_found, "p4_report": p4_report, "p6_found": p6_found, "p6_unified": p6_unified}
