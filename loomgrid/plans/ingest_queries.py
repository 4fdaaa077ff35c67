"""Queries that write raw files and artifacts to the shared folder and read them as a user would."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid import config
from loomgrid.functions.ids import loose_bool, usable_text
from loomgrid.operators import baselines, cells, expression_counts, gene_space, group_split, report
from loomgrid.operators.lookup import grid
from loomgrid.plans import inputs
from loomgrid.plans.general_queries import gene_columns
from loomgrid.plans.reference_queries import _assigned, _mapping, _members, _space, r6
from loomgrid.sources import matrix_io, wide_text
from loomgrid.sources.resolver import resolve_file
from loomgrid.sources.staging import release_at_exit, shared_dir, stage
from loomgrid.sources.tables import table

QUERIES = {}
FLAG = "IsDefaultEntryForModel"
PROFILE_COLUMNS = {"row_id": "Unnamed: 0", "sequencingid": "SequencingID", "modelconditionid": "ModelConditionID", "modelid": "ModelID", "isdefaultentryformc": "IsDefaultEntryForMC", "isdefaultentryformodel": FLAG}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    release_at_exit(spark, path)
    return path


def _in_order(df: DataFrame, order: str) -> DataFrame:
    """Files that follow each other by name hold rows that follow each other."""
    return df.repartitionByRange(order).sortWithinPartitions(order)


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def _label(column: str) -> str:
    symbol, _, number = column.rpartition("_")
    return f"{symbol.upper()} ({number})" if number.isdigit() else column


# --- raw files ------------------------------------------------------------------


@query
def ingest_expression(spark, d):
    """The wide file of profiles: default profiles, the first of each model, numeric columns, as FLOAT."""
    t, folder = table(spark, d, "expression_profile"), _folder(spark, "raw")
    genes = gene_columns(t)
    wide = _in_order(t, "row_id").select(*[F.col(a).cast("string").alias(b) for a, b in PROFILE_COLUMNS.items()], *[F.col(g).cast("string").alias(_label(g)) for g in genes])
    _csv(wide, f"{folder}/OmicsExpressionTPMLogp1HumanProteinCodingGenes.csv")
    path = resolve_file(spark, "expression", folder)
    raw, _ = wide_text.read_wide(spark, path, "ModelID", drop=[*PROFILE_COLUMNS.values()], keep=[FLAG])
    numbers = wide_text.numeric_cells(raw).filter(loose_bool(F.col(FLAG)) & F.col("row_key").isNotNull())
    return cells.keep_first(numbers.select("ord", "row_key", "col_key", "value"), ["row_key", "col_key"], "ord").select("row_key", "col_key", F.round(F.col("value").cast("double"), 4).alias("value"))


def _wide_effects(spark: SparkSession, d: str) -> DataFrame:
    genes = [(r["entrez"], r["canonical_label"]) for r in table(spark, d, "gene_id_map").orderBy("entrez").collect()]  # columns of the file
    own = inputs.effect_cells(spark, d).groupBy("row_key").agg(*[F.max(F.when(F.col("col_key") == e, F.col("value"))).cast("string").alias(label) for e, label in genes])
    return _in_order(own, "row_key").withColumnRenamed("row_key", "Unnamed: 0")


@query
def ingest_effects(spark, d):
    """The wide file of effects, whose key column has no name."""
    folder = _folder(spark, "raw")
    _csv(_wide_effects(spark, d), f"{folder}/CRISPRGeneEffect.csv")
    raw, _ = wide_text.read_wide(spark, resolve_file(spark, "crispr", folder))
    return wide_text.numeric_cells(raw).select("row_key", "col_key", F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def ingest_first_lines(spark, d):
    """Only the first 100 lines of the file, and what they hold."""
    folder = _folder(spark, "raw")
    _csv(_wide_effects(spark, d), f"{folder}/CRISPRGeneEffect.csv")
    raw, labels = wide_text.read_wide(spark, resolve_file(spark, "crispr", folder), rows=100)
    return raw.agg(F.countDistinct("row_key").alias("n_rows"), F.max("row_key").alias("last_row"), F.count("raw").alias("n_values")).withColumn("n_columns", F.lit(len(labels)))


@query
def ingest_metadata(spark, d):
    """The table of models with its wanted columns, the first row of each model."""
    t, folder = table(spark, d, "depmap_model"), _folder(spark, "raw")
    have = {c.lower(): c for c in config.METADATA_COLUMNS}
    _csv(_in_order(t, "row_id").select(*[F.col(c).cast("string").alias(have.get(c, c)) for c in t.columns if c != "pediatricmodeltype"]), f"{folder}/Model.csv")
    rows, missing = wide_text.read_metadata(spark, resolve_file(spark, "model", folder))
    first = cells.keep_first(rows.filter("ModelID is not null"), ["ModelID"], "_ord")
    return first.select(F.col("ModelID").alias("model"), F.col("PatientID").alias("patient"), F.col("OncotreeLineage").alias("lineage"), F.col("Age").try_cast("int").alias("age"), F.lit(",".join(missing)).alias("missing_columns"))


@query
def ingest_response(spark, d):
    """Responses with compounds on the rows, and the report where there is no such file."""
    folder = _folder(spark, "raw")
    effects = stage(inputs.effect_cells(spark, d), "effects")
    models = effects.select("row_key").distinct()
    dense = grid(effects.select("col_key").distinct(), models).join(effects, ["row_key", "col_key"], "left")
    packed = F.transform(F.array_sort(F.collect_list(F.struct("row_key", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v")))), lambda s: s["v"])
    body = dense.groupBy("col_key").agg(F.concat_ws(",", F.concat(F.lit("BRD-"), F.first("col_key")), F.concat_ws(",", packed)).alias("value")).select(F.col("col_key").alias("ord"), "value")
    # the header of the file to be read names every line
    head = models.agg(F.concat(F.lit(","), F.concat_ws(",", F.array_sort(F.collect_list("row_key")))).alias("value")).select(F.lit("").alias("ord"), "value")
    head.unionByName(body).repartition(1).sortWithinPartitions("ord").select("value").write.text(f"{folder}/primary-screen-replicate-collapsed-logfold-change.csv")
    found, seen = wide_text.read_response(spark, resolve_file(spark, "prism_matrix", folder, required=False))
    _, absent = wide_text.read_response(spark, resolve_file(spark, "prism_matrix", f"{folder}/none", required=False))
    there = found.agg(F.countDistinct("row_key").alias("n_lines"), F.countDistinct("col_key").alias("n_compounds"), F.count("value").alias("n_values"), F.round(F.sum("value"), 2).alias("total"))
    there = there.select(F.lit(seen["status"]).alias("status"), F.lit(seen["transposed"]).alias("transposed"), "*")
    none = spark.createDataFrame([(absent["status"],)], "status string")
    return there.unionByName(none, allowMissingColumns=True)


@query
def ingest_counts(spark, d):
    """The file of expected counts, aligned to the lines of a split and the mapped genes."""
    folder = _folder(spark, "raw")
    own = expression_counts.pseudo_counts(inputs.expression_cells(spark, d))
    names = [r[0] for r in gene_space.parse_labels(inputs.expression_labels(spark, d)).filter("entrez is not null").orderBy("entrez").select("entrez").collect()]  # columns of the file
    wide = own.groupBy("row_key").agg(*[F.max(F.when(F.col("col_key") == e, F.col("value"))).cast("string").alias(e) for e in names])
    _csv(_in_order(wide, "row_key"), f"{folder}/OmicsExpressionGenesExpectedCountProfile.csv")
    raw, _ = wide_text.read_wide(spark, resolve_file(spark, "expression_counts", folder, required=False), "row_key")
    counts = stage(wide_text.numeric_cells(raw).select("row_key", "col_key", F.col("value").cast("double").alias("value")), "counts")
    rows = inputs.splits(spark, d).select(F.col("model_id").alias("row_key"))
    out = expression_counts.aligned_counts(counts, rows, table(spark, d, "gene_id_map").select(F.col("entrez").alias("col_key")))
    return out.groupBy("col_key").agg(F.count("*").alias("n"), F.count("value").alias("n_known"), F.count_if(F.col("value") > 0).alias("n_positive"))


@query
def cached_map(spark, d):
    """The typed map of targets, built once and read from its file."""
    path = f"{_folder(spark, 'cache')}/map.csv"
    for _ in range(2):
        out = matrix_io.cached_table(spark, path, "entrez string, target string", lambda: _mapping(spark, d))
    return out


# --- artifacts ------------------------------------------------------------------


@query
def saved_matrix(spark, d):
    path = _folder(spark, "matrix")
    matrix_io.save_matrix(inputs.expression_cells(spark, d), path)
    return matrix_io.load_matrix(spark, path).select("row_key", "col_key", F.round(F.col("value").cast("double"), 4).alias("value"))


@query
def saved_table(spark, d):
    """Metadata written as CSV and as parquet, and read by the same call."""
    folder, out = _folder(spark, "table"), None
    for form in ("csv", "parquet"):
        matrix_io.save_table(inputs.metadata(spark, d).select("model_id", "lineage"), f"{folder}/{form}", form)
        one = matrix_io.load_table(spark, f"{folder}/{form}").groupBy("lineage").agg(F.count("*").alias("n")).select(F.lit(form).alias("form"), "lineage", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query
def saved_splits(spark, d):
    """The frozen assignment after a round trip; it is written only if it keeps groups whole."""
    path = f"{_folder(spark, 'splits')}/splits.json"
    groups = group_split.greedy_split(group_split.majority_stratum(_members(spark, d))).select("grp", "split")
    assigned = stage(_members(spark, d).join(groups, "grp").select("model_id", "grp", "stratum", "split"), "assigned")
    figures = group_split.verify_splits(assigned)
    matrix_io.save_splits(assigned, path, {"seed": "0"}, figures, {"sizes": figures["split_sizes"]})
    return matrix_io.load_splits(spark, path)


@query
def gene_socket(spark, d):
    """The feature space as a document, each feature at its place."""
    path = f"{_folder(spark, 'socket')}/gene_columns.json"
    space = [r.asDict() for r in _space(spark, d).select("pos", "entrez", "symbol", "canonical").orderBy("pos").collect()]  # the features of a model
    matrix_io.save_json(spark, {"n_genes": len(space), "entrez_ids": [r["entrez"] for r in space], "symbols": [r["symbol"] for r in space], "canonical_columns": [r["canonical"] for r in space]}, path)
    back = spark.read.option("multiLine", True).json(path)
    zipped = F.arrays_zip("entrez_ids", "symbols", "canonical_columns")
    return back.select("n_genes", F.posexplode(zipped).alias("pos", "z")).select("n_genes", "pos", F.col("z.entrez_ids").alias("entrez"), F.col("z.symbols").alias("symbol"), F.col("z.canonical_columns").alias("canonical"))


@query
def saved_components(spark, d):
    """The sparse matrix and its tables, counted after they are read again."""
    path = _folder(spark, "components")
    own = stage(expression_counts.pseudo_counts(inputs.expression_cells(spark, d)), "counts")
    matrix_io.save_components(own, expression_counts.row_table(own, inputs.metadata(spark, d), inputs.splits(spark, d)), own.select("col_key").distinct(), path)
    parts = [(n, spark.read.parquet(f"{path}/{n}")) for n in ("X", "obs", "var")]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "embeddings")
    matrix_io.save_embeddings(table(spark, d, "embeddings").select(F.format_string("ACH-%06d", F.col("vec_id")).alias("row_key"), F.col("embedding").alias("x")), path)
    return matrix_io.load_embeddings(spark, path)


@query
def saved_embeddings(spark, d):
    return _embedded(spark, d).select("row_key", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


# --- order, concatenation, examples ----------------------------------------------


@query
def canonical_matrix(spark, d):
    return gene_space.canonical_order(inputs.expression_cells(spark, d), _space(spark, d)).select("row_key", "pos", "canonical", r6("value"))


@query
def ordered_equality(spark, d):
    """Whether two lists of labels agree place by place: the space's own labels, and those that the effects use."""
    space = stage(_space(spark, d), "space")
    own = space.select("pos", F.col("label_a").alias("a")).join(space.select("pos", F.col("label_b").alias("b")), "pos", "full")
    return own.agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_apart"), (F.count_if(~F.col("a").eqNullSafe(F.col("b"))) == 0).alias("equal"))


@query
def concat_by_position(spark, d):
    """The n-th split row beside the n-th model row."""
    left = table(spark, d, "split_assignment").select("row_id", "split")
    right = table(spark, d, "depmap_model").select("row_id", F.col("sex").alias("sex_raw"))
    return report.concat_columns(left, right, "row_id").filter("split is not null and sex_raw is not null").groupBy("split", "sex_raw").agg(F.count("*").alias("n"))


@query
def straddle_examples(spark, d):
    found = group_split.straddling_groups(_assigned(spark, d))
    return report.first_examples(found, "grp", 5)


@query
def conflict_examples(spark, d):
    apart = gene_space.parse_labels(inputs.effect_labels(spark, d)).filter("entrez is not null").groupBy("entrez").agg(F.count("*").alias("n")).filter("n > 1")
    return report.first_examples(apart, "entrez", 10)


@query
def complete_models(spark, d):
    """Models that lack none of donor, lineage and disease."""
    rows = inputs.metadata(spark, d).select("model_id", "patient_id", "lineage", usable_text(F.col("disease")).alias("disease"))
    return rows.na.drop("any").select("model_id", "patient_id", "lineage")


@query
def task_sizes(spark, d):
    """Which tasks can be run: training and evaluated lines of each, and the gates they must pass."""
    out = None
    for name in ("crispr", "prism"):
        lines = task_targets(name, inputs.effect_cells(spark, d), None)
        n = {"train": 0, "val": 0}
        if lines is not None:
            both = lines.select("row_key").distinct().join(inputs.default_profiles(spark, d).select(F.col("model_key").alias("row_key")), "row_key", "left_semi")
            n |= {r["split"]: r["n"] for r in both.join(inputs.splits(spark, d), both["row_key"] == F.col("model_id")).groupBy("split").agg(F.count("*").alias("n")).collect()}
        one = spark.createDataFrame([(name, n["train"], n["val"], baselines.task_available(n["train"], n["val"]))], "task string, n_train long, n_eval long, available boolean")
        out = one if out is None else out.unionByName(one)
    return out


def task_targets(task: str, effects: DataFrame, response: DataFrame | None) -> DataFrame | None:
    """The target cells of a task, None where it has none; an unknown task is a ValueError."""
    if task == "crispr":
        return effects
    if task == "prism":
        return response
    raise ValueError(f"unknown task {task!r}; known: crispr, prism")
