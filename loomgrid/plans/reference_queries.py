"""Named queries of the matrix engine over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid import config
from loomgrid.functions.ids import loose_bool, model_id
from loomgrid.operators import baselines, cells, checks, expression_counts, gene_space, group_split, metrics, report
from loomgrid.operators.lookup import grid
from loomgrid.plans import inputs
from loomgrid.plans.general_queries import gene_columns
from loomgrid.sources.staging import stage
from loomgrid.sources.tables import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name), 6).alias(alias or name)


# --- predictors and scores ------------------------------------------------------


def _means(spark: SparkSession, d: str, pred: str) -> DataFrame:
    """Predictions of one mean model; the cells are written once, as the means and the evaluated rows both read them."""
    own = stage(inputs.split_cells(spark, d), "cells")
    return baselines.predict_means(own).select("row_key", "target", "truth", F.col(pred).alias("pred"))


@query
def lineage_mean_spearman(spark, d):
    return metrics.spearman(_means(spark, d, "lineage_pred"), ["target"]).select("target", "n", (r6("spearman") + 0.0).alias("spearman"))


@query
def global_mean_r2(spark, d):
    return metrics.r_squared(_means(spark, d, "global_pred"), ["target"]).select("target", "n", (r6("r2") + 0.0).alias("r2"))


@query
def lineage_mean_r2(spark, d):
    return metrics.r_squared(_means(spark, d, "lineage_pred"), ["target"]).select("target", "n", (r6("r2") + 0.0).alias("r2"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    own = stage(inputs.split_cells(spark, d), "cells")
    long = baselines.predict_means(own).select("row_key", "target", "truth", F.explode(F.create_map(F.lit("global_mean"), F.col("global_pred"), F.lit("lineage_mean"), F.col("lineage_pred"))).alias("model", "pred"))
    long = stage(long, "scored")
    rho = metrics.spearman(long, ["model", "target"]).select("model", F.lit("spearman").alias("metric"), F.col("spearman").alias("score"))
    return rho.unionByName(metrics.r_squared(long, ["model", "target"]).select("model", F.lit("r2").alias("metric"), F.col("r2").alias("score")))


@query
def metric_summary(spark, d):
    return metrics.summary(_scores(spark, d), "score", ["model", "metric"])


@query
def model_deltas(spark, d):
    means = metrics.summary(_scores(spark, d), "score", ["model", "metric"]).select(F.col("metric").alias("task"), "model", "mean")
    return report.deltas(means, ["global_mean"], "mean")


# --- filters and selection ------------------------------------------------------


def _selected(spark: SparkSession, d: str) -> DataFrame:
    own = inputs.effect_cells(spark, d)
    n = own.select("row_key").distinct().count()
    return cells.target_statistics(own, n)


@query
def selective_targets(spark, d):
    return cells.selective(_selected(spark, d)).select("col_key", r6("missing_share"), "n_dependent", r6("dependent_share"), F.round(F.col("sd").cast("double"), 4).alias("sd"))


@query
def selective_report(spark, d):
    return cells.exclusion_report(_selected(spark, d))


@query
def all_zero_features(spark, d):
    """Genes on which no line depends, as columns of the matrix of dependencies without a value other than zero."""
    own = inputs.effect_cells(spark, d).withColumn("value", F.when(F.col("value") < config.DEPENDENCY_THRESHOLD, 1.0).otherwise(0.0))
    return cells.all_zero_columns(own)


@query
def low_variance_features(spark, d):
    return cells.low_variance_columns(inputs.expression_cells(spark, d), 1.2).select("col_key", F.round("sd", 4).alias("sd"))


@query
def default_profile_filter(spark, d):
    flag = loose_bool(F.col("isdefaultentryformodel"))
    return table(spark, d, "expression_profile").agg(F.count("*").alias("n_before"), F.count_if(flag).alias("n_after"), F.count_if(~flag).alias("n_dropped"))


@query
def dedup_keep_first(spark, d):
    rows = table(spark, d, "expression_profile").select("row_id", model_id(F.col("modelid")).alias("model_key"), "sequencingid").filter("model_key is not null")
    return cells.keep_first(rows, ["model_key"], "row_id")


@query
def duplicate_ids(spark, d):
    rows = table(spark, d, "depmap_model").select(model_id(F.col("modelid")).alias("model_key"))
    return cells.duplicate_keys(rows, "model_key")


@query
def non_numeric_columns(spark, d):
    t = table(spark, d, "expression_profile")
    long = cells.melt(t, "row_id", gene_columns(t), lambda c: F.col(c).cast("string")).withColumnRenamed("value", "raw")
    return cells.non_numeric_columns(long)


@query
def keyword_mask(spark, d):
    t = table(spark, d, "depmap_model")
    mask = cells.keyword_mask("mixed cell", F.col("oncotreeprimarydisease"), F.col("oncotreesubtype")) | cells.keyword_mask("type b", F.col("oncotreesubtype"))
    return t.filter(mask).groupBy(F.col("oncotreecode")).agg(F.count("*").alias("n"))


@query
def orientation_detect(spark, d):
    own = table(spark, d, "crispr_gene_effect")
    rows = own.filter("modelid is not null").groupBy(F.col("modelid").alias("label")).agg(F.min("row_id").alias("ord")).withColumn("axis", F.lit("rows"))
    cols = inputs.effect_labels(spark, d).select("label", F.col("pos").alias("ord")).withColumn("axis", F.lit("columns"))
    return cells.orientation(rows.unionByName(cols), "axis", "label", "ord")


@query
def transpose_long(spark, d):
    return cells.transpose(inputs.expression_cells(spark, d)).select("row_key", "col_key", r6("value"))


@query
def matrix_statistics(spark, d):
    e = cells.matrix_statistics(inputs.expression_cells(spark, d)).withColumn("matrix", F.lit("expression"))
    c = cells.matrix_statistics(inputs.effect_cells(spark, d)).withColumn("matrix", F.lit("effects"))
    return e.unionByName(c).select("matrix", *[r6(x) for x in ("min_value", "max_value", "median", "sd", "missing_share")], "n_infinite")


@query
def empty_rows(spark, d):
    return cells.empty_rows(inputs.effect_cells(spark, d))


# --- labels and feature spaces --------------------------------------------------


@query
def parse_labels(spark, d):
    return gene_space.parse_labels(inputs.effect_labels(spark, d)).select("label", "symbol", "entrez")


@query
def unparsed_labels(spark, d):
    return gene_space.parse_labels(inputs.expression_labels(spark, d)).filter("entrez is null").select("label")


def _renamed(labels: DataFrame) -> DataFrame:
    """Another release of the labels: some symbols have changed."""
    number = F.regexp_extract("label", r"\((\d+)\)", 1)
    return labels.withColumn("label", F.when(number.cast("long") % 7 == 0, F.concat(F.lit("OLD-"), F.col("label"))).otherwise(F.col("label")))


@query
def gene_space_intersect(spark, d):
    return gene_space.intersect(inputs.expression_labels(spark, d), inputs.effect_labels(spark, d)).select("pos", "entrez", "symbol", "label_a", "label_b", "canonical")


@query
def symbol_conflicts(spark, d):
    both = gene_space.intersect(inputs.expression_labels(spark, d), _renamed(inputs.effect_labels(spark, d)))
    return both.filter("conflict").select("entrez", "symbol", "label_b")


@query
def only_in_one(spark, d):
    a, b = inputs.expression_labels(spark, d), inputs.effect_labels(spark, d)
    return gene_space.only_in(a, b).withColumn("side", F.lit("expression")).unionByName(gene_space.only_in(b, a).withColumn("side", F.lit("effects")))


def _external(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a foreign matrix: each gene under one of three styles or under none, and each symbol also with another gene's number."""
    t = table(spark, d, "gene_id_map")
    n = F.col("entrez").cast("long")
    first = t.select(_foreign_label().alias("label"), n.alias("pos"))
    others = t.select(_another_gene().alias("label"), (n - 1_000_000).alias("pos"))
    return first.unionByName(others).groupBy("label").agg(F.min("pos").alias("pos"))


def _another_gene() -> Column:
    return F.concat(F.col("symbol"), F.lit(" (9"), F.col("entrez"), F.lit(")"))


def _foreign_label() -> Column:
    n = F.col("entrez").cast("long")
    return F.when(n % 4 == 0, F.col("symbol")).when(n % 4 == 1, F.col("entrez")).when(n % 4 == 2, F.col("canonical_label")).otherwise(_another_gene())


def _space(spark: SparkSession, d: str) -> DataFrame:
    return gene_space.intersect(inputs.expression_labels(spark, d), inputs.effect_labels(spark, d))


@query
def remap_external(spark, d):
    return gene_space.match_external(_external(spark, d), _space(spark, d).select("pos", "entrez", "symbol")).select("pos", "entrez", "label", "tier")


@query
def remap_cells(spark, d):
    matched = gene_space.match_external(_external(spark, d), _space(spark, d).select("pos", "entrez", "symbol"))
    ids = table(spark, d, "gene_id_map").select("entrez", "symbol", "canonical_label")
    own = inputs.expression_cells(spark, d).join(ids, F.col("col_key") == F.col("entrez"))
    return gene_space.remap(own.select("row_key", _foreign_label().alias("col_key"), "value"), matched).select("row_key", "pos", "entrez", r6("value"))


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    """Entrez to target ids, several genes on one target."""
    n = F.col("entrez").cast("long")
    return table(spark, d, "gene_id_map").select("entrez", F.concat(F.lit("ENSG"), F.lpad((n % 23).cast("string"), 11, "0")).alias("target"))


@query
def lookup_chain_first_wins(spark, d):
    return gene_space.lookup_chain(inputs.expression_labels(spark, d), _mapping(spark, d)).select("target", "label", "entrez")


# --- samples --------------------------------------------------------------------


@query
def three_way_intersection(spark, d):
    e, c = inputs.default_profiles(spark, d).select(F.col("model_key").alias("k")), inputs.effect_cells(spark, d).select(F.col("row_key").alias("k")).distinct()
    m = inputs.metadata(spark, d).select(F.col("model_id").alias("k"))
    every = e.withColumn("e", F.lit(1)).join(c.withColumn("c", F.lit(1)), "k", "full").join(m.withColumn("m", F.lit(1)), "k", "full")
    shared = F.col("e").isNotNull() & F.col("c").isNotNull() & F.col("m").isNotNull()
    return every.agg(F.count("e").alias("n_expression"), F.count("c").alias("n_effects"), F.count("m").alias("n_metadata"), F.count_if(shared).alias("n_shared"), (F.count("e") - F.count_if(shared)).alias("lost_from_expression"), (F.count("c") - F.count_if(shared)).alias("lost_from_effects"))


@query
def shared_samples(spark, d):
    e, m = inputs.default_profiles(spark, d).select("model_key"), inputs.metadata(spark, d).select(F.col("model_id").alias("model_key"))
    c = inputs.effect_cells(spark, d).select(F.col("row_key").alias("model_key")).distinct()
    return m.join(e, "model_key", "left_semi").join(c, "model_key", "left_semi")


@query
def set_predicates(spark, d):
    """Intersection, differences, subset, disjointness and uniqueness of key sets."""
    s = inputs.splits(spark, d)
    m = inputs.metadata(spark, d).select("model_id")
    part = lambda n: s.filter(F.col("split") == n).select("model_id")
    counts = [
        ("split_and_model", s.join(m, "model_id", "left_semi")), ("split_without_model", s.join(m, "model_id", "left_anti")), ("model_without_split", m.join(s, "model_id", "left_anti")),
        ("train_and_val", part("train").join(part("val"), "model_id", "left_semi")), ("train_and_test", part("train").join(part("test"), "model_id", "left_semi")), ("val_and_test", part("val").join(part("test"), "model_id", "left_semi")),
    ]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("predicate"), "n", (F.col("n") == 0).alias("is_empty"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def embedding_coverage(spark, d):
    v = table(spark, d, "embeddings").select(F.format_string("ACH-%06d", F.col("vec_id")).alias("row_key"))
    m = inputs.metadata(spark, d).select(F.col("model_id").alias("row_key"))
    both = m.join(v.withColumn("there", F.lit(1)), "row_key", "left")
    return both.agg(F.count("*").alias("n_models"), F.count("there").alias("n_covered"), (F.count("there") * 2 < F.count("*")).alias("warn"))


@query
def disease_coverage(spark, d):
    m = inputs.metadata(spark, d).withColumn("hit", cells.keyword_mask("small cell", F.col("disease"), F.col("subtype")))
    s = m.join(inputs.splits(spark, d), "model_id", "left")
    return s.filter("hit").groupBy(F.coalesce("lineage", F.lit("Unknown")).alias("lineage"), F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("n"))


# --- splits ---------------------------------------------------------------------


def _members(spark: SparkSession, d: str) -> DataFrame:
    return inputs.metadata(spark, d).select("model_id", group_split.group_key(F.col("patient_id"), F.col("model_id")).alias("grp"), F.col("lineage").alias("stratum"), "disease", "subtype")


@query
def group_majority_stratum(spark, d):
    return group_split.majority_stratum(_members(spark, d))


@query
def greedy_split(spark, d):
    return group_split.greedy_split(group_split.majority_stratum(_members(spark, d)))


@query
def lineage_holdout(spark, d):
    return group_split.stratum_holdout(_members(spark, d))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).join(inputs.splits(spark, d), "model_id")


@query
def split_straddlers(spark, d):
    return group_split.straddling_groups(_assigned(spark, d))


@query
def split_sizes(spark, d):
    return group_split.split_sizes(_assigned(spark, d))


@query
def split_summary(spark, d):
    return group_split.split_summary(_assigned(spark, d), cells.keyword_mask("small cell", F.col("disease"), F.col("subtype")))


@query
def group_kfold(spark, d):
    train = _assigned(spark, d).filter("split = 'train'")
    return group_split.group_folds(train.groupBy("grp").agg(F.count("*").alias("size")))


# --- imputation, scaling, linear models ------------------------------------------


def _expression_split(spark: SparkSession, d: str) -> DataFrame:
    return baselines.with_split(inputs.expression_cells(spark, d), inputs.splits(spark, d))


@query
def impute_train_mean(spark, d):
    return baselines.impute_train_mean(_expression_split(spark, d)).select("row_key", "col_key", "split", r6("imputed"))


@query
def standardize(spark, d):
    own = baselines.impute_train_mean(_expression_split(spark, d)).select("row_key", "col_key", "split", F.col("imputed").alias("value"))
    return baselines.standardize(own).select("row_key", "col_key", (r6("scaled") + 0.0).alias("scaled"))


def _samples(spark: SparkSession, d: str, features: str = "expression") -> tuple[DataFrame, DataFrame]:
    """Samples with features (imputed expression, or embeddings as they are) and targets, split and fold; and the raw targets."""
    effects = stage(inputs.effect_cells(spark, d), "effects")
    chosen = cells.selective(cells.target_statistics(effects, effects.select("row_key").distinct().count())).select("col_key")
    # tables of a row for each line or cell are merged: their files are packed so well that the optimizer would broadcast them
    splits = inputs.splits(spark, d).hint("merge")
    raw = stage(baselines.with_split(effects, splits).join(chosen, "col_key", "left_semi"), "targets")
    if features == "embeddings":
        vectors = table(spark, d, "embeddings").select(F.format_string("ACH-%06d", F.col("vec_id")).alias("row_key"), F.col("embedding").cast("array<double>").alias("x"))
        xs = baselines.with_split(vectors, splits).select("row_key", "split", "x")
    else:
        x = baselines.impute_train_mean(baselines.with_split(inputs.expression_cells(spark, d), splits))
        keep = F.array_sort(F.collect_list(F.struct(F.col("col_key").cast("long").alias("k"), F.col("imputed").alias("v"))))
        xs = x.groupBy("row_key", "split").agg(F.transform(keep, lambda s: s["v"]).alias("x"))
    targets = [r[0] for r in raw.select("col_key").distinct().orderBy(F.col("col_key").cast("long")).collect()]  # the selected targets, as the model has them
    position = F.array_position(F.array(*map(F.lit, targets)), F.col("col_key")).cast("int") - 1
    truth = raw.select("row_key", "split", position.alias("pos"), F.col("value").alias("truth"))
    mean = raw.filter("split = 'train'").groupBy("col_key").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"))
    # exactly the cells that the target arrays hold; absent ones get the training mean
    dense = grid(raw.select("row_key").distinct(), mean).join(raw.select("row_key", "col_key", "value").hint("merge"), ["row_key", "col_key"], "left").select("row_key", F.col("col_key").cast("long").alias("k"), F.coalesce("value", "mean").alias("v"))
    ys = dense.groupBy("row_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("y"))
    grp = _members(spark, d).select(F.col("model_id").alias("row_key"), "grp")
    both = stage(xs.join(ys.hint("merge"), "row_key").join(grp.hint("merge"), "row_key", "left").withColumn("grp", F.coalesce("grp", "row_key")), "unfolded")
    folds = group_split.group_folds(both.filter("split = 'train'").groupBy("grp").agg(F.count("*").alias("size"))).select("grp", "fold")
    out = both.join(folds.hint("merge"), "grp", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    return stage(out, "samples"), stage(truth, "truth")


@query
def gram_matrix(spark, d):
    """Products of the scaled training features, summed over samples in the workers."""
    from loomgrid.operators import linear

    own = baselines.impute_train_mean(_expression_split(spark, d)).select("row_key", "col_key", "split", F.col("imputed").alias("value"))
    scaled = baselines.standardize(own).filter("split = 'train'")
    names = [r[0] for r in scaled.select("col_key").distinct().orderBy(F.col("col_key").cast("long")).collect()]  # features, as the model has them
    packed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("col_key").cast("long").alias("k"), "scaled"))), lambda s: s["scaled"])
    samples = scaled.groupBy("row_key").agg(packed.alias("x")).withColumn("fold", F.lit(0)).withColumn("y", F.array().cast("array<double>"))
    by_fold = linear.moments(samples)
    rows = [(names[i], names[j], round(float(v), 4)) for m in by_fold.values() for i, r in enumerate(m.xx) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "a string, b string, product double")


def _univariate(spark: SparkSession, d: str) -> DataFrame:
    """Per target, sums of the training pairs with its own gene's expression."""
    x = inputs.expression_cells(spark, d).withColumnRenamed("value", "x")
    y = inputs.split_cells(spark, d).withColumnRenamed("value", "y")
    return y.join(x, ["row_key", "col_key"]).filter("x is not null and y is not null")


ALPHAS = [1.0, 10.0, 100.0, 1000.0]


@query
def ridge_univariate(spark, d):
    pairs = _univariate(spark, d).filter("split = 'train'")
    s = pairs.groupBy("col_key").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.avg("x")).alias("sxx"), (F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.avg("y")).alias("sxy"))
    slope = F.col("sxy") / (F.col("sxx") + 10.0)
    return s.select(F.col("col_key").alias("target"), "n", F.round(slope, 6).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), 6).alias("intercept"))


@query
def alpha_select(spark, d):
    own = stage(_univariate(spark, d), "pairs")
    pairs = own.filter("split = 'train'")
    s = pairs.groupBy("col_key").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.avg("x")).alias("sxx"), (F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.avg("y")).alias("sxy"))
    held = own.filter("split <> 'train'").join(F.broadcast(s), "col_key").withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    pred = F.col("my") + F.col("sxy") / (F.col("sxx") + F.col("alpha")) * (F.col("x") - F.col("mx"))
    scored = metrics.r_squared(held.select("alpha", F.col("col_key").alias("target"), F.col("y").alias("truth"), pred.alias("pred")), ["alpha", "target"])
    return metrics.best_alpha(scored.select("alpha", F.col("r2").alias("score"))).select("alpha", r6("score"), "chosen", "at_boundary")


def _head(spark: SparkSession, d: str, kind: str, features: str, split: str = "val") -> DataFrame:
    """One row of scores of a head on the lines of a split.

    For ``test``, alpha is chosen on the lines of ``val`` if there are five, else
    and for ``val`` itself by grouped folds of the training lines.
    """
    from loomgrid.operators import linear

    samples, truth = _samples(spark, d, features)
    truth = truth.select("row_key", "pos", "truth")
    train, val, held = (samples.filter(F.col("split") == s) for s in ("train", "val", split))
    schema = "head string, alpha double, at_boundary boolean, n_targets long, spearman_mean double, r2_mean double"
    if not baselines.task_available(train.count(), held.count()):
        return spark.createDataFrame([], schema)
    if kind == "mlp":
        fit = linear.mlp_cv(train, truth)
        preds = linear.predict_mlp(held, fit)
    else:
        components = config.PCA_COMPONENTS if kind == "ridge_pca" else None
        if split == "test" and val.count() >= config.MIN_EVAL_ROWS:
            fit = linear.ridge_by_validation(train, val, truth, components)
        else:
            fit = linear.ridge_cv(train, truth, components)
        preds = linear.predict(held.withColumn("fold", F.lit(0)), {0: (fit.projection, {fit.alpha: (fit.coef, fit.intercept)})})
    scored = stage(linear.with_truth(preds, truth).select("pos", "truth", "pred"), "scored")
    both = metrics.spearman(scored, ["pos"]).drop("n").join(metrics.r_squared(scored, ["pos"]).drop("n"), "pos")
    out = both.agg(F.count("*").alias("n_targets"), F.round(F.avg("spearman"), 4).alias("spearman_mean"), F.round(F.avg("r2"), 4).alias("r2_mean"))
    return out.select(F.lit(kind).alias("head"), F.lit(float(fit.alpha)).alias("alpha"), F.lit(bool(fit.at_boundary)).alias("at_boundary"), "n_targets", "spearman_mean", "r2_mean")


@query
def ridge_pca_cv(spark, d):
    return _head(spark, d, "ridge_pca", "expression")


@query
def ridge_pca_test(spark, d):
    return _head(spark, d, "ridge_pca", "expression", "test")


@query
def ridge_head_cv(spark, d):
    return _head(spark, d, "ridge", "embeddings")


@query
def mlp_head_cv(spark, d):
    return _head(spark, d, "mlp", "embeddings")


@query
def results_document(spark, d):
    """Scores of the mean models as a document that is written, read and compared."""
    from loomgrid.sources import matrix_io
    from loomgrid.sources.staging import shared_dir

    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}.json"
    scores = [r.asDict() for r in metrics.summary(_scores(spark, d), "score", ["model", "metric"]).orderBy("model", "metric").collect()]  # a row per model and metric
    matrix_io.save_json(spark, {"split": "val and test", "results": scores}, path)
    back = spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    return back.select("model", "metric", "mean", "n_scored", "n_undefined")


# --- counts, reports, checks ------------------------------------------------------


@query
def pseudocounts(spark, d):
    return expression_counts.pseudo_counts(inputs.expression_cells(spark, d)).select("row_key", "col_key", F.round("value", 4).alias("value"))


@query
def row_sum_median(spark, d):
    sums = cells.row_sums(expression_counts.pseudo_counts(inputs.expression_cells(spark, d)))
    sums = stage(sums, "sums")
    figures = sums.agg(F.count("*").alias("n_rows"), F.count("total").alias("n_complete"), F.count_if(F.col("total") <= 0).alias("n_not_positive"))
    return figures.join(cells.overall_median(sums, "total"), F.lit(True), "left").select("n_rows", "n_complete", F.round("median", 4).alias("median_total"), "n_not_positive")


@query
def target_matrix(spark, d):
    own = expression_counts.pseudo_counts(inputs.expression_cells(spark, d))
    labels = inputs.expression_labels(spark, d)
    by_label = own.join(gene_space.parse_labels(labels).select("entrez", "label"), F.col("col_key") == F.col("entrez")).select("row_key", F.col("label").alias("col_key"), "value")
    out, _ = expression_counts.to_targets(by_label, labels, _mapping(spark, d))
    return expression_counts.coordinates(out).select("row_key", "target", F.round("value", 4).alias("value"))


@query
def row_table(spark, d):
    out = expression_counts.row_table(expression_counts.pseudo_counts(inputs.expression_cells(spark, d)), inputs.metadata(spark, d), inputs.splits(spark, d))
    return out.withColumn("n_counts", F.round("n_counts", 4))


@query
def aligned_counts(spark, d):
    """Counts of the profiled genes for all lines of a split and all mapped genes."""
    own = stage(expression_counts.pseudo_counts(inputs.expression_cells(spark, d)), "counts")
    rows = inputs.splits(spark, d).select(F.col("model_id").alias("row_key"))
    cols = table(spark, d, "gene_id_map").select(F.col("entrez").alias("col_key"))
    return expression_counts.aligned_counts(own, rows, cols).select("row_key", "col_key", F.round("value", 4).alias("value"))


@query
def quality_checks(spark, d):
    e, c = stage(inputs.expression_cells(spark, d), "expression"), stage(inputs.effect_cells(spark, d), "effects")
    n = c.select("row_key").distinct().count()
    chosen = cells.selective(cells.target_statistics(c, n)).select("col_key")
    # the lines' effects stand for the response, too: there is no table of compounds
    response = c
    out = checks.integrity_checks(e, c, inputs.metadata(spark, d), stage(_space(spark, d), "space"), stage(chosen, "chosen"), inputs.splits(spark, d), response)
    return out.select("name", "severity", "passed", "detail")


def _sections(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The figures of each step of a build, a row each."""
    effects, meta, space = stage(inputs.effect_cells(spark, d), "effects"), inputs.metadata(spark, d), stage(_space(spark, d), "space")
    lines = shared_samples(spark, d)
    keyword = cells.keyword_mask("small cell", F.col("disease"), F.col("subtype"))
    zero = cells.all_zero_columns(inputs.expression_cells(spark, d))
    chosen = cells.selective(cells.target_statistics(effects, effects.select("row_key").distinct().count()))
    return {
        "01_expression": default_profile_filter(spark, d),
        "02_effects": effects.agg(F.countDistinct("row_key").alias("n_lines"), F.countDistinct("col_key").alias("n_genes"), F.count("value").alias("n_values")),
        "03_metadata": meta.agg(F.count("*").alias("n_models"), F.count("patient_id").alias("n_with_donor"), F.count("lineage").alias("n_with_lineage")),
        "04_response": spark.range(1).select(F.lit("absent").alias("status")),
        "05_feature_space": space.agg(F.count("*").alias("n_shared"), F.count_if("conflict").alias("n_conflicts")),
        "06_expression_features": zero.agg(F.count("*").alias("n_all_zero")),
        "07_selective_targets": selective_report(spark, d),
        "08_intersection": three_way_intersection(spark, d),
        "09_disease": meta.filter(keyword).agg(F.count("*").alias("n_models"), F.countDistinct("lineage").alias("n_lineages")),
        "10_final": lines.agg(F.count("*").alias("n_lines")).select("n_lines", F.lit(space.count()).alias("n_features"), F.lit(chosen.count()).alias("n_targets")),
    }


@query
def audit_report(spark, d):
    out = None
    for name, figures in _sections(spark, d).items():
        part = report.as_section(name, figures)
        out = part if out is None else out.unionByName(part)
    return out


@query
def schema_peek(spark, d):
    return report.schema_peek(table(spark, d, "embeddings"))
