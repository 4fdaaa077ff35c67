"""Queries of the training-data problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions.ids import donor_id, model_id, plain_number
from loomgrid.llm.overlap import cross_split_overlaps, split_sides
from loomgrid.llm.splits import entity_groups, grouped_splits
from loomgrid.llm.textstats import OF_KINDS, judge, other_than_prose, text_statistics
from loomgrid.plans.general_queries import gene_columns, model_lineage
from loomgrid.sources.staging import stage
from loomgrid.sources.tables import table

CAPACITY = 2048
PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def model_groups(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "depmap_model").select(model_id(F.col("modelid")).alias("model"), donor_id(F.col("patientid")).alias("donor"))
    return entity_groups(members, "model", "donor")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = stage(model_groups(spark, d), "groups")
    several = groups.groupBy("group_entity").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.join(several, "group_entity", "left_semi").select(F.col("entity").alias("modelid"), F.col("group_entity").alias("group_modelid"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    strata = model_lineage(spark, d).select(F.col("model_key").alias("entity"), F.col("lineage").alias("stratum"))
    done = grouped_splits(stage(model_groups(spark, d), "groups"), strata, PROPORTIONS)
    return done.select(F.col("entity").alias("modelid"), F.col("group_entity").alias("group_modelid"), "split")


def _sides(spark: SparkSession, d: str) -> DataFrame:
    return stage(split_sides(table(spark, d, "split_assignment").withColumn("model", model_id(F.col("modelid"))), "model", "split"), "sides")


def _overlaps(spark: SparkSession, d: str, sides: DataFrame) -> DataFrame:
    profiles = table(spark, d, "expression_profile")
    genes = gene_columns(profiles)
    kinds = dict(profiles.dtypes)
    vectors = profiles.select(model_id(F.col("modelid")).alias("entity"), *[(plain_number(F.col(g)) if kinds[g] == "string" else F.col(g)).alias(g) for g in genes])
    found = cross_split_overlaps(sides, model_groups(spark, d), vectors, genes)
    kind = F.when(F.col("overlap") == "same", "model").when(F.col("overlap") == "group", "donor").otherwise("profile")
    return found.select(kind.alias("overlap"), F.col("a").alias("modelid_a"), F.col("b").alias("modelid_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d, _sides(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation models with an overlap, per kind, split and centre that profiled them."""
    sides = _sides(spark, d)
    found = _overlaps(spark, d, sides)
    ends = found.select("overlap", F.explode(F.array_distinct(F.array("modelid_a", "modelid_b"))).alias("entity"))
    held = ends.join(sides.filter("side = 'eval'").select("entity", "split"), "entity").distinct()
    loads = table(spark, d, "load_batch").filter("table_name = 'expression_profile'").select("load_id", "centre")
    made = table(spark, d, "expression_profile").select(model_id(F.col("modelid")).alias("entity"), "load_id").join(F.broadcast(loads), "load_id").select("entity", "centre").distinct()
    return held.join(made, "entity", "left").groupBy("overlap", "split", F.coalesce("centre", F.lit("none")).alias("centre")).agg(F.countDistinct("entity").alias("n_models"))


# what needs NumPy or pandas is imported where it is used, to keep other queries' drivers small


def _packed(spark: SparkSession, d: str) -> DataFrame:
    from loomgrid.llm.packing import pack, token_counts

    sizes = token_counts(table(spark, d, "documents")).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))
    return pack(sizes, CAPACITY)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(F.col("item_id").alias("doc_id"), "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    from loomgrid.llm.packing import fill_report

    return fill_report(_packed(spark, d), CAPACITY)


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What any packing must keep, as one row."""
    packed = stage(_packed(spark, d), "packing")
    per_item = packed.groupBy("item_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"), F.countDistinct("piece").alias("k"), F.max("piece").alias("last"))
    boxes = packed.groupBy("container").agg(F.sum("size").alias("fill"))
    used = boxes.agg((F.max("fill") <= CAPACITY).alias("none_overfull"), (F.count("*") <= F.ceil(F.sum("fill") / CAPACITY * 1.01)).alias("within_1_percent_of_least")).first().asDict()
    fewest = F.greatest(F.lit(1), F.ceil(F.col("tokens") / CAPACITY))
    whole = per_item.agg(F.count("*").alias("n_documents"), F.bool_and((F.col("n") == fewest) & (F.col("k") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("divided_only_beyond_capacity"))
    return whole.select("*", *[F.lit(v).alias(c) for c, v in used.items()])


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    from loomgrid.llm.leakage import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the documents that hold them, by suite and side."""
    items = F.broadcast(table(spark, d, "heldout_item").select("item_id", "suite", "side"))
    return _leaks(spark, d).join(items, "item_id").groupBy("suite", "side", "item_id").agg(F.count("*").alias("n_documents"), F.round(F.max("held"), 6).alias("most_held"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return other_than_prose(judge(text_statistics(_documents(spark, d), only=OF_KINDS), published=False), "doc_id")


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    shares = ["mean_word_length", "symbol_share", "punctuated_share", "common_share"]
    stats = text_statistics(_documents(spark, d), only=["n_words", *shares])
    return stats.select("doc_id", F.col("stats.n_words").cast("long").alias("n_words"), *[F.round(F.col(f"stats.{c}"), 6).alias(c) for c in shares])


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    return judge(text_statistics(_documents(spark, d))).select("doc_id", "kind", "failures")


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p5_found": p5_found, "p5_report": p5_report, "p7_containers": p7_containers, "p7_report": p7_report, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_report": p8_report, "p9_found": p9_found, "p9_stats": p9_stats, "p9_judged": p9_judged}
