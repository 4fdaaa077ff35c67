"""Grouped, stratified splits by greedy allocation, their checks, and grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid import config


def group_key(patient: Column, model: Column) -> Column:
    """A model without a patient is a group of its own."""
    return F.coalesce(patient, model)


def majority_stratum(members: DataFrame) -> DataFrame:
    """``grp, stratum, size``: the stratum of most members, ties by name; NULL is ``Unknown``."""
    votes = members.withColumn("stratum", F.coalesce("stratum", F.lit("Unknown"))).groupBy("grp", "stratum").agg(F.count("*").alias("n"))
    return votes.groupBy("grp").agg(F.min_by("stratum", F.struct(-F.col("n"), "stratum")).alias("stratum"), F.sum("n").alias("size"))


def _order(seed: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), F.col("grp")))


def greedy_split(groups: DataFrame, test: float = config.TEST_FRACTION, val: float = config.VAL_FRACTION, seed: str = "0") -> DataFrame:
    """``grp, stratum, size, split``: each stratum's groups in hash order go to test, then val, then train.

    A group is taken if half of it still fits the target; what is taken, and
    nothing else, fills the target.  Each decision needs the one before, so a
    stratum is one stream: its groups are sorted by Spark, which spills, and
    read batch by batch with two numbers as state.  The order is total, so a
    rerun gives the same.
    """
    from collections.abc import Iterator

    import pandas as pd

    def allocate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stratum, taken = None, {}
        for rows in batches:
            out = []
            for name_of, size, total in zip(rows["stratum"], rows["size"].tolist(), rows["total"].tolist()):
                if name_of != stratum:
                    stratum, taken = name_of, {"test": 0, "val": 0}
                for name, share in (("test", test), ("val", val)):
                    if taken[name] + size / 2 <= total * share:
                        taken[name] += size
                        out.append(name)
                        break
                else:
                    out.append("train")
            yield rows[["grp", "stratum", "size"]].assign(split=out)

    sized = groups.join(groups.groupBy("stratum").agg(F.sum("size").alias("total")), "stratum").withColumn("digest", _order(seed))
    streams = sized.repartition("stratum").sortWithinPartitions("stratum", "digest", "grp").select("grp", "stratum", "size", "total")
    return streams.mapInPandas(allocate, "grp string, stratum string, size long, split string")


def stratum_holdout(members: DataFrame, test: float = config.TEST_FRACTION, val: float = config.VAL_FRACTION, seed: str = "0") -> DataFrame:
    """``stratum, split``: whole strata are held out, at least one for test and for val."""
    strata = members.select(F.coalesce("stratum", F.lit("Unknown")).alias("stratum")).distinct().withColumn("grp", F.col("stratum"))
    w = W.orderBy(_order(seed), "stratum")  # one row per stratum
    ranked = strata.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy()))
    n_test, n_val = (F.greatest(F.lit(1), F.bround(F.col("n") * x)) for x in (test, val))
    return ranked.select("stratum", F.when(F.col("r") <= n_test, "test").when(F.col("r") <= n_test + n_val, "val").otherwise("train").alias("split"))


def straddling_groups(assigned: DataFrame) -> DataFrame:
    """``grp, n_splits`` of groups in more than one split; needs ``grp, split``."""
    return assigned.groupBy("grp").agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def verify_splits(assigned: DataFrame) -> dict:
    """Figures of a sound assignment (``model_id, grp, split``); a ValueError names what is wrong with another."""
    names = ["train", "val", "test"]
    row = assigned.agg(
        F.count("*").alias("n"), F.countDistinct("model_id").alias("k"), F.count_if(~F.coalesce(F.col("split").isin(names), F.lit(False))).alias("odd"),
        *[F.count_if(F.col("split") == s).alias(s) for s in names],
    ).first()
    if row["n"] != row["k"]:
        raise ValueError(f"{row['n'] - row['k']} repeated models")
    if row["odd"]:
        raise ValueError(f"{row['odd']} models without a known split")
    torn = straddling_groups(assigned).orderBy("grp").limit(5).collect()
    if torn:
        raise ValueError(f"groups in several splits, as {', '.join(r['grp'] for r in torn)}")
    if empty := [s for s in names if not row[s]]:
        raise ValueError(f"empty: {', '.join(empty)}")
    return {"all_assigned": True, "disjoint": True, "groups_straddling": 0, "split_sizes": {s: row[s] for s in names}}


def split_sizes(assigned: DataFrame) -> DataFrame:
    """``split, n, fraction`` for train, val and test, the empty ones too."""
    spark = assigned.sparkSession
    every = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    counts = assigned.groupBy("split").agg(F.count("*").alias("n"))
    out = every.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("fraction", F.round(F.col("n") / F.expr("nullif(sum(n) over (), 0)"), 4))


def split_summary(assigned: DataFrame, mask: Column, top: int = 5) -> DataFrame:
    """Per split: members, fraction, strata, the largest strata and how many match ``mask``; needs ``split, stratum``."""
    assigned = assigned.withColumn("stratum", F.coalesce("stratum", F.lit("Unknown"))).withColumn("_mask", mask)
    per = assigned.groupBy("split", "stratum").agg(F.count("*").alias("n"), F.count_if("_mask").alias("m"))
    ranked = per.withColumn("_r", F.row_number().over(W.partitionBy("split").orderBy(F.desc("n"), "stratum")))
    named = F.concat_ws("=", "stratum", F.col("n").cast("string"))
    out = ranked.groupBy("split").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_strata"), F.sum("m").alias("n_masked"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", named.alias("t"))))), lambda x: x["t"]), ";").alias("top_strata"),
    )
    return out.withColumn("fraction", F.round(F.col("n") / F.expr("sum(n) over ()"), 4))


def group_folds(groups: DataFrame, folds: int = config.CV_FOLDS) -> DataFrame:
    """``grp, size, fold``: the largest group first, each to the lightest fold, ties by lowest fold and name.

    Each decision needs the one before: the groups are sorted by Spark and read
    as one stream, batch by batch, with one number a fold as state.
    """
    from collections.abc import Iterator

    import pandas as pd

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = [0] * folds
        for rows in batches:
            out = []
            for size in rows["size"].tolist():
                at = load.index(min(load))
                load[at] += size
                out.append(at)
            yield rows.assign(fold=out)

    stream = groups.select("grp", F.col("size").cast("long").alias("size")).repartition(1).sortWithinPartitions(F.desc("size"), "grp")
    return stream.mapInPandas(deal, "grp string, size long, fold int")
