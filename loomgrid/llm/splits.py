"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.llm.components import connected_components
from loomgrid.operators.lookup import salted_lookup


def entity_groups(members: DataFrame, entity: str, owner: str) -> DataFrame:
    """``entity, group_entity``: entities tied by owners, directly or through a chain.

    One row per distinct non-null entity; ``group_entity`` is the smallest of
    its group, the entity itself if nothing ties it to another.  A NULL owner
    ties nothing.  Owners never clash with entities of the same spelling.
    """
    ties = members.filter(F.col(entity).isNotNull() & F.col(owner).isNotNull()).select(F.concat(F.lit("e:"), F.col(entity)).alias("a"), F.concat(F.lit("o:"), F.col(owner)).alias("b"))
    found = connected_components(ties).filter(F.col("vertex").startswith("e:"))
    # "e:" sorts before "o:", so the smallest vertex is an entity
    tied = found.select(F.substring("vertex", 3, 1 << 30).alias("entity"), F.substring("component", 3, 1 << 30).alias("group_entity"))
    every = members.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity")).distinct()
    return every.join(tied, "entity", "left").select("entity", F.coalesce("group_entity", "entity").alias("group_entity"))


def grouped_splits(groups: DataFrame, strata: DataFrame, proportions: dict[str, float], seed: str = "0") -> DataFrame:
    """``entity, group_entity, split``: all of a group in one split, proportions met overall and per stratum.

    ``groups`` as :func:`entity_groups` gives them; ``strata`` has ``entity,
    stratum`` (an entity without one, or with NULL, is in stratum ``unknown``).
    A group belongs to the stratum of most of its entities, ties by name.

    Groups stand in the order of a hash, those heavier than the smallest
    split's share first, and the running weight decides: each stratum is cut
    where its splits' quotas end, a group going where its middle lies.  Quotas
    are rounded on the sums over strata, so rounding does not pile up in small
    ones.  The first split of ``proportions`` takes what the others leave.
    Running sums are taken over 4,096 hash ranges first and then within each, so
    no task holds a stratum.  An empty table gives no rows.
    """
    names = list(proportions)
    total = sum(proportions.values())
    share = {s: p / total for s, p in proportions.items()}
    least = min(share[s] for s in names[1:]) if len(names) > 1 else 1.0
    members = groups.join(strata.select("entity", "stratum"), "entity", "left").withColumn("stratum", F.coalesce("stratum", F.lit("unknown")))
    votes = members.groupBy("group_entity", "stratum").agg(F.count("*").alias("n"))
    whole = votes.groupBy("group_entity").agg(F.sum("n").alias("weight"), F.min_by("stratum", F.struct(-F.col("n"), "stratum")).alias("stratum"))

    sums = whole.groupBy("stratum").agg(F.sum("weight").alias("all"))
    before = F.coalesce(F.sum("all").over(W.orderBy("stratum").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_s", before)  # one row per stratum, few however many groups
    for s in names[1:]:
        sums = sums.withColumn(f"quota_{s}", F.round(F.lit(share[s]) * (F.col("_s") + F.col("all"))) - F.round(F.lit(share[s]) * F.col("_s")))
    sums = F.broadcast(sums.drop("_s"))

    digest = F.md5(F.concat_ws("-", F.lit(seed), "group_entity"))
    placed = whole.join(sums, "stratum").withColumn("digest", digest)
    heavy = F.col("weight") > F.greatest(F.lit(1.0), F.lit(least) * F.col("all"))
    placed = placed.withColumn("range", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int") + F.when(heavy, 0).otherwise(4096))
    ranges = placed.groupBy("stratum", "range").agg(F.sum("weight").alias("_w"))
    upto = W.partitionBy("stratum").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("stratum", "range", F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_before"))
    inside = W.partitionBy("stratum", "range").orderBy("digest", "group_entity").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.join(ranges, ["stratum", "range"]).withColumn("middle", F.col("_before") + F.sum("weight").over(inside) - F.col("weight") / 2)
    end, split = F.col("all"), F.lit(names[0])
    for s in reversed(names[1:]):
        start = end - F.col(f"quota_{s}")
        split = F.when((F.col("middle") >= start) & (F.col("middle") < end), F.lit(s)).otherwise(split)
        end = start
    placed = placed.select("group_entity", split.alias("split"))
    return salted_lookup(groups, placed, "group_entity", "entity").select("entity", "group_entity", "split")
