"""Connected components by random-mate contraction in SQL joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.lookup import salted_lookup
from loomgrid.sources.staging import release, stage


def _toss(vertex: Column, turn: int) -> Column:
    return F.xxhash64(vertex, F.lit(turn))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``vertex, component`` for every vertex of an edge; ``component`` is the smallest vertex.

    ``pairs`` has ``a, b`` of one orderable type.  Edges with a NULL end and
    loops are no edges; repeated and reversed edges count once; no edges, no
    rows.

    In each round every vertex tosses a coin of 64 bits, drawn anew from round
    and vertex.  A vertex that a neighbour beats collapses into the neighbour
    with the lowest toss; the others stay.  The edges are renamed after the
    vertices they collapsed into, and loops vanish.  With so many sides to the
    coin no edge is undecided, so the graph shrinks by a constant factor each
    round.  When no edge is left, the collapses are unwound from the last round
    to the first.  Every table is written to the shared folder, so a lost
    executor costs one round, and neighbours of a hub are combined before the
    shuffle and renamed in salted joins.
    """
    edges = stage(_edges(pairs.select("a", "b").filter("a is not null and b is not null")), "edges")
    collapses: list[DataFrame] = []
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = ends.groupBy("u").agg(F.min(F.struct(_toss(F.col("v"), turn).alias("toss"), F.col("v").alias("mate"))).alias("low"))
        own = F.struct(_toss(F.col("u"), turn).alias("toss"), F.col("u").alias("mate"))
        mates = stage(lowest.select("u", F.when(own < F.col("low"), F.col("u")).otherwise(F.col("low.mate")).alias("mate")), f"mates-{turn}")
        collapses.append(mates)
        renamed = salted_lookup(edges, mates.select(F.col("u").alias("a"), F.col("mate").alias("a2")), "a", "b")
        renamed = salted_lookup(renamed, mates.select(F.col("u").alias("b"), F.col("mate").alias("b2")), "b", "a")
        fewer = stage(_edges(renamed.select(F.col("a2").alias("a"), F.col("b2").alias("b"))), f"edges-{turn}")
        release(edges)
        edges = fewer
    else:
        raise RuntimeError("contraction did not end")
    if not collapses:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    labels = collapses[-1].select(F.col("u").alias("vertex"), F.col("mate").alias("label"))
    for mates in reversed(collapses[:-1]):
        later = labels.select(F.col("vertex").alias("mate"), F.col("label"))
        labels = salted_lookup(mates, later, "mate", "u").select(F.col("u").alias("vertex"), F.coalesce("label", "mate").alias("label"))
    labels = stage(labels, "labels")
    names = labels.groupBy("label").agg(F.min("vertex").alias("component"))
    return salted_lookup(labels, names, "label", "vertex").select("vertex", "component")
