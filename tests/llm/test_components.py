import random

import pytest

from loomgrid.llm.components import connected_components
from loomgrid.llm.splits import entity_groups, grouped_splits


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    groups = {}
    for x in parent:
        groups.setdefault(root(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def components(spark, edges):
    out = connected_components(spark.createDataFrame(edges, "a string, b string"))
    found = [(r["vertex"], r["component"]) for r in out.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randint(0, 120):03d}", f"v{rng.randint(0, 120):03d}") for _ in range(80)]
    assert components(spark, edges) == brute(edges)


def test_chain_star_and_copies(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"leaf{i:03d}") for i in range(200)] + [("x", "x"), (None, "y"), ("q", "r"), ("r", "q"), ("q", "r")]
    assert components(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert components(spark, []) == {}
    assert components(spark, [("a", "a")]) == {}


MEMBERS = "model string, donor string, model2 string"


def test_groups_through_chains(spark):
    data = [("m1", "p1", ""), ("m2", "p1", ""), ("m2", "p2", ""), ("m3", "p2", ""), ("m4", None, ""), ("m5", "m4", ""), (None, "p1", ""), ("m1", "p1", "")]
    got = {r["entity"]: r["group_entity"] for r in entity_groups(spark.createDataFrame(data, MEMBERS), "model", "donor").collect()}
    # a donor spelled like a model ties nothing to that model
    assert got == {"m1": "m1", "m2": "m1", "m3": "m1", "m4": "m4", "m5": "m5"}
    assert entity_groups(spark.createDataFrame([], MEMBERS), "model", "donor").count() == 0


SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def split(spark, groups, strata):
    g = spark.createDataFrame(groups, "entity string, group_entity string")
    s = spark.createDataFrame(strata, "entity string, stratum string")
    return {r["entity"]: r["split"] for r in grouped_splits(g, s, SHARES).collect()}


def test_proportions_hold_overall_and_per_stratum(spark):
    rng = random.Random(5)
    groups, strata = [], []
    for i in range(900):
        size = rng.choice([1, 1, 1, 2, 3])
        stratum = rng.choice(["a", "a", "a", "b", "c"])
        for j in range(size):
            groups.append((f"e{i}-{j}", f"e{i}-0"))
            strata.append((f"e{i}-{j}", stratum))
    groups += [(f"big{j}", "big0") for j in range(500)]
    strata += [(f"big{j}", "b") for j in range(500)]
    got = split(spark, groups, strata)
    assert len(got) == len(groups)
    by_group = {}
    for e, g in groups:
        by_group.setdefault(g, set()).add(got[e])
    assert all(len(s) == 1 for s in by_group.values())
    where = dict(strata)
    for name, share in SHARES.items():
        assert abs(sum(s == name for s in got.values()) / len(got) - share) < 0.02
        own = [got[e] for e, s in where.items() if s == "a"]
        assert abs(sum(s == name for s in own) / len(own) - share) < 0.02


def test_many_small_strata_still_give_every_split(spark):
    groups = [(f"e{i}", f"e{i}") for i in range(60)]
    got = split(spark, groups, [(f"e{i}", f"s{i // 3}") for i in range(60)])
    assert [sum(s == n for s in got.values()) for n in SHARES] == [48, 6, 6]


def test_missing_strata_and_empty_tables(spark):
    assert set(split(spark, [("a", "a")], [("a", None)])) == {"a"}
    assert split(spark, [], []) == {}
