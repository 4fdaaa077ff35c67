import random

import pytest

from loomgrid.llm import overlap
from loomgrid.llm.overlap import Nearness, cross_split_overlaps, near_pairs, split_sides, tiers

G = 30
NAMES = [f"g{i}" for i in range(G)]
FIELDS = ", ".join(f"{n} float" for n in NAMES)


def near(a, b, t=0.05):
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    agree = sum(round(abs(x - y), 5) <= t for x, y in both)
    return len(both) >= 15 and 5 * agree >= 4 * len(both)


def noisy(rng, v, gaps, off):
    """A near copy: ``gaps`` fields lost, ``off`` fields moved, the rest shifted within the tolerance."""
    out = [x if x is None else round(x + rng.uniform(-0.0499, 0.0499), 4) for x in v]
    for i in rng.sample(range(G), gaps):
        out[i] = None
    for i in rng.sample([i for i in range(G) if out[i] is not None] or [0], min(off, sum(x is not None for x in out))):
        out[i] = round((out[i] or 0) + rng.uniform(0.06, 3), 4)
    return out


def test_tiers_cover_all_lengths():
    found = tiers(G, Nearness())
    assert found[0].low == 0 and found[-1].high == 2 * (G - 15)
    assert all(b.low == a.high + 1 for a, b in zip(found, found[1:]))
    for t in found:
        for m in range(t.low, t.high + 1):
            assert G - Nearness().needed(max(15, G - m)) < G // t.size


@pytest.mark.parametrize("seed", [1, 2])
def test_all_near_pairs_are_found(spark, seed):
    rng = random.Random(seed)
    base = [[round(rng.gauss(4, 1.2), 4) for _ in range(G)] for _ in range(25)]
    index = [noisy(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 5, 8]), rng.choice([0, 2, 4])) for _ in range(120)]
    probes = [noisy(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 5, 8, 15, 18]), rng.choice([0, 2, 4, 6])) for _ in range(150)]
    # values on the edge of cells and of the tolerance, odd values, zeros
    index += [[0.0] * G, [0.2] * G, [1e15] * G, [None] * G, [0.05 * i for i in range(G)]]
    probes += [[0.05] * G, [0.25] * G, [1e15] * G, [None] * G, [0.05 * i + 0.05 for i in range(G)], [0.0] * 15 + [None] * 15]
    frame = lambda vs: spark.createDataFrame([(str(i), v) for i, v in enumerate(vs)], "vec_id string, vals array<double>")
    got = {(int(r[0]), int(r[1])) for r in near_pairs(frame(index), frame(probes), G).collect()}
    want = {(i, j) for i, a in enumerate(index) for j, b in enumerate(probes) if near(a, b)}
    assert got == want and len(want) > 30


def test_overlaps_of_each_kind(spark):
    v = [float(i) for i in range(G)]
    far = [50.0 + i for i in range(G)]
    sides = split_sides(spark.createDataFrame([("a", "Train "), ("a", "TEST"), ("b", "val"), ("c", "train"), ("d", "test"), ("e", None), (None, "train"), ("c", "train")], "m string, s string"), "m", "s")
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "c")], "entity string, group_entity string")
    vectors = spark.createDataFrame([("c", *v), ("d", *v), ("d", *v), ("d", *far), ("e", *v), (None, *v), ("b", *([float("nan")] * G))], f"entity string, {FIELDS}")
    got = sorted(tuple(r) for r in cross_split_overlaps(sides, groups, vectors, NAMES).collect())
    assert got == [("group", "a", "b"), ("same", "a", "a"), ("vector", "c", "d")]


def test_equal_vectors_of_many(spark):
    v = [float(i) for i in range(G)]
    sides = split_sides(spark.createDataFrame([(f"t{i:02d}", "train") for i in range(12)] + [(f"v{i:02d}", "val") for i in range(9)], "m string, s string"), "m", "s")
    vectors = spark.createDataFrame([(f"{k}{i:02d}", *v) for k, n in (("t", 12), ("v", 9)) for i in range(n)], f"entity string, {FIELDS}")
    groups = spark.createDataFrame([], "entity string, group_entity string")
    assert cross_split_overlaps(sides, groups, vectors, NAMES).count() == 108


def test_a_hot_key_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PER_TASK", 7)
    v = [float(i) for i in range(G)]
    index = [[x + 0.001 * i for x in v] for i in range(20)]
    probes = [[x - 0.001 * i for x in v] for i in range(30)]
    frame = lambda vs: spark.createDataFrame([(str(i), x) for i, x in enumerate(vs)], "vec_id string, vals array<double>")
    got = {(int(r[0]), int(r[1])) for r in near_pairs(frame(index), frame(probes), G).collect()}
    assert got == {(i, j) for i, a in enumerate(index) for j, b in enumerate(probes) if near(a, b)}
    sides = split_sides(spark.createDataFrame([(f"m{i:02d}", "train" if i % 3 else "val") for i in range(40)], "m string, s string"), "m", "s")
    groups = spark.createDataFrame([(f"m{i:02d}", "m00") for i in range(40)], "entity string, group_entity string")
    found = cross_split_overlaps(sides, groups, spark.createDataFrame([], f"entity string, {FIELDS}"), NAMES)
    assert found.count() == 14 * 26


def test_empty_tables(spark):
    sides = split_sides(spark.createDataFrame([], "m string, s string"), "m", "s")
    groups = spark.createDataFrame([], "entity string, group_entity string")
    assert cross_split_overlaps(sides, groups, spark.createDataFrame([], f"entity string, {FIELDS}"), NAMES).count() == 0
