import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgrid.operators import group_split


def test_majority_and_ties(spark):
    df = spark.createDataFrame([("g", "B"), ("g", "A"), ("h", "B"), ("h", "B"), ("h", "A"), ("i", None)], "grp string, stratum string")
    assert rows(group_split.majority_stratum(df)) == [("g", "A", 2), ("h", "B", 3), ("i", "Unknown", 1)]


def greedy(order, total, test=0.15, val=0.15):
    taken, out = [0, 0], []
    for s in order:
        for k, share in enumerate((test, val)):
            if taken[k] + s / 2 <= total * share:
                taken[k] += s
                out.append(("test", "val")[k])
                break
        else:
            out.append("train")
    return out


def test_greedy_allocation(spark):
    assert greedy([3, 1, 1, 1, 1, 1, 1, 1], 10) == ["test", "val", "val"] + ["train"] * 5
    rng = random.Random(1)
    data = [(f"g{i}", rng.choice("ab"), rng.randint(1, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "grp string, stratum string, size long")
    got = {r["grp"]: r["split"] for r in group_split.greedy_split(df).collect()}
    ordered = df.withColumn("d", F.md5(F.concat_ws("-", F.lit("0"), "grp"))).orderBy("d", "grp").collect()
    for s in "ab":
        own = [r for r in ordered if r["stratum"] == s]
        assert [got[r["grp"]] for r in own] == greedy([r["size"] for r in own], sum(r["size"] for r in own))
    assert group_split.greedy_split(df.limit(0)).count() == 0


def test_holdout_takes_whole_strata(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(10)] + [(None,)], "stratum string")
    got = [r["split"] for r in group_split.stratum_holdout(df).collect()]
    assert sorted(got) == ["test"] * 2 + ["train"] * 7 + ["val"] * 2


def test_straddlers_sizes_and_summary(spark):
    df = spark.createDataFrame([("p", "train", "A"), ("p", "test", "A"), ("q", "train", None), ("q", "train", "B")], "grp string, split string, stratum string")
    assert rows(group_split.straddling_groups(df)) == [("p", 2)]
    assert rows(group_split.split_sizes(df)) == [("test", 1, 0.25), ("train", 3, 0.75), ("val", 0, 0.0)]
    got = {r["split"]: r for r in group_split.split_summary(df, F.col("stratum") == "A").collect()}
    assert got["train"]["top_strata"] == "A=1;B=1;Unknown=1" and got["train"]["n_masked"] == 1


def test_null_patients_are_groups_of_their_own(spark):
    df = spark.createDataFrame([("m1", None, "train"), ("m2", None, "test")], "model_id string, patient_id string, split string")
    keyed = df.withColumn("grp", group_split.group_key(F.col("patient_id"), F.col("model_id")))
    assert group_split.straddling_groups(keyed).count() == 0


def test_folds_agree_with_a_loop(spark):
    rng = random.Random(3)
    sizes = {f"g{i:03d}": rng.randint(1, 9) for i in range(60)}
    got = {r["grp"]: r["fold"] for r in group_split.group_folds(spark.createDataFrame(list(sizes.items()), "grp string, size long")).collect()}
    load, want = [0] * 5, {}
    for g, s in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = load.index(min(load))
        load[f] += s
        want[g] = f
    assert got == want


def test_a_sound_assignment_is_verified_and_another_refused(spark):
    schema = "model_id string, grp string, split string"
    good = [("a", "g", "train"), ("b", "g", "train"), ("c", "h", "val"), ("d", "i", "test")]
    assert group_split.verify_splits(spark.createDataFrame(good, schema))["split_sizes"] == {"train": 2, "val": 1, "test": 1}
    for bad, what in (([*good, ("a", "g", "train")], "repeated"), ([*good, ("e", "j", "hold")], "known split"), ([*good, ("e", "h", "test")], "several splits"), (good[:3], "empty: test")):
        with pytest.raises(ValueError, match=what):
            group_split.verify_splits(spark.createDataFrame(bad, schema))
