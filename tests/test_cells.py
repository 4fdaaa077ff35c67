from conftest import rows
from pyspark.sql import functions as F

from loomgrid.operators import cells
from loomgrid.operators.baselines import impute_train_mean, predict_means, standardize, task_available

LONG = "row_key string, col_key string, value double"


def long(spark, data):
    return spark.createDataFrame(data, LONG)


def test_keep_first_by_order_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(2, "a", "late"), (1, "a", None), (1, "a", None), (3, None, "x"), (4, "b", "y")], "o int, k string, v string")
    assert rows(cells.keep_first(df, ["k"], "o")) == [(1, "a", None), (3, None, "x"), (4, "b", "y")]
    assert cells.keep_first(df.limit(0), ["k"], "o").count() == 0
    assert rows(cells.duplicate_keys(df, "k")) == [("a", 3)]


def test_target_selection(spark):
    n = 10
    data = [(f"r{i}", "edge", -1.0 if i < 9 else 0.0) for i in range(n)] + [(f"r{i}", "all", -1.0) for i in range(n)]
    data += [(f"r{i}", "gap", -1.0 if i < 5 else 0.0) for i in range(9)] + [("r9", "gap", None)]
    data += [(f"r{i}", "at", -0.5) for i in range(n)] + [(f"r{i}", "five", -1.0 if i < 5 else 0.0) for i in range(n)]
    stats = cells.target_statistics(long(spark, data), n)
    got = {r["col_key"]: r for r in stats.collect()}
    assert abs(got["gap"]["missing_share"] - 0.1) < 1e-12 and got["gap"]["dependent_share"] == 0.5
    assert got["at"]["n_dependent"] == 0
    assert [r["col_key"] for r in cells.selective(stats).orderBy("col_key").collect()] == ["edge", "five"]
    assert cells.exclusion_report(stats).first().asDict() == {"considered": 5, "excluded_too_many_missing": 1, "excluded_never_dependent": 1, "excluded_always_dependent": 1, "excluded_low_variance": 2, "kept": 2}


def test_absent_cells_are_missing(spark):
    got = cells.target_statistics(long(spark, [("r1", "c", -1.0)]), 4).first()
    assert got["missing_share"] == 0.75 and got["dependent_share"] == 0.25


def test_zero_and_flat_columns(spark):
    data = [("a", "z", 0.0), ("b", "z", None), ("a", "y", 0.0), ("b", "y", 0.1), ("a", "n", None)]
    assert rows(cells.all_zero_columns(long(spark, data))) == [("n",), ("z",)]
    assert rows(cells.low_variance_columns(long(spark, [("a", "c", 1.0), ("b", "c", 1.0), ("a", "d", 1.0), ("b", "d", 5.0)]), 0.5)) == [("c", 0.0)]


def test_masks_clip_and_sums(spark):
    df = spark.createDataFrame([(None, "OsteoSarcoma x"), ("Bone", None), (None, None)], "d string, s string")
    assert [r[0] for r in df.select(cells.keyword_mask("osteosarcoma", F.col("d"), F.col("s"))).collect()] == [True, False, False]
    v = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in v.select(cells.clip_low(F.col("v"))).collect()] == [0.0, 2.0, None]
    sums = {r[0]: r[1] for r in cells.row_sums(long(spark, [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", None), ("b", "y", 2.0)])).collect()}
    assert sums == {"a": 3.0, "b": None}
    assert rows(cells.empty_rows(long(spark, [("a", "x", None), ("b", "x", 1.0)]))) == [("a",)]


def test_orientation_and_text_columns(spark):
    data = [("rows", f"ACH-{i:06d}", i) for i in range(60)] + [("cols", "BRD-1", 0), ("cols", "BRD-2", 1), ("one", "ACH-1", 0)]
    got = {r["axis"]: r["is_key"] for r in cells.orientation(spark.createDataFrame(data, "axis string, label string, o int"), "axis", "label", "o").collect()}
    assert got == {"rows": True, "cols": False, "one": True}
    raw = spark.createDataFrame([("a", "x", "1.5"), ("b", "x", "NA"), ("a", "y", "abc"), ("b", "y", "2"), ("a", "z", None)], "row_key string, col_key string, raw string")
    assert rows(cells.non_numeric_columns(raw)) == [("y", 1)]


def test_keep_list(spark):
    df = spark.createDataFrame([(1, 2)], "a int, B int")
    kept, gone = cells.keep_list(df, ["b", "c"])
    assert kept.columns == ["B"] and gone == ["c"]


SPLIT = "row_key string, col_key string, value double, split string, lineage string"


def test_means_fall_back(spark):
    data = [("t1", "g", 1.0, "train", "A"), ("t2", "g", 3.0, "train", "B"), ("t3", "h", None, "train", "A"), ("v1", "g", 0.0, "val", "A"), ("v2", "g", 0.0, "val", "new"), ("v3", "h", 1.0, "test", "A")]
    got = {r["row_key"]: (r["global_pred"], r["lineage_pred"]) for r in predict_means(spark.createDataFrame(data, SPLIT)).collect()}
    assert got == {"v1": (2.0, 1.0), "v2": (2.0, 2.0), "v3": (0.0, 0.0)}


def test_impute_and_scale(spark):
    inf = float("inf")
    data = [("t1", "g", 1.0, "train", ""), ("t2", "g", None, "train", ""), ("t3", "g", 3.0, "train", ""), ("v", "g", None, "val", ""), ("w", "g", inf, "val", ""), ("v", "h", None, "val", "")]
    got = {(r["row_key"], r["col_key"]): r["imputed"] for r in impute_train_mean(spark.createDataFrame(data, SPLIT)).collect()}
    assert got[("t2", "g")] == got[("v", "g")] == got[("w", "g")] == 2.0 and got[("v", "h")] == 0.0
    flat = [("t1", "c", 5.0, "train", ""), ("t2", "c", 5.0, "train", ""), ("v", "c", 7.0, "val", ""), ("t1", "d", 1.0, "train", ""), ("t2", "d", 3.0, "train", "")]
    scaled = {(r["row_key"], r["col_key"]): r["scaled"] for r in standardize(spark.createDataFrame(flat, SPLIT)).collect()}
    assert scaled[("v", "c")] == 2.0 and scaled[("t1", "d")] == -1.0
    assert not task_available(9, 5) and not task_available(10, 4) and task_available(10, 5)
