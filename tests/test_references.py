from datetime import datetime as dt

from conftest import rows

from loomgrid.operators.references import orphan_references, orphan_report, parent_intervals

REFS = "table_name string, row_id long, ref_key string, ref_time timestamp"
PARENTS = "k string, since timestamp, until timestamp"


def orphans(spark, refs, parents):
    intervals = parent_intervals(spark.createDataFrame(parents, PARENTS), "k", "since", "until")
    return orphan_references(spark.createDataFrame(refs, REFS), intervals)


def test_kinds_and_ties(spark):
    parents = [("a", dt(2020, 1, 2), None), ("a", dt(2020, 1, 5), None), ("b", dt(2020, 1, 1), dt(2020, 1, 3)), (None, dt(2019, 1, 1), None)]
    refs = [
        ("t", 1, "a", dt(2020, 1, 2)),  # loaded at the same moment: valid
        ("t", 2, "a", dt(2020, 1, 1)),
        ("t", 3, "b", dt(2020, 1, 3)),  # withdrawn at the same moment
        ("t", 4, "b", dt(2020, 1, 2)),
        ("t", 5, "zzz", dt(2020, 1, 2)),
        ("t", 5, "zzz", dt(2020, 1, 2)),
        ("t", 6, None, dt(2020, 1, 2)),
        ("t", 7, "a", None),
        ("t", 8, "zzz", None),
    ]
    found = orphans(spark, refs, parents).select("row_id", "kind")
    assert rows(found) == [(2, "late"), (3, "deleted"), (5, "missing"), (5, "missing"), (8, "missing")]


def test_empty_tables(spark):
    assert rows(orphans(spark, [], [("a", dt(2020, 1, 1), None)])) == []
    assert [r["kind"] for r in orphans(spark, [("t", 1, "a", dt(2020, 1, 1))], []).collect()] == ["missing"]


def test_hot_key_and_extra_columns(spark):
    refs = [("t", i, "hot", dt(2020, 1, 1)) for i in range(500)]
    df = spark.createDataFrame(refs, REFS).selectExpr("*", "'x' as kind2", "1 as _other")
    out = orphan_references(df, parent_intervals(spark.createDataFrame([("hot", dt(2021, 1, 1), None)], PARENTS), "k", "since", "until"))
    assert out.count() == 500 and {"kind2", "_other"} <= set(out.columns)
    assert rows(orphan_report(out)) == [("t", "2020-01", "late", 500, 1)]
