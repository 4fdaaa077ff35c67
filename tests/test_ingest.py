import pytest

from loomgrid.operators import report
from loomgrid.operators.lookup import grid
from loomgrid.plans.ingest_queries import task_targets


def test_tasks():
    assert task_targets("crispr", "cells", None) == "cells" and task_targets("prism", "cells", None) is None
    with pytest.raises(ValueError, match="unknown task"):
        task_targets("other", "cells", None)


def test_columns_side_by_side_and_first_examples(spark):
    a = spark.createDataFrame([(5, "x"), (1, "y"), (9, "z")], "o long, a string")
    b = spark.createDataFrame([(7, "p"), (2, "q")], "o long, b string")
    assert sorted((r["a"], r["b"]) for r in report.concat_columns(a, b, "o").collect()) == [("x", "p"), ("y", "q"), ("z", None)]
    assert report.first_examples(a, "a", 2).first().asDict() == {"n": 3, "examples": "x, y"}
    assert report.first_examples(a.limit(0), "a", 2).first()["n"] == 0


def test_grid(spark):
    rows, columns = spark.createDataFrame([("a",), ("b",)], "row_key string"), spark.createDataFrame([("x",), ("y",), ("z",)], "col_key string")
    assert grid(rows, columns).distinct().count() == 6
    assert grid(rows, columns.limit(0)).count() == 0
