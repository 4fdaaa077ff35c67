from conftest import rows

from loomgrid.operators import gene_space
from loomgrid.operators.expression_counts import aligned_counts, coordinates, pseudo_counts, to_targets

LABELS = "label string, pos long"


def labels(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], LABELS)


def test_intersection_in_numeric_order_with_conflicts(spark):
    a = labels(spark, ["A (10)", "B (9)", "C (100)", "OLD (7)", "B2 (9)", "bad", None])
    b = labels(spark, ["C (100)", "A (10)", "NEW (7)", "B (9)", "D (11)"])
    got = gene_space.intersect(a, b).orderBy("pos").collect()
    assert [(r["entrez"], r["symbol"], r["conflict"]) for r in got] == [("7", "OLD", True), ("9", "B", False), ("10", "A", False), ("100", "C", False)]
    assert got[1]["canonical"] == "B (9)" and got[1]["label_a"] == "B (9)"
    assert rows(gene_space.only_in(b, a)) == [("11",)]
    assert gene_space.intersect(a.limit(0), b).count() == 0


def test_external_columns(spark):
    space = spark.createDataFrame([(0, "1", "A"), (1, "2", "B"), (2, "3", "C")], "pos int, entrez string, symbol string")
    matched = gene_space.match_external(labels(spark, ["B", "1", "A (1)"]), space)
    assert rows(matched.select("pos", "label", "tier")) == [(0, "1", 1), (1, "B", 2), (2, None, None)]
    # a symbol with another gene's number is another gene
    other = gene_space.match_external(labels(spark, ["A (999)", "B (7)", " B ", "C (3) x"]), space)
    assert rows(other.select("pos", "label", "tier")) == [(0, None, None), (1, " B ", 2), (2, None, None)]
    cells = spark.createDataFrame([("s", "1", 5.0), ("s", "B", None), ("s", "A (1)", 9.0)], "row_key string, col_key string, value double")
    assert rows(gene_space.remap(cells, matched).select("row_key", "entrez", "value")) == [("s", "1", 5.0), ("s", "2", None), ("s", "3", 0.0)]


def test_lookup_chain(spark):
    own = labels(spark, ["S1 (1)", "S2 (2)", "S3 (3)", "S4 (4)", "junk"])
    mapping = spark.createDataFrame([("1", "E1"), ("2", "E1"), ("3", "E3"), ("3", "E9")], "entrez string, target string")
    assert rows(gene_space.lookup_chain(own, mapping).select("target", "entrez")) == [("E1", "1"), ("E3", "3")]
    cells = spark.createDataFrame([("r", f"S{i} ({i})", float(i)) for i in range(1, 5)], "row_key string, col_key string, value double")
    out, report = to_targets(cells, own, mapping)
    assert rows(out) == [("r", "E1", 1.0), ("r", "E3", 3.0)]
    assert report.first().asDict() == {"n_unmapped": 2, "n_mapped": 3, "n_targets": 2}


def test_counts(spark):
    cells = spark.createDataFrame([("r", "a", 0.0), ("r", "b", 3.0), ("r", "c", None), ("r", "d", -1.0)], "row_key string, col_key string, value double")
    counts = pseudo_counts(cells)
    assert rows(counts) == [("r", "a", 0.0), ("r", "b", 7.0), ("r", "c", None), ("r", "d", 0.0)]
    assert rows(coordinates(counts).select("col_key")) == [("b",), ("c",)]
    wanted_rows = spark.createDataFrame([("r",), ("q",)], "row_key string")
    wanted_cols = spark.createDataFrame([("b",), ("z",)], "col_key string")
    assert rows(aligned_counts(counts, wanted_rows, wanted_cols)) == [("q", "b", None), ("q", "z", None), ("r", "b", 7.0), ("r", "z", 0.0)]
