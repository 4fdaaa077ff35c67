from pyspark.sql import functions as F

from loomgrid.functions import ids, labels


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_model_ids(spark):
    given = ["ACH-000001", " ach 1 ", "ACH_000001", "ACH‑000001\t", "ACH - 1234567", "ACH-", "ACH-TBD", "MC-000001", "CCL1170", "", None, "control?"]
    want = ["ACH-000001"] * 4 + ["ACH-1234567"] + [None] * 7
    assert column(spark, given, ids.model_id) == want


def test_donor_ids(spark):
    given = ["PT-00012", "pt 12", "PT12", "PT-0", "pt-00000", "unknown", "", None, "PT-123456"]
    assert column(spark, given, ids.donor_id) == ["PT-00012"] * 3 + [None] * 5 + ["PT-123456"]


def test_missing_words(spark):
    given = [None, "", "  ", "N/A", "(blank)", "--", "?", "Not Known", "n.k.", " ", "Lung", "Nancy", "0"]
    assert column(spark, given, ids.is_missing_text) == [True] * 10 + [False] * 3


def test_loose_bool(spark):
    given = ["True", "true ", "1", "1.0", "YES", "t", "0", "no", None]
    assert column(spark, given, ids.loose_bool) == [True] * 6 + [False] * 3


def test_plain_numbers(spark):
    given = ["1.5", " 2 ", "-.5", "3,4", "1e5", "NaN", "~4", "", None, "5."]
    assert column(spark, given, ids.plain_number) == [1.5, 2.0, -0.5, None, None, None, None, None, None, 5.0]


def test_labels(spark):
    given = ["A1BG (1)", "  HLA-A (x) (3105) ", "BADGENE", "X (abc)", None, "A(7)"]
    assert column(spark, given, labels.symbol_of) == ["A1BG", "HLA-A (x)", None, None, None, "A"]
    assert column(spark, given, labels.entrez_of) == ["1", "3105", None, None, None, "7"]
    assert column(spark, ["HLA-A (x) (3105)", "B"], labels.bare_symbol) == ["HLA-A (x)", "B"]
