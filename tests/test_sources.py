import json

import pytest
from conftest import rows

from loomgrid.operators.cells import keep_first
from loomgrid.sources import matrix_io, resolver, wide_text
from loomgrid.sources.staging import release, shared_dir, stage


def test_wide_matrix(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('"",ModelID,A (1),B (2),note,Unnamed: 5\n0,ACH-000001,1.5,NA,x,9\n1,ACH-000002,,2,,9\n2,ACH-000001,7,8,y,9\n')
    raw, labels = wide_text.read_wide(spark, str(path), "ModelID", drop=[])
    assert labels == ["A (1)", "B (2)", "note"]
    cells = wide_text.numeric_cells(raw)
    assert rows(keep_first(cells, ["row_key", "col_key"], "ord").select("row_key", "col_key", "value")) == [
        ("ACH-000001", "A (1)", 1.5), ("ACH-000001", "B (2)", None), ("ACH-000002", "A (1)", None), ("ACH-000002", "B (2)", 2.0),
    ]
    assert wide_text.read_wide(spark, str(path), "ModelID", rows=1)[0].select("row_key").distinct().count() == 1
    with pytest.raises(KeyError):
        wide_text.read_wide(spark, str(path), "Nope")


def test_first_column_is_the_key_whatever_its_header(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",A (1)\nACH-000001,1\n")
    raw, labels = wide_text.read_wide(spark, str(path))
    assert labels == ["A (1)"] and raw.first()["row_key"] == "ACH-000001"


def test_many_columns(spark, tmp_path):
    path = tmp_path / "w.csv"
    n = 5000
    path.write_text("," + ",".join(f"G{i} ({i})" for i in range(n)) + "\n" + "\n".join(f"ACH-{r}," + ",".join(str(i) for i in range(n)) for r in range(3)) + "\n")
    raw, labels = wide_text.read_wide(spark, str(path))
    cells = wide_text.numeric_cells(raw)
    assert len(labels) == n and cells.count() == 3 * n and cells.filter("value <> col_pos").count() == 0


def test_metadata(spark, tmp_path):
    path = tmp_path / "Model.csv"
    path.write_text('ModelID,PatientID,OncotreeLineage,Extra\nACH-1,"PT, 1",NA,x\n')
    df, missing = wide_text.read_metadata(spark, str(path))
    assert df.first()["PatientID"] == "PT, 1" and df.first()["OncotreeLineage"] is None and "Sex" in missing


def test_resolver(spark, tmp_path, monkeypatch):
    (tmp_path / "CRISPRGeneEffect_v2.csv").write_text("x")
    assert resolver.resolve_file(spark, "crispr", str(tmp_path)).endswith("CRISPRGeneEffect_v2.csv")
    (tmp_path / "CRISPRGeneEffect.csv").write_text("x")
    assert resolver.resolve_file(spark, "crispr", str(tmp_path)).endswith("CRISPRGeneEffect.csv")
    assert resolver.resolve_file(spark, "prism_matrix", str(tmp_path), required=False) is None
    with pytest.raises(FileNotFoundError, match="CRISPRGeneEffect.csv"):
        resolver.resolve_file(spark, "model", str(tmp_path))
    with pytest.raises(KeyError):
        resolver.resolve_file(spark, "nothing", str(tmp_path), required=False)
    monkeypatch.setenv("LOOMGRID_DATA_DIR", str(tmp_path))
    assert resolver.data_dir() == str(tmp_path)


def test_matrices_tables_and_splits(spark, tmp_path):
    cells = spark.createDataFrame([("a", "x", 1.5), ("a", "y", None), ("a", "z", 0.0)], "row_key string, col_key string, value double")
    matrix_io.save_matrix(cells, str(tmp_path / "m"))
    back = matrix_io.load_matrix(spark, str(tmp_path / "m"))
    assert dict(back.dtypes)["value"] == "float" and back.count() == 3
    matrix_io.save_table(cells, str(tmp_path / "t"), "csv")
    assert matrix_io.load_table(spark, str(tmp_path / "t")).count() == 3
    matrix_io.save_splits(spark.createDataFrame([("b", "val"), ("a", "train")], "model_id string, split string"), str(tmp_path / "s.json"))
    assert list(json.loads((tmp_path / "s.json").read_text())["assignment"]) == ["a", "b"]
    assert rows(matrix_io.load_splits(spark, str(tmp_path / "s.json"))) == [("a", "train"), ("b", "val")]
    matrix_io.save_components(cells, cells.select("row_key"), cells.select("col_key"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h/X")).count() == 1
    spark.createDataFrame([("a", 1.0, 2.0, "t")], "ModelID string, d0 double, d1 double, note string").write.parquet(str(tmp_path / "e"))
    assert matrix_io.load_embeddings(spark, str(tmp_path / "e")).first()["x"] == [1.0, 2.0]
    spark.createDataFrame([("a", "t")], "ModelID string, note string").write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError):
        matrix_io.load_embeddings(spark, str(tmp_path / "n"))


def test_quoted_fields_and_several_files(spark, tmp_path):
    folder = tmp_path / "q.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text('ModelID,"A, b (1)",flag,C (2)\nACH-1,"1",yes,"2"\n"ACH,2",3,"no ""way""",\n')
    (folder / "part-1.csv").write_text('ModelID,"A, b (1)",flag,C (2)\nACH-1,7,no,8\n')
    raw, labels = wide_text.read_wide(spark, str(folder), "ModelID", keep=["flag"])
    assert labels == ["A, b (1)", "C (2)"]
    first = keep_first(raw, ["row_key", "col_key"], "ord").select("row_key", "flag", "col_key", "raw")
    assert rows(first) == [("ACH,2", 'no "way"', "A, b (1)", "3"), ("ACH,2", 'no "way"', "C (2)", None), ("ACH-1", "yes", "A, b (1)", "1"), ("ACH-1", "yes", "C (2)", "2")]


def test_response_on_either_axis(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",ACH-1,ACH-2,ACH-1\nBRD-1,1,2,9\nBRD-1,5,5,5\nBRD-2,,4,9\n")
    (tmp_path / "n.csv").write_text(",BRD-1,BRD-2\nACH-1,1,\nACH-2,2,4\n")
    (tmp_path / "u.csv").write_text(",x,y\nz,1,2\n")
    want = [("ACH-1", "BRD-1", 1.0), ("ACH-1", "BRD-2", None), ("ACH-2", "BRD-1", 2.0), ("ACH-2", "BRD-2", 4.0)]
    for name, turned in (("t", True), ("n", False)):
        cells, report = wide_text.read_response(spark, str(tmp_path / f"{name}.csv"))
        assert rows(cells) == want and report == {"status": "present", "transposed": turned}
    assert wide_text.read_response(spark, str(tmp_path / "u.csv"))[1]["status"] == "unrecognised_layout"
    assert wide_text.read_response(spark, None) == (None, {"status": "absent"})


def test_cached_tables_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("007", "E1"), ("8", None)], "entrez string, target string")

    for _ in range(2):
        assert rows(matrix_io.cached_table(spark, str(tmp_path / "map.csv"), "entrez string, target string", build)) == [("007", "E1")]
    assert built == [1]


def test_staged_tables(spark):
    df = stage(spark.range(5).toDF("n"), "numbers")
    assert df.count() == 5 and df._loomgrid_path.startswith(shared_dir(spark))
    release(df)
