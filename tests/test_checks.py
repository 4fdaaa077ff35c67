import pytest

from loomgrid.operators.checks import hard_failures, integrity_checks

CELLS = "row_key string, col_key string, value double"
IDS = [f"ACH-{i:06d}" for i in range(6)]


def tables():
    return {
        "expression": [(m, c, float(i + j)) for i, m in enumerate(IDS) for j, c in enumerate("12")],
        "effects": [(m, c, (-1.0) ** (i + j) * 0.2) for i, m in enumerate(IDS) for j, c in enumerate("12")],
        "metadata": [(m, f"p{i}", "Bone", "Osteosarcoma" if i else None, None) for i, m in enumerate(IDS)],
        "space": [(0, "1"), (1, "2")],
        "selective": [("1",)],
        "splits": [(m, ("train", "val", "test")[i % 3]) for i, m in enumerate(IDS)],
        "response": [(m, "d", 0.1) for m in IDS],
    }


SCHEMAS = {
    "expression": CELLS, "effects": CELLS, "response": CELLS, "metadata": "model_id string, patient_id string, lineage string, disease string, subtype string",
    "space": "pos int, entrez string", "selective": "col_key string", "splits": "model_id string, split string",
}


def failed(spark, t, severity=None):
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in t.items()}
    out = integrity_checks(**frames)
    return {r["name"] for r in out.collect() if not r["passed"] and severity in (None, r["severity"])}


def test_a_sound_data_set_passes(spark):
    assert failed(spark, tables()) == {"response_has_50_rows"}


def add(name, *extra):
    return lambda t: t[name].extend(extra)


def change(name, i, row):
    return lambda t: t[name].__setitem__(i, row)


@pytest.mark.parametrize(
    "mutate, want",
    [
        (lambda t: t["expression"].clear(), {"expression_not_empty", "same_rows", "expression_columns_canonical", "response_rows_in_core"}),
        (add("expression", (IDS[0], "1", 1.0)), {"expression_cells_unique"}),
        (add("effects", (IDS[0], "1", 0.1)), {"effect_cells_unique"}),
        (add("metadata", (IDS[0], "p0", None, None, None)), {"metadata_ids_unique"}),
        (add("effects", ("ACH-999999", "1", 0.1)), {"same_rows"}),
        (lambda t: t["metadata"].pop(), {"metadata_covers_rows"}),
        (add("expression", ("X1", "1", 1.0)), {"same_rows", "metadata_covers_rows", "ids_have_prefix", "all_rows_assigned"}),
        (add("expression", (IDS[0], "3", 1.0)), {"expression_columns_canonical"}),
        (add("effects", (IDS[0], "3", 0.1)), {"effect_columns_in_space"}),
        (change("space", 1, (5, "2")), {"positions_consistent"}),
        (change("expression", 0, (IDS[0], "1", float("inf"))), {"expression_finite"}),
        (change("effects", 0, (IDS[0], "1", float("-inf"))), {"effects_finite"}),
        (lambda t: (change("expression", 0, (IDS[0], "1", None))(t), change("expression", 1, (IDS[0], "2", None))(t)), {"no_empty_expression_row"}),
        (lambda t: t["selective"].clear(), {"selective_targets_not_empty"}),
        (add("selective", ("9",)), {"selective_targets_exist"}),
        (lambda t: t["splits"].pop(), {"all_rows_assigned"}),
        (add("splits", ("ACH-000099", "other")), {"split_names_valid"}),
        (lambda t: t.__setitem__("splits", [(m, "train") for m in IDS]), {"no_split_empty"}),
        (change("metadata", 1, (IDS[1], "p0", "Bone", "Osteosarcoma", None)), {"no_patient_straddles"}),
        (add("response", (IDS[0], "d", 0.2)), {"response_cells_unique"}),
        (add("response", ("ACH-000099", "d", 0.2)), {"response_rows_in_core"}),
    ],
)
def test_each_hard_check_catches_its_fault(spark, mutate, want):
    t = tables()
    mutate(t)
    assert failed(spark, t, "hard") == want


def test_soft_checks(spark):
    t = tables()
    t["expression"][0] = (IDS[0], "1", 500.0)
    t["effects"] = [(m, c, 50.0 if c == "1" else None) for m, c, _ in t["effects"]]
    assert {"expression_in_log_range", "effects_in_range", "effects_median_near_zero", "effects_missing_below_5_percent", "selective_block_varies"} <= failed(spark, t, "soft")


def test_missing_patients_do_not_straddle(spark):
    t = tables()
    t["metadata"] = [(m, None, l, d, s) for m, _, l, d, s in t["metadata"]]
    assert "no_patient_straddles" not in failed(spark, t)


def test_sections_without_a_table_are_skipped(spark):
    t = tables()
    del t["splits"], t["response"]
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in t.items()}
    out = integrity_checks(**frames)
    assert hard_failures(out).count() == 0 and out.filter("name like '%split%'").count() == 0
