import json

from conftest import rows
from pyspark.sql import functions as F

from loomgrid.operators.drift import alias_table, schema_drift, unified_table

SCHEMA = "raw_id long, series string, seq int, file_name string, record_text string"


def deliver(spark, files):
    """files: {(series, seq): [record, ...]}"""
    data, n = [], 0
    for (series, seq), records in files.items():
        for r in records:
            n += 1
            data.append((n, series, seq, f"{series}_{seq}", r if isinstance(r, str) or r is None else json.dumps(r)))
    return spark.createDataFrame(data, SCHEMA)


def changes(spark, files):
    return rows(schema_drift(deliver(spark, files)).changes.select("file_name", "field_name", "change_kind"))


def records(n, *fields):
    every = {"id": lambda i: f"R{i}", "rid": lambda i: f"R{i}", "age": lambda i: 20 + i, "years": lambda i: str(20 + i), "ok": lambda i: i % 3 == 0, "flag": lambda i: "yes" if i % 3 == 0 else "no", "other": lambda i: i % 2 == 0, "obj": lambda i: {"id": f"R{i}", "alt": True}}
    return [{f: every[f](i) for f in fields} for i in range(n)]


def test_added_removed_renamed_retyped(spark):
    files = {("s", 1): records(20, "id", "age", "ok"), ("s", 2): records(20, "id", "years", "ok"), ("s", 4): records(20, "id", "years", "flag"), ("s", 5): records(20, "id", "years", "other")}
    assert changes(spark, files) == [
        ("s_2", "years", "renamed"), ("s_2", "years", "retyped"), ("s_4", "flag", "renamed"), ("s_4", "flag", "retyped"), ("s_5", "flag", "removed"), ("s_5", "other", "added"),
    ]


def test_the_record_key_itself_is_renamed(spark):
    files = {("s", 1): records(20, "id", "age"), ("s", 2): records(20, "rid", "age")}
    assert changes(spark, files) == [("s_2", "rid", "renamed")]


def test_text_becomes_object(spark):
    files = {("s", 1): [{"k": f"K{i}", "mc": f"R{i}"} for i in range(9)], ("s", 2): [{"k": f"K{i}", "mc": {"id": f"R{i}", "alt": False}} for i in range(9)]}
    assert changes(spark, files) == [("s_2", "mc", "retyped")]


def test_nulls_keep_a_field_and_its_type(spark):
    files = {("s", 1): [{"k": 1, "a": "x"}], ("s", 2): [{"k": 1, "a": None}], ("s", 3): [{"k": 1, "a": "x"}], ("s", 4): [{"k": 1, "a": 5}]}
    assert changes(spark, files) == [("s_4", "a", "retyped")]


def test_series_are_apart_and_late_files_do_not_matter(spark):
    files = {("s", 2): [{"k": 1, "b": 2}], ("s", 1): [{"k": 1}], ("t", 1): [{"k": 1, "c": 1}]}
    assert changes(spark, files) == [("s_2", "b", "added")]


def test_broken_empty_and_repeated_records(spark):
    assert changes(spark, {}) == []
    files = {("s", 1): [{"k": 1}, {"k": 1}, "no json", "", None, "[1, 2]", '{"k": 1, "k": 2}'], ("s", 2): [{"k": 1}]}
    assert changes(spark, files) == []


def test_unified_table(spark):
    files = {("s", 1): records(12, "id", "age", "ok"), ("s", 2): records(12, "id", "years", "flag"), ("s", 3): [{"id": "R0", "years": "many", "flag": "no"}]}
    drift = schema_drift(deliver(spark, files))
    table = unified_table(drift, alias_table(drift))
    by_id = {r["raw_id"]: r for r in table.collect()}
    assert len(by_id) == 25
    names = {a.canonical: a.names for a in alias_table(drift)}
    assert {frozenset(v) for v in names.values()} == {frozenset(["id"]), frozenset(["age", "years"]), frozenset(["ok", "flag"])}
    age = next(k for k, v in names.items() if "age" in v)
    assert by_id[1][age] is not None and by_id[25]["raw_id"] == 25


def test_unified_table_keeps_the_members_of_objects(spark):
    texts = [{"k": "K0", "mc": "R0-alt"}, {"k": "K1", "mc": "R1-alt2"}, {"k": "K2", "mc": "R2"}, {"k": "K3", "mc": "R3"}]
    objects = [{"k": "K0", "mc": {"id": "R0", "alt": True}}, {"k": "K1", "mc": {"id": "R1", "alt": True}}, {"k": "K2", "mc": {"id": "R2", "alt": False}}]
    others = [{"k": "K3", "mc": {"no": 7, "batch": None}}, {"k": "K4", "mc": {"id": "R4", "well": "B2"}}, {"k": "K5", "mc": {"alt": True}}, {"k": "K6", "mc": None}]
    drift = schema_drift(deliver(spark, {("s", 1): texts, ("s", 2): texts, ("s", 3): objects + others}))
    by_id = {r["raw_id"]: r for r in unified_table(drift, alias_table(drift)).collect()}
    assert [by_id[i]["mc"] for i in range(1, 5)] == ["R0-alt", "R1-alt2", "R2", "R3"] and by_id[1]["object_values"] == []
    # an alternative is neither the plain condition nor one certain alternative, and is listed
    assert [json.loads(by_id[i]["mc"]) for i in (9, 10)] == [{"id": "R0", "alt": True}, {"id": "R1", "alt": True}]
    assert [by_id[i]["mc"] for i in (11, 12, 15)] == ["R2", "7", None]
    assert [json.loads(by_id[i]["mc"]) for i in (13, 14)] == [{"id": "R4", "well": "B2"}, {"alt": True}]
    assert {i for i, r in by_id.items() if r["cast_failed"] == "mc"} == {9, 10, 13, 14}
    # nothing of an object is lost, also where a text stands for it
    assert [(o["field_name"], json.loads(o["value"])) for o in by_id[11]["object_values"]] == [("mc", {"id": "R2", "alt": False})]


def test_objects_in_a_column_of_numbers(spark):
    drift = schema_drift(deliver(spark, {("s", 1): [{"k": "a", "n": 4}], ("s", 2): [{"k": "a", "n": 4}], ("s", 3): [{"k": "a", "n": {"v": 4, "est": True}}, {"k": "b", "n": {"v": 5}}]}))
    got = {r["raw_id"]: r for r in unified_table(drift, alias_table(drift)).collect()}
    assert [(got[i]["n"], got[i]["cast_failed"]) for i in (1, 3, 4)] == [(4.0, ""), (None, "n"), (5.0, "")]
    assert json.loads(got[3]["object_values"][0]["value"]) == {"v": 4, "est": True}


def test_unified_table_keeps_records_without_fields(spark):
    odd = ["no json", "", None, "[1, 2]", '{"k": 1, "k": 2}', "{}"]
    drift = schema_drift(deliver(spark, {("s", 1): [{"k": 1}, *odd, {"k": None}], ("s", 2): ["broken"]}))
    got = {r["raw_id"]: r for r in unified_table(drift, alias_table(drift)).collect()}
    assert sorted(got) == list(range(1, 10)) and got[1]["k"] == 1.0 and all(got[i]["k"] is None for i in range(2, 10))
    assert {i for i, r in got.items() if r["unreadable"]} == {2, 3, 4, 5, 6, 9}
    assert all(r["cast_failed"] == "" and r["object_values"] == [] for r in got.values())
    # also where no record has a field
    drift = schema_drift(deliver(spark, {("s", 1): ["broken", "{}"]}))
    assert [(r["raw_id"], r["unreadable"]) for r in unified_table(drift, alias_table(drift)).orderBy("raw_id").collect()] == [(1, True), (2, False)]


def test_spellings_that_count_as_equal_are_declared(spark):
    old = [(i, "s", 1, "a", f'{{"key": "k{i}", "cond": "MC-{i:06d}"}}') for i in range(20)]
    new = [(100 + i, "s", 2, "b", f'{{"key": "k{i}", "condition": "MC-{i:06d}-alt{i % 3}"}}') for i in range(20)]
    raw = spark.createDataFrame(old + new, "raw_id long, series string, seq int, file_name string, record_text string")
    kinds = lambda **kw: sorted((r["field_name"], r["change_kind"]) for r in schema_drift(raw, **kw).changes.collect())
    assert kinds() == [("cond", "removed"), ("condition", "added")]
    assert kinds(normal=lambda c: F.regexp_replace(c, "-alt[0-9]*$", "")) == [("condition", "renamed")]
