import random

import duckdb
import pandas as pd
from conftest import rows

from loomgrid.operators.expressions import induce
from loomgrid.operators.languages import contained
from loomgrid.operators.profile import ColumnRule, column_profile, load_findings, value_counts
from loomgrid.operators.quantiles import exact_quantiles


def test_quantiles_agree_with_brute_force(spark):
    rng = random.Random(3)
    data = [(g, float(v), rng.randint(1, 3)) for g in ("a", "b", "c") for v in {round(rng.gauss(0, 10 ** rng.randint(-3, 6)), 4) for _ in range(200)}]
    data += [("one", 5.0, 1), ("two", -1.0, 1), ("two", 2.0, 1)]
    df = spark.createDataFrame([*data, ("a", None, 9)], "g string, v double, n long")
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in exact_quantiles(df, ["g"], "v", "n", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).collect()}
    flat = pd.DataFrame([(g, v) for g, v, n in data for _ in range(n)], columns=["g", "v"])
    want = duckdb.sql("select g, quantile_cont(v, 0.25) a, quantile_cont(v, 0.5) b, quantile_cont(v, 0.75) c from flat group by g").fetchall()
    assert len(got) == len(want)
    for g, *q in want:
        assert all(abs(x - y) < 1e-9 * max(1, abs(y)) for x, y in zip(got[g], q))


def test_induced_expressions(spark):
    values = [("c", f"ACH-{i:06d}") for i in range(300)] + [("c", f"odd{chr(97 + i)}!") for i in range(5)]
    language = induce(spark.createDataFrame(values, "k string, v string"), ["k"], "v")
    assert language[("c",)] == ["ACH-[0-9]{6}"]
    assert induce(spark.createDataFrame([], "k string, v string"), ["k"], "v") == {}


def test_short_values_beside_many_long_shapes(spark):
    letters = [chr(97 + i) for i in range(26)]
    values = [("c", (a + b) * 30) for a in letters[:20] for b in letters[:20] if a != b] + [("c", f"A-{i}") for i in range(100, 120)]
    language = induce(spark.createDataFrame(values, "k string, v string"), ["k"], "v")
    assert set(language[("c",)]) == {"[A-Za-z]+", "A-[0-9]{3}"}


def test_containment_of_expressions():
    ach, mc = r"^ACH-[0-9]{6,}$", r"^MC-[0-9]{6,}(-alt[0-9]*)?$"
    for e, p, want in [
        ("ACH-[0-9]{6}", ach, True), ("ACH-[0-9]{6,}", ach, True), ("ACH-[0-9]+", ach, False), ("ACH-[0-9]{5}", ach, False), ("[A-Za-z]+-[0-9]+", ach, False),
        ("MC-[0-9]{6}-alt[0-9]{1}", mc, True), ("MC-[0-9]{6}-[A-Za-z]+", mc, False), ("ACH-[0-9]{6}|ACH-[0-9]{7}", ach, True), ("(A|B)*C?", "[ABC]*", True),
        ("a\\?b", "a.b", False), ("x*y", "x*", False), ("a?", "a{0,2}", True), ("[A", "[A-Z]", False), ("(?i)a", "a", False),
    ]:
        assert contained(e, p) == want, (e, p)


def test_absorbed_values_are_found_and_counted(spark):
    # a spelling so frequent that the column's own expressions take it in
    data = [(1, f"A-{i:02d}" if i % 2 else f"b{i:02d}", 1.0 * i, "1", "") for i in range(90)]
    df = spark.createDataFrame(data, "load_id int, id string, x float, t string, extra string")
    profile = column_profile(value_counts(df, "tab", "load_id", RULES), {("tab", c): r for c, r in RULES.items()}, spark.createDataFrame([(1, "c", "tab", 1)], "load_id int, centre string, table_name string, seq int"))
    r = profile.filter("column_name = 'id'").first()
    assert (r["n_nonconforming"], r["n_badly_formed"], r["n_absorbed"]) == (0, 45, 45) and r["coverage"] == 1.0


RULES = {"id": ColumnRule(pattern="^A-[0-9]{2}$"), "x": ColumnRule(low=0, high=20), "t": ColumnRule(low=0, high=20)}


def findings(spark, data, loads=((1, "c", "tab", 1), (2, "c", "tab", 2), (3, "c", "tab", 3))):
    df = spark.createDataFrame(data, "load_id int, id string, x float, t string, extra string")
    counts = value_counts(df, "tab", "load_id", RULES)
    profile = column_profile(counts, {("tab", c): r for c, r in RULES.items()}, spark.createDataFrame(list(loads), "load_id int, centre string, table_name string, seq int"))
    return {tuple(r) for r in load_findings(profile).select("column_name", "load_id", "finding").collect()}


def test_findings(spark):
    nan = float("nan")
    load1 = [(1, f"A-{i:02d}", float(i), str(i), "e") for i in range(10)]
    load3 = [(3, "A-1" if i == 0 else f"A-{i:02d}", float(i + 9), "n.d." if i == 1 else "7", "e") for i in range(9)] + [(3, None, nan, None, None)] * 3 + [(3, "A-10", 99.0, "7", "e")]
    got = findings(spark, load1 + load3)
    # load 2 has no rows, so load 3 is held against load 1
    assert got == {("id", 3, "pattern"), ("t", 3, "nonnumeric"), ("t", 3, "constant"), ("x", 3, "range"), ("id", 3, "nulls"), ("x", 3, "nulls"), ("t", 3, "nulls"), ("x", 3, "shift")} | (
        {("t", 3, "shift")} if abs(7 - 4.5) > 4.5 else set()
    )


def test_one_number_is_not_constant_and_unknown_loads_have_no_load_before(spark):
    data = [(1, "A-01", 1.0, "1", ""), (9, "A-02", 15.0, "1", ""), (9, "A-02", 15.0, "2", "")]
    assert findings(spark, data) == {("x", 9, "constant")}


def test_empty_table(spark):
    assert findings(spark, []) == set()


def test_all_missing(spark):
    assert findings(spark, [(1, None, None, None, None)] * 3) == set()


def test_counts_keep_repeated_rows(spark):
    df = spark.createDataFrame([(1, "A-01", 1.0, " 2 ", "")] * 4, "load_id int, id string, x float, t string, extra string")
    assert {r["n"] for r in value_counts(df, "tab", "load_id", RULES).collect()} == {4}
    assert len(rows(value_counts(df, "tab", "load_id", RULES))) == 3
