"""Column-level data quality profile per load, and what changed since the load before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrid.functions.ids import plain_number
from loomgrid.operators import expressions
from loomgrid.operators.languages import contained
from loomgrid.operators.quantiles import exact_quantiles
from loomgrid.sources.staging import stage


@dataclass(frozen=True)
class ColumnRule:
    """What is expected of a column.  ``pattern`` set: an id; else numbers within ``low..high``."""

    pattern: str | None = None
    low: float | None = None
    high: float | None = None


def value_counts(rows: DataFrame, table_name: str, load: str, columns: dict[str, ColumnRule]) -> DataFrame:
    """Long form, counted: one row per column, load and distinct value.

    ``num`` is the value as number, ``text`` an id or a text that is no number;
    both NULL: missing (NULL or NaN).  The count is combined before the shuffle.
    """
    entries = []
    for name, rule in columns.items():
        kind = dict(rows.dtypes)[name]
        if rule.pattern is not None:
            num, text = F.lit(None).cast("double"), F.col(name).cast("string")
        elif kind == "string":
            num = plain_number(F.col(name))
            text = F.when(num.isNull(), F.col(name))
        else:
            num = F.col(name).cast("double")
            num = F.when(~F.isnan(num), num)
            text = F.lit(None).cast("string")
        entries.append(F.struct(F.lit(name).alias("column_name"), num.alias("num"), text.alias("text")))
    long = rows.select(F.col(load).alias("load_id"), F.explode(F.array(*entries)).alias("e")).select("load_id", "e.*")
    return long.groupBy("column_name", "load_id", "num", "text").agg(F.count("*").alias("n")).select(F.lit(table_name).alias("table_name"), "*")


def column_profile(counts: DataFrame, rules: dict[tuple[str, str], ColumnRule], loads: DataFrame) -> DataFrame:
    """One row per table, column and load.

    ``counts`` comes from :func:`value_counts` (several tables may be united);
    ``loads`` has ``table_name, load_id, centre, seq``.  For each load: rows,
    missing share, distinct count, smallest and largest number, numbers out of
    range, texts that are no numbers, quartiles; for id columns the expression
    induced over all distinct values of all loads, which sees nothing of the
    declared pattern, the share of present values that it covers
    (``coverage``) and its change since the load before
    (``coverage_change``).  ``prev_*`` are the figures of the nearest earlier
    load of the same centre and table that has rows; NULL where there is none
    or the load is unknown.  Empty tables give no rows; a column without any
    number has NULL statistics.

    Badly formed ids: an induced expression is accepted if all that it can
    match is of the declared form, which is decided on the two expressions.
    Values of accepted expressions are well formed; only the others are held
    against the declared form.  ``n_absorbed`` counts the badly formed rows that
    the induced language as a whole would have let through.
    """
    spark = counts.sparkSession
    counts = stage(counts, "value-counts")
    keys = ["table_name", "column_name", "load_id"]
    limit = lambda x: None if x is None else float(x)
    rule_rows = [(t, c, r.pattern is not None, limit(r.low), limit(r.high)) for (t, c), r in rules.items()]
    # one row per declared rule, as many as the caller wrote down
    rule = F.broadcast(spark.createDataFrame(rule_rows, "table_name string, column_name string, is_id boolean, low double, high double"))

    ids = rule.filter("is_id").select("table_name", "column_name")
    texts = counts.filter("text is not null").join(ids, ["table_name", "column_name"], "left_semi")
    shapes = stage(texts.groupBy(*keys, expressions.shape(F.col("text")).alias("shape")).agg(F.sum("n").alias("n"), F.min("text").alias("one")), "shapes")
    language = expressions.induce(texts.select("table_name", "column_name", "text").distinct(), ["table_name", "column_name"], "text")
    declared = {key: r.pattern for key, r in rules.items() if r.pattern is not None}
    accepted = {key: [e for e in language.get(key, []) if contained(e, form)] for key, form in declared.items()}

    def by_column(patterns: dict[tuple[str, str], str]) -> Column:
        out = F.lit(None).cast("string")
        for (t, c), p in patterns.items():
            out = F.when((F.col("table_name") == t) & (F.col("column_name") == c), p).otherwise(out)
        return out

    # all values of a shape stand or fall together, so one of them is matched
    fits = shapes.withColumn("expression", by_column({k: expressions.union_of(language.get(k, [])) for k in declared}))
    fits = fits.withColumn("accepted", by_column({k: expressions.union_of(v) for k, v in accepted.items()})).withColumn("declared", by_column(declared))
    outside, suspect = ~F.expr("one rlike expression"), ~F.expr("one rlike accepted")
    bad = suspect & F.when(suspect, ~F.expr("one rlike declared")).otherwise(False)
    conform = fits.groupBy(*keys).agg(
        F.min("expression").alias("expression"),
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_nonconforming"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("n_badly_formed"),
        F.sum(F.when(bad & ~outside, F.col("n")).otherwise(0)).alias("n_absorbed"),
    )

    num, n = F.col("num"), F.col("n")
    stats = (
        counts.join(rule, ["table_name", "column_name"])
        .groupBy(*keys, "is_id")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(num.isNull() & F.col("text").isNull(), n).otherwise(0)).alias("n_missing"),
            F.count(F.when(num.isNotNull() | F.col("text").isNotNull(), 1)).alias("n_distinct"),
            F.sum(F.when(num.isNotNull(), n).otherwise(0)).alias("n_numbers"),
            F.sum(F.when(~F.col("is_id") & F.col("text").isNotNull(), n).otherwise(0)).alias("n_nonnumeric"),
            F.sum(F.when((num < F.col("low")) | (num > F.col("high")), n).otherwise(0)).alias("n_out_of_range"),
            F.min("num").alias("min_value"),
            F.max("num").alias("max_value"),
        )
    )
    quartiles = exact_quantiles(counts, keys, "num", "n", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    now = (
        stats.join(quartiles, keys, "left").join(conform, keys, "left")
        .join(loads.select("table_name", "load_id", "centre", "seq").dropDuplicates(["table_name", "load_id"]), ["table_name", "load_id"], "left")
        .withColumn("missing_share", F.col("n_missing") / F.col("n_rows"))
        .withColumn("coverage", 1 - F.col("n_nonconforming") / F.expr("nullif(n_rows - n_missing, 0)"))
    )
    before = W.partitionBy("table_name", "column_name", "centre").orderBy("seq", "load_id")
    kept = ["load_id", "missing_share", "median", "q25", "q75", "coverage"]
    now = now.select("*", *[F.when(F.col("centre").isNotNull(), F.lag(c).over(before)).alias(f"prev_{c}") for c in kept])
    return now.withColumn("coverage_change", F.col("coverage") - F.col("prev_coverage"))


def load_findings(profile: DataFrame, null_step: float = 0.15) -> DataFrame:
    """``table_name, column_name, load_id, finding`` for what is wrong with a load or changed in it."""
    spread = F.col("prev_q75") - F.col("prev_q25")
    tests = {
        "pattern": F.col("is_id") & (F.col("n_badly_formed") > 0),
        "nonnumeric": F.col("n_nonnumeric") > 0,
        "range": F.col("n_out_of_range") > 0,
        "constant": (F.col("n_numbers") >= 2) & (F.col("min_value") == F.col("max_value")),
        "nulls": F.col("missing_share") - F.col("prev_missing_share") > null_step,
        "shift": (spread > 0) & (F.abs(F.col("median") - F.col("prev_median")) > spread),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return profile.select("table_name", "column_name", "load_id", F.explode(found).alias("finding"))
