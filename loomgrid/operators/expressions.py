"""Regular expressions of columns, induced by minimum description length.

Every distinct value is cut into runs of digits, letters and other signs.  From
these runs candidate expressions of several generalities are made; a candidate
costs its own length and saves, for each distinct value that it matches, the
difference between spelling the value out and choosing it within the
expression.  Candidates are taken greedily while they shorten the description.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RAW_BITS = 7.0  # a character spelled out
SIGN_BITS = 8.0  # a character of an expression
DIGIT_BITS, LETTER_BITS = math.log2(10), math.log2(26)


def shape(col: Column) -> Column:
    """The value with each run of digits written as ``\\x01`` and its length; all else stays.

    Two values of one shape are matched by the same candidates.
    """
    runs = F.regexp_extract_all(col, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    coded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("\x01"), F.length(r).cast("string"), F.lit("\x02"))).otherwise(r))
    return F.concat_ws("", coded)


def _escaped(run: Column) -> Column:
    return F.regexp_replace(run, r"([^0-9A-Za-z\x80-\x{10FFFF} _-])", r"\\$1")


def _rewritten(col: Column, digits, letters) -> Column:
    runs = F.regexp_extract_all(col, F.lit("([0-9]+|[A-Za-z]+|[^0-9A-Za-z]+)"), F.lit(1))
    return F.concat_ws(
        "",
        F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), digits(r)).when(r.rlike("^[A-Za-z]"), letters(r)).otherwise(_escaped(r))),
    )


def candidates(col: Column) -> list[Column]:
    """Expressions that match the value, from the narrowest to the widest."""
    n = lambda r: F.concat(F.lit("[0-9]{"), F.length(r).cast("string"), F.lit("}"))
    n_up = lambda r: F.concat(F.lit("[0-9]{"), F.length(r).cast("string"), F.lit(",}"))
    any_digits = lambda r: F.lit("[0-9]+")
    same = lambda r: r
    any_letters = lambda r: F.lit("[A-Za-z]+")
    return [_rewritten(col, n, same), _rewritten(col, n_up, same), _rewritten(col, any_digits, same), _rewritten(col, any_digits, any_letters)]


def _classes(expression: str) -> list[tuple[str, float, bool]]:
    """The expression's character classes with their bits a character, and whether the length is open."""
    out = []
    for m in re.finditer(r"\[(0-9|A-Za-z)\](\{(\d+)(,)?\}|\+)", expression):
        bits = DIGIT_BITS if m[1] == "0-9" else LETTER_BITS + 1
        out.append((m[1], bits, m[2] == "+" or bool(m[4])))
    return out


def _inside_bits(expression: str, n_digits: float, n_letters: float) -> float:
    """Bits to choose a value of so many digits and letters within the expression."""
    bits = 0.0
    for kind, per, open_ended in _classes(expression):
        share = n_digits if kind == "0-9" else n_letters
        n = max(1, sum(k == kind for k, _, _ in _classes(expression)))
        bits += per * share / n + (2 * math.log2(share / n + 2) if open_ended else 0)
    return bits


def induce(values: DataFrame, keys: list[str], value: str, share: float = 0.05) -> dict[tuple, list[str]]:
    """The expressions of each group of ``keys``.

    ``values`` has one row per group and distinct value.  Candidates are counted
    over all of them.  An expression that covers less than ``share`` of the
    distinct values is not part of the column's language; all others come to
    the driver, where the choice is made.  As a value has four candidates,
    these are at most 4 / ``share``, however many values.
    """
    n_digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    n_letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    shapes = (
        values.filter(F.col(value).isNotNull())
        .groupBy(*keys, shape(F.col(value)).alias("_shape"))
        .agg(F.count("*").alias("_n"), F.first(value).alias("_one"), F.sum(F.length(value)).alias("_chars"), F.sum(n_digits).alias("_digits"), F.sum(n_letters).alias("_letters"))
    )
    exploded = shapes.select(*keys, "_n", "_chars", "_digits", "_letters", "_one", F.posexplode(F.array(*candidates(F.col("_one")))).alias("_level", "expression"))
    found = exploded.groupBy(*keys, "expression").agg(
        F.sum("_n").alias("n"), F.sum("_chars").alias("chars"), F.sum("_digits").alias("digits"), F.sum("_letters").alias("letters"), F.min("_one").alias("one")
    )
    total = W.partitionBy(*keys)
    rows = found.withColumn("total", F.sum("n").over(total) / F.lit(4.0)).filter(F.col("n") >= share * F.col("total")).collect()
    groups: dict[tuple, list] = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    return {key: _choose(found_here, share) for key, found_here in groups.items()}


def _choose(found: list, share: float) -> list[str]:
    """Greedy choice; candidates of one column overlap, so each counts what no chosen one matches."""
    left = {r["expression"]: dict(n=r["n"], chars=r["chars"], digits=r["digits"], letters=r["letters"], one=r["one"]) for r in found}
    total = max((r["total"] for r in found), default=0)
    chosen: list[str] = []
    while left:
        def saving(e: str) -> float:
            x = left[e]
            if x["n"] <= 0:
                return -1.0
            return RAW_BITS * x["chars"] - x["n"] * _inside_bits(e, x["digits"] / x["n"], x["letters"] / x["n"]) - SIGN_BITS * len(e)

        best = max(left, key=lambda e: (saving(e), -len(e), e))
        if saving(best) <= 0:
            break
        took = left.pop(best)
        if took["n"] >= share * total:
            chosen.append(best)
        for e in list(left):
            if re.fullmatch(best, left[e]["one"]) or re.fullmatch(e, took["one"]):
                # the narrower of two overlapping candidates is spent with the wider
                for k in ("n", "chars", "digits", "letters"):
                    left[e][k] -= min(left[e][k], took[k])
                if left[e]["n"] <= 0:
                    del left[e]
    return chosen


def union_of(expressions: list[str]) -> str:
    return "^(" + "|".join(sorted(expressions)) + ")$" if expressions else "^$"
