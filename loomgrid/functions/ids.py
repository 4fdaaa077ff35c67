"""Canonical ids, missing words and loose booleans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs and words that stand for "no value", lower case, trimmed.
MISSING_WORDS = [
    "#n/a", "#na", "#value!", "(blank)", "(none)", "(null)", "<na>", "<null>", "blank", "empty", "missing", "n.a", "n.a.", "n.d", "n.d.", "n.k", "n.k.",
    "n/a", "n/d", "n/k", "na", "nan", "nd", "nil", "nk", "no value", "none", "not applicable", "not available", "not known",
    "not determined", "not given", "not provided", "not recorded", "not reported", "not specified", "null", "pending", "tba", "tbd",
    "undefined", "unk", "unknown", "unspecified", "void",
]

#: A text without any letter or digit says nothing.
NO_SIGN = r"^[^\p{L}\p{N}]*$"
_BLANK = "[\\s\u00a0\u200b\ufeff]+"


def _compact(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, "[^0-9A-Za-z]", ""))


def _padded(prefix: str, number: Column, width: int) -> Column:
    digits = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    return F.when(number != "", F.concat(F.lit(prefix), digits))


def model_id(col: Column) -> Column:
    """``ACH-`` and the number with at least six digits; NULL for any other form."""
    return _padded("ACH-", F.regexp_extract(_compact(col), "^ACH0*([0-9]+)$", 1), 6)


def donor_id(col: Column) -> Column:
    """``PT-`` and the number with at least five digits; NULL if it names no donor."""
    return _padded("PT-", F.regexp_extract(_compact(col), "^PT0*([1-9][0-9]*)$", 1), 5)


def tidy(col: Column) -> Column:
    """Blanks of any kind trimmed and runs of them made one."""
    return F.trim(F.regexp_replace(col, _BLANK, " "))


def is_missing_text(col: Column) -> Column:
    text = F.lower(tidy(col))
    return F.coalesce(text.isin(MISSING_WORDS) | text.rlike(NO_SIGN), F.lit(True))


def usable_text(col: Column) -> Column:
    """The tidied text, or NULL where it stands for no value."""
    return F.when(~is_missing_text(col), tidy(col))


def loose_bool(col: Column) -> Column:
    """true, 1, 1.0, yes, t in any case are true; anything else, NULL too, is false."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("true", "1", "1.0", "yes", "t"), F.lit(False))


def finite(col: Column) -> Column:
    """The number as double, or NULL for NULL, NaN and infinities."""
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def plain_number(col: Column) -> Column:
    """A text as double if it is a plain decimal with a point once trimmed, else NULL."""
    text = tidy(col)
    return F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text.try_cast("double"))
