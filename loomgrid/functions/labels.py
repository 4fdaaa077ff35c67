"""Feature labels of the form ``SYMBOL (ENTREZ)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: symbol, blanks, number in brackets.
LABEL = r"^\s*(.+?)\s*\((\d+)\)\s*$"


def _part(label: Column, group: int) -> Column:
    found = F.regexp_extract(label, LABEL, group)
    return F.when(found != "", found)


def symbol_of(label: Column) -> Column:
    return _part(label, 1)


def entrez_of(label: Column) -> Column:
    """The number as text, NULL for a label of another form."""
    return _part(label, 2)


def canonical_label(symbol: Column, entrez: Column) -> Column:
    return F.concat(symbol, F.lit(" ("), entrez, F.lit(")"))


def bare_symbol(label: Column) -> Column:
    """What stands before the last `` (``."""
    return F.regexp_replace(label, r" \([^(]*$", "")
