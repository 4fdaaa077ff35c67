"""What the driver contract adds when this package is there."""

from __future__ import annotations

from loomgrid.llm.queries import QUERIES
from loomgrid.llm.sql import SQL as ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
