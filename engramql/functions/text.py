"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as Java's (?U) class has it.
EDGE_SPACE = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    """The value without white space of any script at either end; null stays null."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def blank(c: Column) -> Column:
    """True for null, empty or white-space-only values."""
    return F.coalesce(stripped(c) == "", F.lit(True))


def match_key(c: Column) -> Column:
    """Key under which differently spelled ids meet: stripped and lower-cased."""
    return F.lower(stripped(c))
