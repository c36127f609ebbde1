"""Versions of a record: the last or first row of each id by landing time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edge_row(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def last_rows(df: DataFrame, keys: Sequence[str] = ("id",), at: str = "landed_at", ties: Sequence[str] = ()) -> DataFrame:
    """The last landed row of each key.

    Rows without a landing time count as the oldest; equal times are decided
    by the columns in ``ties`` (largest first), so the choice does not depend
    on the order of rows.  Only the columns that the caller selected before are
    shuffled.  Spark limits each map task to one row a key before the shuffle.
    """
    return _edge_row(df, keys, [F.col(at).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties]])


def first_rows(df: DataFrame, keys: Sequence[str] = ("id",), at: str = "landed_at", ties: Sequence[str] = ()) -> DataFrame:
    """The first landed row of each key; rows without a landing time come last."""
    return _edge_row(df, keys, [F.col(at).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]])
