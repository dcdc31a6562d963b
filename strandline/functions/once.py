"""Columns that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with these columns added or replaced, each computed once.

    Columns that build on columns are otherwise written out again wherever a later
    filter uses them, and the condition that is pushed down grows with every layer. A
    one-row generator ends that: what stands above sees plain columns.
    """
    keep = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def merged(df: DataFrame) -> DataFrame:
    """``df`` for joins whose two sides both grow with the input: they are sorted and merged.
    Sizes are estimates from files and column widths, and a table of a million rows may
    seem small enough to be collected by the driver and sent to every task."""
    return df.hint("merge")
