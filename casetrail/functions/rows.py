"""Controlling how often Spark evaluates an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, kept: list[str], value: Column) -> DataFrame:
    """``kept`` and the fields of the struct ``value``, which is evaluated once per row.

    A filter on a plain projection is moved below it, with the whole expression in it, and so everything is computed
    again. A generator of one row stops that.
    """
    return df.select(*kept, F.inline(F.array(value)))
