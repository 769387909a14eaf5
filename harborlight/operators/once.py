"""Evaluate a dear expression exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column, keep_null: bool = True) -> DataFrame:
    """Add `value` as a column that later projections and filters do not evaluate again.

    Catalyst merges neighbouring projections and pushes filters down by putting expressions in
    place of their names, which repeats them; a generator stops that. keep_null=False drops
    rows whose value is null.
    """
    items = F.array(value)
    return df.withColumn(name, F.explode(items if keep_null else F.array_compact(items)))
