"""Columns that are costly to compute."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add the columns so that each row computes them a single time.

    A filter on a projected column is moved below the projection together with a copy of the whole
    expression. The output of a generator is left in place, so a one-row `inline` stops that.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
