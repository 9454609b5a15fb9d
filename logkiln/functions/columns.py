"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns fixed as values.

    Filters move below projections by copying the expressions they test. For columns that build
    on each other the copies multiply at every step, in the plan and per row. A filter does not
    move below the generator that makes these columns, so they are computed once and then tested.
    """
    kept = [c for c in df.columns if c not in names]
    made = F.explode(F.array(F.struct(*names))).alias("_settled")
    return df.select(*kept, made).select(*kept, *[F.col(f"_settled.{n}").alias(n) for n in names])
