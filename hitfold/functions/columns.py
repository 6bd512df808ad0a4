"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions; false when there are none."""
    conditions = list(conditions)
    return reduce(or_, conditions) if conditions else F.lit(False)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def ratio_pct(part: Column, whole: Column) -> Column:
    """``part * 100 / whole``, 0 when there is no whole."""
    return F.when(
        whole > 0, part.cast("double") * F.lit(100.0) / whole.cast("double")
    ).otherwise(F.lit(0.0))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a plain projected column is pushed below the projection with its
    expression inlined, so a costly parse would run for the filter and again for the output.
    A filter does not pass a generator; exploding a one-element array is a
    generator that stays in whole-stage codegen and adds no rows.
    """
    packed = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.withColumn("_once", F.explode(F.array(packed))).select(
        *df.columns, *[F.col(f"_once.{name}").alias(name) for name in values]
    )
