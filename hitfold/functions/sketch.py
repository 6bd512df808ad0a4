"""Distinct counting: DataSketches for storage, a register form for exact comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sketch_counts(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``uv`` and ``ip`` per key from hourly sketch rows, in one aggregation."""
    of_kind = lambda kind: F.hll_sketch_estimate(
        F.hll_union_agg(F.when(F.col("kind") == kind, F.col("sketch")))
    )
    return sketches.groupBy(*keys).agg(of_kind("uv").alias("uv"), of_kind("ip").alias("ip"))


def exact_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    """``uv`` and ``ip`` per key from rows (kind, value).

    Duplicates go first, by a key that contains the value, so no key is hot.
    """
    of_kind = lambda kind: F.count_if(F.col("kind") == kind)
    return (
        values.select(*keys, "kind", "value")
        .distinct()
        .groupBy(*keys)
        .agg(of_kind("uv").alias("uv"), of_kind("ip").alias("ip"))
    )


def unique_counts(uniques: DataFrame, keys: list[str]) -> DataFrame:
    """Estimate from sketch rows, or count exactly from value rows."""
    return (sketch_counts if "sketch" in uniques.columns else exact_counts)(uniques, keys)


def register_counts(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """HyperLogLog with 2^10 registers kept as rows: maximum rank per register, then the
    harmonic estimate with linear counting. The bits come from MD5."""
    digits = F.col("_h")
    head = F.conv(F.substring(digits, 1, 3), 16, 10).cast("bigint")
    rest = F.conv(F.substring(digits, 4, 13), 16, 10).cast("bigint")
    remainder = F.pmod(head, F.lit(4)) * F.lit(1 << 52) + rest
    bits = F.when(remainder == 0, F.lit(0)).otherwise(F.length(F.bin(remainder)))
    registers = (
        values.select(*keys, F.md5(F.col(value)).alias("_h"))
        .select(*keys, F.floor(head / 4).alias("_idx"), (F.lit(55) - bits).alias("_rank"))
        .groupBy(*keys, "_idx")
        .agg(F.max("_rank").alias("_rank"))
    )
    size = 1024.0
    alpha = 0.7213 / (1.0 + 1.079 / size)
    folded = registers.groupBy(*keys).agg(
        F.count("*").alias("registers"), F.sum(F.pow(F.lit(2.0), -F.col("_rank"))).alias("_hs")
    )
    raw = F.lit(alpha * size * size) / (F.col("_hs") + F.lit(size) - F.col("registers"))
    linear = F.lit(size) * F.log(F.lit(size) / (F.lit(size) - F.col("registers")))
    return folded.select(
        *keys,
        "registers",
        F.round(F.when((raw <= 2.5 * size) & (F.col("registers") < 1024), linear).otherwise(raw))
        .cast("bigint")
        .alias("estimate"),
    )


def sketch_of(value: Column, precision: int) -> Column:
    return F.hll_sketch_agg(value, F.lit(precision))
