"""Counts, facets and profiles over analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.where(F.col(columns[0]).isNotNull()).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The most frequent values, ties by name: a report of `most` rows."""
    return counts.orderBy(F.desc("n"), by).limit(most)


def top_with_others(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The top values and how many others there are."""
    kept = top(counts.where(F.trim(F.col(by)) != ""), by, most)
    others = counts.where(F.trim(F.col(by)) != "").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("n")).select(F.lit("… others").alias(by), "n")
    return kept.select(by, "n").unionByName(others)


def numeric_profile(rows: DataFrame, value: Column) -> DataFrame:
    v = value.alias("v")
    return rows.select(v).agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


def buckets(rows: DataFrame, value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """How many values lie below the first bound, between neighbours, and from the last up; empty buckets are left out."""
    out = F.when(value < bounds[0], f"<{bounds[0]:g}")
    for a, b in zip(bounds, bounds[1:], strict=False):
        out = out.when(value < b, f"{a:g}-{b:g}")
    return rows.where(value.isNotNull()).groupBy(out.otherwise(f">={bounds[-1]:g}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rate(part: Column, whole: Column) -> Column:
    """Percent, rounded half to even; 0 where there is no whole."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, 0)).otherwise(0.0).cast("long")


def completeness(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """variable, n_present, percent (one decimal) in one pass over rows."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_present")) for c in columns])).alias("x")
    return totals.select("n", each).select("x.variable", "x.n_present", F.round(F.col("x.n_present") * 100.0 / F.col("n"), 1).alias("percent"))
