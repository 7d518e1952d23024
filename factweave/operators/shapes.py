"""Constraints on the properties of a class's members, and their violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.sources.binding import TYPE


def members(triples: DataFrame, cls: str) -> DataFrame:
    return triples.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s")


def _violations(bad: DataFrame, path: str, constraint: str) -> DataFrame:
    return bad.select(F.col("s").alias("focus"), F.lit(path).alias("path"), F.lit(constraint).alias("constraint"))


def count_violations(triples: DataFrame, cls: str, path: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Members with fewer than least or more than most values of path."""
    n = triples.where(F.col("p") == path).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    per = members(triples, cls).join(n, "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = _violations(per.where(F.col("n") < least), path, "min_count")
    return low if most is None else low.unionByName(_violations(per.where(F.col("n") > most), path, "max_count"))


def value_violations(triples: DataFrame, cls: str, path: str, good: Column, constraint: str) -> DataFrame:
    """Members with a value of path that is not good; good is a condition on o."""
    return _violations(triples.where((F.col("p") == path) & ~F.coalesce(good, F.lit(False))).join(members(triples, cls), "s", "left_semi"), path, constraint)


def class_violations(triples: DataFrame, cls: str, path: str, target: DataFrame) -> DataFrame:
    """Members whose value of path is not among target (column o)."""
    return _violations(triples.where(F.col("p") == path).join(members(triples, cls), "s", "left_semi").join(target, "o", "left_anti"), path, "class")
