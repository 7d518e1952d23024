"""Column functions on numbers written as text, and their units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number with a decimal comma or point, null where it is none."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("decimal(18,6)").cast("double")


def mean_of(text: Column) -> Column:
    """21.5 from 'M=21,5 (SD=2,1)'."""
    return number(F.regexp_extract(text, "^M=([0-9.,]+)", 1))


def range_of(text: Column) -> tuple[Column, Column]:
    """15 and 20 from '[15-20]'."""
    form = "^\\[([0-9.,]+)-([0-9.,]+)\\]"
    return number(F.regexp_extract(text, form, 1)), number(F.regexp_extract(text, form, 2))


def weekly_hours(v: Column, unit: Column, base: Column) -> Column:
    """Hours a week; without a known unit, numbers from 50 up are minutes."""
    u, b = F.coalesce(unit, F.lit("")), F.coalesce(base, F.lit(""))
    return (
        F.when((u == "minutes") & (b == "week"), v / 60.0)
        .when((u == "minutes") & (b == "day"), v / 60.0 * 7.0)
        .when((u == "hours") & (b == "day"), v * 7.0)
        .when((u == "hours") & (b == "week"), v)
        .when((u == "days") & (b == "week"), v * 24.0)
        .when((u == "sessions") & (b == "week"), v * 1.5)
        .otherwise(F.when(v < 50, v).otherwise(v / 60.0))
    )


def weekly_hours_short(v: Column, unit: Column, base: Column) -> Column:
    """Minutes and days a week in hours, all else as it is."""
    u, b = F.coalesce(unit, F.lit("")), F.coalesce(base, F.lit(""))
    return F.when((u == "minutes") & (b == "week"), v / 60.0).when((u == "days") & (b == "week"), v * 24.0).otherwise(v)


def years(v: Column, unit: Column) -> Column:
    u = F.coalesce(unit, F.lit(""))
    return F.when(u == "months", v / 12.0).when(u == "weeks", v / 52.0).when(u == "days", v / 365.0).otherwise(v)


#: Factors to hours a week by unit/base, and to years by unit.
HOURS = {
    "hours/week": 1.0,
    "hours/day": 7.0,
    "hours/month": 1.0 / 4.33,
    "minutes/week": 1.0 / 60,
    "minutes/day": 7.0 / 60,
    "sessions/week": 1.5,
    "sessions/day": 10.5,
    "times/week": 1.5,
    "times/day": 10.5,
}
YEARS = {"years": 1.0, "months": 1.0 / 12, "weeks": 1.0 / 52, "days": 1.0 / 365}


def unit_key(unit: Column, base: Column | None = None) -> Column:
    """unit/base, or the unit alone, in lower case and trimmed; null where a part is missing."""
    u = F.lower(F.trim(unit))
    return u if base is None else F.concat(u, F.lit("/"), F.lower(F.trim(base)))


def converted(v: Column, key: Column, factor: Column) -> Column:
    """v by its unit's factor (unknown units: unchanged); null for a missing unit, a missing value or 0."""
    return F.when(key.isNotNull() & (v != 0), v * F.coalesce(factor, F.lit(1.0)))


def unit_table(spark: SparkSession, kind: str, more: dict[str, float] | None = None) -> DataFrame:
    """unit_key, factor: the factors of a kind ("frequency" or "experience"), with those of `more` added or put in their place."""
    table = {"frequency": HOURS, "experience": YEARS}[kind]
    return spark.createDataFrame(list((table | (more or {})).items()), "unit_key string, factor double")
