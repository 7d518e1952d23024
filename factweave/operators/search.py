"""The filtered search over analyses: typed filters become one conjunction; families choose their first matching form."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.hierarchy import descendants_of, min_category

#: The named categories and their bounds.
AGE = {"adolescent": (15, 19), "jeune-adulte": (18, 26), "adulte": (26, 35), "adulte-mature": (35, 50), "senior": (50, 80)}
FREQUENCY = {"faible": (0, 4.9), "moderee": (5, 10), "elevee": (10.1, 15), "intensive": (15.1, 50)}
EXPERIENCE = {"debutant": (0, 1.9), "intermediaire": (2, 7), "experimente": (7.1, 15), "expert": (15.1, 50)}
RESULT = ("analysis_id", "vi", "vd", "category_vi", "category_vd", "mediator", "moderator", "relation_direction", "reference", "gender", "practice_type", "sport_name")


@dataclass(frozen=True)
class Statistic:
    """One family of filters (age, frequency, experience): mean near a value; named categories; a range for the mean; bounds for the range."""

    mean: float | None = None
    categories: tuple[str, ...] = ()
    overlap: bool = True
    low: float | None = None
    high: float | None = None
    by_mean: bool = False
    inclusive: bool = False

    def __post_init__(self):
        if self.low is not None and self.high is not None and self.low >= self.high:
            raise ValueError("low must be less than high")


@dataclass(frozen=True)
class Family:
    """The columns of a family: the mean for one value, the mean and range for categories and inclusive ranges, and the plain range."""

    names: dict
    near: str
    mean: str
    low: str
    high: str
    plain_low: str
    plain_high: str


FAMILIES = {
    "age": Family(AGE, "age_mean", "age_mean", "age_lo", "age_hi", "age_lo", "age_hi"),
    "frequency": Family(FREQUENCY, "freq_hours", "freq_mean4", "freq_min4", "freq_max4", "freq_min", "freq_max"),
    "experience": Family(EXPERIENCE, "exp_years", "exp_years", "exp_min_years", "exp_max_years", "exp_min", "exp_max"),
}


@dataclass(frozen=True)
class Filters:
    age: Statistic | None = None
    frequency: Statistic | None = None
    experience: Statistic | None = None
    gender: str | None = None
    category_vi: str | None = None
    category_vd: str | None = None
    #: immediate: the least direct parent; ancestor: any above.
    category_vi_mode: str = "immediate"
    practice_types: tuple[str, ...] = ()
    sports: tuple[str, ...] = ()
    sport_type: str | None = None
    vi: str | None = None
    vd: str | None = None
    direction: str | None = None
    simple_only: bool = True
    extra: tuple[Column, ...] = field(default=())


def in_statistic(f: Statistic, c: Family) -> Column | None:
    between = lambda col, lo, hi: F.coalesce(F.col(col).between(lo, hi), F.lit(False))
    overlaps = lambda lo, hi: F.coalesce((F.col(c.high) >= lo) & (F.col(c.low) <= hi), F.lit(False))
    if f.mean is not None:
        return between(c.near, f.mean - 1, f.mean + 1)
    if f.categories:
        bounds = [c.names[k] for k in f.categories]
        return reduce(or_, [between(c.mean, *b) | overlaps(*b) if f.overlap else between(c.mean, *b) for b in bounds])
    if f.low is not None and f.high is not None and f.by_mean:
        return between(c.mean, f.low, f.high) | (overlaps(f.low, f.high) if f.inclusive else F.lit(False))
    bounds = [F.col(c.plain_low) >= f.low] if f.low is not None else []
    bounds += [F.col(c.plain_high) <= f.high] if f.high is not None else []
    return reduce(and_, bounds) if bounds else None


def contains_any(column: Column, words: tuple[str, ...]) -> Column:
    """Case-insensitive, as literals."""
    return reduce(or_, [F.lower(column).contains(w.lower()) for w in words])


def with_categories(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with category_vi and category_vd; the categories are as many as labels, and Spark broadcasts them while they are small."""
    by = min_category(edges)
    for v in ("vi", "vd"):
        rows = rows.join(by.withColumnsRenamed({"label": f"{v}_label", "category": f"category_{v}"}), f"{v}_label", "left")
    return rows


def search(rows: DataFrame, edges: DataFrame, closure: DataFrame | None, f: Filters = Filters()) -> DataFrame:  # noqa: B008
    """The RESULT columns of the analyses that pass all filters. closure is needed for category_vd and category_vi_mode 'ancestor'."""
    conditions = list(f.extra)
    if f.simple_only:
        conditions.append(F.col("complexity").isin("Simple analyses", "simple analyses"))
    for name, family in FAMILIES.items():
        if (s := getattr(f, name)) is not None and (c := in_statistic(s, family)) is not None:
            conditions.append(c)
    for column, value in (("gender", f.gender), ("vi", f.vi), ("vd", f.vd), ("relation_direction", f.direction)):
        if value is not None:
            conditions.append(F.col(column) == value)
    if f.practice_types:
        conditions.append(F.col("practice_type").isin(*f.practice_types))
    if f.sports or f.sport_type:
        conditions.append(contains_any(F.col("sport_name"), f.sports or (f.sport_type,)))
    for c in conditions:
        rows = rows.where(c)
    if f.category_vd is not None:
        rows = rows.join(descendants_of(closure, f.category_vd).withColumnRenamed("descendant", "vd_iri"), "vd_iri", "left_semi")
    if f.category_vi is not None and f.category_vi_mode == "ancestor":
        rows = rows.join(descendants_of(closure, f.category_vi).withColumnRenamed("descendant", "vi_iri"), "vi_iri", "left_semi")
    out = with_categories(rows, edges)
    if f.category_vi is not None and f.category_vi_mode == "immediate":
        out = out.where(F.col("category_vi") == f.category_vi)
    return out.withColumn("reference", F.col("raw_id")).select(*RESULT)
