"""The fixed competency questions: one template, a condition and columns for each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.hierarchy import descendants_of
from factweave.operators.search import contains_any, with_categories

BASE = ("vi", "vd", "category_vi", "category_vd", "relation_direction", "analysis_id")


@dataclass(frozen=True)
class Question:
    title: str
    equal: tuple[tuple[str, str], ...] = ()
    extra: tuple[str, ...] = ()
    vi_below: str | None = None
    sports: tuple[str, ...] = ()
    mean_age: tuple[float, float] | None = None
    has_sport: bool = False


def _dimension(prefix: str, column: str, values: dict[str, str], **more) -> dict[str, Question]:
    return {f"{prefix}_{k}": Question(f"{column} = {v}", ((column, v),), (column,), **more) for k, v in values.items()}


GENDERS = {"male": "Male", "female": "Female", "mixed": "Mixed"}
PRACTICES = {"individual": "Individual sport", "team": "Team sport", "mixed": "Mixed sport", "aesthetic": "Aesthetic sport"}
QUESTIONS = {
    "q1": Question("all relations", extra=("mediator", "moderator")),
    **_dimension("q2", "relation_direction", {"protective": "-", "risk": "+", "ambiguous": "NS"}),
    **{f"q3_{k}": Question(f"factors below {v}", vi_below=v) for k, v in {"a": "Market factor", "b": "Size factor", "c": "Type SMALL", "d": "Type PROMO"}.items()},
    **_dimension("q4", "gender", GENDERS),
    **_dimension("q5", "practice_type", PRACTICES),
    **_dimension("q6", "gender", GENDERS),
    "q7_profile": Question("men of about 20 in one sport", (("gender", "Male"),), ("gender", "sport_name", "age_mean"), sports=("gear",), mean_age=(18, 22)),
    **_dimension("q8", "practice_type", PRACTICES, has_sport=True),
    "default": Question("general question"),
    "fallback": Question("simple analyses", (("complexity", "Simple analyses"),)),
}


def answer(rows: DataFrame, edges: DataFrame, closure: DataFrame, question: str) -> DataFrame:
    """The distinct rows that answer a question; an unknown one is answered as 'default'."""
    q = QUESTIONS.get(question, QUESTIONS["default"])
    for column, value in q.equal:
        rows = rows.where(F.col(column) == value)
    if q.sports:
        rows = rows.where(contains_any(F.col("sport_name"), q.sports))
    if q.mean_age:
        rows = rows.where(F.col("age_mean").between(*q.mean_age))
    if q.has_sport:
        rows = rows.where(F.col("sport_name").isNotNull())
    if q.vi_below:
        rows = rows.join(descendants_of(closure, q.vi_below).withColumnRenamed("descendant", "vi_iri"), "vi_iri", "left_semi")
    return with_categories(rows, edges).select(*dict.fromkeys((*BASE, *q.extra))).distinct()
