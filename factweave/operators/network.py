"""The network of factors: nodes, links, curves, and the full record of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import present


def nodes(rows: DataFrame) -> DataFrame:
    """id (type_label), type, label, category (the least), n_analyses: factors, outcomes, mediators and moderators that are present."""
    parts = F.array(*[F.struct(F.lit(kind).alias("type"), F.col(c).alias("label"), category.alias("category")) for kind, c, category in (
        ("factor", "vi", F.col("category_vi")), ("acad", "vd", F.col("category_vd")), ("mediator", "mediator", F.lit("mediator")), ("moderator", "moderator", F.lit("moderator")))])
    each = rows.select("analysis_id", F.explode(parts).alias("n")).select("analysis_id", "n.*").where(present(F.col("label")).isNotNull())
    return each.groupBy("type", "label").agg(F.min("category").alias("category"), F.countDistinct("analysis_id").alias("n_analyses")).select(F.concat_ws("_", "type", "label").alias("id"), "type", "label", "category", "n_analyses")


def links(rows: DataFrame) -> DataFrame:
    """analysis_id, source, target, relation: through the mediator, else the moderator, else straight."""
    link = lambda a, b, r: F.struct(a.alias("source"), b.alias("target"), r.alias("relation"))
    vi, vd, rel = F.concat(F.lit("factor_"), "vi"), F.concat(F.lit("acad_"), "vd"), F.coalesce("relation_direction", F.lit("NS"))
    via = lambda kind: F.array(link(vi, F.concat(F.lit(f"{kind}_"), kind), F.lit(kind)), link(F.concat(F.lit(f"{kind}_"), kind), vd, rel))
    made = F.when(present(F.col("mediator")).isNotNull(), via("mediator")).when(present(F.col("moderator")).isNotNull(), via("moderator")).otherwise(F.array(link(vi, vd, rel)))
    return rows.select("analysis_id", F.explode(made).alias("l")).select("analysis_id", "l.*")


def grouped_links(each: DataFrame) -> DataFrame:
    """A link for each source, target and relation: the first analysis, how many, and a label."""
    out = each.groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("analysis_id").alias("representative"))
    return out.withColumn("label", F.when(F.col("n") > 1, F.concat("relation", F.lit(" ("), F.col("n").cast("string"), F.lit(" analyses)"))).otherwise(F.col("relation")))


def curves(grouped: DataFrame, spread: float = 60.0) -> DataFrame:
    """Links with their offset among those of the same two nodes, in whichever direction."""
    pair = [F.least("source", "target"), F.greatest("source", "target")]
    n = F.count(F.lit(1)).over(Window.partitionBy(*pair))
    i = F.row_number().over(Window.partitionBy(*pair).orderBy("source", "target", "relation")).cast("long") - 1
    return grouped.select("source", "target", "relation", i.alias("place"), n.alias("total")).withColumn(
        "offset", F.when(F.col("total") > 1, (F.col("place") - (F.col("total") - 1) / 2.0) * spread / (F.col("total") - 1)).otherwise(0.0))


#: entity and its columns, for the full record.
ENTITIES = {
    "analysis": ("complexity", "relation_direction", "mediator", "moderator"),
    "article": ("article_id", "article_year", "country", "continent", "study_type"),
    "population": ("gender", "sample_size_raw", "age_mean_raw", "age_range_raw"),
    "sport": ("sport_name", "practice_type"),
    "variables": ("vi", "vd"),
    "frequency": ("freq_mean_raw", "freq_min_raw", "freq_max_raw", "freq_unit", "freq_base"),
    "experience": ("exp_mean_raw", "exp_min_raw", "exp_max_raw", "exp_unit"),
}


def record(rows: DataFrame, *properties: str) -> DataFrame:
    """analysis_id, entity, property, value: every present property of each analysis, or of some properties only."""
    cells = [F.struct(F.lit(e).alias("entity"), F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for e, cs in ENTITIES.items() for c in cs if not properties or c in properties]
    return rows.select("analysis_id", F.explode(F.array(*cells)).alias("x")).select("analysis_id", "x.*").where("value is not null")


def wide_record(rows: DataFrame) -> DataFrame:
    """Every property as a column, absent ones as N/A, and how many are present."""
    columns = [c for cs in ENTITIES.values() for c in cs]
    count = sum((F.col(c).isNotNull().cast("long") for c in columns), F.lit(0).cast("long"))
    return rows.select("analysis_id", *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in columns], count.alias("n_properties"))
