"""The evidence graph as DataFrames over the driver's tables: analyses, concept edges, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import numbers, text
from factweave.sources.shared import once

VOCAB, DATA, ONTOLOGY = "urn:kg/vocab/", "urn:kg/data/", "urn:kg/ontology/"
TYPE = "urn:kg/rdf/type"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: str, values: dict[str, str], otherwise: str | None = text.MISSING) -> Column:
    out = F.lit(otherwise)
    for k, v in reversed(values.items()):
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def integer(column: str) -> Column:
    return F.col(column).cast("int")


def hundredths(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("int")


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each analysis, with what it links and the context; texts as they came in (_raw) and as numbers.

    Only the columns that a query uses are read, joined and computed. The articles are joined by themselves and the lines come to them last, dealt by the article as
    the numbering of repeated ids needs them, so a line is dealt out by part and by article and not again.
    """
    t = lambda name: table(spark, sf_dir, name)
    articles = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = (
        t("lineitem")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(articles, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    raw_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    s = lambda c: c.cast("string")
    q, size, r = integer("l_quantity"), F.col("p_size"), hundredths("l_discount")
    distance = F.abs(r - 5)
    kept = joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw_id.alias("raw_id"), nth.alias("occurrence"),
        s(F.col("o_orderkey")).alias("article_id"), F.year("o_orderdate").cast("long").alias("article_year"), F.col("n_name").alias("country"), F.col("r_name").alias("continent"),
        mapped("o_orderstatus", {"O": "Cross-sectional studies", "F": "Longitudinal"}).alias("study_type"),
        mapped("l_returnflag", {"R": "+", "A": "-"}, "NS").alias("relation_direction"),
        mapped("l_linestatus", {"O": "Simple analyses"}, "Complex analyses").alias("complexity"),
        mapped("c_mktsegment", {"MACHINERY": "Male", "FURNITURE": "Female", "BUILDING": "Mixed"}).alias("gender"),
        mapped("o_orderpriority", {"1-URGENT": "Individual sport", "2-HIGH": "Team sport", "3-MEDIUM": "Mixed sport", "4-NOT SPECIFIED": "Aesthetic sport"}).alias("practice_type"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("sport_name"),
        F.concat(F.lit(VOCAB), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("vi_iri"), F.concat(F.lit(VOCAB), F.col("s_name")).alias("vd_iri"),
        F.when(F.col("l_suppkey") % 7 == 0, F.concat(F.lit("Mediator "), F.col("p_brand"))).when(F.col("l_suppkey") % 5 == 0, text.MISSING).alias("mediator"),
        F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("Moderator "), F.col("p_type"))).alias("moderator"),
        F.when(F.col("l_linenumber") == 1, text.MISSING).otherwise(F.concat(F.lit("M="), s(q), F.lit(","), s(r % 10), F.lit(" (SD=2,1)"))).alias("age_mean_raw"),
        F.when(F.col("l_linenumber") == 2, text.MISSING).otherwise(F.concat(F.lit("["), s(size), F.lit("-"), s(size + 5), F.lit("]"))).alias("age_range_raw"),
        F.when(F.col("l_linenumber") == 3, text.MISSING).otherwise(F.concat(s(q), F.lit(",5"))).alias("freq_mean_raw"),
        s(q).alias("freq_min_raw"), s(q + 4).alias("freq_max_raw"),
        F.when(F.col("l_suppkey") % 5 == 0, "hours").when(F.col("l_suppkey") % 5 == 1, "minutes").when(F.col("l_suppkey") % 5 == 2, "days").when(F.col("l_suppkey") % 5 == 3, "sessions").alias("freq_unit"),
        F.when(F.col("l_partkey") % 3 == 0, "day").otherwise("week").alias("freq_base"),
        F.concat(s(size), F.lit(",0")).alias("exp_mean_raw"), s(size).alias("exp_min_raw"), s(size + 3).alias("exp_max_raw"),
        F.when(F.col("l_partkey") % 5 == 0, "years").when(F.col("l_partkey") % 5 == 1, "months").when(F.col("l_partkey") % 5 == 2, "weeks").when(F.col("l_partkey") % 5 == 3, "days").alias("exp_unit"),
        s(F.floor(F.col("o_totalprice") / 250)).alias("sample_size_raw"),
        F.concat(F.when(r < 5, "-").otherwise(""), F.when(distance == 5, "1,0").otherwise(F.concat(F.lit("0,"), s(distance * 2)))).alias("degree_r_raw"),
        F.concat(F.lit("0,0"), s(hundredths("l_tax"))).alias("degree_p_raw"),
    )
    lo, hi = numbers.range_of(F.col("age_range_raw"))
    n = lambda c: numbers.number(F.col(c))
    vi, vd = text.local_name(F.col("vi_iri")), text.local_name(F.col("vd_iri"))
    unit, base, exp_unit = F.col("freq_unit"), F.col("freq_base"), F.col("exp_unit")
    out = kept.withColumns({
        "analysis_id": F.when(F.col("occurrence") == 1, F.col("raw_id")).otherwise(F.concat("raw_id", F.lit("."), s(F.col("occurrence") - 1))),
        "vi": vi, "vd": vd, "vi_label": text.label(vi), "vd_label": text.label(vd),
        "age_mean": numbers.mean_of(F.col("age_mean_raw")), "age_lo": lo, "age_hi": hi,
        "freq_mean": n("freq_mean_raw"), "freq_min": n("freq_min_raw"), "freq_max": n("freq_max_raw"),
        "exp_mean": n("exp_mean_raw"), "exp_min": n("exp_min_raw"), "exp_max": n("exp_max_raw"),
        "sample_size": F.col("sample_size_raw").try_cast("long"), "degree_r": n("degree_r_raw"), "degree_p": n("degree_p_raw"),
    })
    return out.withColumns({
        "freq_hours": numbers.weekly_hours(F.col("freq_mean"), unit, base), "freq_mean4": numbers.weekly_hours_short(F.col("freq_mean"), unit, base),
        "freq_min4": numbers.weekly_hours_short(F.col("freq_min"), unit, base), "freq_max4": numbers.weekly_hours_short(F.col("freq_max"), unit, base),
        "exp_years": numbers.years(F.col("exp_mean"), exp_unit), "exp_min_years": numbers.years(F.col("exp_min"), exp_unit), "exp_max_years": numbers.years(F.col("exp_max"), exp_unit),
    })


def stored_analyses(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of analyses for a query that reads them several times: joined once for each application and state of the tables."""
    tables = ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")
    columns = sorted(set(columns))
    return once(spark, f"analyses {columns}", [f"{sf_dir}/{t}.parquet" for t in tables], lambda: analyses(spark, sf_dir).select(*columns), "analyses")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent: the broader relation between concepts."""
    t = lambda name: table(spark, sf_dir, name)
    v = lambda c: F.concat(F.lit(VOCAB), c)
    joined = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    kind = F.concat(F.lit(VOCAB + "Type_"), F.col("p_type"))
    up = F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), VOCAB + "Size_factor").otherwise(VOCAB + "Market_factor")
    return (
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(v(F.col("s_name")).alias("child"), v(F.col("n_name")).alias("parent"))
        .union(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(v(F.col("n_name")), v(joined("r_name"))))
        .union(t("part").select(v(joined("p_name")), kind))
        .union(t("part").select(kind, up))
        .distinct()
    )


#: predicate local name and the column of analyses that it holds.
PROPERTIES = ("relation_direction", "complexity", "gender", "practice_type", "sport_name", "mediator", "moderator", "country", "study_type", "vi_iri", "vd_iri", "age_mean_raw", "article_id")


def subject() -> Column:
    """The IRI of a row of analyses."""
    return F.concat(F.lit(DATA + "Analysis_"), F.col("analysis_id"))


def triples(rows: DataFrame, properties: tuple[str, ...] = PROPERTIES, typed: bool = True) -> DataFrame:
    """s, p, o of analyses: one for each property that is neither null nor blank, and (typed) one for the class.

    A set without a shuffle, as an analysis has one row and a property one value. Only the columns that the properties need are read.
    """
    s = subject()
    made = [F.struct(F.lit(TYPE).alias("p"), F.lit(ONTOLOGY + "Analysis").alias("o"))] if typed else []
    made += [F.struct(F.lit(ONTOLOGY + c).alias("p"), F.col(c).alias("o")) for c in properties]
    return rows.select(s.alias("s"), F.explode(F.array(*made)).alias("t")).select("s", "t.p", "t.o").where("o is not null and o <> ''")
