"""Reports of many measures in one pass, without a row for each distinct count.

`distincts` brings rows to a long form (measure, value), makes that distinct by one shuffle, and counts: so any number of distinct counts cost one
shuffle of their values, not copies of every row, and a value that a third of the rows share is taken out where it lies. Sums, averages and
conditional counts are one aggregate beside it.

Blank and missing values (null, '', NA, N.A., N/A) count as absent. Repeated rows count each. An empty table gives zeros, and nulls for averages, extremes and modes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import present


def distincts(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row with a column for each measure: how many different values its column has."""
    cells = F.array(*[F.struct(F.lit(k).alias("measure"), present(v.cast("string")).alias("value")) for k, v in columns.items()])
    counts = rows.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").distinct().groupBy("measure").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("measure") == k, F.col("n"))), F.lit(0)).alias(k) for k in columns])


def mode(rows: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent present value (ties: the least) and its number."""
    counts = rows.select(present(F.col(column)).alias("mode")).where("mode IS NOT NULL").groupBy("mode").agg(F.count(F.lit(1)).alias("mode_n"))
    best = F.min_by(F.struct("mode", "mode_n"), F.struct(-F.col("mode_n"), F.col("mode"))).alias("best")
    return counts.agg(best).select(F.col("best.mode").alias("mode"), F.coalesce("best.mode_n", F.lit(0)).alias("mode_n"))


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0].withColumn("one", F.lit(1))
    for f in frames[1:]:
        out = out.join(F.broadcast(f.withColumn("one", F.lit(1))), "one")
    return out.drop("one")


def when(condition: Column | str) -> Column:
    return F.count(F.when(F.expr(condition) if isinstance(condition, str) else condition, 1))


def summary(rows: DataFrame) -> DataFrame:
    """The eleven measures of the whole table: counts, different values, directions, and the profile of sample sizes and ages."""
    plain = rows.agg(
        F.count(F.lit(1)).alias("analyses"), when("relation_direction = '+'").alias("risk"), when("relation_direction = '-'").alias("protective"), when(F.col("relation_direction").isin("NS", "N.S.")).alias("not_significant"),
        F.round(F.avg("age_mean"), 6).alias("mean_age"), F.sum("sample_size").alias("participants"), F.round(F.avg("sample_size"), 6).alias("mean_sample"))
    return beside(plain, distincts(rows, {"articles": F.col("article_id"), "factors": F.col("vi"), "outcomes": F.col("vd"), "countries": F.col("country")}))


def is_valid(vi: str = "vi", vd: str = "vd") -> Column:
    """Whether a result has what a relation needs: both variables and a direction."""
    return present(F.col(vi)).isNotNull() & present(F.col(vd)).isNotNull() & present(F.col("relation_direction")).isNotNull()


def results(rows: DataFrame, valid: Column) -> DataFrame:
    """Statistics of a result: valid rows and errors, success in percent (1 decimal), different countries, journals and sports, and the years."""
    n, good = F.count(F.lit(1)), when(valid)
    plain = rows.agg(
        n.alias("results"), good.alias("valid"), (n - good).alias("errors"), F.coalesce(F.round(good * 100.0 / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("success_percent"),
        F.min("article_year").alias("first_year"), F.max("article_year").alias("last_year"), F.floor(F.avg("article_year") + 0.5).alias("mean_year"))
    return beside(plain, distincts(rows.where(valid), {"countries": F.col("country"), "journals": F.col("journal"), "sports": F.col("sport_name")}))


def competency(rows: DataFrame, valid: Column) -> DataFrame:
    """The statistics of results with the kinds of relation and the most frequent one."""
    return beside(results(rows, valid), distincts(rows.where(valid), {"relation_types": F.col("relation_direction")}), mode(rows.where(valid), "relation_direction"))


def breakdown(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """key (prefix:value), n, percent of all analyses (1 decimal): a row counts once for each of its categories."""
    cells = F.array(*[F.struct(F.lit(f"{k}:").alias("prefix"), present(F.col(c)).alias("value")) for k, c in columns.items()])
    counts = rows.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("prefix", "value").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select(F.concat("prefix", "value").alias("key"), "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))
