"""Exports of a result: triples under a running index, and a wide table whose columns come from the data.

Nulls are left out of triples and are empty in wide tables; ties in the order are numbered by all columns; repeated rows are results of
their own; an empty result gives the metadata alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.sources.shared import kept

#: Buckets that rows are dealt to for numbering, by ranges of the order.
RANGES = 64


def indexed(rows: DataFrame, *order: str, ranges: int = RANGES) -> DataFrame:
    """rows with index, from 1 over the whole result, without a task that holds all of them.

    Rows are dealt to sorted ranges of the order; the sums of the ranges before give each range its first index, and rows are
    numbered within their range only.
    """
    every = [*order, *[c for c in rows.columns if c not in order]]
    # Rows that are equal in every column may be many: the row's place tells them apart, so they too are dealt out.
    placed = rows.select(F.struct(*every, F.monotonically_increasing_id().alias("place")).alias("k"))
    cuts = placed.repartitionByRange(ranges, "k").select(F.spark_partition_id().alias("range"), "k")
    # The ranges depend on a sample: they are written once, so that numbers and sums speak of the same.
    dealt = kept(cuts.select("range", "k.*"))
    sizes = sorted((r["range"], r["n"]) for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # at most ranges rows
    firsts, at = [], 0
    for k, n in sizes:
        firsts.append((k, at))
        at += n
    start = F.broadcast(rows.sparkSession.createDataFrame(firsts, "range int, first long"))
    number = F.row_number().over(Window.partitionBy("range").orderBy(*every, "place"))
    return dealt.withColumn("number", number).join(start, "range").select(*rows.columns, (F.col("first") + F.col("number")).alias("index"))


def term(value: Column, is_iri: Column | bool) -> Column:
    """A value as Turtle text."""
    literal = F.concat(F.lit('"'), text.escaped(value), F.lit('"'))
    return F.when(F.lit(is_iri) if isinstance(is_iri, bool) else is_iri, F.concat(F.lit("<"), value, F.lit(">"))).otherwise(literal)


def result_triples(rows: DataFrame, order: tuple[str, ...], iris: tuple[str, ...] = (), about: dict[str, str] | None = None) -> DataFrame:
    """s, p, o: export:result_1, export:result_2, ... with a predicate for each value that is there, its index, and a metadata node with what about says and the count."""
    numbered = indexed(rows, *order)
    values = [F.struct(F.lit(f"export:{c}").alias("p"), F.when(F.col(c).isNotNull(), term(F.col(c).cast("string"), c in iris)).alias("o")) for c in rows.columns]
    values.append(F.struct(F.lit("export:resultIndex").alias("p"), F.col("index").cast("string").alias("o")))
    each = numbered.select(F.concat(F.lit("export:result_"), F.col("index").cast("string")).alias("s"), F.explode(F.array(*values)).alias("x")).select("s", "x.*").where("o IS NOT NULL")
    notes = [F.struct(F.lit(f"export:{k}").alias("p"), term(F.lit(v), False).alias("o")) for k, v in (about or {}).items()]
    notes.append(F.struct(F.lit("export:resultCount").alias("p"), F.count(F.lit(1)).cast("string").alias("o")))
    head = rows.agg(F.array(*notes).alias("notes")).select(F.lit("export:metadata").alias("s"), F.explode("notes").alias("x")).select("s", "x.*")
    return each.unionByName(head)


def turtle_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


#: Properties that come first in a wide table.
PRIORITY = ("analysisId", "title", "creator", "date", "doi", "journal", "country", "gender", "sampleSize", "sportName", "VI", "VD", "resultatRelation")
#: Columns of a wide table at most; more properties are an error, never left out.
MOST_COLUMNS = 2000


def wide_columns(properties: list[str], priority: tuple[str, ...] = PRIORITY) -> list[str]:
    """Those of priority that are there, in its order, then the rest by name."""
    there = set(properties)
    return [p for p in priority if p in there] + sorted(there - set(priority))


def wide(rows: DataFrame, key: str, priority: tuple[str, ...] = PRIORITY, separator: str = " | ") -> DataFrame:
    """One row for each key of rows (key, property, value), a column for each property that occurs; distinct values of one are joined in order."""
    found = [r["property"] for r in rows.where("property IS NOT NULL").select("property").distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} properties; export them as triples")
    if clash := {key, f"{key}_"} & set(found):
        raise ValueError(f"a property is named like the key: {sorted(clash)}")
    values = F.when(F.count("value") > 0, F.array_join(F.array_sort(F.collect_set("value")), separator))
    return rows.groupBy(key).pivot("property", wide_columns(found, priority)).agg(values)
