"""Delimited text as it comes: short and long rows, stray quotes, blank lines, rows without an id.

Lines are read as text and cut naively, as a hand-written loader does: quotes are deleted and every separator cuts, also within quotes. What is wrong
with a row is said in a column beside it, so nothing is lost: a caller takes the good rows, and counts or mends the others.

The header is the first line of the first file; lines equal to it are headers of further files. A byte-order mark is dropped; blank lines are skipped;
cells are trimmed; missing cells are empty texts; cells beyond the header are kept in `extra`. An empty file gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text

OK, SHORT, LONG, NO_ID, QUOTES = "", "short", "long", "no id", "stray quotes"


def read_ragged(spark: SparkSession, path: str, key: str, sep: str = ";") -> DataFrame:
    """The header's columns as text, extra (cells beyond them), and problem: no id, short, long or stray quotes, the first that holds, else ''."""
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "^﻿", ""), F.lit("\r")).alias("line")).where(F.trim("line") != "")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], f"`{key}` string, extra array<string>, problem string")
    cut = lambda c: F.transform(F.split(F.replace(c, F.lit('"'), F.lit("")), f"\\Q{sep}\\E", -1), lambda x: F.trim(x))
    names = [x.strip() for x in first["line"].replace('"', "").split(sep)]
    if key not in names or len(set(names)) < len(names) or {"extra", "problem"} & set(names):
        raise ValueError(f"the header must name {key} and no column twice: {names}")
    rows = lines.where(F.col("line") != F.lit(first["line"])).select("line", cut(F.col("line")).alias("cells"))
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    size, n = F.size("cells"), len(names)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    identifier: Column = text.present(F.coalesce(F.get("cells", F.lit(names.index(key))), F.lit("")))
    problem = F.when(identifier.isNull(), NO_ID).when(size < n, SHORT).when(size > n, LONG).when(quotes % 2 == 1, QUOTES).otherwise(OK)
    extra = F.when(size > n, F.slice("cells", n + 1, F.greatest(size - n, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return rows.select(*cells, extra.alias("extra"), problem.alias("problem"))


def taken(rows: DataFrame) -> DataFrame:
    """The rows a loader keeps: all but those without an id, missing cells as empty texts."""
    return rows.where(F.col("problem") != NO_ID).drop("extra", "problem")


def problems(rows: DataFrame) -> DataFrame:
    """problem, n."""
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
