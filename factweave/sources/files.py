"""Delimited files and N-Triples, in and out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.sources.shared import distinct_rows

#: Headers that come under another name, and headers that must be there.
RENAMED = {"Analysis ID": "Analysis_ID", "Sport name": "Sport_name", "Measure VD": "Measure_VD", "Measure VI": "Measure_VI"}
REQUIRED = ("Analysis_ID", "Sport_name", "Measure_VD", "VD_final_sub-class", "Measure_VI", "VI_final_sub-class", "Title", "Country")


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in df.columns]


def read_delimited(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """All columns as text; a byte-order mark is dropped, quotes are honoured."""
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")


def write_delimited(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> None:
    df.write.csv(path, sep=sep, header=True, quoteAll=quote_all, escape='"', emptyValue="")


def renamed(df: DataFrame, names: dict[str, str] = RENAMED) -> DataFrame:
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def without_blank_rows(df: DataFrame) -> DataFrame:
    return df.where(reduce(or_, [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in df.columns]))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Columns that have a value somewhere; one aggregate over df."""
    has = df.agg(*[F.max(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if has[c]])


def with_unique_ids(df: DataFrame, key: str, *order: str) -> DataFrame:
    """unique_id: the key, trimmed, then key.1, key.2 for its repetitions in the given order; blank keys stay."""
    k = F.trim(F.col(key))
    # Blank keys take no number: their rows are spread.
    blank = F.when(F.coalesce(k, F.lit("")) == "", F.xxhash64(*order))
    n = F.row_number().over(Window.partitionBy(k, blank).orderBy(*order))
    return df.withColumn("unique_id", F.when((k == "") | (n == 1), k).otherwise(F.concat(k, F.lit("."), (n - 1).cast("string"))))


def unescaped(literal: Column) -> Column:
    """A literal's text without the escapes of N-Triples."""

    def code_points(x: Column, mark: str, digits: int, charset: str) -> Column:
        parts = F.split(x, mark)
        char = lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, digits)), charset), p.substr(F.lit(digits + 1), F.length(p)))
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), char), ""))

    def part(x: Column) -> Column:
        x = code_points(code_points(x, r"\\U", 8, "UTF-32"), r"\\u", 4, "UTF-16BE")
        for escape, char in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f")):
            x = F.replace(x, F.lit(escape), F.lit(char))
        return x

    # An escaped backslash begins no other escape.
    return F.when(literal.contains("\\"), F.array_join(F.transform(F.split(literal, r"\\\\"), part), "\\")).otherwise(literal)


#: A line with one space between its terms, whose object is an IRI or a string without tag, quote or backslash.
PLAIN = r'^<[^<> ]*> <[^<> ]*> (?:<[^<>]*>|"[^"\\]*") \.$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_kind, o_datatype, o_lang; comments and blank lines are left out, repeated triples count once.

    A plain line is cut at its marks and is its own digest; any other is matched by patterns, and its digest is that of the plain line that would say the same.
    """
    value, plain, size = F.col("value"), F.col("plain"), F.col("size")
    term = '(?s)^\\s*(<[^>]*>|_:\\S+)\\s+<([^>]*)>\\s+(.*?)\\s*\\.\\s*$'
    literal = r'(?s)^"((?:[^"\\]|\\.)*)"'
    # Matched once; a line holds no line end, so that marks the terms off.
    terms = F.when(~plain, F.split(F.regexp_replace("value", term, "$1\n$2\n$3"), "\n"))
    lines = spark.read.text(path).select("value", value.rlike(PLAIN).alias("plain")).where(plain | value.rlike(term))
    lines = lines.select("value", "plain", terms.alias("t"), F.substring_index("value", ">", 2).alias("head")).select("*", F.length("head").alias("size"))
    either = lambda told, odd: F.when(plain, told).otherwise(odd)
    said = lines.select(
        "value", "plain", "size",
        either(F.substring_index("head", ">", 1).substr(F.lit(2), size), F.regexp_replace(F.col("t")[0], "[<>]", "")).alias("s"),
        either(F.substring_index("head", "<", -1), F.col("t")[1]).alias("p"),
        F.when(~plain, F.col("t")[2]).alias("raw"),
    )
    raw = F.col("raw")
    kind = F.when(raw.startswith("<"), "iri").when(raw.startswith("_:"), "bnode").otherwise("literal")
    odd = F.when(raw.startswith('"'), unescaped(F.regexp_extract("raw", literal, 1))).otherwise(F.regexp_replace("raw", "[<>]", ""))
    tag = lambda pattern: F.when(~plain, F.nullif(F.regexp_extract("raw", pattern, 1), F.lit("")))
    parsed = said.select(
        "value", "plain", "s", "p",
        either(value.substr(size + 4, F.length("value") - size - 6), odd).alias("o"),
        either(F.when(value.endswith("> ."), "iri").otherwise("literal"), kind).alias("o_kind"),
        tag('\\^\\^<([^>]*)>$').alias("o_datatype"),
        tag('"@([A-Za-z-]+)$').alias("o_lang"),
    )
    o, mark = F.col("o"), lambda c, m: F.coalesce(F.concat(F.lit(m), c), F.lit(""))
    shown = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), o, F.lit(">"))).when(F.col("o_kind") == "bnode", o).otherwise(F.concat(F.lit('"'), o, F.lit('"'), mark("o_datatype", "^^"), mark("o_lang", "@")))
    line = either(value, F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), shown, F.lit(" .")))
    return distinct_rows(parsed.select("s", "p", "o", "o_kind", "o_datatype", "o_lang", F.xxhash64(line).alias("digest")), "digest")
