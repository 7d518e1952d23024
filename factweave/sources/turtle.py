"""Turtle text, read and written as Spark text files.

The reader splits files where a line ends in a point, which no short string can hold, so files are read in parts. A statement is cut into tokens by one
pattern; its ; and , lists are unfolded by splits at these tokens alone, so a string may hold any of them. Prefixes are gathered
for each file and joined in.

Understood: prefixes, IRIs, prefixed names, a, short strings with escapes, languages and datatypes, integers, decimals, booleans, labelled blank
nodes, ; and , lists, comments. Not understood, and given by `bad_statements`, never lost: [] and () forms, long strings, @base, a prefix that is nowhere defined. A prefix
defined twice in a file must be the same. Repeated triples count once; an empty file gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.sources.files import unescaped
from factweave.sources.mapping import DECIMAL, INTEGER, TERMS, TYPE

BOOLEAN = "urn:xsd/boolean"
_IRI, _NAME = r"<[^<>\"\s]*>", r"(?:[A-Za-z][\w.-]*)?:(?:[\w%-](?:[\w.:%/-]*[\w%/-])?)?"
_LITERAL = rf'"(?:[^"\\\n]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^(?:{_IRI}|{_NAME}))?'
_NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?"
_BLANK = r"_:[\w-]+"
#: One token; comments are taken as tokens too, so that a # in a string or an IRI is none.
TOKEN = rf"#[^\n]*|@prefix|{_LITERAL}|{_IRI}|{_BLANK}|{_NAME}|{_NUMBER}|\btrue\b|\bfalse\b|\ba\b|[;,]"
_CUT = "\u0001"


_COMMENTS = r"\s*(?:#[^\n]*(?:\n\s*|$))*"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: the text of each statement or prefix, without its point; what is blank or comment alone is left out."""
    lines = spark.read.option("lineSep", ".\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^﻿|\.?\s*$", "").alias("value"))
    return lines.where(~F.col("value").rlike(f"^{_COMMENTS}$"))


def _tokens(lines: DataFrame) -> DataFrame:
    """lines with tokens (without comments), and whether they cover all but white space. The pattern goes over a line once: no filter asks for tokens."""
    every = lines.select("*", F.regexp_extract_all("value", F.lit(TOKEN), F.lit(0)).alias("every"))
    dense = lambda x: F.length(F.translate(x, " \t\n\r\f\u000b", ""))
    whole = dense(F.col("value")) == dense(F.array_join("every", ""))
    return every.select(*lines.columns, F.filter("every", lambda x: ~x.startswith("#")).alias("tokens"), whole.alias("whole"))


def _is_prefix() -> Column:
    return F.col("value").rlike(f"^{_COMMENTS}@prefix")


def prefixes(lines: DataFrame) -> DataFrame:
    """file, names: a map of the file's prefixes. One row for each file."""
    rows = _tokens(lines.where(_is_prefix())).where(F.size("tokens") == 3).select("file", F.struct(F.col("tokens")[1].alias("k"), F.regexp_replace(F.col("tokens")[2], "[<>]", "").alias("v")).alias("x")).distinct()
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_list("x")).alias("names"))


def _iri(token: Column) -> Column:
    """The IRI of an IRI token or of a prefixed name; null for an unknown prefix."""
    prefix = F.concat(F.substring_index(token, ":", 1), F.lit(":"))
    name = token.substr(F.length(prefix) + 1, F.length(token))
    known = F.element_at(F.col("names"), prefix)
    return F.when(token.startswith("<"), F.regexp_replace(token, "[<>]", "")).when(token.startswith("_:"), token).when(token == "a", TYPE).when(token.contains(":"), F.concat(known, name))


def _unfolded(spark: SparkSession, path: str) -> DataFrame:
    """value, whole (no text outside of tokens), and the terms of each triple, null where one isn't understood."""
    lines = _lines(spark, path)
    rows = _tokens(lines.where(~_is_prefix())).join(prefixes(lines), "file", "left")
    listed = F.regexp_replace(F.array_join(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), _CUT), f"({_CUT};)+$", "")
    rows = rows.select("value", "names", "whole", F.get("tokens", F.lit(0)).alias("s"), F.explode_outer(F.split(listed, f"{_CUT}(?:;{_CUT})+")).alias("group"))
    objects = F.split(F.regexp_replace("group", f"^[^{_CUT}]*{_CUT}?", ""), f"{_CUT},{_CUT}")
    rows = rows.select("value", "names", "whole", "s", F.substring_index("group", _CUT, 1).alias("p"), F.explode_outer(objects).alias("o"))
    o = F.col("o")
    literal, number, boolean = o.startswith('"'), o.rlike(f"^{_NUMBER}$"), o.isin("true", "false")
    tag = F.regexp_extract(o, r'"(?:@([A-Za-z0-9-]+))$', 1)
    typed = F.regexp_extract(o, r'"\^\^([^"]+)$', 1)
    datatype = F.when(literal & (typed != ""), _iri(typed)).when(number, F.when(o.contains("."), DECIMAL).otherwise(INTEGER)).when(boolean, BOOLEAN)
    value = F.when(literal, unescaped(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1))).when(number | boolean, o).otherwise(_iri(o))
    kind = F.when(literal | number | boolean, "literal").when(o.startswith("_:"), "bnode").otherwise("iri")
    single = ~o.contains(_CUT) & ((o != "a")) & ~(literal & (typed != "") & datatype.isNull())
    return rows.select("value", "whole", _iri(F.col("s")).alias("s"), _iri(F.col("p")).alias("p"), F.when(single, value).alias("o"), kind.alias("o_kind"), datatype.alias("o_datatype"), F.nullif(tag, F.lit("")).alias("o_lang"))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_kind, o_datatype, o_lang of the statements that are understood whole."""
    return _unfolded(spark, path).where("whole AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select(*TERMS).distinct()


def bad_statements(spark: SparkSession, path: str) -> DataFrame:
    """statement, n: statements with something that isn't understood, and how many of their triples are left out."""
    return _unfolded(spark, path).where("NOT (whole AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)").groupBy(F.col("value").alias("statement")).agg(F.count(F.lit(1)).alias("n"))


#: A subject's triples are dealt to so many statements, so that none grows without bound.
STATEMENTS = 16
#: Parts that the statements are dealt to; a file holds several.
PARTS = 1024


def shortened(iri: Column, names: dict[str, str]) -> Column:
    """An IRI as a prefixed name where a prefix fits and the rest is a plain name."""
    out = F.concat(F.lit("<"), iri, F.lit(">"))
    for prefix, base in names.items():
        rest = iri.substr(F.lit(len(base) + 1), F.length(iri))
        out = F.when(iri.startswith(base) & rest.rlike(r"^[A-Za-z0-9_-]+$"), F.concat(F.lit(f"{prefix}:"), rest)).otherwise(out)
    return out


def write_turtle(triples: DataFrame, path: str, names: dict[str, str]) -> None:
    """One statement for each subject and bucket of its triples, with ; and , lists; every part file begins with the prefixes."""
    quoted = F.concat(F.lit('"'), text.escaped(F.col("o")), F.lit('"'))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^"), shortened(F.col("o_datatype"), names))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(quoted, tail)).when(F.col("o_kind") == "bnode", F.col("o")).otherwise(shortened(F.col("o"), names))
    bucket = F.pmod(F.xxhash64("p", "o"), F.lit(STATEMENTS))
    # A part has the prefixes before its statements, and a file holds whole parts: triples are dealt out by part once, and gathered where they lie.
    part = F.pmod(F.xxhash64("s", bucket), F.lit(PARTS)).cast("int")
    rows = triples.select(part.alias("part"), F.lit(1).alias("k"), "s", bucket.alias("bucket"), shortened(F.col("p"), names).alias("p"), o.alias("o"))
    head = "\n".join(f"@prefix {k}: <{v}> ." for k, v in names.items())
    heads = triples.sparkSession.range(PARTS).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("k"), F.lit("").alias("s"), F.lit(0).cast("long").alias("bucket"), F.lit("").alias("p"), F.lit(head).alias("o"))
    dealt = rows.unionByName(heads).repartition("part")
    lists = dealt.groupBy("part", "k", "s", "bucket", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), " , ").alias("o"))
    body = F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ")
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(shortened(F.col("s"), names))
    statements = lists.groupBy("part", "k", "s", "bucket").agg(body.alias("body"))
    value = F.when(F.col("k") == 0, F.ltrim("body")).otherwise(F.concat(subject, F.lit(" "), "body", F.lit(" ."))).alias("value")
    statements.sortWithinPartitions("part", "k").select(value).write.text(path, compression="gzip")
