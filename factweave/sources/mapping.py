"""Declarative mapping of a table to typed triples.

An Entity names a subject (a template over one or more columns), its classes, and for each predicate a column, a template, or a constant.
`triples` compiles the entities asked for to one pass: a single explode over an array that holds only the wanted predicates, so Spark
reads only the columns that these need. A term has a kind (iri or literal), a datatype and a language. Of subjects that rows share the columns are made distinct
first, and only what is left becomes triples.

A null or blank column gives no triple; a subject with a null or blank column gives none at all. Column values within an IRI are
percent-encoded. Repeated rows and subjects that several rows share are made once: triples are a set. An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import text

TYPE = "urn:kg/rdf/type"
TERMS = ("s", "p", "o", "o_kind", "o_datatype", "o_lang")
INTEGER, DECIMAL = "urn:xsd/integer", "urn:xsd/decimal"


@dataclass(frozen=True)
class Ref:
    """The text of a column as a literal."""

    column: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Template:
    """Text with {column} parts: an IRI, whose values are percent-encoded, or a literal, whose values stay as they are."""

    form: str
    kind: str = "iri"
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Constant:
    value: str
    kind: str = "literal"
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Entity:
    """own: every row has a subject of its own, so its triples need not be made distinct."""

    name: str
    subject: Template
    classes: tuple[str, ...]
    properties: dict[str, Ref | Template | Constant] = field(default_factory=dict)
    own: bool = False


def parts(form: str) -> list[tuple[str, str | None]]:
    """The text before each column, and the column (None after the last)."""
    return [(before, column) for before, column, _, _ in string.Formatter().parse(form)]


def filled(column: str) -> Column:
    """A column's text, null where it is blank."""
    value = F.col(column).cast("string")
    return F.when(F.trim(value) != "", value)


Value = Callable[[str, bool], Column]


def value_of(column: str, iri: bool) -> Column:
    """A column's text as it goes into a literal or an IRI."""
    return text.iri_encode(filled(column)) if iri else filled(column)


def ready(column: str, iri: bool) -> Column:
    """The same, of rows that prepared() gave."""
    return F.col(f"`{column} iri`" if iri else f"`{column}`")


def prepared(rows: DataFrame, entities: Iterable[Entity], predicates: Iterable[str] | None = None, **more: Column) -> DataFrame:
    """The columns that entities use, as texts and, where a template needs them, percent-encoded: once for each row, not for each triple; and more columns, from rows as they are."""
    used = {(c, isinstance(t, Template) and t.kind == "iri") for e in entities if wanted(e, predicates) for t in (e.subject, *[o for _, o in wanted(e, predicates)]) for c in columns(t)}
    return rows.select(*[value_of(c, iri).alias(f"{c} iri" if iri else c) for c, iri in sorted(used)], *[v.alias(k) for k, v in more.items()])


def templated(t: Template, value: Value = value_of) -> Column:
    pieces = [p for before, column in parts(t.form) for p in ([F.lit(before)] if before else []) + ([value(column, t.kind == "iri")] if column else [])]
    return F.concat(*pieces)


def term(o: Ref | Template | Constant, value: Value = value_of) -> Column:
    """The text of an object."""
    return value(o.column, False) if isinstance(o, Ref) else templated(o, value) if isinstance(o, Template) else F.lit(o.value)


def kind(o: Ref | Template | Constant) -> str:
    return "literal" if isinstance(o, Ref) else o.kind


def columns(o: Ref | Template | Constant) -> list[str]:
    return [o.column] if isinstance(o, Ref) else [c for _, c in parts(o.form) if c] if isinstance(o, Template) else []


def may_meet(a: Template, b: Template) -> bool:
    """Whether two templates may give the same text: not if they begin differently."""
    a, b = parts(a.form)[0][0], parts(b.form)[0][0]
    return a.startswith(b) or b.startswith(a)


def alone(entity: Entity, entities: Iterable[Entity]) -> bool:
    """Whether all that is said of a subject of this entity comes from one row: each row has its own, and no other entity can make it."""
    return entity.own and not any(e is not entity and may_meet(e.subject, entity.subject) for e in entities)


def surely_of(o: Ref | Template | Constant, cls: str, entities: Iterable[Entity]) -> bool:
    """Whether a value is of a class wherever it is there: the same template makes the subject of an entity of that class, from the same row."""
    return isinstance(o, Template) and o.kind == "iri" and any(e.subject == o and cls in e.classes for e in entities)


def wanted(entity: Entity, predicates: Iterable[str] | None) -> list[tuple[str, Ref | Template | Constant]]:
    every = [(TYPE, Constant(c, "iri")) for c in entity.classes] + list(entity.properties.items())
    return [(p, o) for p, o in every if predicates is None or p in predicates]


def _values(rows: DataFrame, entities: list[Entity], predicates: Iterable[str] | None) -> DataFrame:
    """entity, s, place, o: what each row says by each entity; entity and place are numbers in entities and in what is wanted of it."""
    made = [F.struct(F.lit(k).alias("entity"), templated(e.subject, ready).alias("s"), F.array(*[term(o, ready) for _, o in wanted(e, predicates)]).alias("v")) for k, e in enumerate(entities)]
    each = prepared(rows, entities, predicates).select(F.explode(F.array(*made)).alias("x")).select("x.*").where("s IS NOT NULL")
    return each.select("entity", "s", F.posexplode("v").alias("place", "o")).where("o IS NOT NULL")


def _named(values: DataFrame, entities: list[Entity], predicates: Iterable[str] | None) -> DataFrame:
    """values with p, o_kind, o_datatype and o_lang in place of entity and place."""
    names = [(k, i, p, kind(o), o.datatype, o.lang) for k, e in enumerate(entities) for i, (p, o) in enumerate(wanted(e, predicates))]
    table = values.sparkSession.createDataFrame(names, "entity int, place int, p string, o_kind string, o_datatype string, o_lang string")
    return values.join(F.broadcast(table), ["entity", "place"]).drop("entity", "place")  # as long as the mapping


def _exploded(rows: DataFrame, entities: list[Entity], predicates: Iterable[str] | None) -> DataFrame | None:
    asked = [e for e in entities if wanted(e, predicates)]
    return _named(_values(rows, asked, predicates), asked, predicates).select(*TERMS) if asked else None


def _distinct(rows: DataFrame, entities: list[Entity], predicates: Iterable[str] | None) -> DataFrame | None:
    """The distinct triples of entities that rows share: a row gives one array of column values for each entity, and only different ones become triples."""
    asked = [e for e in entities if wanted(e, predicates)]
    if not asked:
        return None
    named = [list(dict.fromkeys(c for t in (e.subject, *[o for _, o in wanted(e, predicates)]) for c in columns(t))) for e in asked]
    values = [F.struct(F.lit(k).alias("entity"), F.array(*[filled(c) for c in cs]).alias("v")) for k, cs in enumerate(named)]
    few = rows.select(F.explode(F.array(*values)).alias("x")).select("x.*").distinct()
    s, v = F.lit(None), F.lit(None)
    for k, (e, cs) in enumerate(zip(asked, named, strict=True)):

        def value(c: str, iri: bool, at=cs) -> Column:
            x = F.col("v")[at.index(c)]
            return text.iri_encode(x) if iri else x

        s = F.when(F.col("entity") == k, templated(e.subject, value)).otherwise(s)
        v = F.when(F.col("entity") == k, F.array(*[term(o, value) for _, o in wanted(e, predicates)])).otherwise(v)
    each = few.select("entity", s.alias("s"), v.alias("v")).where("s IS NOT NULL").select("entity", "s", F.posexplode("v").alias("place", "o")).where("o IS NOT NULL")
    return _named(each, asked, predicates).select(*TERMS).distinct()


def triples(rows: DataFrame, entities: Iterable[Entity], predicates: Iterable[str] | None = None) -> DataFrame:
    """s, p, o, o_kind, o_datatype, o_lang of the entities, or of some predicates only. Only shared subjects are shuffled."""
    entities = list(entities)
    predicates = None if predicates is None else set(predicates)
    own = _exploded(rows, [e for e in entities if e.own], predicates)
    shared = _distinct(rows, [e for e in entities if not e.own], predicates)
    found = [x for x in (own, shared) if x is not None]
    if not found:
        raise ValueError("no predicate of these entities is asked for")
    return reduce(DataFrame.unionByName, found)


def by_predicate(rows: DataFrame, entities: Iterable[Entity]) -> DataFrame:
    """p, o_kind, o_datatype, o_lang, n, n_subjects, least, most: the triples of each predicate and kind of term, counted.

    Subjects of one row are counted in that row, the least and the most are sought in the rows as they are, all in one aggregate of the whole
    table without a group, so nothing is sorted; only the other subjects are dealt out, one row for each subject and predicate.
    """
    entities = list(entities)
    key = ["p", "o_kind", "o_datatype", "o_lang"]
    lone = [e for e in entities if alone(e, entities)]
    texts = prepared(rows, entities)
    cells, aggregates = [], []
    for e in entities:
        s, seen = templated(e.subject, ready), set()
        for p, o in wanted(e, None):
            tags, k = (p, kind(o), o.datatype, o.lang), len(cells)
            value = F.when(s.isNotNull(), term(o, ready))
            aggregates += [F.count(value).alias(f"n{k}"), F.min(value).alias(f"least{k}"), F.max(value).alias(f"most{k}")]
            # Of several values that a subject has by one predicate and kind of term, classes are always there: the first counts it.
            n, first = (F.col(f"n{k}") if e in lone else F.lit(0).cast("long")), e in lone and tags not in seen
            seen.add(tags)
            cells.append(F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(key, tags, strict=True)], n.alias("n"), (n if first else F.lit(0).cast("long")).alias("n_subjects"), F.col(f"least{k}").alias("least"), F.col(f"most{k}").alias("most")))
    if not cells:
        raise ValueError("these entities say nothing")
    found = [texts.agg(*aggregates).select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("least IS NOT NULL")]
    if shared := [e for e in entities if e not in lone and wanted(e, None)]:
        each = triples(rows, shared).groupBy(*key, "s").agg(F.count(F.lit(1)).alias("n"))
        found.append(each.groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_subjects")))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    return every.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("n_subjects").alias("n_subjects"), F.min("least").alias("least"), F.max("most").alias("most"))


def unmapped(rows: DataFrame, entities: Iterable[Entity]) -> DataFrame:
    """entity, n: rows that make no subject of an entity because a column of its template is blank."""
    entities = list(entities)
    counts = [F.count(F.when(~reduce(and_, [filled(c).isNotNull() for _, c in parts(e.subject.form) if c], F.lit(True)), 1)).alias(e.name) for e in entities]
    one = rows.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(e.name).alias("entity"), F.col(f"`{e.name}`").alias("n")) for e in entities])).alias("x")).select("x.*")
