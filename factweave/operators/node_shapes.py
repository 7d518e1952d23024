"""Shapes: constraints on the properties of a class's members, read off the triples, or off the rows that a mapping makes triples of.

A shape names a class and, for each path, how many values it has, of what datatype or kind of term, of what class the value is, from what list,
or by what pattern. All shapes compile to one table of violations: each value is judged by every constraint of its path where it
lies, and one grouped aggregate for each shape and node counts values and bad values at once; members without any value come from
the same aggregate by a row each. Only the class of a value needs a join.

A member of two target classes has violations of both shapes. Members of a subclass aren't members unless they are typed so too. An empty graph
has no violations. Repeated triples must be taken out before.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.sources import mapping
from factweave.sources.mapping import DECIMAL, INTEGER, TYPE, Entity
from factweave.sources.shared import kept
from factweave.sources.sheet import P


@dataclass(frozen=True)
class Rule:
    """What holds for the values of a path. least, most: their number; the others hold for each value."""

    path: str
    least: int = 0
    most: int | None = None
    datatype: str | None = None
    node_kind: str | None = None
    values: tuple[str, ...] = ()
    pattern: str | None = None
    cls: str | None = None


@dataclass(frozen=True)
class Shape:
    name: str
    target: str
    rules: tuple[Rule, ...]


def _stats(name: str, cls: str, *rules: Rule) -> Shape:
    return Shape(name, P(cls), rules)


#: The directions and genders that are allowed.
DIRECTIONS, GENDERS = ("+", "-", "NS", "NA", "N.A."), ("Male", "Female", "Mixed", "N.A.")
SHAPES = (
    Shape("ArticleShape", P("SportPsychologyArticle"), (
        Rule(P("doi"), 1, pattern="^10[.][0-9]+/[0-9]*[02468]$"), Rule(P("title"), 1, 1), Rule(P("date"), 1, datatype=INTEGER), Rule(P("journal"), 1), Rule(P("country"), 1), Rule(P("hasAnalysis"), 1, node_kind="iri", cls=P("Analysis")))),
    Shape("AnalysisShape", P("Analysis"), (
        Rule(P("analysisId"), 1, 1), Rule(P("hasRelation"), 1, 1, cls=P("Relations")), Rule(P("hasPopulation"), 1, 1, cls=P("Population")), Rule(P("relationDirection"), 1, 1, values=DIRECTIONS),
        Rule(P("typeOfAnalysis"), 1), Rule(P("hasSport"), 1, node_kind="iri", cls=P("Sport")), Rule(P("hasMediator"), 0, 1, node_kind="literal"))),
    Shape("RelationsShape", P("Relations"), (
        Rule(P("hasDependentVariable"), 1, 1, cls=P("VariableDependante")), Rule(P("hasIndependentVariable"), 1, 1, cls=P("VariableIndependante")), Rule(P("degreP"), 0, 1, datatype=DECIMAL, pattern="^0,0[1-5]$"))),
    Shape("DependentShape", P("VariableDependante"), (Rule(P("refersToVariable"), 1, 1, node_kind="iri"), Rule(P("measure"), 1, cls=P("Measure")))),
    Shape("IndependentShape", P("VariableIndependante"), (Rule(P("refersToVariable"), 1, 1, node_kind="iri", cls=P("Concept")), Rule(P("measure"), 1))),
    Shape("PopulationShape", P("Population"), (Rule(P("gender"), 1, 1, values=GENDERS[:3]), Rule(P("sampleSize"), 1, 1, datatype=INTEGER), Rule(P("ageStats"), 0, 1, cls=P("AgeStatistics")))),
    _stats("AgeShape", "AgeStatistics", Rule(P("meanAge"), 0, 1, pattern="^M="), Rule(P("minAge"), 1, datatype=INTEGER)),
    Shape("SportShape", P("Sport"), (Rule(P("sportName"), 1, 1), Rule(P("inScheme"), 1, 1, node_kind="literal"))),
)
CONSTRAINTS = ("min_count", "max_count", "datatype", "node_kind", "in", "pattern", "class")


def _each(rules: list[tuple[str, Rule]], value) -> Column:
    """value(rule) for the row's shape and path, null where it is None."""
    out = F.lit(None)
    for shape, rule in rules:
        if (v := value(rule)) is not None:
            out = F.when((F.col("shape") == shape) & (F.col("path") == rule.path), v).otherwise(out)
    return out


def violations(triples: DataFrame, shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """shape, focus, path, constraint, n: members of a shape's class that break a constraint, and by how many values (min_count: how many lack).

    A value is judged where it lies; only counts are dealt out, one row for each shape and node.
    """
    spark = triples.sparkSession
    rules = [(s.name, r) for s in shapes for r in s.rules]
    paths = sorted({r.path for _, r in rules})
    targets = F.broadcast(spark.createDataFrame([(s.target, s.name) for s in shapes], "o string, shape string"))
    wanted = F.broadcast(spark.createDataFrame([(s.name, r.path, k) for s in shapes for k, r in enumerate(s.rules)], "shape string, path string, place int"))  # both as long as the shapes
    classes = sorted({r.cls for _, r in rules if r.cls})
    members = triples.where(F.col("p") == TYPE).select("s", "o").join(targets, "o").select("shape", F.col("s").alias("focus"))
    values = triples.where(F.col("p").isin(*paths)).select(F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "o_datatype")
    if classes:
        checked = sorted({r.path for _, r in rules if r.cls})
        typed = triples.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).groupBy(F.col("s").alias("o")).agg(F.collect_set("o").alias("classes"))
        # Only values of paths that ask for a class meet the types.
        asked = values.where(F.col("path").isin(*checked)).join(typed, "o", "left").select("focus", "path", "o", "o_kind", "o_datatype", "classes")
        values = asked.unionByName(values.where(~F.col("path").isin(*checked)).withColumn("classes", F.lit(None).cast("array<string>")))
    else:
        values = values.withColumn("classes", F.lit(None).cast("array<string>"))
    bad = {
        "datatype": lambda r: ~F.col("o_datatype").eqNullSafe(F.lit(r.datatype)) if r.datatype else None,
        "node_kind": lambda r: F.col("o_kind") != r.node_kind if r.node_kind else None,
        "in": lambda r: ~F.col("o").isin(*r.values) if r.values else None,
        "pattern": lambda r: ~F.col("o").rlike(r.pattern) if r.pattern else None,
        "class": lambda r: ~F.coalesce(F.array_contains("classes", r.cls), F.lit(False)) if r.cls else None,
    }
    judged = values.join(wanted, "path").select("shape", "focus", "place", *[_each(rules, v).cast("boolean").alias(k) for k, v in bad.items()])
    every = judged.unionByName(members, allowMissingColumns=True)
    count = lambda c: F.count(F.when(c, 1))
    places = range(max(len(s.rules) for s in shapes))
    at = {k: [s.rules[k] for s in shapes if k < len(s.rules)] for k in places}
    broken = [(k, c) for k in places for c, v in bad.items() if any(v(r) is not None for r in at[k])]
    counts = every.groupBy("shape", "focus").agg(
        count(F.col("place").isNull()).alias("member"), *[count(F.col("place") == k).alias(f"n_{k}") for k in places], *[count((F.col("place") == k) & F.col(c)).alias(f"n_{k}_{c}") for k, c in broken]
    )

    def of(k: int, value) -> Column:
        """value(rule) of the row's shape at a place, null where there is none."""
        out = F.lit(None)
        for s in shapes:
            if k < len(s.rules) and (v := value(s.rules[k])) is not None:
                out = F.when(F.col("shape") == s.name, F.lit(v)).otherwise(out)
        return out

    cells = [(k, "min_count", of(k, lambda r: r.least) - F.col(f"n_{k}")) for k in places] + [(k, "max_count", F.col(f"n_{k}") - of(k, lambda r: r.most)) for k in places]
    cells += [(k, c, F.col(f"n_{k}_{c}")) for k, c in broken]
    found = F.filter(F.array(*[F.struct(of(k, lambda r: r.path).cast("string").alias("path"), F.lit(c).alias("constraint"), n.cast("long").alias("n")) for k, c, n in cells]), lambda x: x["n"] > 0)
    return counts.where("member > 0").select("shape", "focus", F.explode(found).alias("x")).select("shape", "focus", "x.path", "x.constraint", "x.n")


def mapped_violations(rows: DataFrame, entities: tuple[Entity, ...], shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """violations() of the triples that entities make of rows, without making those of subjects that come from one row each.

    Such a subject has one value of a path at most and is judged in its row. A value has a class for certain if its template makes the subject of an entity of that class;
    other values are looked up among the class's members. Shapes of subjects that rows share are judged on these entities' triples.
    """
    spark = rows.sparkSession
    own = [e for e in entities if mapping.alone(e, entities)]
    used = {r.path for s in shapes for r in s.rules}
    texts = mapping.prepared(rows, own, used | {TYPE})
    judged, names, looked_up, rest = [], [], [], []
    for shape in shapes:
        makers = [e for e in entities if shape.target in e.classes]
        if not all(e in own for e in makers):
            rest.append(shape)
            continue
        for e in makers:
            counts = []
            for r in shape.rules:
                o = e.properties.get(r.path)
                value = F.lit(None).cast("string") if o is None else mapping.term(o, mapping.ready)
                n = lambda c, value=value: F.when(value.isNotNull() & c, 1).otherwise(0)
                has = n(F.lit(True))
                found = {"min_count": r.least - has, "max_count": has - r.most if r.most is not None else None}
                if o is not None:
                    found |= {
                        "datatype": has if r.datatype and o.datatype != r.datatype else None,
                        "node_kind": has if r.node_kind and mapping.kind(o) != r.node_kind else None,
                        "in": n(~value.isin(*r.values)) if r.values else None,
                        "pattern": n(~value.rlike(r.pattern)) if r.pattern else None,
                    }
                    if r.cls and not mapping.surely_of(o, r.cls, entities):
                        looked_up.append((shape.name, e, r))
                for k, v in found.items():
                    if v is not None and not (k == "min_count" and not r.least or k == "max_count" and r.most):
                        names.append((len(judged), len(counts), shape.name, r.path, k))
                        counts.append(v.cast("long"))
            if counts:
                judged.append(F.struct(F.lit(len(judged)).alias("judged"), mapping.templated(e.subject, mapping.ready).alias("focus"), F.array(*counts).alias("v")))
    out = []
    if judged:
        each = texts.select(F.explode(F.array(*judged)).alias("x")).select("x.*").where("focus IS NOT NULL").select("judged", "focus", F.posexplode("v").alias("place", "n")).where("n > 0")
        out.append(each.join(F.broadcast(spark.createDataFrame(names, "judged int, place int, shape string, path string, constraint string")), ["judged", "place"]).drop("judged", "place"))  # as long as the shapes
    members: dict[str, DataFrame | None] = {}
    for name, e, r in looked_up:
        if r.cls not in members:
            of = [x for x in entities if r.cls in x.classes]
            members[r.cls] = kept(mapping.triples(rows, of, {TYPE}).where(F.col("o") == r.cls).select(F.col("s").alias("o")).distinct(), "members") if of else None
        each = texts.select(F.lit(name).alias("shape"), mapping.templated(e.subject, mapping.ready).alias("focus"), F.lit(r.path).alias("path"), F.lit("class").alias("constraint"), F.lit(1).cast("long").alias("n"), mapping.term(e.properties[r.path], mapping.ready).alias("o"))
        each = each.where("focus IS NOT NULL AND o IS NOT NULL")
        out.append((each if members[r.cls] is None else each.join(members[r.cls], "o", "left_anti")).drop("o"))
    if rest:
        shared = [e for e in entities if e not in own]
        sure = lambda r: all(mapping.surely_of(e.properties[r.path], r.cls, entities) for e in shared if r.path in e.properties)
        rest = tuple(replace(s, rules=tuple(replace(r, cls=None) if r.cls and sure(r) else r for r in s.rules)) for s in rest)
        made = mapping.triples(rows, shared, {r.path for s in rest for r in s.rules} | {TYPE})
        classes = {r.cls for s in rest for r in s.rules if r.cls}
        if more := [e for e in entities if e not in shared and classes & set(e.classes)]:
            made = made.unionByName(mapping.triples(rows, more, {TYPE}))
        out.append(violations(made, rest))
    return reduce(DataFrame.unionByName, out).select("shape", "focus", "path", "constraint", "n")
