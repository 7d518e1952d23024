"""Updates of whole entities over typed triples: forms to insert, values to replace, and deletion with what only the deleted own.

Blank form fields count as the missing mark, as a form gives them. Repeated form rows make one set of triples. Subjects without the class
asked for are left as they are. Empty inputs change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.sources.mapping import TYPE, Constant, Entity, Ref, Template, alone, kind, may_meet, parts, prepared, ready, templated, term, triples, wanted
from factweave.sources.shared import apart
from factweave.sources.shared import kept as stored
from factweave.sources.sheet import ENTITIES, SUPERCLASSES, P

#: Links from an owner to a satellite: what goes when its last owner goes.
OWNING = tuple(P(x) for x in ("hasPopulation", "hasSport", "hasRelation", "hasSubgroup", "ageStats", "bmiStats", "exerciseStats", "experienceStats", "hasDependentVariable", "hasIndependentVariable"))


def form_triples(forms: DataFrame, entities: tuple[Entity, ...] = ENTITIES) -> DataFrame:
    """The triples of one form a row (the sheet's columns): all entities' templates, blank fields as the missing mark. A set."""
    rows = forms.distinct().select(*[text.default_missing(F.col(c).cast("string")).alias(c) for c in forms.columns])
    keys = named_by_all(entities)
    if not keys:
        return triples(rows, entities).distinct()
    # Forms that share these columns with no other make triples of their own, which can't repeat: the rest are few, and compared.
    counted = rows.withColumn("forms_", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    own, shared = [e for e in entities if e.own], [e for e in entities if not e.own]
    made = [triples(counted.where("forms_ = 1"), own), triples(counted.where("forms_ > 1"), own).distinct()]
    return reduce(DataFrame.unionByName, made + ([triples(rows, shared)] if shared else []))


def named_by_all(entities: tuple[Entity, ...]) -> list[str]:
    """Columns that every triple of the own entities names: by its subject, or by each object of an entity without a class."""
    columns = lambda t: {c for _, c in parts(t.form) if c} if isinstance(t, Template) else {t.column} if isinstance(t, Ref) else set()
    found = []
    for e in entities:
        if e.own:
            objects = [columns(o) for o in e.properties.values()]
            found.append(columns(e.subject) | (set.intersection(*objects) if objects and not e.classes else set()))
    return sorted(set.intersection(*found)) if found else []


def members(types: DataFrame, cls: str, above: dict[str, str] = SUPERCLASSES) -> DataFrame:
    """s of the members of a class, or of a class below it; types: triples of the class predicate."""
    below = {cls}
    while more := {c for c, up in above.items() if up in below} - below:
        below |= more
    return types.where((F.col("p") == TYPE) & F.col("o").isin(*below)).select("s").distinct()


def guarded(new: DataFrame, types: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Rows of new whose subject has the class that their predicate asks for (classes: predicate to class; others pass)."""
    asked = text.looked_up(F.col("p"), classes, F.lit(None).cast("string")) if classes else F.lit(None).cast("string")
    rows = new.withColumn("asked", asked)
    out = rows.where("asked IS NULL")
    for cls in sorted(set(classes.values())):
        asking = rows.where(F.col("asked") == cls)
        found = apart(members(types, cls).withColumn("asked", F.lit(cls)), asking, "asked")[0]
        out = out.unionByName(asking.join(found.select("s"), "s", "left_semi"))
    return out.drop("asked")


def reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """node: start and all that links (owner, node) lead to from it. One join a step, until nothing is new; cycles end."""
    known = stored(start.select("node").distinct())
    last = known
    while True:
        last = stored(links.join(last.select(F.col("node").alias("owner")), "owner", "left_semi").select("node").distinct().join(known, "node", "left_anti"))
        if last.isEmpty():
            return known
        known = known.unionByName(last)


def doomed(rows: DataFrame, roots: DataFrame, owning: tuple[str, ...] = OWNING) -> DataFrame:
    """node: roots (column s) and the satellites that no one else owns.

    What roots lead to along owning links, less what a node outside of it owns, and less what that leads to. So a satellite that two deleted
    nodes share goes, one that a living node shares stays with all it owns, and satellites that own each other go together. rows are read once
    a step: give a stored table.
    """
    links = rows.where(F.col("p").isin(*owning) & (F.col("o_kind") == "iri")).select(F.col("s").alias("owner"), F.col("o").alias("node"))
    start = roots.select(F.col("s").alias("node"))
    within = reached(links, start)
    inner = links.join(within, "node", "left_semi")
    lives = inner.join(within.select(F.col("node").alias("owner")), "owner", "left_anti").select("node").distinct().join(start, "node", "left_anti")
    kept = reached(inner.join(start, "node", "left_anti"), lives)
    return within.join(kept, "node", "left_anti")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Triples that neither start nor end at a node of gone; a literal that reads like one of them is no end."""
    out = rows.join(gone.select(F.col("node").alias("s")), "s", "left_anti")
    ends = gone.select(F.col("node").alias("o"), F.lit("iri").alias("o_kind"))
    return out.join(ends, ["o", "o_kind"], "left_anti").select(*rows.columns)


def cascaded(rows: DataFrame, roots: DataFrame, owning: tuple[str, ...] = OWNING) -> DataFrame:
    """rows without roots, their satellites, and every triple from or to these."""
    return without(rows, doomed(rows, roots, owning))


@dataclass(frozen=True)
class Cascade:
    """What goes with a row's root: owner of each node that only the row itself makes (root: None), links from these to nodes that rows share, and other links to such nodes."""

    owners: dict[Template, Template | None]
    shared: list[tuple[Template, Template]]
    others: list[tuple[Template, Template]]


def cascade(entities: tuple[Entity, ...], root: Template, owning: tuple[str, ...] = OWNING) -> Cascade:
    """The cascade from root as the mapping tells it. ValueError where a row alone doesn't tell: use doomed()."""
    lone = {e.subject for e in entities if alone(e, entities)}
    said = [(e, p, o) for e in entities for p, o in e.properties.items() if kind(o) == "iri"]
    links = [(e.subject, o) for e, p, o in said if p in owning and isinstance(o, Template)]
    owners: dict[Template, Template | None] = {root: None}
    for at in (queue := [root]):
        for s, o in links:
            if s == at and o in lone and o not in owners:
                owners[o] = at
                queue.append(o)
    shared = [(s, o) for s, o in links if s in owners and o not in owners]
    others = [(s, o) for s, o in links if s not in owners and any(may_meet(o, x) for _, x in shared)]
    told = root in lone and all(
        isinstance(o, Template) and (not any(may_meet(o, t) for t in owners) or o in owners and e.own and (p not in owning or owners[o] == e.subject))
        or isinstance(o, Constant) and p not in owning and not any(o.value.startswith(parts(t.form)[0][0]) for t in owners)
        for e, p, o in said
    )
    if not told or len({o for s, o in links if o in owners}) < sum(o in owners for _, o in links) or any(may_meet(s, x) for s, _ in links for _, x in shared) or any(may_meet(x, t) for _, x in shared for t in lone):
        raise ValueError("what goes isn't told by each row alone: use doomed()")
    return Cascade(owners, shared, others)


def _going(found: Cascade) -> dict[Template, Column]:
    """The node of each template where it goes with its row's root (column goes), else null."""
    out: dict[Template, Column] = {}
    for t, owner in found.owners.items():
        node = templated(t, ready)
        out[t] = F.when(F.col("goes") if owner is None else out[owner].isNotNull(), node)
    return out


def _shared_gone(texts: DataFrame, found: Cascade, going: dict[Template, Column]) -> DataFrame | None:
    """node: shared nodes all of whose owners go. One row for each node and task is dealt out."""
    links = [(s, o, going[s].isNotNull()) for s, o in found.shared] + [(s, o, F.lit(False)) for s, o in found.others]
    if not found.shared:
        return None
    cells = [F.struct(F.when(templated(s, ready).isNotNull(), templated(o, ready)).alias("node"), goes.alias("goes")) for s, o, goes in links]
    each = texts.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("node IS NOT NULL")
    return each.groupBy("node").agg(F.bool_and("goes").alias("goes")).where("goes").select("node")


def mapped_doomed(rows: DataFrame, goes: Column, root: Template, entities: tuple[Entity, ...] = ENTITIES, owning: tuple[str, ...] = OWNING) -> DataFrame:
    """doomed() of the triples that entities make of rows, with the roots of the rows where goes holds, without the triples.

    Nodes that only one row makes go with its root, where they lie; of shared nodes it is asked whether an owner stays, one row for each node and task.
    """
    found = cascade(entities, root, owning)
    texts = prepared(rows, entities, owning, goes=F.coalesce(goes, F.lit(False)))
    going = _going(found)
    own = texts.where("goes").select(F.explode(F.array(*going.values())).alias("node")).where("node IS NOT NULL")
    shared = _shared_gone(texts, found, going)
    return own if shared is None else own.unionByName(shared)


def mapped_left(rows: DataFrame, goes: Column, root: Template, predicates: set[str], entities: tuple[Entity, ...] = ENTITIES, owning: tuple[str, ...] = OWNING) -> DataFrame:
    """p, n, first_subject, last_subject, n_objects of what cascaded() leaves of the triples of some predicates, counted by predicate without making those of one row's own.

    Objects that only one row makes are different wherever they are counted; only the other triples are dealt out, by predicate and object.
    """
    found = cascade(entities, root, owning)
    lone = {e.subject for e in entities if alone(e, entities)}
    texts = prepared(rows, entities, set(owning) | predicates, goes=F.coalesce(goes, F.lit(False)))
    going = _going(found)
    gone = _shared_gone(texts, found, going)
    gone = None if gone is None else stored(gone, "gone")
    said = [(e, p, o) for e in entities for p, o in wanted(e, predicates)]
    aggregates, cells, rest = [], [], []
    for e, p, o in said:
        if not e.own:
            continue
        s = templated(e.subject, ready)
        stays = ~reduce(lambda a, b: a | b, [going[t].isNotNull() for t in (e.subject, o) if t in going], F.lit(False))
        if o in lone and sum(q == p for _, q, _ in said) == 1 and not any(may_meet(t, x) for t in (e.subject, o) for _, x in found.shared):
            there, k = F.when(stays & term(o, ready).isNotNull(), s), len(cells)
            aggregates += [F.count(there).alias(f"n{k}"), F.min(there).alias(f"least{k}"), F.max(there).alias(f"most{k}")]
            cells.append(F.struct(F.lit(p).alias("p"), F.col(f"n{k}").alias("n"), F.col(f"least{k}").alias("first_subject"), F.col(f"most{k}").alias("last_subject"), F.col(f"n{k}").alias("n_objects")))
        else:
            rest.append(F.struct(F.when(stays, s).alias("s"), F.lit(p).alias("p"), term(o, ready).alias("o"), F.lit(kind(o)).alias("o_kind")))
    each = [texts.select(F.explode(F.array(*rest)).alias("x")).select("x.*").where("s IS NOT NULL AND o IS NOT NULL")] if rest else []
    if any(not e.own for e, *_ in said):
        each.append(triples(rows, [e for e in entities if not e.own], predicates).select("s", "p", "o", "o_kind"))
    out = [texts.agg(*aggregates).select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("n > 0")] if cells else []
    if each:
        every = reduce(DataFrame.unionByName, each)
        every = every if gone is None else without(every, gone)
        per = every.groupBy("p", "o").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_subject"), F.max("s").alias("last_subject"))
        out.append(per.groupBy("p").agg(F.sum("n").alias("n"), F.min("first_subject").alias("first_subject"), F.max("last_subject").alias("last_subject"), F.count(F.lit(1)).alias("n_objects")))
    return reduce(DataFrame.unionByName, out)
