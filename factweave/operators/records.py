"""The full record of an analysis: everything said of it and of what is linked to it, over typed triples.

The branches are a table of paths: predicates to follow, forward or in reverse. The paths share their beginnings, so they are walked as one
trie: for each step all paths' frontiers join the pruned link triples once, and the nodes found join all triples once at the end. A node
that two paths reach stands for each of them (a bag, as a union of patterns gives it).

An analysis without a link has no rows of that branch. Repeated triples must be taken out before (triples are a set).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.sources import mapping
from factweave.sources.mapping import Entity, Template
from factweave.sources.shared import parted
from factweave.sources.sheet import P

ANY = "*"


@dataclass(frozen=True)
class Path:
    """Steps from an analysis: a predicate's local name, or one after ^ to be followed from object to subject; ^* follows any."""

    entity: str
    entity_type: str
    steps: tuple[str, ...] = ()


PATHS = (
    Path("analysis", "direct"),
    Path("article", "linked", ("^hasAnalysis",)),
    Path("population", "linked", ("hasPopulation",)),
    Path("sport", "linked", ("hasSport",)),
    Path("relation", "linked", ("hasRelation",)),
    Path("variableVD", "nested", ("hasRelation", "hasDependentVariable")),
    Path("variableVI", "nested", ("hasRelation", "hasIndependentVariable")),
    Path("ageStats", "nested", ("hasPopulation", "ageStats")),
    Path("bmiStats", "nested", ("hasPopulation", "bmiStats")),
    Path("exerciseStats", "nested", ("hasPopulation", "exerciseStats")),
    Path("experienceStats", "nested", ("hasPopulation", "experienceStats")),
    Path("reverse_linked", "reverse", ("^*",)),
    Path("mediator", "linked", ("hasMediator",)),
    Path("moderator", "linked", ("hasModerator",)),
    Path("subgroup", "linked", ("hasSubgroup",)),
    Path("measure", "nested", ("hasRelation", "hasDependentVariable", "measure")),
    Path("measure", "nested", ("hasRelation", "hasIndependentVariable", "measure")),
)
#: Entity, property's local name, field of the record.
FIELDS = (
    *[("analysis", p, f) for p, f in (("analysisId", "analysis_id"), ("typeOfAnalysis", "type_of_analysis"), ("relationDegree", "relation_degree"), ("sampleSizeMobilized", "sample_size_mobilized"), ("authorConclusion", "author_conclusion"), ("limites", "limits"), ("perspectives", "perspectives"), ("moderatorMeasure", "measure_moderator"), ("mediatorMeasure", "measure_mediator"), ("complexityOfAnalysis", "complexity"), ("sportPracticeType", "sport_practice_type"), ("groupStatisticalAnalysis", "group_of_analysis"))],
    *[("article", p, f) for p, f in (("doi", "doi"), ("title", "title"), ("creator", "authors"), ("journal", "journal"), ("date", "year"), ("country", "country"), ("continent", "continent"), ("studyType", "study_type"))],
    *[("population", p, f) for p, f in (("sampleSize", "sample_size"), ("gender", "gender"), ("population", "population"), ("inclusionCriteria", "inclusion_criteria"), ("sportingPopulation", "sporting_population"), ("sportLevel", "sport_level"))],
    ("sport", "sportName", "sport_name"),
    *[("relation", p, f) for p, f in (("degreR", "degree_r"), ("degreP", "degree_p"), ("signeP", "sign_p"), ("degreBeta", "degree_beta"), ("degreR2", "degree_r2"), ("resultatRelation", "relation_result"), ("relationDegreeSecondary", "relation_degree_secondary"))],
    ("variableVD", "VD", "vd_name"), ("variableVD", "specification", "vd_specification"), ("variableVI", "VI", "vi_name"), ("variableVI", "specification", "vi_specification"),
    *[("ageStats", p, f) for p, f in (("ageDescription", "age_description"), ("meanAge", "mean_age"), ("sdAge", "sd_age"), ("minAge", "min_age"), ("maxAge", "max_age"))],
    *[("bmiStats", p, f) for p, f in (("bmiDescription", "bmi_description"), ("meanBMI", "mean_bmi"))],
    ("mediator", "prefLabel", "mediator"), ("moderator", "prefLabel", "moderator"),
)


def trie(paths: tuple[Path, ...]) -> tuple[list[list[tuple[int, str, bool, int]]], dict[int, list[Path]]]:
    """For each depth the moves (state, predicate, forward, next state), and the paths that end in each state."""
    states: dict[tuple[str, ...], int] = {(): 0}
    moves: list[list[tuple[int, str, bool, int]]] = []
    ends: dict[int, list[Path]] = {}
    for path in paths:
        for i, step in enumerate(path.steps):
            if path.steps[: i + 1] not in states:
                states[path.steps[: i + 1]] = len(states)
                while len(moves) <= i:
                    moves.append([])
                name = step.removeprefix("^")
                moves[i].append((states[path.steps[:i]], name if name == ANY else P(name), not step.startswith("^"), states[path.steps[: i + 1]]))
        ends.setdefault(states[path.steps], []).append(path)
    return moves, ends


def linked(triples: DataFrame, roots: DataFrame, paths: tuple[Path, ...] = PATHS) -> DataFrame:
    """analysis, node, entity, entity_type, sub_entity: the nodes that paths lead to from roots (column s)."""
    spark = triples.sparkSession
    moves, ends = trie(paths)
    names = {p for level in moves for _, p, forward, _ in level if forward}
    reverse = {p for level in moves for _, p, forward, _ in level if not forward}
    iris = triples.where("o_kind = 'iri'").select("s", "p", "o")
    step = lambda df, p, start, end, forward: df.select(p.alias("p"), F.col("p").alias("via"), F.col(start).alias("node"), F.col(end).alias("to"), F.lit(forward).alias("forward"))
    sides = [step(iris.where(F.col("p").isin(*names)), F.col("p"), "s", "o", True)] if names else []
    sides += [step(iris if p == ANY else iris.where(F.col("p") == p), F.lit(p), "o", "s", False) for p in sorted(reverse)]
    frontier = roots.select(F.col("s").alias("analysis"), F.col("s").alias("node"), F.lit(0).alias("state"), F.lit("").alias("via"))
    levels = [frontier]
    for level in moves:
        table = F.broadcast(spark.createDataFrame(level, "state int, p string, forward boolean, next int"))  # as long as the paths' table
        links = reduce(DataFrame.unionByName, [x for x, forward in zip(sides, [True] * bool(names) + [False] * len(reverse), strict=True) if any(f == forward for _, _, f, _ in level)])
        frontier = frontier.drop("via").join(table, "state").join(links, ["node", "p", "forward"]).select("analysis", F.col("to").alias("node"), F.col("next").alias("state"), "via")
        levels.append(frontier)
    rows = [(state, p.entity, p.entity_type) for state, found in ends.items() for p in found]
    table = F.broadcast(spark.createDataFrame(rows, "state int, entity string, entity_type string"))
    nodes = reduce(DataFrame.unionByName, levels).join(table, "state")
    plain = (F.col("entity_type") == "direct") | F.col("entity").isin("mediator", "moderator")
    sub: Column = F.when(plain, "").when(F.col("entity_type") == "reverse", F.concat("node", F.lit(" -> "), "via")).otherwise(F.col("node"))
    return nodes.select("analysis", "node", "entity", "entity_type", sub.alias("sub_entity"))


def record(triples: DataFrame, roots: DataFrame, paths: tuple[Path, ...] = PATHS) -> DataFrame:
    """analysis, entity, entity_type, sub_entity, property, value: every property of every linked node."""
    values = triples.select(F.col("s").alias("node"), F.col("p").alias("property"), F.col("o").alias("value"))
    return linked(triples, roots, paths).join(values, "node").drop("node")


def resolved(entities: tuple[Entity, ...], root: Template, paths: tuple[Path, ...] = PATHS) -> list[tuple[Path, Template]] | None:
    """The template of the node that each path leads to from the row's own root; None where a node isn't told by the row alone."""
    own = lambda t: all(mapping.alone(e, entities) for e in entities if mapping.may_meet(e.subject, t))
    links = [(e, p, o) for e in entities for p, o in e.properties.items() if isinstance(o, Template) and o.kind == "iri"]
    out = []
    for path in paths:
        at = [root]
        for step in path.steps:
            if not all(own(t) for t in at):
                return None
            p = None if step.removeprefix("^") == ANY else P(step.removeprefix("^"))
            asked = [(e, o) for e, q, o in links if p in (None, q)]
            if step.startswith("^"):
                if any(mapping.may_meet(o, t) and o != t for _, o in asked for t in at) or any(isinstance(o, mapping.Constant) and o.kind == "iri" for e in entities for q, o in e.properties.items() if p == q):
                    return None
                at = [e.subject for t in at for e, o in asked if o == t]
            elif p is None:
                return None
            else:
                at = [o for t in at for e, o in asked if e.subject == t]
        out += [(path, t) for t in at]
    return out


def mapped_branches(rows: DataFrame, entities: tuple[Entity, ...], root: Template, paths: tuple[Path, ...] = PATHS) -> DataFrame:
    """analysis, entity, entity_type, n, n_nodes, least, n_chars: for each analysis and branch the rows of record, their nodes, the least property and the length of the values.

    The mapping tells where a path leads: what an analysis's row says of the row's own nodes is counted in the row and not dealt out; nodes that rows share are
    counted once each, and only their counts meet the analyses.
    """
    found = resolved(entities, root, paths)
    if found is None:
        raise ValueError("a path leads on from nodes that rows share: use record()")
    groups = [(p.entity, p.entity_type) for p, _ in found]
    names = sorted({p for e in entities for p, _ in mapping.wanted(e, None)})
    name = lambda rank: F.element_at(F.array(*[F.lit(p) for p in names]), rank.cast("int"))
    makers = [[e for e in entities if mapping.may_meet(e.subject, t)] for _, t in found]
    lone = [len(of) == 1 and mapping.alone(of[0], entities) and of[0].subject == t and groups.count(g) == 1 for of, (_, t), g in zip(makers, found, groups, strict=True)]
    texts = mapping.prepared(rows, entities)
    analysis = mapping.templated(root, mapping.ready)
    table = F.broadcast(rows.sparkSession.createDataFrame([(k, *g) for k, g in enumerate(groups)], "branch int, entity string, entity_type string"))  # as long as paths
    out = []
    if any(lone):
        cells, orders = [], []
        for k, (of, (_, t)) in enumerate(zip(makers, found, strict=True)):
            if lone[k]:
                said = sorted(mapping.wanted(of[0], None), key=lambda x: x[0])
                cells.append(F.struct(F.lit(k).alias("branch"), mapping.templated(t, mapping.ready).alias("node"), F.array(*[mapping.term(o, mapping.ready) for _, o in said]).alias("v")))
                orders += [(k, i, p) for i, (p, _) in enumerate(said, 1)]
        first = F.broadcast(rows.sparkSession.createDataFrame(orders, "branch int, place long, least string"))
        each = texts.select(analysis.alias("analysis"), F.explode(F.array(*cells)).alias("x")).select("analysis", "x.*").where("analysis IS NOT NULL AND node IS NOT NULL")
        counted = each.select("analysis", "branch", F.size(F.array_compact("v")).cast("long").alias("n"), F.lit(1).cast("long").alias("n_nodes"), F.array_position(F.transform("v", lambda x: x.isNotNull()), F.lit(True)).alias("place"), F.char_length(F.array_join("v", "")).cast("long").alias("n_chars"))
        out.append(counted.join(first, ["branch", "place"]).join(table, "branch"))
    if not all(lone):
        shared = [e for e in entities if any(e in of for of, x in zip(makers, lone, strict=True) if not x)]
        said = mapping.triples(rows, shared).select("s", F.array_position(F.array(*[F.lit(p) for p in names]), F.col("p")).alias("rank"), F.char_length("o").alias("n_chars"))
        nodes = said.groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"), F.sum("n_chars").alias("n_chars"))
        cells = [F.struct(F.lit(k).alias("branch"), mapping.templated(t, mapping.ready).alias("node")) for k, (_, t) in enumerate(found) if not lone[k]]
        links = texts.select(analysis.alias("analysis"), F.explode(F.array(*cells)).alias("x")).select("analysis", "x.*").where("analysis IS NOT NULL AND node IS NOT NULL")
        met = links.join(nodes, "node").join(table, "branch")
        many = F.array(*[F.lit(f"{e}\n{t}") for e, t in sorted({g for g in groups if groups.count(g) > 1})]).cast("array<string>")
        repeated = F.array_contains(many, F.concat_ws("\n", "entity", "entity_type"))
        key = ["analysis", "entity", "entity_type"]
        out.append(met.where(~repeated).select(*key, "n", F.lit(1).cast("long").alias("n_nodes"), name(F.col("rank")).alias("least"), "n_chars"))
        if len(set(groups)) < len(groups):
            per = met.where(repeated).groupBy(*key, "node").agg(F.sum("n").alias("n"), F.min("rank").alias("rank"), F.sum("n_chars").alias("n_chars"))
            summed = per.groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_nodes"), F.min("rank").alias("rank"), F.sum("n_chars").alias("n_chars"))
            out.append(summed.select(*key, "n", "n_nodes", name(F.col("rank")).alias("least"), "n_chars"))
    return reduce(DataFrame.unionByName, [x.select("analysis", "entity", "entity_type", "n", "n_nodes", "least", "n_chars") for x in out])


def _told(entities: tuple[Entity, ...], root: Template, paths: tuple[Path, ...]) -> tuple[list[tuple[Path, Template]], list[list[Entity]], list[bool]]:
    """Where paths lead, the entities that may say something of each node, and whether only the row itself does."""
    found = resolved(entities, root, paths)
    if found is None:
        raise ValueError("a path leads on from nodes that rows share: use record()")
    makers = [[e for e in entities if mapping.may_meet(e.subject, t)] for _, t in found]
    lone = [len(of) == 1 and mapping.alone(of[0], entities) and of[0].subject == t for of, (_, t) in zip(makers, found, strict=True)]
    return found, makers, lone


def _slots(of: list[Entity], fields: set[str] | None = None) -> list[str]:
    """The properties that entities say, or those of fields."""
    return sorted({p for e in of for p, _ in mapping.wanted(e, fields)})


def _said(e: Entity, slots: list[str], fields: set[str]) -> Column:
    """What a row says by an entity, a place for each of slots (the least of several values); of what is no field only that it is there."""
    cells = []
    for p in slots:
        terms = [mapping.term(o, mapping.ready) for q, o in mapping.wanted(e, None) if q == p]
        value = F.least(*terms) if len(terms) > 1 else terms[0] if terms else F.lit(None).cast("string")
        cells.append(value if p in fields else F.when(value.isNotNull(), F.lit("")))
    return F.array(*cells)


def _families(entities: tuple[Entity, ...], makers: list[list[Entity]], lone: list[bool]) -> list[list[Entity]]:
    """The entities of shared nodes, those together whose subjects may meet."""
    out: list[list[Entity]] = []
    for of, x in zip(makers, lone, strict=True):
        if not x:
            meeting = [f for f in out if any(e in f for e in of)]
            out = [f for f in out if f not in meeting] + [[e for e in entities if e in of or any(e in f for f in meeting)]]
    return out


def mapped_wide(rows: DataFrame, entities: tuple[Entity, ...], root: Template, paths: tuple[Path, ...] = PATHS) -> DataFrame:
    """wide(record()) without the triples: fields, n_properties and entities_found of each analysis, from what its row says and from the nodes that rows share.

    A shared node is one row, with the least value of each property; one table for each family of nodes, so that small ones are broadcast by Spark's own rule. An
    analysis's row is dealt out once for each family that isn't small.
    """
    found, makers, lone = _told(entities, root, paths)
    texts = mapping.prepared(rows, entities)
    node = lambda t: mapping.templated(t, mapping.ready)
    fields = {P(p) for _, p, _ in FIELDS}
    families = _families(entities, makers, lone)
    slots = [_slots(of) for of in families]
    tables: list[DataFrame] = []
    if families:
        width = max(map(len, slots))
        cells = []
        for k, of in enumerate(families):
            pad = F.array_repeat(F.lit(None).cast("string"), width - len(slots[k]))
            cells += [F.struct(F.lit(k).alias("family"), node(e.subject).alias("node"), F.concat(_said(e, slots[k], fields), pad).alias("v")) for e in of]
        few = texts.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("node IS NOT NULL").distinct()
        nodes = few.groupBy("family", "node").agg(F.array(*[F.min(F.col("v")[i]) for i in range(width)]).alias("v"))
        tables = parted(nodes, "family", len(families), "nodes")
    joined = list(dict.fromkeys((next(k for k, f in enumerate(families) if of[0] in f), t) for of, (_, t), x in zip(makers, found, lone, strict=True) if not x))
    own: dict[str, list[tuple[list[str], Column]]] = {}
    for of, (path, t), x in zip(makers, found, lone, strict=True):
        if x:
            own.setdefault(path.entity, []).append((_slots(of), F.when(node(t).isNotNull(), _said(of[0], _slots(of), fields))))
    every = list(dict.fromkeys(p.entity for p, _ in found))
    out = texts.select(
        node(root).alias("analysis"),
        *[node(t).alias(f"node{j}") for j, (_, t) in enumerate(joined)],
        *[v.alias(f"own {e} {i}") for e, said in own.items() for i, (_, v) in enumerate(said)],
    ).where("analysis IS NOT NULL")
    for j, (k, _) in enumerate(joined):
        out = out.join(tables[k].select(F.col("node").alias(f"node{j}"), F.slice("v", 1, len(slots[k])).alias(f"said{j}")), f"node{j}", "left").drop(f"node{j}")
    counts, values = [], {}
    for e in every:
        sources = [(s, F.col(f"`own {e} {i}`")) for i, (s, _) in enumerate(own.get(e, []))]
        for of, (path, t), x in zip(makers, found, lone, strict=True):
            if not x and path.entity == e:
                j = next(i for i, (k, u) in enumerate(joined) if u == t and of[0] in families[k])
                sources.append((slots[joined[j][0]], F.col(f"said{j}")))
        merged: dict[str, Column] = {}
        if len(sources) == 1:
            (names, v), = sources
            counts.append((e, F.coalesce(F.size(F.array_compact(v)), F.lit(0))))
            merged = {p: v[i] for i, p in enumerate(names)}
        else:
            for p in sorted({p for names, _ in sources for p in names}):
                of_p = [v[names.index(p)] for names, v in sources if p in names]
                merged[p] = F.least(*of_p) if len(of_p) > 1 else of_p[0]
            counts.append((e, F.size(F.array_compact(F.array(*merged.values())))))
        values |= {(e, p): v for p, v in merged.items()}
    columns = [F.coalesce(values.get((e, P(p)), F.lit(None).cast("string")), F.lit("N/A")).alias(f) for e, p, f in FIELDS]
    there = F.array_sort(F.array_compact(F.array(*[F.when(n > 0, F.lit(e)) for e, n in counts])))
    return out.select("analysis", *columns, sum((n for _, n in counts), F.lit(0)).cast("long").alias("n_properties"), F.array_join(there, ", ").alias("entities_found"))


def mapped_fields(rows: DataFrame, entities: tuple[Entity, ...], root: Template, paths: tuple[Path, ...] = PATHS) -> DataFrame:
    """entity, field, n, n_values, least, most: with_fields(record()) counted by field, without the triples.

    What rows say of their own nodes is counted by value where it lies; a shared node is one row with its
    different values, as long as these are, and the number of its links.
    """
    found, makers, lone = _told(entities, root, paths)
    texts = mapping.prepared(rows, entities)
    node = lambda t: mapping.templated(t, mapping.ready)
    field = {(e, P(p)): (k, f) for k, (e, p, f) in enumerate(FIELDS)}
    asked = {p for _, p in field}
    none = F.lit(None).cast("string")
    counted = []
    cells = []
    for of, (path, t), x in zip(makers, found, lone, strict=True):
        if x:
            cells += [F.struct(F.lit(field[path.entity, p][0]).alias("k"), F.when(node(t).isNotNull() & node(root).isNotNull(), mapping.term(o, mapping.ready)).alias("value")) for p, o in mapping.wanted(of[0], None) if (path.entity, p) in field]
    if cells:
        counted.append(texts.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("k", "value").agg(F.count(F.lit(1)).alias("n")))
    branches = [(path, t, of) for of, (path, t), x in zip(makers, found, lone, strict=True) if not x and any((path.entity, p) in field for p in _slots(of))]
    if branches:
        shared = [e for e in entities if any(e in of for *_, of in branches)]
        slots = _slots(shared, asked)
        empty = F.array(*[none for _ in slots])
        cells = []
        for e in shared:
            said: dict[str, list[Column]] = {}
            for p, o in mapping.wanted(e, asked):
                said.setdefault(p, []).append(mapping.term(o, mapping.ready))
            # Several values of one property make a row for each.
            cells += [F.struct(F.lit(-1).alias("branch"), node(e.subject).alias("node"), F.array(*[(said[p][i] if i < len(said.get(p, ())) else none) for p in slots]).alias("v")) for i in range(max(map(len, said.values()), default=0))]
        cells += [F.struct(F.lit(b).alias("branch"), F.when(node(root).isNotNull(), node(t)).alias("node"), empty.alias("v")) for b, (_, t, _) in enumerate(branches)]
        few = texts.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("node IS NOT NULL").groupBy("branch", "node", "v").agg(F.count(F.lit(1)).alias("n"))
        sets = [F.collect_set(F.col("v")[i]).alias(f"v{i}") for i in range(len(slots))]
        links = [F.sum(F.when(F.col("branch") == b, F.col("n"))).alias(f"n{b}") for b in range(len(branches))]
        per = few.groupBy("node").agg(*sets, *links)
        counted_by = lambda k, b: lambda x: F.struct(F.lit(k).alias("k"), x.alias("value"), F.col(f"n{b}").alias("n"))
        pairs = [F.transform(F.col(f"v{slots.index(p)}"), counted_by(field[path.entity, p][0], b)) for b, (path, _, of) in enumerate(branches) for p in _slots(of, asked) if (path.entity, p) in field]
        counted.append(per.select(F.explode(F.concat(*pairs)).alias("x")).select("x.*").where("n IS NOT NULL").groupBy("k", "value").agg(F.sum("n").alias("n")))
    names = F.broadcast(rows.sparkSession.createDataFrame([(k, e, f) for k, (e, _, f) in enumerate(FIELDS)], "k int, entity string, field string"))
    each = reduce(DataFrame.unionByName, counted)
    if len(counted) > 1:
        each = each.groupBy("k", "value").agg(F.sum("n").alias("n"))
    summed = each.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"), F.min("value").alias("least"), F.max("value").alias("most"))
    return summed.join(names, "k").select("entity", "field", "n", "n_values", "least", "most")


def with_fields(rows: DataFrame) -> DataFrame:
    """The rows of record that a field stands for, with its name."""
    table = F.broadcast(rows.sparkSession.createDataFrame([(e, P(p), f) for e, p, f in FIELDS], "entity string, property string, field string"))
    return rows.join(table, ["entity", "property"])


def wide(rows: DataFrame) -> DataFrame:
    """analysis, a column for each field (the least value; N/A where there is none), n_properties (of any entity), entities_found.

    Values are brought down to one for each entity and property first, so what an analysis gathers is as long as its properties, whatever they hold.
    """
    names = [f for *_, f in FIELDS]
    each = rows.groupBy("analysis", "entity", "property").agg(F.min("value").alias("value"))
    name = F.concat_ws("\n", "entity", "property")
    field = text.looked_up(name, {f"{e}\n{P(p)}": f for e, p, f in FIELDS}, F.lit(None).cast("string"))
    gathered = each.select("analysis", "entity", F.struct(field.alias("field"), "value").alias("x")).groupBy("analysis").agg(F.collect_list("x").alias("cells"), F.collect_set("entity").alias("entities"))
    values = gathered.withColumn("values", F.map_from_entries(F.filter("cells", lambda x: x["field"].isNotNull())))
    columns = [F.coalesce(F.element_at("values", f), F.lit("N/A")).alias(f) for f in names]
    return values.select("analysis", *columns, F.size("cells").cast("long").alias("n_properties"), F.array_join(F.array_sort("entities"), ", ").alias("entities_found"))
