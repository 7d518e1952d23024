"""Updates of a set of triples; each gives a new set and leaves the old one as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.sources.binding import TYPE


def inserted(triples: DataFrame, new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """triples (a set) with those of new that aren't there; known: a part of triples that holds all of them that new could repeat, so that the rest isn't shuffled."""
    fresh = new.distinct().join(triples if known is None else known, ["s", "p", "o"], "left_anti")
    return triples.unionByName(fresh.select(*triples.columns))


def replaced(triples: DataFrame, new: DataFrame, cls: str, types: DataFrame | None = None) -> DataFrame:
    """new's (s, p) lose their old values, where the subject is of the class; rows of new for other subjects are left out. types: the part of triples that gives the classes."""
    members = (triples if types is None else types).where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s")
    new = new.join(members, "s", "left_semi").distinct()
    # Triples of other predicates stay as they are, without a shuffle; what stays of new's predicates has no (s, p) of new, so the union is a set.
    touched = F.col("p").isin(*[r["p"] for r in new.select("p").distinct().collect()])
    old = triples.where(touched).join(new.select("s", "p").distinct(), ["s", "p"], "left_anti")
    return triples.where(~F.coalesce(touched, F.lit(False))).unionByName(old.select(*triples.columns)).unionByName(new.select(*triples.columns))


def cascade_deleted(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the triples that start or end at one of ids (column s)."""
    return without_ends(without_subjects(triples, ids), ids)


def without_subjects(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (triples, or wide rows before they become triples) whose s isn't one of ids."""
    return rows.join(ids, "s", "left_anti")


def without_ends(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Triples that end at none of ids. Only objects between the least and the greatest of ids can be one, so only these meet them."""
    least, greatest = ids.agg(F.min("s"), F.max("s")).first()
    if least is None:
        return triples.select("s", "p", "o")
    near = F.coalesce(F.col("o").between(least, greatest), F.lit(False))
    left = triples.where(near).join(ids.select(F.col("s").alias("o")), "o", "left_anti")
    return triples.where(~near).select("s", "p", "o").unionByName(left.select("s", "p", "o"))


def inferred(triples: DataFrame, labels: DataFrame, predicate: str) -> DataFrame:
    """Copies a concept's values of predicate to other concepts of the same label (s, label), except missing ones."""
    have = triples.where(F.col("p") == predicate).join(labels, "s").select("label", "p", "o")
    return inserted(triples, labels.where("label <> 'N.A.'").join(have, "label").select("s", "p", "o"))
