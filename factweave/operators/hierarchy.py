"""Concept hierarchies: transitive closure, roots, neighbourhoods, categories of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.sources import binding
from factweave.sources.shared import kept, once


def closure(edges: DataFrame) -> DataFrame:
    """descendant, ancestor, depth (the least): one or more steps up.

    Each round joins the pairs found so far with themselves, so paths double in length and the rounds are the logarithm of the depth; a round is one table.
    A round that neither finds a pair nor shortens a path is the last, so cycles end.
    """
    known = kept(edges.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure")
    size = None
    while True:
        after = tuple(known.agg(F.count(F.lit(1)), F.sum("depth")).first())
        if after == size:
            return known
        size = after
        up = known.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        found = known.join(up, "ancestor").select("descendant", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = kept(known.unionByName(found).groupBy("descendant", "ancestor").agg(F.min("depth").alias("depth")), "closure")


def closure_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of a folder's graph, made once for each Spark application and state of the tables."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("supplier", "nation", "region", "part")]
    return once(spark, "closure", paths, lambda: closure(binding.edges(spark, sf_dir)))


def labelled(concept) -> F.Column:
    return text.label(text.local_name(F.col(concept) if isinstance(concept, str) else concept))


def roots(edges: DataFrame) -> DataFrame:
    """Concepts that are parents and have none."""
    return edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")


def roots_within(edges: DataFrame, namespace: str) -> DataFrame:
    """Parents within a namespace whose own parents, if any, lie outside it."""
    inside = edges.where(F.col("parent").contains(namespace))
    return inside.select(F.col("parent").alias("root")).distinct().join(inside.select(F.col("child").alias("root")), "root", "left_anti")


def min_category(edges: DataFrame) -> DataFrame:
    """label, category: the least name among a label's direct parents, so a label with several parents makes no more rows."""
    name = F.replace(F.regexp_replace("parent", ".*/", ""), F.lit("%20"), F.lit(" "))
    return edges.groupBy(labelled("child").alias("label")).agg(F.min(name).alias("category"))


def descendants_of(pairs: DataFrame, ancestor_label: str) -> DataFrame:
    return pairs.where(labelled("ancestor") == ancestor_label).select("descendant").distinct()


def neighbourhood(edges: DataFrame, pairs: DataFrame, concept_label: str, levels: int = 3) -> DataFrame:
    """concept, relation (parent, child, self), related, related_label, level: parents up to some levels, children, and the concept."""
    own = F.lit(binding.VOCAB + concept_label.replace(" ", "_"))
    up = pairs.where((F.col("descendant") == own) & (F.col("depth") <= levels)).select(F.lit("parent").alias("relation"), F.col("ancestor").alias("related"), F.col("depth").alias("level"))
    down = edges.where(F.col("parent") == own).select(F.lit("child"), "child", F.lit(1))
    self_ = edges.where((F.col("child") == own) | (F.col("parent") == own)).select(F.lit("self"), own, F.lit(0)).distinct()
    out = up.union(down).union(self_)
    return out.select(own.alias("concept"), "relation", "related", labelled("related").alias("related_label"), F.col("level").cast("long").alias("level"))


def display_levels(around: DataFrame) -> DataFrame:
    """Parents by level with their display name N1, N2, ..."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("level", "related")).cast("long")
    return around.where("relation = 'parent'").select("related_label", "level", F.concat(F.lit("N"), n.cast("string")).alias("display"))


def summary(around: DataFrame) -> DataFrame:
    n = lambda r: F.count(F.when(F.col("relation") == r, 1)).alias(f"n_{r}")
    return around.agg(n("parent"), n("child"), F.count(F.lit(1)).alias("n_nodes")).withColumn("is_empty", F.col("n_nodes") <= 1)
