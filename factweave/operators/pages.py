"""Member lists of nodes and links in numbered pages, so that no row holds a group whole.

A group of at most HOT members is numbered where it is dealt to. In a larger one a member's place is the sum of the group's members in the ranges before plus its place
within its range; ranges are by a hash of the member, so such a group is numbered in many tasks. Members that repeat count once; nulls are left out; an empty table gives no pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.shared import kept

PAGE, STRIPES = 1000, 64
#: Above so many rows a group is numbered in many tasks.
HOT = 100_000


def paged(rows: DataFrame, group: tuple[str, ...], member: str, page: int = PAGE, stripes: int = STRIPES, hot: int = HOT) -> DataFrame:
    """group, page (from 1), n_pages, n_members (of the group), members: an ordered list of page members at most.

    Members are ordered by stripe, then by themselves: the order is the same whatever the partitions and however a group is numbered. They are dealt out once,
    those of hot groups once more, gathered by page. A group is one column of its values, as nulls are equal within it.
    """
    members = kept(rows.where(F.col(member).isNotNull()).select(F.struct(*group).alias("group"), F.col(member).alias("member")), "members")
    large = kept(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("group"), "hot_groups")
    striped = members.withColumn("stripe", F.pmod(F.xxhash64("member"), F.lit(stripes)).cast("int"))
    some = not large.isEmpty()
    small = striped.join(large, "group", "left_anti") if some else striped
    whole = Window.partitionBy("group")
    placed = small.repartition("group").distinct().select("group", "member", (F.row_number().over(whole.orderBy("stripe", "member")) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(whole).alias("n_members"))
    out = _listed(placed, page)
    if some:
        own = F.row_number().over(Window.partitionBy("group", "stripe").orderBy("member"))
        numbered = kept(striped.join(large, "group", "left_semi").repartition("group", "stripe").distinct().withColumn("own", own), "numbered")
        sizes = numbered.groupBy("group", "stripe").agg(F.count(F.lit(1)).alias("n"))  # stripes rows for a hot group at most
        before = kept(sizes.select("group", "stripe", (F.sum("n").over(whole.orderBy("stripe")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("n_members")), "stripes")
        out = out.unionByName(_listed(numbered.join(before, ["group", "stripe"]).select("group", "member", (F.col("before") + F.col("own") - 1).alias("place"), "n_members"), page))
    return out.select("group.*", "page", F.ceil(F.col("n_members") / page).alias("n_pages"), "n_members", "members")


def _listed(placed: DataFrame, page: int) -> DataFrame:
    """group, page, members, n_members of members with their place."""
    number = (F.floor(F.col("place") / page) + 1).alias("page")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x["member"])
    return placed.groupBy("group", number).agg(lists.alias("members"), F.first("n_members").alias("n_members"))


def summary(paged_rows: DataFrame, *group: str) -> DataFrame:
    """For each group what its pages hold: n_pages, n_members, pages_found, listed, different, least, most.

    A page is one row and a member stands on one page, so each page is counted where it lies and only its counts are dealt out.
    """
    each = paged_rows.select(*group, "page", "n_pages", "n_members", F.size("members").alias("listed"), F.size(F.array_distinct("members")).alias("different"), F.array_min("members").alias("least"), F.array_max("members").alias("most"))
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return each.groupBy(*group).agg(F.max("n_pages").alias("n_pages"), F.max("n_members").alias("n_members"), F.count("page").alias("pages_found"), total("listed"), total("different"), F.min("least").alias("least"), F.max("most").alias("most"))
