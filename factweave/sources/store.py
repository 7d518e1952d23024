"""A versioned table of triples in one folder, partitioned by predicate.

A version is a small list of the parts that each predicate has. A change that only adds writes what it adds as one more part; any other writes the predicates
it touches anew. Then the new list follows; what isn't touched is read from where it lies, and every earlier version stays readable. A change
that dies before its list is written leaves the table as it was.

Rows are written where they are, without being dealt out: a task has a file for each predicate it holds. A change deals out those old rows only whose subject
has a stem (the subject without its digits) that a row of the change has too; no other can meet it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.mapping import TERMS
from factweave.sources.shared import apart, kept

LIST = "p string, part long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = 0
        self.chains: dict[str, tuple[int, ...]] = {}  # the parts of each predicate

    @property
    def parts(self) -> dict[str, int]:
        """The last part of each predicate."""
        return {p: ks[-1] for p, ks in self.chains.items()}

    @classmethod
    def created(cls, triples: DataFrame, path: str) -> Store:
        """A store whose version 1 holds triples (a set)."""
        return cls(triples.sparkSession, path)._with(triples, {})

    def at(self, version: int) -> Store:
        out = Store(self.spark, self.path)
        out.version = version
        for r in self.spark.read.schema(LIST).parquet(f"{self.path}/versions/{version}").orderBy("part").collect():
            out.chains[r["p"]] = (*out.chains.get(r["p"], ()), r["part"])
        return out

    def read(self, predicates: set[str] | None = None) -> DataFrame:
        """The triples of this version, or of some predicates; only their parts are read."""
        return self._read({(p, k) for p, ks in self.chains.items() if predicates is None or p in predicates for k in ks}).select(*TERMS)

    def through(self, *versions: int) -> DataFrame:
        """The triples of some versions, each part read once, with the array of versions that a row is in. A triple that was written again has a row for each time."""
        within: dict[tuple[str, int], list[int]] = {}
        for version in versions:
            for p, ks in self.at(version).chains.items():
                for k in ks:
                    within.setdefault((p, k), []).append(version)
        listed = self.spark.createDataFrame([(p, k, v) for (p, k), v in within.items()], "p string, part long, versions array<int>")
        return self._read(set(within)).join(F.broadcast(listed), ["p", "part"]).select(*TERMS, "versions")  # as long as the lists

    def _read(self, wanted: set[tuple[str, int]]) -> DataFrame:
        """TERMS and part, of some predicates' parts."""
        schema = ", ".join(f"{c} string" for c in TERMS)
        found: dict[int, list[str]] = {}
        for p, part in sorted(wanted):
            found.setdefault(part, []).append(p)
        frames = [self.spark.read.schema(schema).option("basePath", f"{self.path}/part={part}").parquet(f"{self.path}/part={part}").where(F.col("p").isin(*ps)).select(*TERMS, F.lit(part).cast("long").alias("part")) for part, ps in sorted(found.items())]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"{schema}, part long")

    def _with(self, triples: DataFrame, kept: dict[str, tuple[int, ...]]) -> Store:
        """The next version: triples besides the parts in kept."""
        part = self.version + 1
        folder = f"{self.path}/part={part}"
        triples.select(*TERMS).write.partitionBy("p").parquet(folder, compression="zstd")
        held = [r["p"] for r in self.spark.read.schema(", ".join(f"{c} string" for c in TERMS)).parquet(folder).select("p").distinct().collect()]
        out = Store(self.spark, self.path)
        out.version, out.chains = part, kept | {p: (*kept.get(p, ()), part) for p in held}
        self.spark.createDataFrame([(p, k) for p, ks in out.chains.items() for k in ks], LIST).coalesce(1).write.parquet(f"{self.path}/versions/{part}")
        return out

    def changed(self, new: DataFrame | None = None, gone: DataFrame | None = None, replaced: bool = False) -> Store:
        """The next version, with new triples, without gone (s, p: all values; with o too: that value); replaced: new ones take the place of their subjects' old values.

        Only the parts of predicates that occur in new or gone are read; where triples are only added, none is written again.
        """
        new = None if new is None else kept(new.select(*TERMS).distinct(), "new")
        keys = [] if gone is None else [c for c in ("s", "p", "o") if c in gone.columns]
        gone = None if gone is None else kept(gone.select(*keys).distinct(), "gone")
        touched = {r["p"] for x in (new, gone) if x is not None for r in x.select("p").distinct().collect()}
        if not touched:
            return self
        rows = self.read(touched)
        if gone is None and not replaced:
            return self._with(new.subtract(apart(rows, new)[0]), self.chains)
        if gone is not None:
            near, far = apart(rows, gone)
            rows = near.join(gone, keys, "left_anti").select(*TERMS).unionByName(far)
        if new is not None:
            near, far = apart(rows, new)
            if replaced:
                mine = new.select(F.col("s").alias("new_s"), F.col("p").alias("new_p")).distinct()
                rows = near.join(mine, F.col("s").eqNullSafe(F.col("new_s")) & (F.col("p") == F.col("new_p")), "left_anti").unionByName(far).unionByName(new)
            else:
                rows = rows.unionByName(new.subtract(near))
        return self._with(rows, {p: ks for p, ks in self.chains.items() if p not in touched})
