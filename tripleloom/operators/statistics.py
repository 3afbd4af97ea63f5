"""What a graph's predicates hold, counted once and stored, and what follows for the order of joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from .graph import Graph

#: Sets of predicates that are read to the driver at most; a graph with more is estimated from its predicates alone.
SETS = 10_000


def profiles(graph: Graph, ontology: str | None = None, layers: tuple[str, ...] = ("data",)) -> DataFrame:
    """``profile, count``: how many subjects have these predicates, each so often (``array<struct<p, n>>``).

    One exchange, by subject: equal triples, a subject's predicates and its profile are all found where its triples meet."""
    rows, unique = graph.scope(None, ontology, layers)
    own = rows.select("s", "p", "o", "o_kind", "dt", "lang", "layer", "s_kind", *([] if ontology is None else ["ontology"]))
    own = own.repartition("s") if unique else own.repartition("s").distinct()
    own = own.groupBy("s", "p").agg(F.count("*").alias("n")).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("profile"))
    return own.groupBy("profile").agg(F.count("*").alias("count"))


def predicates(graph: Graph, ontology: str | None = None, layers: tuple[str, ...] = ("data",), counted: DataFrame | None = None) -> DataFrame:
    """``p, n, subjects, objects, most``: triples, distinct subjects, about how many distinct objects, and the most triples of one subject.

    ``counted``: the graph's `profiles`, where they are stored."""
    each = (profiles(graph, ontology, layers) if counted is None else counted).select("count", F.inline("profile"))
    each = each.groupBy("p").agg(F.sum(F.col("n") * F.col("count")).alias("n"), F.sum("count").alias("subjects"), F.max("n").alias("most"))
    # equal triples count as one object anyhow
    objects = graph.scope(None, ontology, layers)[0].groupBy("p").agg(F.approx_count_distinct("o").alias("objects"))
    return each.join(objects, "p").select("p", "n", "subjects", "objects", "most")


def characteristic_sets(graph: Graph, ontology: str | None = None, layers: tuple[str, ...] = ("data",), counted: DataFrame | None = None) -> DataFrame:
    """``predicates, subjects``: the sets of predicates that subjects have, and how many have each."""
    counted = profiles(graph, ontology, layers) if counted is None else counted
    return counted.groupBy(F.col("profile.p").alias("predicates")).agg(F.sum("count").alias("subjects"))


@dataclass(frozen=True)
class Count:
    n: int
    subjects: int
    objects: int
    most: int


@dataclass
class Statistics:
    by_predicate: dict[str, Count] = field(default_factory=dict)
    sets: list[tuple[frozenset[str], int]] = field(default_factory=list)

    @classmethod
    def collect(cls, graph: Graph, path: str, ontology: str | None = None, layers: tuple[str, ...] = ("data",)) -> Statistics:
        """Count the graph, store both tables at ``path`` and read them back."""
        counted = materialise(profiles(graph, ontology, layers))
        predicates(graph, ontology, layers, counted).write.mode("overwrite").parquet(f"{path}/predicates")
        characteristic_sets(graph, ontology, layers, counted).write.mode("overwrite").parquet(f"{path}/sets")
        return cls.read(graph.spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Statistics:
        rows = spark.read.parquet(f"{path}/predicates").collect()  # a row a predicate
        sets = spark.read.parquet(f"{path}/sets").limit(SETS + 1).collect()
        few = [(frozenset(r["predicates"]), r["subjects"]) for r in sets] if len(sets) <= SETS else []
        return cls({r["p"]: Count(r["n"], r["subjects"], r["objects"], r["most"]) for r in rows}, few)

    def of(self, predicate: str | None) -> Count:
        if predicate is None:
            every = list(self.by_predicate.values()) or [Count(1, 1, 1, 1)]
            return Count(*(sum(getattr(c, k) for c in every) for k in ("n", "subjects", "objects")), max(c.most for c in every))
        return self.by_predicate.get(predicate, Count(0, 1, 1, 0))

    def triples(self, predicate: str | None, subject_given: bool, object_given: bool) -> float:
        """About how many triples a pattern has."""
        c = self.of(predicate)
        return c.n / (max(1, c.subjects) if subject_given else 1) / (max(1, c.objects) if object_given else 1)

    def star(self, star: list[str]) -> float:
        """Subjects that have all the predicates: exact from the sets, else at most the rarest predicate's."""
        if self.sets:
            return float(sum(n for have, n in self.sets if have.issuperset(star)))
        return float(min(self.of(p).subjects for p in star))
