"""The triple table and its scopes.

A graph is a set of *parts*, one DataFrame per group of predicates, so that a question about one predicate reads
only what holds it (a vertical partition); the union of all parts is built only for questions about all predicates.
Columns: ``ontology, layer, s, s_kind, p, o, o_kind, dt, lang``."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import terms as T

SCHEMA = "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
LAYERS = {"schema": "schema", "data": "data", "semantic": "schema", "state": "data", "policy": "policy", "provenance": "provenance", "probabilistic": "probabilistic", "causal": "causal"}


@dataclass
class Part:
    """Triples of some predicates (None: any) of one layer; ``unique`` if no two of them are equal but for the ontology."""

    rows: DataFrame
    predicates: frozenset[str] | None
    layer: str
    unique: bool = False


@dataclass
class Graph:
    """``readable`` limits the ontologies that reads see (None: all); ``overlap``: parts may repeat each other's triples."""

    spark: SparkSession
    parts: list[Part] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)
    readable: frozenset[str | None] | None = None
    overlap: bool = False

    @classmethod
    def of(cls, triples: DataFrame, prefixes: dict[str, str] | None = None) -> Graph:
        """A graph over one stored table with the columns of ``SCHEMA``."""
        t = triples.select(*COLUMNS)
        return cls(triples.sparkSession, [Part(t.where(F.col("layer") == layer), None, layer) for layer in ("schema", "data")], dict(prefixes or {}))

    def iri(self, term: str) -> str:
        return T.iri(term, self.prefixes)

    def triples(self, predicates: Iterable[str] | None = None, ontology: str | None = None, layers: tuple[str, ...] = ("schema", "data")) -> DataFrame:
        """The scope's triples as a set.  ``ontology=None`` is the union of all readable ontologies, in which equal triples are one."""
        rows, unique = self.scope(predicates, ontology, layers)
        # in the union a triple that several ontologies state is one, of none of them
        if ontology is None and not unique:
            rows = rows.withColumn("ontology", F.lit(None).cast("string"))
        return rows if unique else rows.distinct()

    def is_set(self, predicate: str, ontology: str | None = None, layers: tuple[str, ...] = ("schema", "data")) -> bool:
        """Whether one part alone holds the predicate, for it alone, without repeats: then its ``s, o`` are a set as they are."""
        held = [x for x in self.parts if x.layer in layers and (x.predicates is None or predicate in x.predicates)]
        return len(held) == 1 and held[0].unique and not self.overlap and held[0].predicates == {predicate}

    def scope(self, predicates: Iterable[str] | None = None, ontology: str | None = None, layers: tuple[str, ...] = ("schema", "data")) -> tuple[DataFrame, bool]:
        """The scope's rows, and whether no two of them state the same triple."""
        T.ontology_id(ontology)
        want = None if predicates is None else frozenset(predicates)
        found, unique = [], True
        for part in self.parts:
            if part.layer not in layers or want is not None and part.predicates is not None and not want & part.predicates:
                continue
            rows = part.rows
            if want is not None and (part.predicates is None or part.predicates - want):
                rows = rows.where(F.col("p").isin(*sorted(want)))
            found.append(rows)
            unique = unique and part.unique
        if not found:
            return self.spark.createDataFrame([], SCHEMA), True
        rows = found[0]
        for other in found[1:]:
            rows = rows.unionByName(other)
        if ontology is not None:
            if self.readable is not None and ontology not in self.readable:
                raise PermissionError(f"ontology {ontology} is not readable")
            return rows.where(F.col("ontology") == ontology), not self.overlap
        if self.readable is not None:
            named = sorted(x for x in self.readable if x is not None)
            allowed = F.col("ontology").isin(*named) if named else F.lit(False)
            rows = rows.where(F.when(F.col("ontology").isNull(), F.lit(None in self.readable)).otherwise(allowed))
        return rows, unique and not self.overlap

    def edges(self, predicates: Iterable[str] | None = None, ontology: str | None = None, layers: tuple[str, ...] = ("schema", "data")) -> DataFrame:
        """Distinct ``s, p, o`` with resource objects."""
        return self.scope(predicates, ontology, layers)[0].where("o_kind <> 'literal'").select("s", "p", "o").distinct()

    def labels(self, ontology: str | None = None) -> DataFrame:
        """``uri, label``: one row a resource, the untagged label before the English before others, then the least."""
        rank = F.when(F.coalesce("lang", F.lit("")) == "", 0).when(F.lower("lang").rlike("^en(-|$)"), 1).otherwise(2)
        rows, _ = self.scope([T.LABEL], ontology)
        return rows.groupBy(F.col("s").alias("uri")).agg(F.min(F.struct(rank.alias("r"), F.col("o").alias("label"))).alias("m")).select("uri", "m.label")

    def add(self, triples: DataFrame) -> Graph:
        """A graph with the given triples as well (set semantics)."""
        new = Graph.of(triples).parts
        return Graph(self.spark, [*self.parts, *new], self.prefixes, self.readable, True)


def numeric(o: Column | str = "o", dt: Column | str = "dt") -> Column:
    """The value of a numeric literal, null for other terms."""
    o, dt = (F.col(x) if isinstance(x, str) else x for x in (o, dt))
    return F.when(dt.isin(*T.NUMERIC), o.try_cast("decimal(38,10)"))


def subclasses(graph: Graph, class_uri: str, ontology: str | None = None) -> list[str]:
    """The class and all its descendants; safe on cycles.

    The class tree is schema, not data: a frontier is a list of class names, and each step one filtered scan of the
    ``subClassOf`` triples."""
    rows = graph.scope([T.SUBCLASS], ontology, ("schema",))[0].select("s", "o").distinct()
    seen, frontier = {class_uri}, [class_uri]
    children: dict[str, set[str]] = {}
    for r in rows.collect():  # the subclass tree of the schema layer: as many rows as classes have parents
        children.setdefault(r["o"], set()).add(r["s"])
    while frontier:
        frontier = sorted({c for x in frontier for c in children.get(x, ())} - seen)
        seen.update(frontier)
    return sorted(seen)


def instances(graph: Graph, class_uri: str, ontology: str | None = None, infer: bool = True) -> DataFrame:
    """Distinct ``s`` typed by the class or, with ``infer``, a descendant."""
    names = subclasses(graph, class_uri, ontology) if infer else [class_uri]
    return graph.scope([T.TYPE], ontology, ("data",))[0].where(F.col("o").isin(*names)).select("s").distinct()


def status(graph: Graph) -> DataFrame:
    """``triples, schema_triples, data_triples, typed_entities`` in one pass."""
    t = graph.triples()
    typed = (F.col("p") == T.TYPE) & ~F.col("o").isin(*T.VOCABULARY_TYPES) & (F.col("layer") == "data")
    return t.agg(F.count("*").alias("triples"), F.count_if(F.col("layer") == "schema").alias("schema_triples"), F.count_if(F.col("layer") == "data").alias("data_triples"), F.count_distinct(F.when(typed, F.col("s"))).alias("typed_entities"))
