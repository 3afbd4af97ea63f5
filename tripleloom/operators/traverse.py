"""Traversal, shortest paths, closures and identity classes, as loops of joins over frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import terms as T
from ..plans.materialise import Grown, materialise
from .graph import Graph, instances

MAX_DEPTH = T.LIMITS["depth"][1]


def _steps(graph: Graph, predicate: str | None, direction: str, ontology: str | None) -> DataFrame:
    """``u, v, p, forward``: one row a step that a walk may take; literals are no nodes."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    e = graph.edges(None if predicate is None else [graph.iri(predicate)], ontology)
    out = e.select(F.col("s").alias("u"), F.col("o").alias("v"), "p", F.lit(True).alias("forward"))
    back = e.select(F.col("o").alias("u"), F.col("s").alias("v"), "p", F.lit(False).alias("forward"))
    return {"out": out, "in": back}.get(direction, None) if direction != "both" else out.unionByName(back)


def traverse(graph: Graph, start: str, predicate: str | None = None, max_depth: int = 2, direction: str = "out", ontology: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``uri, depth`` (first seen; the start not among them) and the edges ``s, p, o`` that were touched."""
    depth = T.limit("depth", max_depth)
    steps = _steps(graph, predicate, direction, ontology)
    seen = frontier = graph.spark.createDataFrame([(graph.iri(start), 0)], "uri string, depth int")
    touched = None
    for d in range(1, depth + 1):
        # read twice below: nodes and edges of the hop
        hop = materialise(steps.join(frontier.select(F.col("uri").alias("u")), "u", "left_semi"))
        edges = hop.select(F.when(F.col("forward"), F.col("u")).otherwise(F.col("v")).alias("s"), "p", F.when(F.col("forward"), F.col("v")).otherwise(F.col("u")).alias("o")).distinct()
        new = hop.select(F.col("v").alias("uri")).distinct().join(seen, "uri", "left_anti").select("uri", F.lit(d).alias("depth"))
        touched = edges if touched is None else touched.unionByName(edges)
        frontier = materialise(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0"), touched.distinct()


def find_path(graph: Graph, a: str, b: str, max_depth: int = 4, ontology: str | None = None) -> list[dict]:
    """A shortest undirected path as steps ``from, predicate, to, forward``; [] if there is none or a is b.

    Among equal paths each node keeps its least (parent, predicate)."""
    a, b = graph.iri(a), graph.iri(b)
    depth = T.limit("depth", max_depth)
    if a == b:
        return []
    steps = _steps(graph, None, "both", ontology)
    seen = Grown(graph.spark)
    frontier = seen.add(graph.spark.createDataFrame([(a, 0, None, None, None)], "uri string, depth int, parent string, p string, forward boolean"))
    for d in range(1, depth + 1):
        hop = steps.join(frontier.select(F.col("uri").alias("u")), "u", "left_semi")
        new = hop.groupBy(F.col("v").alias("uri")).agg(F.min(F.struct(F.col("u").alias("parent"), "p", "forward")).alias("m"))
        frontier = seen.add(new.join(seen.rows(), "uri", "left_anti").select("uri", F.lit(d).alias("depth"), "m.parent", "m.p", "m.forward"))
        if not frontier.where(F.col("uri") == b).isEmpty():
            break
        if frontier.isEmpty():
            return []
    path, at, found = [], b, seen.rows()
    for _ in range(depth):  # as many rows as the path has steps
        row = found.where((F.col("uri") == at) & (F.col("depth") > 0)).first()
        if row is None:
            return []
        path.append({"from": row["parent"], "predicate": row["p"], "to": at, "forward": row["forward"]})
        at = row["parent"]
        if at == a:
            return path[::-1]
    return []


def distances(graph: Graph, start: str, predicates: tuple[str, ...] | None = None, max_depth: int = MAX_DEPTH, ontology: str | None = None) -> DataFrame:
    """``uri, depth``: undirected distance from the start, up to the depth."""
    e = graph.edges(None if predicates is None else [graph.iri(p) for p in predicates], ontology)
    both = e.select(F.col("s").alias("u"), F.col("o").alias("v")).unionByName(e.select(F.col("o").alias("u"), F.col("s").alias("v")))
    seen = Grown(graph.spark)
    frontier = seen.add(graph.spark.createDataFrame([(graph.iri(start), 0)], "uri string, depth int"))
    for d in range(1, T.limit("depth", max_depth) + 1):
        hop = both.join(frontier.select(F.col("uri").alias("u")), "u", "left_semi").select(F.col("v").alias("uri")).distinct()
        frontier = seen.add(hop.join(seen.rows(), "uri", "left_anti").select("uri", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
    return seen.rows()


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure ``s, o`` of ``edges(s, o)``, semi-naive: each round joins only the pairs that the last one found."""
    found = Grown(edges.sparkSession)
    base = new = found.add(edges.select("s", "o").distinct())
    while not new.isEmpty():
        step = new.join(base.select(F.col("s").alias("o"), F.col("o").alias("t")), "o").select("s", F.col("t").alias("o")).distinct()
        new = found.add(step.join(found.rows(), ["s", "o"], "left_anti"))
    return found.rows()


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``uri`` that a step or more of ``edges(s, o)`` lead to from ``starts(s)``; each round asks only for the edges of what the last one found."""
    seen = Grown(edges.sparkSession)
    frontier = starts
    while True:
        hop = edges.join(frontier, "s", "left_semi").select(F.col("o").alias("uri")).distinct()
        new = seen.add(hop.join(seen.rows(), "uri", "left_anti") if seen.rounds else hop)
        if new.isEmpty():
            return seen.rows()
        frontier = new.select(F.col("uri").alias("s"))


def reachable(graph: Graph, predicate: str, start_uri: str | None = None, start_label: str | None = None, start_class: str | None = None, ontology: str | None = None) -> DataFrame:
    """``uri, label`` reached from the starts by one step or more; a start is among them only on a cycle.

    Starts: a uri, all entities of a label (case aside; within ``start_class`` if given), or all instances of a class."""
    if start_uri is None and start_label is None and start_class is None:
        raise ValueError("a start is needed")
    e = graph.edges([graph.iri(predicate)], ontology).select("s", "o")
    if start_uri is not None:
        starts = graph.spark.createDataFrame([(graph.iri(start_uri),)], "s string")
    else:
        starts = None if start_class is None else instances(graph, graph.iri(start_class), ontology)
        if start_label is not None:
            named = graph.triples([T.LABEL], ontology).where(F.lower("o") == start_label.lower()).select("s").distinct()
            starts = named if starts is None else named.join(starts, "s", "left_semi")
    return reach(e, starts).join(graph.labels(ontology), "uri", "left").orderBy("uri")


def same_as(graph: Graph, uri: str, ontology: str | None = None) -> DataFrame:
    """``uri`` of everything that a chain of sameAs, either way, identifies with the given one (itself left out).

    By identity classes: their rounds grow with the logarithm of a chain's length, those of a search from the given one with its length."""
    uri = graph.iri(uri)
    classes = identity_classes(graph.edges([T.SAME], ontology))
    own = classes.where(F.col("uri") == uri).select("least")
    return classes.join(own, "least", "left_semi").where(F.col("uri") != uri).select("uri").orderBy("uri")


def _ends(up: DataFrame) -> DataFrame:
    """Pointers ``uri, up`` followed to where they end, by doubling; an end points at itself."""
    while True:
        step = up.join(up.toDF("up", "to"), "up").select("uri", F.col("to").alias("up"), (F.col("to") != F.col("up")).alias("moved"))
        step = materialise(step, by_shuffle=True)
        up = step.select("uri", "up")
        if step.where("moved").isEmpty():
            return up


def identity_classes(edges: DataFrame) -> DataFrame:
    """``uri, least``: components of undirected ``edges(s, o)``, contracted.

    Each round points every node at its least neighbour, follows the pointers to their ends and goes on with the edges between ends.
    No two neighbours are ends, so a round leaves half of its nodes at most, and a pointer chain of any length is doubled: the loops grow
    with the logarithm of the nodes, whatever the shape.  A component's least node is always an end, so it is the last one."""
    left = materialise(edges.select("s", "o").unionByName(edges.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct(), by_shuffle=True)
    rounds: list[DataFrame] = []
    while not rounds or not left.isEmpty():
        up = materialise(left.groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("m")).select("uri", F.least("uri", "m").alias("up")), by_shuffle=True)
        ends = _ends(up)
        rounds.append(ends)
        between = left.join(ends.toDF("s", "es"), "s").join(ends.toDF("o", "eo"), "o").where("es <> eo")
        left = materialise(between.select(F.col("es").alias("s"), F.col("eo").alias("o")).distinct(), by_shuffle=True)
    out = rounds.pop().toDF("uri", "least")
    while rounds:
        out = materialise(rounds.pop().join(out.toDF("up", "least"), "up", "left").select("uri", F.coalesce("least", "up").alias("least")), by_shuffle=True)
    return out
