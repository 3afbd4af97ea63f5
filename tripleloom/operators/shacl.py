"""Constraint validation: each constraint is one check over the triples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import terms as T
from .graph import Graph, instances, numeric


@dataclass(frozen=True)
class Constraint:
    """On ``path`` of the instances of ``target``; fields left None don't apply."""

    target: str
    path: str
    datatype: str | None = None
    of_class: str | None = None
    node_kind: str | None = None
    min_count: int | None = None
    max_count: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    pattern: str | None = None
    among: tuple[str, ...] = field(default_factory=tuple)


def validate(graph: Graph, constraints: list[Constraint], ontology: str | None = None) -> DataFrame:
    """``focus, path, value, constraint`` of every violation; value is null for counts."""
    values: dict[str, list[DataFrame]] = {}  # by target: what no instance of it may have
    out = []
    for c in constraints:
        path, target = graph.iri(c.path), graph.iri(c.target)
        v = graph.triples([path], ontology, ("data",)).select("s", "o", "o_kind", "dt")
        bad = []
        if c.datatype:
            bad.append(("datatype", (F.col("o_kind") != "literal") | (F.col("dt") != graph.iri(c.datatype))))
        if c.node_kind == "IRI":
            bad.append(("nodeKind", F.col("o_kind") != "iri"))
        if c.min_inclusive is not None:
            bad.append(("minInclusive", F.coalesce(numeric() < F.lit(c.min_inclusive), F.lit(True))))
        if c.max_inclusive is not None:
            bad.append(("maxInclusive", F.coalesce(numeric() > F.lit(c.max_inclusive), F.lit(True))))
        if c.pattern is not None:
            bad.append(("pattern", ~F.col("o").rlike(c.pattern)))
        if c.among:
            bad.append(("in", ~F.col("o").isin(*c.among)))
        found = []
        if bad:
            marks = F.filter(F.array(*[F.when(cond, name) for name, cond in bad]), lambda x: x.isNotNull())
            found.append(v.select("s", F.col("o").alias("value"), F.explode(marks).alias("constraint")))
        if c.of_class:
            good = instances(graph, graph.iri(c.of_class), ontology).select(F.col("s").alias("o"))
            found.append(v.join(good, "o", "left_anti").select("s", F.col("o").alias("value"), F.lit("class").alias("constraint")))
        for f in found:
            values.setdefault(target, []).append(f.select("s", F.lit(path).alias("path"), "value", "constraint"))
        if c.min_count is not None or c.max_count is not None:
            # values and instances in one grouping, summed before they travel
            own = v if graph.is_set(path, ontology, ("data",)) else v.distinct()
            either = own.select("s", F.lit(1).alias("n"), F.lit(False).alias("meant")).unionByName(instances(graph, target, ontology).select("s", F.lit(0).alias("n"), F.lit(True).alias("meant")))
            n = either.groupBy("s").agg(F.sum("n").alias("n"), F.max("meant").alias("meant")).where("meant")
            few = F.when(F.col("n") < (c.min_count or 0), "minCount")
            many = F.when(F.col("n") > (c.max_count if c.max_count is not None else 1 << 60), "maxCount")
            n = n.select("s", F.explode(F.filter(F.array(few, many), lambda x: x.isNotNull())).alias("constraint"))
            out.append(n.select(F.col("s").alias("focus"), F.lit(path).alias("path"), F.lit(None).cast("string").alias("value"), "constraint"))
    for target, found in values.items():
        # only violating values meet the instances
        met = reduce(DataFrame.unionByName, found).join(instances(graph, target, ontology), "s", "left_semi")
        out.append(met.select(F.col("s").alias("focus"), "path", "value", "constraint"))
    return reduce(DataFrame.unionByName, out).distinct() if out else graph.spark.createDataFrame([], "focus string, path string, value string, constraint string")


def keep_valid(triples: DataFrame, violations: DataFrame) -> DataFrame:
    """Triples without those of a violated (focus, path); without a path all of the focus go."""
    pairs = violations.where("path is not null").select(F.col("focus").alias("s"), F.col("path").alias("p")).distinct()
    whole = violations.where("path is null").select(F.col("focus").alias("s")).distinct()
    return triples.join(pairs, ["s", "p"], "left_anti").join(whole, "s", "left_anti")


def derive(graph: Graph, ontology: str | None = None) -> list[Constraint]:
    """From the schema: ranges as datatype or class, functional properties as a maximum of one; no domain, no constraint."""
    t = graph.triples([T.DOMAIN, T.RANGE, T.TYPE], ontology, ("schema",)).where(F.col("o_kind") == "iri")
    rows: dict[str, dict] = {}
    for r in t.select("s", "p", "o").distinct().orderBy("s", "p", "o").collect():  # the schema's properties
        d = rows.setdefault(r["s"], {})
        key = {T.DOMAIN: "domain", T.RANGE: "range"}.get(r["p"])
        if key:
            d.setdefault(key, r["o"])
        elif r["o"] == T.FUNCTIONAL:
            d["functional"] = True
    out = []
    for p, d in rows.items():
        if "domain" in d and ("range" in d or d.get("functional")):
            r = d.get("range")
            lit = r is not None and r.startswith(T.XSD)
            out.append(Constraint(d["domain"], p, r if lit else None, None if lit else r, None if lit or r is None else "IRI", max_count=1 if d.get("functional") else None))
    return out
