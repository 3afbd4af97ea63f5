"""Schema questions: classes, properties and instance counts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import terms as T
from .graph import Graph


def _english(lang: str = "lang"):
    return (F.coalesce(F.col(lang), F.lit("")) == "") | F.lower(F.col(lang)).rlike("^en(-|$)")


def classes(graph: Graph, ontology: str | None = None) -> DataFrame:
    """``uri, label, parent, description, instances`` per class; instances are typed directly."""
    t = graph.triples([T.TYPE, T.LABEL, T.SUBCLASS, T.COMMENT, T.DEFINITION], ontology, ("schema",))
    one = lambda cond, col="o": F.min(F.when(cond, F.col(col)))
    c = t.groupBy(F.col("s").alias("uri")).agg(
        F.bool_or((F.col("p") == T.TYPE) & F.col("o").isin(*T.CLASSES)).alias("is_class"),
        one((F.col("p") == T.LABEL) & _english()).alias("label"),
        one((F.col("p") == T.SUBCLASS) & (F.col("o_kind") == "iri") & (F.col("o") != T.OWL + "Thing")).alias("parent"),
        F.coalesce(one((F.col("p") == T.COMMENT) & _english()), one((F.col("p") == T.DEFINITION) & _english())).alias("description"),
    )
    n = graph.triples([T.TYPE], ontology, ("data",)).groupBy(F.col("o").alias("uri")).agg(F.count_distinct("s").alias("instances"))
    return c.where("is_class").drop("is_class").join(n, "uri", "left").withColumn("instances", F.coalesce("instances", F.lit(0)))


def properties(graph: Graph, ontology: str | None = None) -> DataFrame:
    """``uri, label, kind, domain, range, transitive, inverse`` per property."""
    t = graph.triples([T.TYPE, T.LABEL, T.DOMAIN, T.RANGE, T.INVERSE], ontology, ("schema",))
    one = lambda cond: F.min(F.when(cond, F.col("o")))
    p = t.groupBy(F.col("s").alias("uri")).agg(
        one((F.col("p") == T.TYPE) & F.col("o").isin(*T.PROPERTIES)).alias("kind"),
        one((F.col("p") == T.LABEL) & _english()).alias("label"),
        one((F.col("p") == T.DOMAIN) & (F.col("o_kind") == "iri")).alias("domain"),
        one((F.col("p") == T.RANGE) & (F.col("o_kind") == "iri")).alias("range"),
        F.coalesce(F.bool_or((F.col("p") == T.TYPE) & (F.col("o") == T.TRANSITIVE)), F.lit(False)).alias("transitive"),
        one(F.col("p") == T.INVERSE).alias("inverse"),
    )
    return p.where("kind is not null")


def class_detail(graph: Graph, class_uri: str, ontology: str | None = None, sample: int = 3) -> dict:
    """Label, description, parents, children, properties, counts and sample instances of one class; KeyError if unknown."""
    uri = graph.iri(class_uri)
    own = classes(graph, ontology).where(F.col("uri") == uri).first()
    if own is None:
        raise KeyError(uri)
    sub = graph.triples([T.SUBCLASS], ontology, ("schema",)).where("s_kind = 'iri' and o_kind = 'iri'").select("s", "o").distinct()
    parents = [r["o"] for r in sub.where(F.col("s") == uri).orderBy("o").collect()]
    children = [r["s"] for r in sub.where(F.col("o") == uri).orderBy("s").collect()]
    props = [r["s"] for r in graph.triples([T.DOMAIN], ontology, ("schema",)).where(F.col("o") == uri).select("s").distinct().orderBy("s").collect()]
    from .graph import instances

    some = [r["s"] for r in instances(graph, uri, ontology, infer=False).orderBy("s").limit(sample).collect()]
    return own.asDict() | {"parents": parents, "children": children, "properties": props, "instances_inferred": instances(graph, uri, ontology).count(), "sample": some}


def class_graph(graph: Graph, ontology: str | None = None) -> DataFrame:
    """``kind, id, label, source, target, instances``: a node per class and an edge per parent, for a drawing of the hierarchy."""
    c = classes(graph, ontology)
    name = F.coalesce("label", F.regexp_extract("uri", r"([^/#:]*)$", 1))
    none = F.lit(None).cast("string")
    nodes = c.select(F.lit("node").alias("kind"), F.col("uri").alias("id"), name.alias("label"), none.alias("source"), none.alias("target"), F.col("instances").cast("long").alias("instances"))
    edges = c.where("parent is not null").select(F.lit("edge").alias("kind"), F.concat(F.col("uri"), F.lit(" subClassOf "), F.col("parent")).alias("id"), F.lit("subClassOf").alias("label"), F.col("parent").alias("source"), F.col("uri").alias("target"), F.lit(None).cast("long").alias("instances"))
    return nodes.unionByName(edges)


def schema_hash(graph: Graph, ontology: str | None = None) -> str:
    """MD5 over the sorted class and property IRIs; changes when the schema does."""
    c = sorted(r["uri"] for r in classes(graph, ontology).select("uri").collect())
    p = sorted(r["uri"] for r in properties(graph, ontology).select("uri").collect())
    return hashlib.md5(json.dumps({"classes": c, "properties": p}).encode()).hexdigest()


def prompt(graph: Graph, ontology: str | None = None) -> str:
    """The schema as compact text for a prompt."""
    lines = ["Classes:"]
    for r in classes(graph, ontology).orderBy("uri").collect():
        lines.append(f"- {r['label'] or r['uri']} <{r['uri']}>" + (f" is a <{r['parent']}>" if r["parent"] else "") + f" ({r['instances']})")
    lines.append("Properties:")
    for r in properties(graph, ontology).orderBy("uri").collect():
        lines.append(f"- {r['label'] or r['uri']} <{r['uri']}>: {r['domain'] or '?'} -> {r['range'] or '?'}" + (" (transitive)" if r["transitive"] else ""))
    return "\n".join(lines)
