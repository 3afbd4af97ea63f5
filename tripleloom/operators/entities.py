"""Finding, counting, describing and grouping instances; related pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import terms as T
from .graph import Graph, instances, numeric

OPS = ("=", "!=", ">", ">=", "<", "<=", "contains", "starts_with")
AGGS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Filter:
    """``property op value``; existential over the property's values."""

    property: str
    op: str
    value: str | int | float

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}")


def _number(value) -> Column | None:
    try:
        float(value)
    except (TypeError, ValueError):
        return None
    return F.lit(str(value)).cast("decimal(38,10)")


def matches(f: Filter) -> Column:
    """The filter on a row's ``o`` and ``dt``.

    A value that looks numeric compares as a number with numeric literals; strings compare with the others."""
    o, n = F.col("o"), numeric()
    text, number = F.lit(str(f.value)), _number(f.value)
    no = F.lit(False)
    if f.op == "contains":
        return o.contains(text)
    if f.op == "starts_with":
        return o.startswith(text)
    if f.op == "=":
        same = (o == text) | (F.lower(o) == F.lower(text))
        return same | F.coalesce(n == number, no) if number is not None else same
    compare = {"!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[f.op]
    as_text = n.isNull() & compare(o, text)
    if f.op == "!=":
        return F.coalesce(compare(n, number), no) | as_text if number is not None else as_text | n.isNotNull()
    if number is not None:
        return F.coalesce(compare(n, number), no) | (as_text & (~F.lit(isinstance(f.value, (int, float)))))
    return as_text


def select(graph: Graph, class_uri: str, filters: tuple[Filter, ...] = (), ontology: str | None = None, infer: bool = True) -> DataFrame:
    """Distinct ``s`` of the class that pass every filter; each filter is a semi-join on its own property's triples."""
    found = instances(graph, graph.iri(class_uri), ontology, infer)
    for f in filters:
        hits = graph.triples([graph.iri(f.property)], ontology, ("data",)).where(matches(f)).select("s")
        found = found.join(hits, "s", "left_semi")
    return found


def find_entities(graph: Graph, class_uri: str, filters: tuple[Filter, ...] = (), limit: int | None = 100, ontology: str | None = None) -> DataFrame:
    """``uri, label``, one row an entity, by uri; the limit counts entities."""
    found = select(graph, class_uri, filters, ontology)
    if limit is not None:
        found = found.orderBy("s").limit(limit)
    return found.join(graph.labels(ontology), found["s"] == F.col("uri"), "left").select(found["s"].alias("uri"), "label")


def properties(graph: Graph, entities: DataFrame, predicates: tuple[str, ...] | None = None, ontology: str | None = None) -> DataFrame:
    """``uri, predicate, value, value_kind``: all but the types of the given ``uri`` rows, one row a value."""
    wanted = None if predicates is None else [graph.iri(p) for p in predicates]
    t = graph.triples(wanted, ontology, ("data",)).where(F.col("p") != T.TYPE)
    return t.join(entities.select(F.col("uri").alias("s")), "s", "left_semi").select(F.col("s").alias("uri"), F.col("p").alias("predicate"), F.col("o").alias("value"), F.col("o_kind").alias("value_kind")).distinct()


def property_map(rows: DataFrame) -> DataFrame:
    """``uri, properties``: a map from predicate to the sorted values; an entity's own values are the group."""
    per = rows.groupBy("uri", "predicate").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return per.groupBy("uri").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "values"))).alias("properties"))


def answer(graph: Graph, class_uri: str, filters: tuple[Filter, ...] = (), cap: int = 30, predicates: tuple[str, ...] | None = None, ontology: str | None = None) -> DataFrame:
    """The first ``cap`` entities with all that an answer shows: ``uri, label, properties, has_more``.

    ``properties`` maps a predicate to its sorted values, each with the label of a resource; ``has_more`` (the same in every
    row) says that at least one entity was left out.  One entity over the cap is looked for, no more."""
    found = select(graph, class_uri, filters, ontology).orderBy("s").limit(cap + 1)
    more = found.agg((F.count("*") > cap).alias("has_more"))
    page = found.orderBy("s").limit(cap).select(F.col("s").alias("uri"))
    labels = graph.labels(ontology)
    own = properties(graph, page, predicates, ontology).join(labels.select(F.col("uri").alias("value"), F.col("label").alias("value_label")), "value", "left")
    own = own.withColumn("value_label", F.when(F.col("value_kind") != "literal", F.col("value_label")))
    per = own.groupBy("uri", "predicate").agg(F.array_sort(F.collect_set(F.struct("value", "value_label"))).alias("values"))
    maps = per.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "values")))).alias("properties"))
    out = page.join(labels, "uri", "left").join(maps, "uri", "left")
    return out.crossJoin(F.broadcast(more)).select("uri", "label", "properties", "has_more")  # one row


def with_labels(graph: Graph, rows: DataFrame, columns: tuple[str, ...], ontology: str | None = None) -> DataFrame:
    """``rows`` and a column ``<c>_label`` for each of the given columns of IRIs; null without a label."""
    for c in columns:
        rows = rows.join(graph.labels(ontology).select(F.col("uri").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
    return rows


def typed_edges(graph: Graph, predicates: tuple[str, ...] | None = None, ontology: str | None = None) -> DataFrame:
    """Distinct ``s, p, o`` whose object has a type of its own (EXISTS): links to unknown resources are left out."""
    typed = graph.triples([T.TYPE], ontology, ("data",)).where(~F.col("o").isin(*T.VOCABULARY_TYPES)).select(F.col("s").alias("o")).distinct()
    names = None if predicates is None else [graph.iri(p) for p in predicates]
    return graph.edges(names, ontology, ("data",)).join(typed, "o", "left_semi").select("s", "p", "o")


def chunks(graph: Graph, ontology: str | None = None) -> DataFrame:
    """``uri, chunk``: a typed entity as text for a vector index: ``label (types). predicate: value. ...`` with local names, sorted."""
    local = lambda c: F.regexp_extract(c, r"([^/#:]*)$", 1)
    labels = graph.labels(ontology)
    types = graph.triples([T.TYPE], ontology, ("data",)).where(~F.col("o").isin(*T.VOCABULARY_TYPES))
    types = types.groupBy(F.col("s").alias("uri")).agg(F.array_join(F.array_sort(F.collect_set(local(F.col("o")))), ", ").alias("types"))
    own = graph.triples(None, ontology, ("data",)).where(~F.col("p").isin(T.TYPE, T.LABEL)).join(labels.select(F.col("uri").alias("o"), F.col("label").alias("o_label")), "o", "left")
    said = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(F.coalesce("o_label", local(F.col("o"))))
    own = own.groupBy(F.col("s").alias("uri")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit(" "), local(F.col("p")), F.lit(": "), said, F.lit(".")))), "").alias("facts"))
    text = F.concat(F.coalesce("label", local(F.col("uri"))), F.lit(" ("), F.col("types"), F.lit(")."), F.coalesce("facts", F.lit("")))
    return types.join(labels, "uri", "left").join(own, "uri", "left").select("uri", text.alias("chunk"))


def count_entities(graph: Graph, class_uri: str, filters: tuple[Filter, ...] = (), ontology: str | None = None) -> DataFrame:
    return select(graph, class_uri, filters, ontology).agg(F.count("*").alias("n"))


def describe_entity(graph: Graph, uri: str, predicates: tuple[str, ...] | None = None, ontology: str | None = None) -> DataFrame:
    """``predicate, value, value_kind, inverse``: outgoing triples, and incoming ones under the declared inverse."""
    uri = graph.iri(uri)
    wanted = None if predicates is None else [graph.iri(p) for p in predicates]
    out = graph.triples(None, ontology).where(F.col("s") == uri).select(F.col("p").alias("predicate"), F.col("o").alias("value"), F.col("o_kind").alias("value_kind"), F.lit(False).alias("inverse"))
    inv = graph.triples([T.INVERSE], ontology, ("schema",)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    inv = inv.unionByName(inv.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    back = graph.triples(None, ontology).where((F.col("o") == uri) & (F.col("o_kind") != "literal") & (F.col("p") != T.TYPE))
    back = back.join(inv, back["p"] == inv["a"]).select(F.col("b").alias("predicate"), F.col("s").alias("value"), F.col("s_kind").alias("value_kind"), F.lit(True).alias("inverse"))
    rows = out.unionByName(back).groupBy("predicate", "value", "value_kind").agg(F.bool_and("inverse").alias("inverse"))
    return rows if wanted is None else rows.where(F.col("predicate").isin(*wanted))


def require(df: DataFrame, what: str) -> DataFrame:
    """The rows, or KeyError if there is none: for callers that must tell an unknown name from an empty answer."""
    if df.isEmpty():
        raise KeyError(what)
    return df


def aggregate(graph: Graph, class_uri: str, group_by: str, agg: str = "count", ontology: str | None = None, measure: str | None = None) -> DataFrame:
    """``value, result`` per value of the property, largest result first.

    Without ``measure`` sums and the like run over the grouping value itself; with it over that property of the
    same entity.  Values that are no numbers make no group of a numeric aggregate."""
    if agg not in AGGS:
        raise ValueError(f"unknown aggregate {agg!r}")
    own = select(graph, class_uri, (), ontology)
    g = graph.triples([graph.iri(group_by)], ontology, ("data",)).select("s", "o", "dt").distinct().join(own, "s", "left_semi")
    if agg == "count":
        out = g.groupBy(F.col("o").alias("value")).agg(F.count_distinct("s").cast("double").alias("result"))
    else:
        if measure is None:
            m = g.withColumn("x", F.col("o").try_cast("decimal(38,10)"))
        else:
            m = g.join(graph.triples([graph.iri(measure)], ontology, ("data",)).select("s", F.col("o").try_cast("decimal(38,10)").alias("x")).distinct(), "s")
        fold = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg]
        out = m.where("x is not null").groupBy(F.col("o").alias("value")).agg(fold("x").cast("double").alias("result"))
    return out.orderBy(F.desc("result"), "value")


def find_related(graph: Graph, class_a: str, predicate: str, class_b: str, filters_a: tuple[Filter, ...] = (), filters_b: tuple[Filter, ...] = (), infer: bool = False, ontology: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct ``a, b`` with a - predicate -> b between instances of the two classes."""
    a = select(graph, class_a, filters_a, ontology, infer).withColumnRenamed("s", "a")
    b = select(graph, class_b, filters_b, ontology, infer).withColumnRenamed("s", "b")
    e = graph.edges([graph.iri(predicate)], ontology, ("data",)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    out = e.join(a, "a", "left_semi").join(b, "b", "left_semi").select("a", "b")
    return out if limit is None else out.orderBy("a", "b").limit(T.limit("related", limit))
