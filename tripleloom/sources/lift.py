"""Lifting relational tables to triples, predicate by predicate.

Nothing is stored: each predicate is a projection of its base table, so a question about it reads those
columns only.  IRIs are ``urn:t:<kind>/<key>``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import COLUMNS, Graph, Part
from ..plans import terms as T

NS = "urn:t:"
V = "urn:v:"


@dataclass(frozen=True)
class Lift:
    """``predicate`` of ``subject`` is ``obj``; ``dt`` None for resources.  Columns are built late: there may be no session yet."""

    table: str
    subject: tuple[str, str]  # kind, key column
    predicate: str
    obj: object  # (kind, column) for a resource, else a SQL expression of the literal
    dt: str | None = None


def ref(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{NS}{kind}/"), F.col(key).cast("string"))


INT, DEC, STR = T.XSD + "integer", T.XSD + "decimal", T.XSD + "string"

LIFTS = (
    Lift("region", ("region", "r_regionkey"), T.LABEL, "r_name", STR),
    Lift("nation", ("nation", "n_nationkey"), T.LABEL, "n_name", STR),
    Lift("nation", ("nation", "n_nationkey"), V + "locatedIn", ("region", "n_regionkey")),
    Lift("customer", ("customer", "c_custkey"), T.LABEL, "c_name", STR),
    Lift("customer", ("customer", "c_custkey"), V + "locatedIn", ("nation", "c_nationkey")),
    Lift("customer", ("customer", "c_custkey"), V + "segment", "c_mktsegment", STR),
    Lift("customer", ("customer", "c_custkey"), V + "balance", "cast(c_acctbal as decimal(18,2))", DEC),
    Lift("supplier", ("supplier", "s_suppkey"), T.LABEL, "s_name", STR),
    Lift("supplier", ("supplier", "s_suppkey"), V + "locatedIn", ("nation", "s_nationkey")),
    Lift("supplier", ("supplier", "s_suppkey"), V + "balance", "cast(s_acctbal as decimal(18,2))", DEC),
    Lift("part", ("part", "p_partkey"), T.LABEL, "p_name", STR),
    Lift("part", ("part", "p_partkey"), V + "hasBrand", ("brand", "p_brand")),
    Lift("part", ("part", "p_partkey"), V + "partType", "p_type", STR),
    Lift("part", ("part", "p_partkey"), V + "size", "p_size", INT),
    Lift("part", ("part", "p_partkey"), V + "retailPrice", "cast(p_retailprice as decimal(18,2))", DEC),
    Lift("orders", ("order", "o_orderkey"), V + "placedBy", ("customer", "o_custkey")),
    Lift("orders", ("order", "o_orderkey"), V + "status", "o_orderstatus", STR),
    Lift("orders", ("order", "o_orderkey"), V + "priority", "o_orderpriority", STR),
    Lift("orders", ("order", "o_orderkey"), V + "totalPrice", "cast(o_totalprice as decimal(18,2))", DEC),
    Lift("lineitem", ("order", "l_orderkey"), V + "orderContains", ("part", "l_partkey")),
    Lift("lineitem", ("order", "l_orderkey"), V + "orderSuppliedBy", ("supplier", "l_suppkey")),
    Lift("events", ("event", "event_id"), V + "byUser", ("user", "user_id")),
    Lift("events", ("event", "event_id"), V + "eventType", "event_type", STR),
    Lift("documents", ("document", "doc_id"), V + "text", "text", STR),
    Lift("documents", ("document", "doc_id"), V + "language", "lang", STR),
    Lift("documents", ("document", "doc_id"), V + "nChars", "n_chars", INT),
)

#: Table, subject kind, key, and the class: fixed, or a class per value of a column.
CLASSES = (
    ("region", "region", "r_regionkey", "Region", None), ("nation", "nation", "n_nationkey", "Nation", None),
    ("customer", "customer", "c_custkey", "Customer_", "c_mktsegment"), ("supplier", "supplier", "s_suppkey", "Supplier", None),
    ("part", "part", "p_partkey", "Part_", "p_type"), ("orders", "order", "o_orderkey", "Order_", "o_orderstatus"),
    ("events", "event", "event_id", "Event_", "event_type"), ("documents", "document", "doc_id", "Document", None),
)
_PARENTS = {"Region": "Place", "Nation": "Place", "Customer": "Agent", "Supplier": "Agent"}


def _row(df: DataFrame, layer: str, s: Column, p: str, o: Column, kind: str, dt: str | None) -> DataFrame:
    t = df.select(F.lit(None).cast("string").alias("ontology"), F.lit(layer).alias("layer"), s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    return t.where("s is not null and o is not null").select(*COLUMNS)


def slug(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9]+", "_")


def lifted(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> Graph:
    """The graph of the tables in ``sf_dir`` (all, or only those named)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    parts = []
    for x in LIFTS:
        if tables is None or x.table in tables:
            o, kind = (ref(*x.obj), "iri") if isinstance(x.obj, tuple) else (F.expr(x.obj), "literal")
            parts.append(Part(_row(read(x.table), "data", ref(*x.subject), x.predicate, o, kind, x.dt), frozenset([x.predicate]), "data", x.table != "lineitem"))
    tbox = [(V + c, T.SUBCLASS, V + p, "iri", None) for c, p in _PARENTS.items()]
    for table, kind, key, name, by in CLASSES:
        if tables is None or table in tables:
            df = read(table)
            cls = F.lit(V + name) if by is None else F.concat(F.lit(V + name), slug(F.col(by)))
            parts.append(Part(_row(df, "data", ref(kind, key), T.TYPE, cls, "iri", None), frozenset([T.TYPE]), "data", True))
            if by is not None:
                sub = df.select(F.concat(F.lit(V + name), slug(F.col(by))).alias("c")).distinct()
                parts.append(Part(_row(sub, "schema", F.col("c"), T.SUBCLASS, F.lit(V + name[:-1]), "iri", None), frozenset([T.SUBCLASS]), "schema", True))
    for c in ("Place", "Region", "Nation", "Agent", "Customer", "Supplier", "Part", "Order", "Event", "Document"):
        tbox.append((V + c, T.TYPE, T.OWL + "Class", "iri", None))
    for p, d, r in (("locatedIn", "Place", "Place"), ("placedBy", "Order", "Customer"), ("placed", "Customer", "Order"), ("hasBrand", "Part", "Brand"), ("orderContains", "Order", "Part"), ("orderSuppliedBy", "Order", "Supplier"), ("byUser", "Event", "User")):
        tbox += [(V + p, T.TYPE, T.OWL + "ObjectProperty", "iri", None), (V + p, T.DOMAIN, V + d, "iri", None), (V + p, T.RANGE, V + r, "iri", None)]
    for p, d, r in (("segment", "Customer", STR), ("balance", "Agent", DEC), ("size", "Part", INT), ("status", "Order", STR), ("priority", "Order", STR), ("totalPrice", "Order", DEC), ("eventType", "Event", STR), ("text", "Document", STR)):
        tbox += [(V + p, T.TYPE, T.OWL + "DatatypeProperty", "iri", None), (V + p, T.DOMAIN, V + d, "iri", None), (V + p, T.RANGE, r, "iri", None)]
    tbox += [(V + "locatedIn", T.TYPE, T.TRANSITIVE, "iri", None), (V + "placed", T.INVERSE, V + "placedBy", "iri", None)]
    rows = spark.createDataFrame([(None, "schema", s, "iri", p, o, k, dt, None) for s, p, o, k, dt in tbox], "ontology string, layer string, s string, s_kind string, p string, o string, o_kind string, dt string, lang string")
    parts.append(Part(rows, None, "schema", True))
    return Graph(spark, parts, {"v": V, "t": NS})
