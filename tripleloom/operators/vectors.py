"""Embeddings: structural (fast random projection), textual (hashed words), and cosine neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import terms as T
from .graph import Graph, instances
from .search import rrf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def find_similar(vectors: DataFrame, key, top_k: int = 10, id_col: str = "id", vec_col: str = "vec", keep: Column | None = None) -> DataFrame:
    """``id, score``: the nearest by cosine to the vector of ``key``, itself and zero vectors left out; empty if it has none.

    ``keep`` filters the candidates before the top is taken."""
    T.limit("similar", top_k)
    v = vectors.where(keep) if keep is not None else vectors
    one = vectors.where(F.col(id_col) == key).select(F.col(vec_col).alias("_q")).limit(1)
    s = v.where(F.col(id_col) != key).crossJoin(F.broadcast(one)).select(F.col(id_col).alias("id"), cosine(F.col(vec_col), F.col("_q")).alias("score"))  # one row
    return s.where("score is not null").orderBy(F.desc("score"), "id").limit(top_k)


def hybrid(structural: DataFrame, textual: DataFrame, top_k: int = 10) -> DataFrame:
    """Fuse two lists ``id, score`` of twice the length."""
    return rrf([x.select(F.col("id").alias("uri"), "score") for x in (structural, textual)], top_k)


def hybrid_search(graph: Graph, structural: DataFrame, textual: DataFrame, uri: str, top_k: int = 10, class_uri: str | None = None, ontology: str | None = None) -> DataFrame:
    """``uri, score``: neighbours of one entity by structure and by text, two lists of twice the length fused by rank.

    Vectors are tables ``id, vec`` of IRIs.  With a class only its instances, descendants included, are candidates, filtered
    before either top is taken; an entity without a vector of one kind is ranked by the other alone."""
    uri = graph.iri(uri)
    lists = []
    for v in (structural, textual):
        if class_uri is not None:
            own = instances(graph, graph.iri(class_uri), ontology).select(F.col("s").alias("id"))
            v = v.join(own, "id", "left_semi").unionByName(v.where(F.col("id") == uri)).distinct()
        lists.append(find_similar(v, uri, 2 * top_k))
    return hybrid(lists[0], lists[1], top_k)


def upsert(table: DataFrame, vectors: DataFrame, ontology: str) -> DataFrame:
    """A vector table ``id, vec, ontologies`` with ``vectors(id, vec)`` of one ontology put in.

    A known id takes the new vector and is tagged with the ontology as well."""
    new = vectors.select("id", F.col("vec").alias("_v")).withColumn("_o", F.array(F.lit(ontology)))
    both = table.join(new, "id", "full_outer")
    none = F.array().cast("array<string>")
    return both.select("id", F.coalesce("_v", "vec").alias("vec"), F.array_sort(F.array_union(F.coalesce("ontologies", none), F.coalesce("_o", none))).alias("ontologies"))


def untag(table: DataFrame, ontology: str) -> DataFrame:
    """The table without the ontology's tag; vectors that no other ontology names go."""
    return table.withColumn("ontologies", F.array_remove("ontologies", ontology)).where(F.size("ontologies") > 0)


def _unit(v: str) -> Column:
    n = F.sqrt(dot(F.col(v), F.col(v)))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.col(v))


def fast_rp(edges: DataFrame, nodes: DataFrame | None = None, dim: int = 256, weights: tuple[float, ...] = (0.0, 1.0, 1.0), seed: int = 42) -> DataFrame:
    """``id, vec`` by fast random projection of undirected ``edges(s, o)``.

    A seed vector's entries are ±sqrt(3) with probability 1/6 each, from a hash of (node, entry, seed), so they do not
    depend on how rows are dealt out.  A hop is the neighbours' mean, scaled to length one.  Isolated nodes are zero."""
    e = edges.select(F.col("s").cast("string").alias("s"), F.col("o").cast("string").alias("o")).where("s <> o")
    both = e.unionByName(e.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct()
    ids = both.select(F.col("s").alias("id")).distinct()
    ids = ids if nodes is None else nodes.select(F.col("id").cast("string").alias("id")).unionByName(ids).distinct()

    def entry(i: Column) -> Column:
        h = F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(6))
        return F.when(h == 0, F.lit(math.sqrt(3))).when(h == 1, F.lit(-math.sqrt(3))).otherwise(F.lit(0.0))

    hop = ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), entry).alias("v"))
    total = hop.select("id", F.transform("v", lambda x: x * F.lit(float(weights[0]))).alias("t"))
    for w in weights[1:]:
        # the mean per entry, a row an edge: summed in the tasks before the shuffle, so a hub costs one row a task
        means = [F.avg(F.get("v", F.lit(k))).alias(f"x{k}") for k in range(dim)]
        far = both.join(hop.select(F.col("id").alias("o"), "v"), "o").groupBy(F.col("s").alias("id")).agg(*means)
        hop = far.select("id", F.array(*[f"x{k}" for k in range(dim)]).alias("v")).withColumn("v", _unit("v"))
        total = total.join(hop, "id", "left").select("id", F.when(F.col("v").isNull(), F.col("t")).otherwise(F.zip_with("t", "v", lambda a, b: a + b * F.lit(float(w)))).alias("t"))
    return total.withColumn("vec", _unit("t")).select("id", "vec")


def text_vectors(texts: DataFrame, dim: int = 256, least: int = 3) -> DataFrame:
    """``id, vec`` by signed counts of hashed words of ``texts(id, text)``, without a provider (see `embedding_store`)."""
    w = texts.where(F.length("text") >= least).select("id", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")).alias("w"))
    w = w.select("id", F.pmod(F.xxhash64("w"), F.lit(dim)).cast("int").alias("k"), (1 - 2 * F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(2))).alias("sign"))
    n = w.groupBy("id", "k").agg(F.sum("sign").cast("double").alias("x"))
    m = n.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))
