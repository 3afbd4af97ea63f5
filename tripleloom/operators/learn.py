"""Typing, taxonomy and relations proposed from text: stages with confidence filters over the proposals of any provider.

A provider maps batches of texts to rows of ``PROPOSED`` on the executors (a model behind `embedding_store.Provider`-like code, or a rule), or is a
query like `cooccurrence`, which needs no model.  Nothing a provider says is taken as it is: classes and predicates must be known,
confidences pass a threshold, a term has its best classes only, a child one parent, and what is proposed must not make the
class tree a cycle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from .reach_index import strong_components
from .search import SPLIT

#: ``kind``: 'type' (term, class), 'parent' (child, parent) or 'relation' (subject, predicate, object).
PROPOSED = "kind string, subject string, predicate string, object string, confidence double"
#: Words of a context at most.
SPAN = 64


def propose(texts: DataFrame, provider: Callable[[Iterable], Iterable]) -> DataFrame:
    """What ``provider`` says about ``texts(text)``, written once: the stages below read it several times.

    Equal proposals of several texts are one, with the greatest confidence; those without a subject, an object or a confidence from 0 to 1 are dropped."""
    p = texts.select("text").mapInPandas(provider, PROPOSED).where("trim(subject) <> '' and trim(object) <> '' and confidence between 0 and 1")
    return materialise(p.groupBy("kind", F.trim("subject").alias("subject"), "predicate", F.trim("object").alias("object")).agg(F.max("confidence").alias("confidence")))


def cooccurrence(texts: DataFrame, terms: list[str], span: int = SPAN) -> DataFrame:
    """``a, b, n_a, n_b, n_ab`` for terms (lower-case words) that stand in one context: contexts of each, and of both.

    A context is a sentence, or ``span`` words of a longer one, so a text of any length makes at most ``span`` pairs a word."""
    words = lambda s: F.filter(F.split(F.lower(s), SPLIT), lambda w: w != "")
    s = texts.select(F.explode(F.split(F.col("text").cast("string"), r"[.!?\n]+")).alias("s")).select(words(F.col("s")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / span).cast("int"))
    c = s.select(F.explode(F.transform(starts, lambda i: F.slice("w", i * span + 1, F.lit(span)))).alias("w"))
    held = c.select(F.array_intersect("w", F.array(*map(F.lit, sorted(set(terms))))).alias("t")).where("size(t) > 0")  # of the listed terms only
    alone = materialise(held.select(F.explode("t").alias("a")).groupBy("a").agg(F.count("*").alias("n")))
    both = held.where("size(t) > 1").select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    return both.join(F.broadcast(alone.toDF("a", "n_a")), "a").join(F.broadcast(alone.toDF("b", "n_b")), "b").select("a", "b", "n_a", "n_b", "n_ab")  # a row a listed term


def subsumptions(pairs: DataFrame) -> DataFrame:
    """Proposals of parents: b is over a if it stands in more of a's contexts than a in b's; the confidence is that share."""
    return pairs.where("n_b > n_a").select(F.lit("parent").alias("kind"), F.col("a").alias("subject"), F.lit(None).cast("string").alias("predicate"), F.col("b").alias("object"), (F.col("n_ab") / F.col("n_a")).alias("confidence"))


def types(proposals: DataFrame, classes: list[str], top_k: int = 1, least: float = 0.5) -> DataFrame:
    """``term, class, confidence, rank``: the best known classes of each term."""
    p = proposals.where((F.col("kind") == "type") & F.col("object").isin(classes) & (F.col("confidence") >= least))
    best = p.groupBy(F.col("subject").alias("term"), F.col("object").alias("class")).agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("confidence"), "class"))  # a term has as many classes as the schema
    return best.withColumn("rank", rank).where(F.col("rank") <= top_k)


def taxonomy(proposals: DataFrame, parents: list[str] | None = None, tree: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``child, parent, confidence``: the best parent of each child, without those that would close a cycle with each other or with ``tree(child, parent)``.

    ``parents``: the classes that may be one (None: any).  Of each cycle the weakest proposal goes, until none is left."""
    p = proposals.where((F.col("kind") == "parent") & (F.col("confidence") >= least) & (F.col("subject") != F.col("object")))
    p = p.where(F.col("object").isin(parents)) if parents is not None else p
    best = p.groupBy(F.col("subject").alias("child")).agg(F.max(F.struct("confidence", F.col("object").alias("parent"))).alias("m")).select("child", "m.parent", "m.confidence")
    kept = materialise(best)
    fixed = tree.select(F.col("child").alias("s"), F.col("parent").alias("o")) if tree is not None else None
    while True:
        edges = kept.select(F.col("child").alias("s"), F.col("parent").alias("o"))
        comps = strong_components(edges if fixed is None else edges.unionByName(fixed))
        inside = kept.join(comps.toDF("child", "c1"), "child").join(comps.toDF("parent", "c2"), "parent").where("c1 = c2")
        weakest = materialise(inside.groupBy("c1").agg(F.min(F.struct("confidence", "child", "parent")).alias("m")).select("m.child", "m.parent"))
        if weakest.isEmpty():
            return kept
        kept = materialise(kept.join(weakest, ["child", "parent"], "left_anti"))


def relations(proposals: DataFrame, predicates: DataFrame, typed: DataFrame, least: float = 0.5) -> DataFrame:
    """``subject, predicate, object, confidence`` of known ``predicates(predicate, domain, range)`` whose ends have the classes asked for (null: any).

    ``typed(term, class)`` are the terms' classes, ancestors included."""
    p = proposals.where((F.col("kind") == "relation") & (F.col("confidence") >= least)).select("subject", "predicate", "object", "confidence")
    p = p.join(F.broadcast(predicates), "predicate")  # a row a predicate of the schema
    for end, side in (("subject", "domain"), ("object", "range")):
        has = typed.select(F.col("term").alias(end), F.col("class").alias(side)).distinct()
        p = p.where(F.col(side).isNull()).unionByName(p.where(F.col(side).isNotNull()).join(has, [end, side], "left_semi").select(*p.columns))
    return p.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))
