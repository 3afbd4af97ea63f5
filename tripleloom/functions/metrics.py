"""Scores over results and answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(df: DataFrame) -> DataFrame:
    """Rows as sorted value lists, once each: names and order of the columns don't count."""
    return df.select(F.array_sort(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])).alias("r")).distinct()


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``shared, either, score``; 1 if both are empty."""
    x = canonical(a).withColumn("a", F.lit(1)).unionByName(canonical(b).withColumn("a", F.lit(2)))
    n = x.groupBy("r").agg(F.bit_or("a").alias("m")).agg(F.count_if(F.col("m") == 3).alias("shared"), F.count("*").alias("either"))
    return n.withColumn("score", F.when(F.col("either") == 0, 1.0).otherwise(F.col("shared") / F.col("either")))


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    r = jaccard(a, b).first()
    return r["shared"] == r["either"]


def tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\W+")), lambda w: w != "")


def citation_overlap(claim: Column, source: Column) -> Column:
    """Share of the claim's tokens that the source holds; null without tokens."""
    t = tokens(claim)
    return F.try_divide(F.size(F.array_intersect(t, tokens(source))).cast("double"), F.size(t).cast("double"))


def hallucination_rate(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """One row ``claims, unsupported, rate`` over distinct claims with the columns of ``facts``."""
    c = claims.distinct()
    names = claims.columns
    f = facts.select(*names).distinct().withColumn("_known", F.lit(1))
    cond = [c[n].eqNullSafe(f[n]) for n in names]
    j = c.join(f, cond, "left")
    return j.agg(F.count("*").alias("claims"), F.count_if(F.col("_known").isNull()).alias("unsupported")).withColumn("rate", F.coalesce(F.try_divide(F.col("unsupported").cast("double"), F.col("claims").cast("double")), F.lit(0.0)))


def inference_utilisation(with_inference: DataFrame, without: DataFrame, answer: DataFrame) -> DataFrame:
    """One row ``inferred, used, score``: how many rows that only inference gives are in the answer."""
    only = canonical(with_inference).subtract(canonical(without))
    j = only.join(canonical(answer).withColumn("_in", F.lit(1)), "r", "left")
    return j.agg(F.count("*").alias("inferred"), F.count("_in").alias("used")).withColumn("score", F.coalesce(F.try_divide(F.col("used").cast("double"), F.col("inferred").cast("double")), F.lit(1.0)))


def uses_property_path(query: str) -> bool:
    """Whether a query text has ``p+``, ``p*``, a sequence or an inverse path."""
    return bool(re.search(r"[\w>][+*](\s|\))|[\w>]/[\w<^]|\^[\w<]", re.sub(r'"[^"]*"', "", query)))


def entropy(p: Column) -> Column:
    """Bits of a distribution given as an array."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0)))


def rollup(results: DataFrame, metrics: list[str], by: str = "difficulty") -> DataFrame:
    """Means that skip nulls, and counts, per value of ``by``."""
    return results.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def bucket(key: Column) -> Column:
    """A stable 0-99 bucket of a key."""
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 4), 16, 10).cast("int") % 100).alias("bucket")
