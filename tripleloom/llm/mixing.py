"""Mixing sources to target weights by iterative proportional fitting.

Built-in functions only.  Token totals per cell (source, language, topic) are raked to target shares
of the three marginals; a document is then kept with its cell's calibrated probability, decided by a hash
of its id, so reruns and lost executors decide alike.

Only the cells move: one aggregation (partial before the shuffle), then the fit over the cell table,
whose size is the number of combinations, not of documents.  Every step of the fit needs the whole
marginal, so the table sits in one partition (windows over it need no exchange).

Targets: a mapping of shares per dimension, or a number: the temperature, by which a value's share is
its token total to that power.  Values without a mapped share keep their natural share of what is left; shares are scaled to 1.
Where the mapped shares leave nothing, values without one (null among them) keep their natural share of all tokens and the mapped ones part the rest.

Where no value of a dimension has a target share, the natural shares stand.  A probability is the raked weight over the natural weight, scaled so that the largest is ``rate``; so
the expected token shares of the sample are the raked ones.

Defined cases: null source, language or topic is a value of its own (``''``); null and empty texts have no
tokens, count nothing and are kept with their cell's probability (1 where the cell has no tokens); a null
id is drawn as if it were -1; repeated rows of one id are drawn alike; a very long text counts all its words; cells of equal weight
are scaled alike; an empty table gives an empty result; extra columns, whatever their names, are kept by ``sample``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spool import maybe_broadcast, spool

DIMS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """White-space separated words of a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (F.size(F.split(F.concat(F.lit("x "), t), r"[\x20\x09-\x0D]+")) - F.when(t.rlike(r"(^|[\x20\x09-\x0D])$"), 2).otherwise(1)).cast("long")


def topic_of(text: Column) -> Column:
    """A stand-in for a topic column: the form of the text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.instr(t, " | ") > 0, "table").when(F.length(t) < 1000, "short").when(F.length(t) < 4000, "medium").otherwise("long")


def draw(doc_id: Column, salt: str = "mix") -> Column:
    """A number in [0, 1) fixed by the id: the first 32 bits of an MD5."""
    key = F.concat(F.coalesce(doc_id.cast("long"), F.lit(-1)).cast("string"), F.lit(":" + salt))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _target(cells: DataFrame, dim: str, want: Mapping[str, float] | float) -> DataFrame:
    """Adds ``t_<dim>``, the target share of the row's value."""
    own = Window.partitionBy(dim)
    everything = Window.partitionBy()
    cells = cells.withColumn("_n", F.sum("n_tokens").over(own)).withColumn("_first", F.row_number().over(own.orderBy(*DIMS)) == 1)
    if isinstance(want, Mapping):
        share = F.lit(None).cast("double")
        for value, w in want.items():
            share = F.when(F.col(dim) == value, float(w)).otherwise(share)
        left = max(0.0, 1.0 - float(sum(want.values())))
        cells = cells.withColumn("_w", share)
        rest = F.sum(F.when(F.col("_w").isNull() & F.col("_first"), F.col("_n"))).over(everything)
        if left > 1e-9:
            cells = cells.withColumn("_w", F.coalesce("_w", F.try_divide(F.lit(left) * F.col("_n"), rest)))
        else:
            listed = F.sum(F.when(F.col("_first"), F.col("_w"))).over(everything)
            cells = cells.withColumns({"_listed": listed, "_others": F.sum("n_tokens").over(everything) - rest})
            cells = cells.withColumn("_w", F.coalesce("_w", F.try_divide(F.col("_listed") * F.col("_n"), F.col("_others")))).drop("_listed", "_others")
    else:
        cells = cells.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(float(want))))
    total = F.sum(F.when(F.col("_first"), F.col("_w"))).over(everything)
    natural = F.col("_n") / F.sum("n_tokens").over(everything)
    return cells.withColumn(f"t_{dim}", F.when(total > 0, F.try_divide(F.col("_w"), total)).otherwise(natural)).drop("_n", "_first", "_w")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rounds: int = 12, rate: float = 1.0) -> DataFrame:
    """``source, lang, topic, n_docs, n_tokens, weight, p, residual`` of every cell.

    ``weight`` is the raked share of the tokens after ``rounds`` passes over the three marginals, ``residual`` (the same in
    every row) the largest distance of a marginal's share from its target that is left."""
    c = spool(cells.where("n_tokens > 0").coalesce(1), "cells")
    c = c.coalesce(1)
    for dim in DIMS:
        c = _target(c, dim, targets.get(dim, 1.0))
    everything = Window.partitionBy()
    c = c.withColumn("natural", F.col("n_tokens") / F.sum("n_tokens").over(everything)).withColumn("weight", F.col("natural"))
    for _ in range(rounds):
        for dim in DIMS:
            c = c.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"t_{dim}"), F.sum("weight").over(Window.partitionBy(dim))), F.lit(0.0)))
    # how far the shares of the raked weights are from their targets, at most
    off = F.greatest(*[F.abs(F.sum("weight").over(Window.partitionBy(dim)) - F.col(f"t_{dim}")) for dim in DIMS])
    c = c.withColumn("_off", off).withColumn("residual", F.max("_off").over(everything)).withColumn("_r", F.col("weight") / F.col("natural"))
    return c.select(*DIMS, "n_docs", "n_tokens", "weight", (F.col("_r") / F.max("_r").over(everything) * F.lit(float(rate))).alias("p"), "residual")


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``row`` (the input row as a struct, so that no name clashes), ``source, lang, topic`` and ``n_tokens``."""
    topic = topic_of(F.col("text")) if topic is None else topic
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), value(F.col("source")).alias("source"), value(F.col("lang")).alias("lang"), value(topic).alias("topic"), tokens(F.col("text")).alias("n_tokens"))


def fit(counted: DataFrame, targets: Mapping, **options) -> DataFrame:
    """Raked cells of ``counted(source, lang, topic, n_tokens)``."""
    cells = counted.groupBy(*DIMS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return spool(rake(cells, targets, **options), "raked")


def calibrate(docs: DataFrame, targets: Mapping, topic: Column | None = None, **options) -> DataFrame:
    """Raked cells of ``docs``."""
    return fit(with_cells(docs, topic).select(*DIMS, "n_tokens"), targets, **options)


def _drawn(rows: DataFrame, cells: DataFrame, doc_id: str) -> DataFrame:
    cells = maybe_broadcast(cells.select(*DIMS, "p"))
    d = rows.join(cells, list(DIMS), "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    return d.withColumn("kept", draw(F.col(doc_id)) < F.col("p"))


def decide(docs: DataFrame, targets: Mapping, topic: Column | None = None, **options) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, p, kept`` of every row; texts are read once and no document is shuffled while the cells are few."""
    d = spool(with_cells(docs, topic).select("row.doc_id", *DIMS, "n_tokens"), "counted")
    return _drawn(d, fit(d, targets, **options), "doc_id").select("doc_id", *DIMS, "n_tokens", "p", "kept")


def sample(docs: DataFrame, targets: Mapping, topic: Column | None = None, **options) -> DataFrame:
    """The drawn documents, columns as they are."""
    return _drawn(with_cells(docs, topic), calibrate(docs, targets, topic, **options), "row.doc_id").where("kept").select("row.*")
