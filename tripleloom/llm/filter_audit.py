"""How five text filters interact: every order of them, audited from one pass over the texts.

A document's failures are five bits, and a precomputed table of 32 masks by 120 orders says at which step each order
removes it.  So an order is never run: tasks count masks, look the steps up and add arrays; partial sums meet by part.

1. *Facts.*  One pass over the texts makes four bits and a 128-bit hash of the text; from there on rows are narrow.
2. *Copies* (filter E).  Rows meet by doc_id, where they get their labels, then by hash, already counted by part and label, so
   that a text that a third of all rows hold brings a row for each part and label of a task.
3. *First failure.*  ``mapInArrow`` sums the rows of a part by mask and label, indexes the table and adds up removals by
   order and step with ``np.bincount``; Spark sums the arrays' cells over tasks.

Defined cases: a null text is empty (fails A only, unless a smaller doc_id is empty too); a null source is part ``''``; a row with a
null doc_id has no label and neither fails E nor makes another row fail it; rows that repeat a doc_id are counted one by one, and
equal texts under one doc_id do not fail E against each other; a document with several label rows is good (toxic) if any says so;
a very long text is read in pieces; an empty table gives no rows; other columns, whatever their names, are not read."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spool import maybe_broadcast, spool

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: A document fails A under so many words, B under so many hundredths of distinct words, C over so many hundredths of capitals, D with any of these.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
_SPACE = re.compile(rb"[ \t-\r]")
_SIGN = re.compile(rb"[" + re.escape(SIGNS) + rb"]")
_UPPER = bytes(range(65, 91))
_STEP = 1 << 20
#: Parts whose counts a task holds at once.
_PARTS = 1024
_LABELS = 4  # neither, good, toxic, both
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def first_failures() -> np.ndarray:
    """``[mask, order]``: the step, from 0, at which the order removes a document with these failures; 5 where it stays."""
    bit = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(1 << len(FILTERS))[:, None, None] & bit) > 0
    return np.where(fails.any(2), fails.argmax(2), len(FILTERS))


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; a long text is split in pieces that end at a separator."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        border = _SPACE.search(text, at + _STEP)
        end = border.start() if border else len(text)
        words = text[at:end].split()  # of bytes: at the six ASCII separators only
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_mask(text: bytes) -> int:
    """The failures of filters A to D as bits 0 to 3."""
    n, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.decode())
    return (n < LEAST_WORDS) | (100 * distinct < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * points) << 2 | (_SIGN.search(text) is not None) << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() for t in b.column("text")]
        mask = pa.array([text_mask(t) for t in texts], pa.int32())
        same = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), mask, same], names=["doc_id", "part", "mask", "same"])


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = first_failures()
    steps = len(FILTERS)
    cells = np.arange(len(ORDERS))[None, :] * (steps + 1) + table
    letter = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    masks = np.arange(len(table))
    held: dict[str, np.ndarray] = {}

    def arrays() -> pa.RecordBatch:
        made = {k: [] for k in _COUNTS}
        for counts in held.values():
            by_label = counts.reshape(len(table), _LABELS)
            every = by_label.sum(1)
            lost = [np.bincount(cells.ravel(), np.repeat(w, len(ORDERS)), len(ORDERS) * (steps + 1)).reshape(len(ORDERS), steps + 1)[:, :steps] for w in (every, by_label[:, [1, 3]].sum(1), by_label[:, 2:].sum(1))]
            failing = np.array([every[(masks >> f) & 1 == 1].sum() for f in range(steps)])
            alone = np.array([every[1 << f] for f in range(steps)])
            made["kept"].append(every.sum() - np.cumsum(lost[0], 1))
            made["removed"].append(lost[0])
            made["redundant"].append(failing[letter] - lost[0])
            made["unique_fails"].append(alone[letter])
            made["good_lost"].append(lost[1])
            made["toxic_lost"].append(lost[2])
        size = len(ORDERS) * steps
        part = pa.array(np.repeat(np.array(list(held), object), size), pa.string())
        cell = pa.array(np.tile(np.arange(size, dtype=np.int32), len(held)))
        held.clear()
        return pa.RecordBatch.from_arrays([part, cell, *(pa.array(np.concatenate([x.ravel() for x in made[k]]).astype(np.int64)) for k in _COUNTS)], names=["part", "cell", *_COUNTS])

    for b in batches:
        parts = b.column("part").dictionary_encode()
        at = parts.indices.to_numpy() * (len(table) * _LABELS) + b.column("mask").to_numpy() * _LABELS + b.column("label").to_numpy()
        counts = np.bincount(at, b.column("n").to_numpy(), len(parts.dictionary) * len(table) * _LABELS)
        for part, own in zip(parts.dictionary.to_pylist(), counts.reshape(len(parts.dictionary), -1), strict=True):
            held[part] = held[part] + own if part in held else own
            if len(held) >= _PARTS:
                yield arrays()
    if held:
        yield arrays()


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, label, n``: documents counted by their five failures and labels (1 good, 2 toxic, 3 both)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = spool(d.mapInArrow(_facts, "doc_id long, part string, mask int, same binary"), "facts")
    said = lambda c: F.max(F.coalesce((F.col(c).cast("double") == 1).cast("int"), F.lit(0)))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((said("quality") + 2 * said("toxic")).alias("label")).where("doc_id is not null and label > 0")
    known = facts.where("doc_id is not null").join(maybe_broadcast(marked), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    each = known.groupBy("doc_id", "same", "part", "mask", "label").agg(F.count("*").alias("n"))
    some = each.groupBy("same", "part", "mask", "label").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))
    some = some.withColumn("firsts", F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    some = some.select("part", "label", F.explode(split).alias("m")).select("part", "m.mask", "label", "m.n")
    nameless = facts.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n"))
    return some.unionByName(nameless.withColumn("label", F.lit(0))).where("n > 0")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, filter_order, step`` with the counts of `_COUNTS` and ``shapley``, 600 rows for each part."""
    schema = "part string, cell int, " + ", ".join(f"{k} long" for k in _COUNTS)
    sums = masks(docs, labels, part).mapInArrow(_removals, schema).groupBy("part", "cell").agg(*(F.sum(k).alias(k) for k in _COUNTS))
    steps = len(FILTERS)
    order: Column = F.element_at(F.array(*map(F.lit, ORDERS)), F.floor(F.col("cell") / steps).cast("int") + 1)
    out = sums.withColumn("filter_order", order).withColumn("step", F.col("cell") % steps + 1).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    return out.select("part", "filter_order", "step", *_COUNTS, "shapley")
