"""Spelling variants: each word's most frequent neighbour at one edit, found without materialising pairs.

1. *Words.*  Each task counts the letter runs of its texts; counts meet by word.  Words in code-point order get ascending
   ids, which from there on stand for them in ties.
2. *Wildcard groups.*  A word is in one group for each of its positions, (position, prefix, suffix); the others in it are one
   replacement away, and nowhere else.  A group is as large as the alphabet at most; its size and its two most frequent words
   tell each member how many neighbours it has there and which is the most frequent.
3. *Deletions.*  A word less one character meets the vocabulary: the whole word of a group is one insertion from each
   member, and each member has that word as a neighbour.
4. *Forms.*  The best of all groups is the word's form if it is frequent enough.  Roots follow by pointer doubling; a form is
   several times as frequent as its word, so chains are short and have no cycles.

Groups meet by 128-bit keys made of prefix sums, so a word of L characters costs O(L) rows of fixed size, however long it is.

Defined cases: a null text has no words, a null doc_id counts as ``''`` where runs are altered; repeated rows count each time;
a very long text is read in pieces that end outside words; ties go to the smaller word in code-point order; an empty table, or one
without frequent words, gives an empty result; other columns, whatever their names, are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spool import spool
from .textkit import U, mix

_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_OTHER = re.compile("[^a-zÀ-ÿ]")
_STEP = 1 << 20
#: Distinct words that a task counts before it passes them on, and code points of a slice of the vocabulary.
_HELD, _SLICE = 200_000, 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def altered(doc_id: int | None, runs: Counter, every: int, least: int) -> Iterator[tuple[str, int]]:
    """The runs of a document with their counts, where ``every``-th by hash has lost one character."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= least:
            yield run, n


def word_table(docs: DataFrame, every: int, least: int) -> DataFrame:
    """``word, n`` over all texts, words of at least ``least`` code points."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least)  # shorter runs make no word, and longer ones match whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t = text.as_py().translate(_LOWER).decode()
                runs: Counter = Counter()
                at = 0
                while at < len(t):
                    border = _OTHER.search(t, at + _STEP)
                    end = border.start() if border else len(t)
                    runs.update(run.findall(t, at, end))
                    at = end
                for word, n in altered(doc_id, runs, every, least):
                    held[word] += n
                if len(held) >= _HELD:
                    yield rows()
        if held:
            yield rows()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    return d.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """``(word, kind, key, key)`` of every group: kind 0 a wildcard at one position, 1 less one character, 2 the whole word.

    Kinds 1 and 2 have one key where their characters are the same; equal variants of one word come once."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(U)
    first = np.concatenate([[0], np.cumsum(size)])
    a, b = first[:-1], first[1:]
    of = np.repeat(np.arange(len(words)), size)
    i = np.arange(len(chars))
    fresh = np.ones(len(chars), bool)
    fresh[1:] = (chars[1:] != chars[:-1]) | (of[1:] != of[:-1])
    place, length = (i - a[of]).astype(U), size[of].astype(U)
    keys = []
    with np.errstate(over="ignore"):
        for base in _BASES:
            up = np.concatenate([np.ones(1, U), np.cumprod(np.full(len(chars), base, U), dtype=U)])
            back = pow(base, -1, 1 << 64)
            down = np.concatenate([np.ones(1, U), np.cumprod(np.full(len(chars), back, U), dtype=U)])
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(chars + U(base & 0xFFFF)) * up[:-1], dtype=U)])
            head, tail = (sums[i] - sums[a[of]]) * down[a[of]], (sums[b[of]] - sums[i + 1]) * down[a[of]]
            wild = mix(mix(head + tail) + mix(place * U(2) + U(1)) * U(3) + mix(length))
            less = mix(head + tail * U(back) + mix(length - U(1)))
            whole = mix((sums[b] - sums[a]) * down[a] + mix(size.astype(U)))
            keys.append(np.concatenate([wild, less[fresh], whole]).view(np.int64))
    word = np.concatenate([of, of[fresh], np.arange(len(words))])
    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(of), int(fresh.sum()), len(words)])
    return word, kind, *keys


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, ids, counts = b.column("word").to_pylist(), b.column("id").to_numpy(), b.column("n").to_numpy()
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= _SLICE):
                size += len(words[end])
                end += 1
            word, kind, k1, k2 = _keys(words[at:end])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, kind, ids[at:end][word], counts[at:end][word])], names=["k1", "k2", "kind", "id", "n"])
            at = end


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``id, n_near, best`` of ``vocabulary(id, word, n)``: words with a neighbour, how many, and the best as ``(n, -id)``."""
    rows = vocabulary.mapInArrow(_groups, "k1 long, k2 long, kind byte, id long, n long")
    group = Window.partitionBy("k1", "k2")
    ranked = group.orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    who = F.struct("n", (-F.col("id")).alias("neg"))
    g = rows.withColumns({"size": F.count("*").over(ranked), "top": F.first(who).over(ranked), "second": F.nth_value(who, 2).over(ranked), "whole": F.max(F.when(F.col("kind") == 2, who)).over(ranked)})
    g = g.where("size > 1 and (kind <> 1 or whole is not null)")
    other = F.when(F.col("top.neg") == -F.col("id"), F.col("second")).otherwise(F.col("top"))
    shared = F.col("kind") == 1
    g = g.select("id", F.when(shared, 1).otherwise(F.col("size") - 1).alias("near"), F.when(shared, F.col("whole")).otherwise(other).alias("best"))
    return g.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` of ``forms(id, form)``, links without cycles: pointers double until none moves."""
    now = spool(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = spool(now.join(then, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, every: int = 199, least: int = 6, occurrences: int = 5, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of at least ``least`` code points and ``occurrences``.

    ``form`` is the most frequent word at one edit if it occurs ``ratio`` times as often; every ``every``-th run of a document, by
    hash, loses a character before counting."""
    words = spool(word_table(docs, every, least).where(F.col("n") >= occurrences), "words")
    # sorted partitions are in order of their numbers, so the ids ascend with the words
    vocabulary = spool(words.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = neighbours(vocabulary)
    v = vocabulary.join(near, "id", "left").withColumn("form", F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.neg")))
    v = spool(v.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best.n")).alias("form_n")), "forms")
    linked = v.where("form is not null")
    named = vocabulary.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    named_root = vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    far = linked.join(roots(linked), "id").join(named, "form").join(named_root, "root")
    far = far.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = v.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return far.unionByName(alone)
