"""Removal of repeated byte strings by suffixes: a difference cover, then one block of suffix buckets at a time.

A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a document of a smaller doc_id, or earlier in
the same one.  So all suffixes of the corpus are classed by their first ``length`` bytes, and of each class only the first stays.

1. *Copies.*  Texts that equal an earlier document's are settled by a 128-bit hash and take no part.
2. *Slices.*  The others are packed, some megabytes a row, as the unit that exchanges refer to.
3. *Cover ranks.*  Positions whose residue is in a difference cover of period v get a rank, a hash of the
   ``length - v + 1`` bytes that start there.  For any two suffixes some offset under v lies in the cover in both, and in two that tie
   for ``length`` bytes the ranks there are equal.  So a suffix without a shared rank in its first v offsets is alone and is
   never sorted.  Ranks of a slice go to a bucket once each, packed; a bit for each comes back.
4. *Blocks.*  The suffixes that are left belong to buckets by their heads (the first v - 1 bytes).  One block of buckets is exchanged
   at a time, so the exchange takes a fraction of the keys' size, whatever the corpus.  In a bucket suffixes
   are sorted by head, and long ties by the rank of what follows the head; both are one 64-bit word, beside the
   bucket's number.  Again equal suffixes of one slice come once, and bits go back.
5. *Spans.*  A slice's bits are laid over its texts.

Ranks stand for byte order by hashes: equal suffixes need to meet, their order among others does not matter.  Prefix sums give the
rank of any position in constant time, so a long tie needs one rank and no offset that depends on the pair.

Defined cases: a null text is empty; texts under ``length`` bytes lose nothing; a null doc_id comes after all others, and
null doc_ids with an equal text are one document; rows that repeat a doc_id and text are one document, each row with the same result; different texts under
one doc_id come in an order of their hashes; a very long text is a slice of its own, worked on in pieces (about 30 bytes of memory a byte
of it); an empty table gives an empty result; other columns, whatever their names, are not read."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spool import discard, maybe_broadcast, spool
from .textkit import U, mix

LAST = (1 << 63) - 1
#: Difference covers that are perfect: every residue of the period is a difference of two elements, once.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Bytes of a slice and its documents at most; entries of a bucket that one task sorts.
SLICE, SLICE_DOCS, BUCKET = 4 << 20, 20_000, 1_500_000
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20260111))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []


def cover_of(length: int) -> tuple[int, np.ndarray]:
    """The largest period that leaves ranks of about ``length * 3 / 7`` bytes, and its cover."""
    fit = [v for v in COVERS if v * 7 <= length * 4]
    if not fit:
        raise ValueError("strings of at least 13 bytes")
    v = max(fit)
    inside = np.zeros(v, bool)
    inside[list(COVERS[v])] = True
    return v, inside


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(n, b, U), dtype=U)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a piece, and the powers that bring a window's sum to its start."""
    up, down = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=U)]), down


def _windows(raw: np.ndarray, at: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ascending positions by pieces: ``(sums, powers, positions in the piece)``; ``reach`` bytes after each are there."""
    for low in range(0, len(raw), _PIECE):
        a, b = np.searchsorted(at, (low, low + _PIECE))
        if a < b:
            yield *_sums(raw[low : low + _PIECE + reach]), at[a:b] - low


def cover_ranks(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = [np.zeros(0, U)]
    with np.errstate(over="ignore"):
        for s, down, p in _windows(raw, at, width):
            out.append(mix((s[p + width] - s[p]) * down[p]))
    return np.concatenate(out)


def suffix_keys(raw: np.ndarray, at: np.ndarray, head: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix the number that its bucket follows from, by its head, and the word it is sorted by: head and rank of what follows."""
    where, word = [np.zeros(0, U)], [np.zeros(0, U)]
    with np.errstate(over="ignore"):
        for s, down, p in _windows(raw, at, length):
            h = (s[p + head] - s[p]) * down[p]
            rank = mix((s[p + length] - s[p + head]) * down[p + head])
            where.append(mix(h + U(0x2545F491)))
            word.append(mix(mix(h) * U(3) + rank))
    return np.concatenate(where), np.concatenate(word)


class Slice:
    """The documents of a slice: order keys, bounds and bytes."""

    def __init__(self, ids: bytes, sizes: bytes, packed: bytes):
        self.ids = np.frombuffer(ids, np.int64).reshape(-1, 3)  # doc_id, tag, times that the row is there
        self.ends = np.cumsum(np.frombuffer(sizes, np.int64))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        n = int(self.ends[-1]) if len(self.ends) else 0
        self.raw = np.frombuffer(pa.decompress(packed, n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)

    def cover(self, v: int, inside: np.ndarray, width: int) -> np.ndarray:
        """Cover positions with ``width`` bytes of their document after them."""
        parts = [a + np.flatnonzero(np.resize(inside, max(0, e - width + 1 - a))) for a, e in zip(self.starts, self.ends, strict=True)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def first_entries(self, where: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal entries the first in document order: its index, and for every entry whether it is one."""
        order = np.lexsort((word, where))
        w, b = word[order], where[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1])
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        return np.flatnonzero(first), first


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], list] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        nonlocal size
        rows = sorted(held.items())
        held.clear()
        size = 0
        ids = np.array([(*k, n) for k, (_, n) in rows], np.int64)
        texts = [t for _, (t, _) in rows]
        body = b"".join(texts)
        values = [[ids.tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [pa.compress(body, "zstd", asbytes=True)]]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in values] + [pa.array([len(body)], pa.int64())], names=["ids", "sizes", "packed", "n_bytes"])

    for b in batches:
        for doc_id, tag, text in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("text"), strict=True):
            if (doc_id, tag) in held:
                held[doc_id, tag][1] += 1
                continue
            t = text.as_py()
            if held and size + len(t) > SLICE:
                yield packed()
            held[doc_id, tag] = [t, 1]
            size += len(t)
            if len(held) >= SLICE_DOCS:
                yield packed()
    if held:
        yield packed()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Slice]]:
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            yield row, Slice(row["ids"], row["sizes"], row["packed"])


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    numbers, at = np.unique(bucket[order], return_index=True)
    if len(numbers):
        yield from zip(numbers.tolist(), np.split(order, at[1:]), strict=True)


def _rank_rows(s: Slice, v: int, inside: np.ndarray, width: int, buckets: int):
    """Cover positions of a slice with their distinct short ranks: ``(positions, index of each one's rank, ranks, buckets)``.

    Beside the bucket's number 32 bits of a rank are enough: one taken for shared by accident costs a look, never a span."""
    at = s.cover(v, inside, width)
    rank = cover_ranks(s.raw, at, width)
    code = (rank >> U(32)) % U(buckets) << U(32) | rank & U(0xFFFFFFFF)
    value, of, times = np.unique(code, return_inverse=True, return_counts=True)
    return at, of, value, times


def _spread(ones: np.ndarray, before: np.ndarray, after: np.ndarray, n: int) -> np.ndarray:
    """Positions within ``[one - before, one + after)`` of any one."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, ones - before, 1)
    np.add.at(d, np.minimum(ones + after, n), -1)
    return np.cumsum(d[:n]) > 0


def _bits(shared: np.ndarray) -> bytes:
    return np.packbits(shared).tobytes()


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _candidate_suffixes(s: Slice, one_of: np.ndarray, v: int, length: int) -> np.ndarray:
    """Starts of ``length`` bytes of one document with a shared rank among their first v offsets."""
    doc = np.searchsorted(s.ends, one_of, side="right")
    near = _spread(one_of, np.minimum(v - 1, one_of - s.starts[doc]), np.ones(len(one_of), np.int64), len(s.raw))
    fits = np.zeros(len(s.raw) + 1, np.int32)
    last = s.ends - length + 1
    room = last > s.starts
    np.add.at(fits, s.starts[room], 1)
    np.add.at(fits, last[room], -1)
    return near & (np.cumsum(fits[:-1]) > 0)


def _exchange(rows: DataFrame, task, schema: str) -> DataFrame:
    return spool(rows.groupBy("bucket").applyInPandas(task, schema), "bits")


def _release(spark: SparkSession) -> None:
    """Exchanges end with the plans that made them; the driver's collector finds these."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated(docs: DataFrame, length: int = 100, blocks: int = 4, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: the maximal removed runs ``array<struct<start, stop>>`` in bytes, and the bytes left.

    ``bucket`` bounds the entries that one task sorts; ``blocks`` is the number of rounds that the suffixes' exchange is cut into."""
    v, inside = cover_of(length)
    width, head = length - v + 1, v - 1
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text.alias("text")).withColumn("same", F.unhex(F.md5("text")))
    twice = d.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    d = d.join(maybe_broadcast(spool(twice, "copied")), "same", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    run = "array<struct<start: long, stop: long>>"
    size = F.octet_length("text").cast("long")
    whole = F.when(size >= length, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop")))).otherwise(F.array().cast(run))
    copies = d.where("copy").select("doc_id", size.alias("n_bytes"), whole.cast(run).alias("spans"), F.when(size < length, F.col("text")).otherwise(F.lit(b"")).alias("kept"))

    tag = F.conv(F.substring(F.hex("same"), 1, 15), 16, 10).cast("long")
    slices = d.where("not copy").select("doc_id", tag.alias("tag"), "text").mapInArrow(_slices, "ids binary, sizes binary, packed binary, n_bytes long")
    slices = spool(slices.withColumn("slice", F.monotonically_increasing_id()), "slices", "zstd")
    total = slices.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 + int(total * inside.sum() / v) // (2 * bucket)

    def ranks(batches):
        for row, s in _opened(batches):
            _, _, value, _ = _rank_rows(s, v, inside, width, buckets)
            b, short = (value >> U(32)).astype(np.int64), value.astype(np.uint32)
            numbers, at = np.unique(b, return_index=True)
            packed = [x.tobytes() for x in np.split(short, at[1:])] if len(numbers) else []
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), row["slice"], np.int64)), pa.array(numbers), pa.array(packed, pa.binary())], names=["slice", "bucket", "entries"])

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        entries = [np.frombuffer(e, np.uint32) for e in rows["entries"]]
        every = np.concatenate(entries)
        order = np.argsort(every)
        x = every[order]
        tie = x[1:] == x[:-1]
        shared = np.zeros(len(x), bool)
        shared[order[1:]] |= tie
        shared[order[:-1]] |= tie
        parts = np.split(shared, np.cumsum([len(e) for e in entries])[:-1])
        return pd.DataFrame({"slice": rows["slice"], "bucket": rows["bucket"], "bits": [_bits(p) for p in parts]})

    marks = _exchange(slices.mapInArrow(ranks, "slice long, bucket long, entries binary"), share, "slice long, bucket long, bits binary")
    gathered = lambda m: m.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("marks"))

    def candidates(batches):
        for row, s in _opened(batches):
            at, of, value, times = _rank_rows(s, v, inside, width, buckets)
            shared = times > 1
            numbers, counts = np.unique((value >> U(32)).astype(np.int64), return_counts=True)
            begin = dict(zip(numbers.tolist(), (np.cumsum(counts) - counts).tolist(), strict=True))
            many = dict(zip(numbers.tolist(), counts.tolist(), strict=True))
            for m in row["marks"] or ():
                a, n = begin[m["bucket"]], many[m["bucket"]]
                shared[a : a + n] |= _unbits(m["bits"], n)
            some = _candidate_suffixes(s, at[shared[of]], v, length)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], some.view(np.int8), [0]])))
            yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int64()), *(pa.array([row[c]], pa.binary()) for c in ("ids", "sizes", "packed")), pa.array([edges.astype(np.int64).tobytes()], pa.binary()), pa.array([int(some.sum())], pa.int64())], names=["slice", "ids", "sizes", "packed", "edges", "n_suffixes"])

    kept = slices.join(gathered(marks), "slice", "left").select("slice", "ids", "sizes", "packed", "marks")
    live = spool(kept.mapInArrow(candidates, "slice long, ids binary, sizes binary, packed binary, edges binary, n_suffixes long"), "suffixes", "zstd")
    suffixes = live.agg(F.sum("n_suffixes")).first()[0] or 0
    discard(slices, marks)
    del slices, marks, kept
    _release(spark)
    each = 1 + suffixes // (blocks * bucket)  # buckets of a block

    def starts(edges: bytes) -> np.ndarray:
        runs = np.frombuffer(edges, np.int64).reshape(-1, 2)
        n = runs[:, 1] - runs[:, 0]
        return np.repeat(runs[:, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def of_block(s: Slice, edges: bytes, block: int | None):
        """Suffixes of a block of buckets (all of them: None): ``(positions, entries that come first, buckets of these, words)``."""
        at = starts(edges)
        where, word = suffix_keys(s.raw, at, head, length)
        number = where % U(each * blocks)
        if block is not None:
            mine = number // U(each) == U(block)
            at, number, word = at[mine], number[mine], word[mine]
        index, first = s.first_entries(number, word)
        return at, first, index, number[index].astype(np.int64), word[index]

    def entries(block: int):
        def run_(batches):
            for row, s in _opened(batches):
                at, _, index, number, word = of_block(s, row["edges"], block)
                doc = np.searchsorted(s.ends, at[index], side="right")
                for b, own in _by_bucket(number):
                    some, n = np.unique(doc[own], return_counts=True)
                    owner = np.concatenate([s.ids[some, :2], n[:, None]], 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row["slice"], b)] + [pa.array([x.tobytes()], pa.binary()) for x in (word[own], owner)], names=["slice", "bucket", "entries", "owners"])

        return run_

    def later(rows: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(e, U) for e in rows["entries"]]
        owner = np.concatenate([np.frombuffer(o, np.int64).reshape(-1, 3) for o in rows["owners"]])
        # places in the order of (doc_id, tag): equal pairs share one
        by = np.lexsort((owner[:, 1], owner[:, 0]))
        o = owner[by, :2]
        place = np.empty(len(by), np.int64)
        place[by] = np.concatenate([[0], np.cumsum((o[1:] != o[:-1]).any(1))])
        doc = np.repeat(place, owner[:, 2])
        every = np.concatenate(words)
        order = np.lexsort((doc, every))
        w, p = every[order], doc[order]
        new = np.concatenate([[True], w[1:] != w[:-1]])
        first = p[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.zeros(len(w), bool)
        gone[order] = p > first
        parts = np.split(gone, np.cumsum([len(x) for x in words])[:-1])
        return pd.DataFrame({"slice": rows["slice"], "bucket": rows["bucket"], "bits": [_bits(x) for x in parts]})

    found = []
    for block in range(blocks if suffixes else 0):
        found.append(_exchange(live.mapInArrow(entries(block), "slice long, bucket long, entries binary, owners binary"), later, "slice long, bucket long, bits binary"))
        _release(spark)

    def spans(batches):
        for row, s in _opened(batches):
            at, first, index, number, _ = of_block(s, row["edges"], None)
            goes = ~first
            bits = {m["bucket"]: m["bits"] for m in row["marks"] or ()}
            for b, own in _by_bucket(number):
                goes[index[own]] = _unbits(bits[b], len(own))
            gone = _spread(at[goes], np.zeros(int(goes.sum()), np.int64), np.full(int(goes.sum()), length), len(s.raw))
            out = []
            for (doc_id, _, times), a, e in zip(s.ids.tolist(), s.starts, s.ends, strict=True):
                mask = gone[a:e]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                one = (doc_id, int(e - a), [{"start": x, "stop": y} for x, y in edges], s.raw[a:e][~mask].tobytes())
                out += [one] * times
            for lo in range(0, len(out), 256):
                cols = list(zip(*out[lo : lo + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])

    last = live.select("slice", "ids", "sizes", "packed", "edges")
    if found:
        every = found[0]
        for m in found[1:]:
            every = every.unionByName(m)
        last = last.join(gathered(every), "slice", "left")
    else:
        last = last.withColumn("marks", F.lit(None).cast("array<struct<bucket: long, bits: binary>>"))
    rest = last.mapInArrow(spans, f"doc_id long, n_bytes long, spans {run}, kept binary")
    return rest.unionByName(copies).withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
