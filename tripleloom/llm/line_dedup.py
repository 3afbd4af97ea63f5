"""Near-duplicate line removal by a deletion-neighbourhood join.

Two lines are near when they are equal or one character inserted, deleted or replaced turns one into the
other.  A line goes when any earlier line of the corpus, by (doc_id, line number), is near it; that
does not depend on whether the earlier one stays itself, so the decision is a join and not a chain.

1. *Equal lines* meet by a 128-bit hash, aggregated before the shuffle: only the earliest place is left.
2. *Sieve, without loss.*  A line of more than 16 characters is cut into parts (4; more for very long lines).  One edit
   leaves all parts but one, so near lines share a key of "everything but part j".  Only lines that share one with a
   different line go on, each with the middle that the key leaves out, read from its first place.  Lines of up to 16
   characters need no sieve: they go on whole, as the middle of a key of their own.
3. *Deletion neighbourhoods* of the middles, as hashed keys.  Lines with the same middle less character p
   are one replacement apart; a line whose middle less one character is another's whole middle is one insertion
   apart.  Each line of a key meets the key's earliest line: a star for each key, no
   pairs within a key.
4. The edit distance of each line's middle and that of the earlier line that it met is verified on the characters; what a key
   leaves outside the middle is equal by a 64-bit hash, equal lines by a 128-bit one.

Blank lines are layout rather than content and always stay; so do lines under ``min_chars`` characters (by default there are
none such: all others are compared).

Defined cases: a null text stays null and has no lines; null doc_ids come after all others, among them the texts in the order of their hashes;
rows that repeat a doc_id with an equal text are one document (each row gets the same result), with different texts
their lines at one place count as earlier by text; a very long line is cut into more parts and compared whole; an empty table gives an empty result; extra columns,
whatever their names, are kept by ``dedup_lines``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spool import maybe_broadcast, spool
from .textkit import U, mix

GRAIN, PARTS, LONG, LONG_PART = 16, 4, 2048, 512
_STEP = 1 << 20
LAST = (1 << 63) - 1
#: A line of nothing else is blank.
BLANKS = " \t\x0b\x0c\r"
#: Counted lines of the sieve's outcome (64 bytes each) that are broadcast at most; beyond it the join shuffles.
WANTED_ROWS = 250_000


def _odd_inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS or len(_POWERS[0][0]) <= n:
        _POWERS[:] = [tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(n + 1, b, U), dtype=U)]) for b in (base, _odd_inverse(base))) for base in _BASES]
    return _POWERS


def parts_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a shorter length ``m``: the rounded length and the number of parts, none under GRAIN."""
    q = m - m % GRAIN
    return q, np.where(q < LONG, np.where(q < GRAIN, 0, PARTS), q // LONG_PART)


def line_table(texts: list[str | None], min_chars: int) -> dict[str, np.ndarray | list]:
    """Of the lines of at least ``min_chars`` characters that are not blank: text row, line number, bounds, two hashes,
    and the sieve keys with their line, rounded length and part."""
    rows, numbers, joined, start = [], [], [], []
    at = 0
    for r, t in enumerate(texts):
        for n, line in enumerate(t.split("\n") if t else ()):
            if len(line) >= min_chars and line.strip(BLANKS):
                rows.append(r)
                numbers.append(n)
                joined.append(line)
                start.append(at)
                at += len(line)
    a = np.array(start, np.int64)
    b = np.append(a[1:], at) if len(a) else a
    chars = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    with np.errstate(over="ignore"):
        value = mix(chars + U(0x51ED27))
        tables = [(np.concatenate([np.zeros(1, U), np.cumsum(value * up[: len(value)], dtype=U)]), down) for up, down in _powers(len(value) + 1)]
        cut = lambda k, x, y: (tables[k][0][y] - tables[k][0][x]) * tables[k][1][x]
        size = b - a
        h1, h2 = mix(cut(0, a, b) + size.astype(U)), mix(cut(1, a, b) + size.astype(U))
        key, of, code = [], [], []
        q0, g0 = parts_of(size)
        q1, g1 = parts_of(size - 1)
        line = np.arange(len(a))
        for q, g, ok in ((q0, g0, np.ones(len(a), bool)), (q1, g1, (q1 != q0))):
            i = np.repeat(line[ok], g[ok])
            j = np.arange(len(i)) - np.repeat(np.cumsum(g[ok]) - g[ok], g[ok])
            qq, gg = q[i], g[i]
            left, right = j * qq // gg, qq - (j + 1) * qq // gg
            head, tail = cut(0, a[i], a[i] + left), cut(0, b[i] - right, b[i])
            key.append(mix(mix(head + left.astype(U)) * U(3) + mix(tail) + mix((qq * 8191 + j).astype(U))))
            of.append(i)
            code.append(np.stack([left, right], 1))
    return {"row": np.array(rows, np.int64), "number": np.array(numbers, np.int64), "text": joined, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "key": np.concatenate(key).view(np.int64), "of": np.concatenate(of), "cut": np.concatenate(code)}


def _tables(batches: Iterator[pa.RecordBatch], min_chars: int):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < _STEP):
                size += len(texts[end] or "")
                end += 1
            yield ids[at:end], tags[at:end], line_table(texts[at:end], min_chars)
            at = end


def _key_lists(t: dict) -> pa.ListArray:
    """Per line its sieve keys with what each leaves of the line on both sides."""
    order = np.argsort(t["of"], kind="stable")
    left, right = t["cut"][order].T.astype(np.int32)
    keys = pa.StructArray.from_arrays([pa.array(t["key"][order]), pa.array(left), pa.array(right)], names=["key", "left", "right"])
    ends = np.cumsum(np.bincount(t["of"], minlength=len(t["row"])))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), keys)


def staying_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``doc_id, tag, kept``: per document with long enough lines the numbers of those that stay (null doc_id: 2^63 - 1; ``tag``: the text's hash)."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    d = d.select("doc_id", F.xxhash64("text").alias("tag"), "text")

    def lines(batches):
        for ids, tags, t in _tables(batches, min_chars):
            columns = [pa.array(v) for v in (t["h1"], t["h2"], ids[t["row"]], t["number"], tags[t["row"]])]
            brief = pa.array([line if len(line) <= GRAIN else None for line in t["text"]], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, brief, _key_lists(t)], names=["h1", "h2", "doc_id", "number", "tag", "brief", "keys"])

    # the keys of equal lines are equal, so each line's first place is enough from here on
    first = d.mapInArrow(lines, "h1 long, h2 long, doc_id long, number long, tag long, brief string, keys array<struct<key: long, left: int, right: int>>")
    first = first.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "number", "tag")).alias("p"), F.first("brief").alias("brief"), F.first("keys").alias("keys"))
    first = spool(first.select("h1", "h2", F.struct("p.doc_id", "p.number").alias("at"), "p.tag", "brief", "keys"), "first_lines")
    shared = first.select("h1", F.explode("keys.key").alias("key")).groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key")
    shared = maybe_broadcast(spool(shared, "shared_keys"))
    wanted = first.select("h1", "h2", "at", "tag", F.inline("keys")).join(shared, "key", "left_semi")
    wanted = spool(wanted.select(F.col("at.doc_id").alias("doc_id"), "tag", F.col("at.number").alias("number"), "h1", "h2", "key", "left", "right"), "wanted_lines")
    n = wanted.count()
    source = d.select("doc_id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("number", "line")).where(F.length("line") >= min_chars).withColumn("number", F.col("number").cast("long"))
    met = source.join(F.broadcast(wanted) if n <= WANTED_ROWS else wanted, ["doc_id", "tag", "number"])
    met = met.select("key", "h1", "h2", F.struct("doc_id", "number").alias("at"), F.expr("substring(line, left + 1, length(line) - left - right)").alias("middle"))
    # rows that repeat a document bring its lines again
    met = met.groupBy("key", "h1", "h2").agg(F.min("at").alias("at"), F.min("middle").alias("middle"))
    short = first.where("brief is not null").select(F.lit(0).cast("long").alias("key"), "h1", "h2", "at", F.col("brief").alias("middle"))
    met = spool(met.unionByName(short), "middles")

    spot = F.sequence(F.lit(1), F.length("middle"))
    less = lambda p: F.concat(F.substring("middle", F.lit(1), p - 1), F.substring("middle", p + 1, F.length("middle")))
    near = met.where("length(middle) > 0")
    who = F.struct("at", "h1", "h2")
    # rows of one variant are different lines, so they are at most as many as characters exist (times the places of one more)
    same = Window.partitionBy("v")
    met_with = lambda early: ["key", "h1", "h2", early["h1"].alias("o1"), early["h2"].alias("o2")]
    # one replacement: the same middle less the character at the same place
    swap = near.select("key", "h1", "h2", "at", F.explode(F.transform(spot, lambda p: F.xxhash64("key", F.lit("swap"), p, less(p)))).alias("v"))
    swaps = swap.withColumn("early", F.min(who).over(same)).where("early.at < at").select(met_with(F.col("early")))
    # one insertion: a whole middle against the others' middles less one character
    whole = met.select("key", "h1", "h2", "at", F.xxhash64("key", F.lit("drop"), F.col("middle")).alias("v"), F.lit(True).alias("whole"))
    drop = near.select("key", "h1", "h2", "at", F.explode(F.array_distinct(F.transform(spot, lambda p: F.xxhash64("key", F.lit("drop"), less(p))))).alias("v"), F.lit(False).alias("whole"))
    both = whole.unionByName(drop).withColumns({"w": F.min(F.when(F.col("whole"), who)).over(same), "o": F.min(F.when(~F.col("whole"), who)).over(same)})
    drops = both.withColumn("early", F.when(F.col("whole"), F.col("o")).otherwise(F.col("w"))).where("early.at < at").select(met_with(F.col("early")))
    pairs = swaps.unionByName(drops).distinct()
    text = met.select("key", "h1", "h2", "middle")
    other = met.select("key", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("middle").alias("m2"))
    near_ones = pairs.join(text, ["key", "h1", "h2"]).join(other, ["key", "o1", "o2"]).where(F.levenshtein("middle", "m2", 1).between(0, 1))
    gone = maybe_broadcast(spool(near_ones.select("h1", "h2").distinct(), "near_lines"))
    stay = first.select("h1", "h2", "at", "tag").join(gone, ["h1", "h2"], "left_anti")
    return stay.groupBy(F.col("at.doc_id").alias("doc_id"), "tag").agg(F.collect_list("at.number").alias("kept"))


def decide_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``row`` (the input row as a struct, so that no name clashes), ``text`` without the lines that go, ``n_lines, n_kept``."""
    keep = staying_lines(docs, min_chars).withColumnRenamed("doc_id", "key")
    text = F.col("text").cast("string")
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text).alias("tag"))
    text = F.col("row.text").cast("string")
    d = d.join(keep, ["key", "tag"], "left").select("row", "kept", F.split(text, "\n", -1).alias("lines"), (F.coalesce(text, F.lit("")) == "").alias("blank"))
    # numbers of the lines that always stay, merged with the others; no line is searched for
    places = F.transform("lines", lambda line, n: F.when((F.length(line) < min_chars) | (F.trim(line, F.lit(BLANKS)) == ""), n.cast("long")))
    numbers = F.sort_array(F.concat(F.array_compact(places), F.coalesce("kept", F.array().cast("array<long>"))))
    stay = F.transform(numbers, lambda n: F.element_at("lines", n.cast("int") + 1))
    count = lambda c: F.when(F.col("blank"), 0).otherwise(F.size(c)).cast("long")
    return d.withColumn("stay", stay).select("row", F.array_join("stay", "\n").alias("text"), count("lines").alias("n_lines"), count("stay").alias("n_kept"))


def dedup_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs``, columns as they are but ``text`` without the lines that go."""
    return decide_lines(docs, min_chars).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
