"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Built-in functions only.  A text's words are the lower-cased runs of letters and digits.  An item's shingles are its runs
of ``k`` words; an item of fewer words is one shingle, its whole sequence.  An item leaks into a document when the document holds
at least ``percent`` % of the item's distinct shingles as runs of its own words.

* Items are partitioned by size: a partition for each length under ``k`` words that occurs, and one for each power of
  two of the number of shingles.  An item of n shingles gets as MinHash sketch its
  ``n - need + 1`` least shingle hashes, ``need = ceil(n * percent / 100)``: a document that holds
  ``need`` of the n misses at most ``n - need``, so it holds one of the sketch.  The search so
  never loses a leak, at any document length.
* A partition is open to a document that has as many shingles as the partition's least ``need``.  To each open
  partition a document offers its hashes up to the partition's ceiling, the largest sketch value in it, and they meet the
  sketches on partition and hash.  A document has no sketch of its own: that would lose short items in long texts.
* Candidates are verified on the shingles' words, not on hashes.

Sketches and items are broadcast only if they were counted under a bound (items: in bytes); beyond it the joins shuffle.

Defined cases: null and empty texts, and texts without letters or digits, have no shingles and neither leak nor
are leaked into; a very long text is searched whole; null ids take no part; rows that repeat an id are checked one by one, and a pair is
reported once with its largest overlap; extra columns are ignored by ``leaks`` and kept by ``drop_leaked``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spool import free_name, maybe_broadcast, spool

WORD = r"[\p{L}\p{N}]+"
#: Bytes of the items' spelled shingles that are broadcast at most.
ITEM_BYTES = 64 << 20


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(WORD), F.lit(0))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however the plan's projections are merged."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(words: Column, length: int, make) -> Column:
    """``make(list of columns)`` of every run of ``length`` words; null of fewer words."""
    n = F.size(words)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: make([F.get(words, i + j) for j in range(length)])))


def _hash(w: list[Column]) -> Column:
    return F.xxhash64(*w)


def _spell(w: list[Column]) -> Column:
    return F.concat_ws(" ", *w)


def _of_item(text: str, k: int, make) -> Column:
    """The distinct shingles of an item."""

    def shingles(words: Column) -> Column:
        out = _runs(words, k, make)
        for length in range(1, k):
            out = F.when(F.size(words) == length, _runs(words, length, make)).otherwise(out)
        return F.array_distinct(out)

    return _let(_words(text), shingles)


def _length(text: str, k: int) -> Column:
    return F.least(F.size(_words(text)), F.lit(k))


def _named(length: int):
    return lambda run: F.struct(F.lit(length).alias("length"), run.alias("run"))


def _key(part: Column, hash_: Column) -> Column:
    """Partition and hash in one long."""
    return hash_.bitwiseXOR(F.shiftleft(part.cast("long"), 57))


def sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """``item_id, length, n, need, part, hash``: a row per sketch value; ``length`` is the words of a shingle."""
    h = items.select(F.col("item_id").cast("long").alias("item_id"), _length("text", k).alias("length"), F.array_sort(_of_item("text", k, _hash)).alias("h")).where("item_id is not null")
    h = h.where("size(h) > 0").withColumn("n", F.size("h"))
    h = h.withColumn("need", F.ceil(F.col("n") * percent / F.lit(100)).cast("int"))
    h = h.withColumn("part", F.when(F.col("length") < k, F.col("length")).otherwise(k + F.floor(F.log2("n"))).cast("int"))
    return h.select("item_id", "length", "n", "need", "part", F.explode(F.slice("h", F.lit(1), F.col("n") - F.col("need") + 1)).alias("hash"))


def partitions(sk: DataFrame) -> list[tuple[int, int, int, int]]:
    """Of each partition its number, words of a shingle, ceiling and least ``need``: a row per short length and power of two."""
    rows = sk.groupBy("part", "length").agg(F.max("hash").alias("top"), F.min("need").alias("least")).orderBy("part").collect()
    return [(r["part"], r["length"], r["top"], r["least"]) for r in rows]


def offers(d: DataFrame, parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """``doc_id, key``: what the documents offer to the partitions open to them."""
    nothing = F.array().cast("array<struct<part: int, hash: bigint>>")

    def to_one(h: Column, part: int, top: int, least: int) -> Column:
        low = F.transform(F.filter(h, lambda v: v <= F.lit(top)), lambda v: F.struct(F.lit(part).alias("part"), v.alias("hash")))
        return F.when(F.size(h) >= least, low).otherwise(nothing)

    def of_length(words: Column, length: int) -> Column:
        h = F.coalesce(_runs(words, length, _hash), F.array().cast("array<bigint>"))
        return _let(h, lambda h: F.concat(*[to_one(h, part, top, least) for part, own, top, least in parts if own == length]))

    def of(words: Column) -> Column:
        return F.concat(nothing, *[of_length(words, length) for length in sorted({p[1] for p in parts})])

    return d.select("doc_id", F.inline(_let(_words("text"), of))).select("doc_id", _key(F.col("part"), F.col("hash")).alias("key"))


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` of every leak."""
    sk = spool(sketches(items, k, percent), "sketches")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    by_key = maybe_broadcast(spool(sk.select(_key(F.col("part"), F.col("hash")).alias("key"), "item_id"), "keys"))
    pairs = spool(offers(d, partitions(sk)).join(by_key, "key").select("doc_id", "item_id").distinct(), "candidates")
    lengths = [r["length"] for r in sk.select("length").distinct().orderBy("length").collect()]  # at most k
    return _verify(d, items, pairs, k, percent, lengths)


def _verify(d: DataFrame, items: DataFrame, pairs: DataFrame, k: int, percent: int, lengths: list[int]) -> DataFrame:
    """Candidates by the words: each distinct run of a candidate document meets the items' shingles once, and overlaps are counted.

    No text is repeated for its candidates, and no item is a key: a row that travels is one run."""
    i = items.select(F.col("item_id").cast("long").alias("item_id"), _length("text", k).alias("length"), _of_item("text", k, _spell).alias("item")).where("item_id is not null and size(item) > 0")
    # rows that repeat an id are told apart by their numbers
    i = i.withColumn("item_row", F.monotonically_increasing_id())
    i = spool(i.select("item_id", "item_row", F.size("item").cast("long").alias("n_item"), "length", F.explode("item").alias("run")), "items")
    heavy = i.agg(F.sum(F.octet_length("run") + 40)).first()[0] or 0
    i = F.broadcast(i) if heavy <= ITEM_BYTES else i
    own = spool(pairs.select("doc_id").distinct(), "candidate_documents")

    def runs(words: Column) -> Column:
        each = [F.transform(F.array_distinct(F.coalesce(_runs(words, n, _spell), F.array().cast("array<string>"))), _named(n)) for n in lengths]
        return F.concat(F.array().cast("array<struct<length: int, run: string>>"), *each)

    texts = d.join(maybe_broadcast(own), "doc_id", "left_semi").withColumn("doc_row", F.monotonically_increasing_id())
    texts = texts.select("doc_id", "doc_row", F.inline(_let(_words("text"), runs)))
    shared = texts.join(i, ["length", "run"]).groupBy("doc_id", "doc_row", "item_id", "item_row", "n_item").agg(F.count("*").alias("n_shared"))
    hit = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return hit.join(pairs, ["doc_id", "item_id"], "left_semi")


def drop_leaked(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, columns as they are, without the documents that some item leaks into."""
    bad = free_name("bad", docs.columns)
    ids = spool(leaks(docs, items, k, percent).select(F.col("doc_id").alias(bad)).distinct(), "leaked")
    return docs.join(maybe_broadcast(ids), docs["doc_id"].cast("long") == F.col(bad), "left_anti")
