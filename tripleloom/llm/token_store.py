"""Token-id output: one concatenated id array with Elias-Fano encoded document boundaries.

Documents are tokenised where they are read and spooled as ids; the ids, not the texts, are range-partitioned and
sorted by doc_id and packed into *blocks*.
A block is one self-describing binary value (layout below); the store is a Parquet table of blocks
in the order of ``(part, seq)``, written by Spark's committer, so a retried task leaves no debris.
Reading takes each document's offsets from ``select`` on the Elias-Fano boundaries; a directory of block totals gives the
block's place in the whole array, so no 64-bit offset table over documents exists anywhere.

Block layout (little endian)::

    magic "TLB1" | u8 id width | 3 x pad | u32 docs | u32 leading null doc_ids | i64 first doc_id
    EF(doc_id - first doc_id) | EF(cumulative ends) | ids

``EF``: u64 count, u64 universe, u8 low bits, 7 x pad, u64 bytes of the high part, then low bits packed,
high bits in unary, and a u32 position of every 64th one (the select directory).

Defined cases: a null or empty text is the end id alone; a very long text is one document like any other, in a block of its own
where it exceeds ``BLOCK_BYTES``; null doc_ids come first; rows that repeat a doc_id are separate documents, ordered by their ids'
hash and then by the ids; an empty table gives an empty store; extra columns are ignored."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spool import ROW_GROUP, folder_for, maybe_broadcast, scratch, spool
from .textkit import slices

BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 1 << 16
SAMPLE = 64
BLOCKS = "part int, seq int, n_docs long, n_tokens long, block binary"
#: Bytes of texts that are encoded at a time.
SLICE = 8 << 20
#: Words that are encoded in one string.
ASK = 10_000
#: Entries of a worker's memory of words and their ids; beyond it, words are encoded once in each slice.
MEMORY = 1_000_000


class EliasFano:
    """A non-decreasing sequence in about ``2 + log2(universe / count)`` bits a value."""

    def __init__(self, count: int, universe: int, bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.count, self.universe, self.bits, self.low, self.high, self.marks = count, universe, bits, low, high, marks
        self._low, self._high = low.tobytes(), high.tobytes()

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        u = int(values[-1]) + 1 if n else 1
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        if bits and n:
            low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, u, bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        return struct.pack("<QQB7xQ", self.count, self.universe, self.bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, u, bits, size = struct.unpack_from("<QQB7xQ", data, at)
        at += 32
        lows, marks = (n * bits + 7) // 8, -(-n // SAMPLE)
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, size, at + lows)
        mark = np.frombuffer(bytes(data[at + lows + size : at + lows + size + 4 * marks]), "<u4")
        return cls(n, u, bits, low, high, mark), at + lows + size + 4 * marks

    def select(self, i: int) -> int:
        """Value ``i``: from the nearest mark on, the place of the i-th one in the high part."""
        at, left = int(self.marks[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            head = int.from_bytes(self._high[byte : byte + 8], "little") >> skip
            here = head.bit_count()
            if here > left:
                break
            left, byte, skip = left - here, byte + 8, 0
        for _ in range(left):
            head &= head - 1
        high = byte * 8 + skip + (head & -head).bit_length() - 1 - i
        p = i * self.bits
        low = int.from_bytes(self._low[p >> 3 : (p + self.bits + 7) >> 3], "little") >> (p & 7) & ((1 << self.bits) - 1)
        return high << self.bits | low

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)).astype(np.int64) << self.bits
        if self.bits and self.count:
            b = np.unpackbits(self.low, bitorder="little")[: self.count * self.bits].reshape(self.count, self.bits)
            out |= b.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        return out


def pack_block(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    nulls = sum(i is None for i in doc_ids)
    real = np.array([i for i in doc_ids if i is not None], np.int64)
    first = int(real[0]) if len(real) else 0
    head = struct.pack("<4sB3xIIq", b"TLB1", ids.itemsize, len(doc_ids), nulls, first)
    return head + EliasFano.of(real.astype(np.uint64) - np.uint64(first & (2**64 - 1))).dump() + EliasFano.of(ends).dump() + ids.tobytes()


class Block:
    """A block read back; offsets by select on the Elias-Fano boundaries."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, self.docs, self.nulls, self.first = struct.unpack_from("<4sB3xIIq", view, 0)
        if magic != b"TLB1":
            raise ValueError("not a token block")
        self.keys, at = EliasFano.load(view, 24)
        self.ends, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view, "<u2" if self.width == 2 else "<u4", -1, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.values() + self.first).tolist()

    def boundaries(self) -> np.ndarray:
        return np.fromiter(map(self.ends.select, range(self.docs)), np.int64, self.docs)

    def document(self, i: int) -> np.ndarray:
        a = self.ends.select(i - 1) if i else 0
        return self.ids[a : self.ends.select(i)]


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word asked once.

    A text is cut before single spaces that stand before a visible character.  A byte-level
    pre-tokenizer always cuts there, so the words' ids add up to the text's ids.  Texts with other runs of spaces or
    with special tokens, and tokenizers of another kind, are encoded whole.

    A slot is a run of packed ids; ``memory`` knows the slots of words (each with its leading space)."""

    _runs = re.compile(r" (?:\s|\Z)")
    _marked = re.compile(r"[^\W\d_]+[.,]")

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        kind = str(self.tok.pre_tokenizer)
        self.by_word = kind.startswith("ByteLevel(") and "use_regex=True" in kind and self.tok.normalizer is None
        self.spaced = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")  # the byte-level alphabet's sign for a space
        self.slots = self._packed([[end_id], *(self.raw([m])[0] for m in ".,")])
        self.memory: dict[str, int] = {}

    def raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _packed(self, lists: list[list[int]]) -> pa.Array:
        return self._slots(np.array([i for one in lists for i in one], self.kind), np.array([len(one) for one in lists], np.int64))

    def _slots(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]) * self.kind.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(ids)])

    def _words(self, words: list[str]) -> pa.Array:
        """The slots of words with a leading space.

        They are encoded in one string: a word starts at each id whose token starts with the space, and no other token holds one."""
        if len(words) > ASK:
            return pa.concat_arrays([self._words(words[k : k + ASK]) for k in range(0, len(words), ASK)])
        if not words:
            return self.slots[:0]
        ids = np.array(self.raw([" " + " ".join(words)])[0], self.kind)
        at = np.flatnonzero(self.spaced[ids])
        if len(at) == len(words):
            return self._slots(ids, np.diff(np.append(at, len(ids))))
        return self._packed(self.raw([" " + w for w in words]))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Of each text its ids and the end id, packed.

        A full stop or comma after a word of letters is a piece of its own for the pre-tokenizer, so such a pair is the slots of both."""
        n = len(texts)
        plain = texts.to_pylist()
        whole = np.array([not self.by_word or bool(self._runs.search(t)) or any(s in t for s in self.special) for t in plain], bool)
        parts = pc.split_pattern(pc.if_else(pa.array(whole, pa.bool_()), "", texts).cast(pa.large_string()), " ")
        count = np.diff(parts.offsets.to_numpy())
        first = np.cumsum(count) - count
        # the first piece of a text has no leading space; a text that is encoded whole has no other
        heads = self._packed(self.raw([t if w else t.partition(" ")[0] for t, w in zip(plain, whole.tolist(), strict=True)]))
        coded = parts.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        follows = np.ones(len(place), bool)
        follows[first] = False
        used = np.zeros(len(words), bool)
        used[place[follows]] = True
        mark = np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            if w.endswith((".", ",")) and self._marked.fullmatch(w):
                mark[k], words[k] = 1 if w[-1] == "." else 2, w[:-1]
        known = np.array(list(map(self.memory.get, words, repeat(-1))), np.int64)
        new = dict.fromkeys(words[k] for k in np.flatnonzero(used & (known < 0)).tolist())
        fresh = self._words(list(new))
        # the slots of this call: the remembered ones, the new words, the heads
        base = len(self.slots)
        new = dict(zip(new, range(base, base + len(fresh)), strict=True))
        for k in np.flatnonzero(used & (known < 0)).tolist():
            known[k] = new[words[k]]
        learned = pa.concat_arrays([self.slots, fresh])
        # a text's slots: its head, its words with their marks, the end
        wide = 1 + (mark[place] > 0) * follows
        stop = np.cumsum(wide)
        slot = np.zeros((int(stop[-1]) if n else 0) + n, np.int64)
        own = stop - wide + np.repeat(np.arange(n), count)
        slot[own] = known[place]
        slot[own[wide == 2] + 1] = mark[place[wide == 2]]
        slot[own[first]] = base + len(fresh) + np.arange(n)
        taken = pc.take(pa.concat_arrays([learned, heads]), pa.array(slot))
        if len(self.memory) + len(new) <= MEMORY:
            self.memory.update(new)
            self.slots = learned
        last = stop[first + count - 1] + np.arange(n) if n else stop
        _, edge, data = taken.buffers()
        edge = np.frombuffer(edge, np.int64)[: len(slot) + 1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(edge[:1], edge[last + 1])), data])


_encoders: dict[tuple[int, int], Encoder] = {}


def _encode_rows(batches: Iterator[pa.RecordBatch], spec, end_id: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids``: each text's ids and the end id, little endian."""
    key = (hash(spec.value), end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec.value, end_id)
    enc = _encoders[key]
    for batch in batches:
        text = batch.column("text")
        for lo, hi, _, _ in slices(text, SLICE):
            ids = enc.encode(text.slice(lo, hi - lo)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([enc.kind.itemsize] * (hi - lo), pa.int32()), ids], names=["doc_id", "width", "ids"])
        pa.default_memory_pool().release_unused()


def _pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of one partition."""
    part, seq, held = TaskContext.get().partitionId(), 0, 0
    doc_ids: list[int | None] = []
    chunks: list[bytes] = []
    width = 2

    def block() -> pa.RecordBatch:
        nonlocal doc_ids, chunks, held, seq
        ends = np.cumsum([len(c) // width for c in chunks])
        row = [[part], [seq], [len(doc_ids)], [held // width], [pack_block(doc_ids, ends, np.frombuffer(b"".join(chunks), f"<u{width}"))]]
        doc_ids, chunks, held, seq = [], [], 0, seq + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_docs", "n_tokens", "block"])

    for batch in batches:
        for i, width, c in zip(batch.column("doc_id").to_pylist(), batch.column("width").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            doc_ids.append(i)
            chunks.append(c)
            held += len(c)
            if held >= BLOCK_BYTES or len(doc_ids) >= BLOCK_DOCS:
                yield block()
    if doc_ids:
        yield block()


def encode(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """The blocks of ``docs(doc_id, text)``, columns ``part, seq, n_docs, n_tokens, block``."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = d.mapInArrow(lambda batches: _encode_rows(batches, spec, end_id), "doc_id long, width int, ids binary")
    # written once: the range sampler then reads two narrow columns; the second key deals out rows that repeat one doc_id
    rows = spool(rows.select("doc_id", F.xxhash64("ids").alias("tag"), "width", "ids"), "ids")
    rows = rows.repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag", "ids")
    return rows.select("doc_id", "width", "ids").mapInArrow(_pack_part, BLOCKS)


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Write the store of ``docs`` to ``path``, a folder that the cluster shares."""
    encode(docs, tokenizer_file, end_id).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written store: ``doc_id, start, n_tokens, ids_crc32``, read from its blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # a row per part and then a row per block: far fewer than documents
    totals = spool(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")), "parts")
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = Window.partitionBy("part").orderBy("seq")
    place = blocks.select("part", "seq", "n_tokens").withColumn("inner", F.sum("n_tokens").over(own) - F.col("n_tokens")).join(F.broadcast(parts), "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    place = maybe_broadcast(spool(place, "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("block"), strict=True):
                b = Block(data.as_py())
                ends = b.boundaries()
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crc = [zlib.crc32(b.ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b.doc_ids(), pa.int64()), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(place, ["part", "seq"]).select("base", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write the store into the shared folder and read it back; it goes with the process."""
    path = folder_for(docs.sparkSession, "tokens")
    with scratch():
        write(docs, path, tokenizer_file, end_id)
    return read(docs.sparkSession, path)
