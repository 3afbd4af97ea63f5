"""N-gram Jaccard self-join of documents by prefix trees.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Two documents link when
``100 * |A n B| >= percent * |A u B|``.

1. *Classes.*  Documents with equal sets fall into one class by a 128-bit digest of the set
   (aggregated before the shuffle); one representative stands for each.
2. *Support, without loss.*  A document that links shares at least ``percent`` % of its n-grams with one other
   document, so at least that many of them stand in some other document.  The representatives' n-grams are dealt by
   parts of the hash space, packed into one row per chunk of documents and part; n-grams that several
   documents of a chunk hold are counted there and go on once.  Documents without enough shared n-grams leave.
3. *Blocking, without loss.*  Sets within a size level differ in at most D elements, so of more than D
   hash ranges of the element space at least one holds the same elements in both.  A digest of
   each range is a key, packed and dealt like the n-grams; documents that share a key are joined into stars,
   never all pairs, and the stars' components are the blocks.
4. *Prefix tree.*  The sets of a block are put in one global order, frequent elements first, so that near copies share
   long prefixes, and stored in a trie without the elements that only one of them holds.  Each set walks the
   trie: the overlap with a common prefix is computed once for all sets below it, and a subtree is left when
   the overlap so far and the smaller of the two remaining lengths cannot reach the needed overlap, when its sizes
   cannot link, or when its sets are in the walking set's component already.  Blocks of more than
   ``piece_elements`` elements are cut by size level and into pieces of that many elements; pieces of the same
   and of neighbouring levels walk pair by pair, so what a task holds is bounded in elements.
5. *Components* of the links, expanded to the classes' members.

Nothing is lost: support, blocking and levels keep every pair over the threshold, and a pair is skipped in the
tree only if it cannot link or is connected already.

Defined cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer than n words has its whole sequence as one n-gram; a very long text is one set like any other and a
piece of its own where it exceeds the bound; equal sets are one class, whose least doc_id stands for it; rows that repeat a
doc_id are one document whose copies are each reported; a null doc_id is never linked and is its own
component (null); extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spool import components, free_name, maybe_broadcast, spool
from .textkit import U, mix, shingle_sets

#: Hash families tried where too many ranges are empty; the last one keeps empty ranges, so none is lost.
FAMILIES = 6


@functools.lru_cache(maxsize=8)
def levels(percent: int, top: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size levels: lower borders, ranges per level, and how many of them may be empty.

    A set of level i links only with sets of levels i - 1 to i + 1.  For the pair of a set of
    level i (at most M elements) and a larger one, the difference D is at most
    ``(n1 + n2) * (100 - percent) / (100 + percent)``.  Of D + 1 + g ranges at least g + 1 agree, so one that
    agrees holds elements if at most g ranges of the set are empty; g is what a set of the level rarely exceeds."""
    border, parts, spare = [1], [], []
    while border[-1] < top:
        border.append(max(border[-1] + 1, border[-1] * 100 // percent + 1))
    for least, low in zip(border, border[1:], strict=False):
        most = low - 1
        differ, g = (most + most * 100 // percent) * (100 - percent) // (100 + percent), 0
        while differ:
            empty = (differ + 1 + g) * np.exp(-least / (differ + 1 + g))
            if g >= empty + 3 * np.sqrt(empty) or g > differ:
                break
            g += 1 + differ // 200
        parts.append(differ + 1 + g)
        spare.append(g)
    return np.array(border, np.int64), np.array(parts, np.int64), np.array(spare, np.int64)


def range_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The blocking keys of one sorted set, for its own level and the one below."""
    border, parts, spare = levels(percent)
    own = int(np.searchsorted(border, len(s), side="right")) - 1
    out = []
    with np.errstate(over="ignore"):
        for level in (own, own - 1):
            if level < 0 or parts[level] < 2:
                continue  # no two different sets of this level link
            k = int(parts[level])
            edge = (np.arange(1, k, dtype=np.float64) * (2.0**64 / k)).astype(U)
            for family in range(FAMILIES):
                x = s if family == 0 else np.sort(mix(s + U(family)))
                cut = np.concatenate([[0], np.searchsorted(x, edge), [len(x)]])
                total = np.concatenate([np.zeros(1, U), np.cumsum(mix(x + U(77)), dtype=U)])
                empty = np.diff(cut) == 0
                key = mix((total[cut[1:]] - total[cut[:-1]]) + mix(np.arange(k, dtype=U) + U((level * 8 + family) << 32)))
                enough = int(empty.sum()) <= spare[level]
                out.append(key if family == FAMILIES - 1 and not enough else key[~empty])
                if enough:
                    break
    return np.concatenate(out) if out else np.zeros(0, U)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, which tell sets apart."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(mix(s + U(1)).sum(dtype=U).view(np.int64)), int(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).view(np.int64))


def _profiles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(s), *_digest(s)) for s in shingle_sets(batch.column("text"), n)]
        sizes, d1, d2 = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, d1, d2))], names=["doc_id", "n_shingles", "d1", "d2"])


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked ids that are not the least of their component, each with that least id."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (differ := root[x] != root[y]).any():
        x, y = x[differ], y[differ]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((up := root[root]) != root).any():
            root = up
    below = root != np.arange(len(ids))
    return ids[below], ids[root[below]]


# --- values dealt by parts of the hash space -------------------------------------------------------------

#: Values that a chunk of documents holds back before it is packed.
HOLD = 500_000
PACKED = "part int, owners binary, counts binary, low binary, high binary, seen binary, a binary, b binary"
#: Bits that are compared beside those that name the part: an n-gram taken for shared costs a look, a key a larger block.
GRAM_BITS, KEY_BITS = 32, 40


def _chunks(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The values of some HOLD at a time, sorted, and the doc_id of each."""
    values, owner, held = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        v, c = np.concatenate(values), np.repeat(np.array(owner, np.int64), [len(x) for x in values])
        order = np.argsort(v, kind="stable")
        return v[order], c[order]

    for doc_id, s in sets:
        if len(s):
            values.append(s)
            owner.append(doc_id)
            held += len(s)
            if held >= HOLD:
                yield flush()
                values, owner, held = [], [], 0
    if held:
        yield flush()


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte over all numbers: the shuffle's compression then removes what is constant."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _pack(v: np.ndarray, c: np.ndarray, seen: np.ndarray, bits: int, kept: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A row per part of the hash space: its owners, how many values each has, the values' bits, and the values in ``seen`` (no owner).

    ``a`` and ``b``, two columns settled in the chunk, go with the first row."""
    part_of = (lambda x: (x >> U(64 - bits)).astype(np.int32)) if bits else (lambda x: np.zeros(len(x), np.int32))
    part, seen_part = part_of(v), part_of(seen)
    order = np.lexsort((c, part))
    part, c, v = part[order], c[order], v[order]
    rows = []
    for p in np.union1d(part, seen_part).tolist() or [0]:
        lo, hi = np.searchsorted(part, [p, p + 1])
        k = v[lo:hi] >> U(64 - bits - kept)
        first = np.ones(hi - lo, bool)
        first[1:] = c[lo + 1 : hi] != c[lo : hi - 1]
        at = np.flatnonzero(first)
        known = seen[slice(*np.searchsorted(seen_part, [p, p + 1]))] >> U(64 - bits - kept)
        high = (np.concatenate([k, known]) >> U(32)).astype(np.uint8).tobytes() if kept > 32 else b""
        rows.append((p, _planes(c[lo:hi][at]), _planes(np.diff(np.append(at, hi - lo)).astype(np.uint32)), k.astype(np.uint32).tobytes(), high, known.astype(np.uint32).tobytes(), a.tobytes(), b.tobytes()))
        a = b = np.zeros(0, np.int64)
    part, *packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "owners", "counts", "low", "high", "seen", "a", "b"])


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one part the values, whether each has an owner, and the owners of those that have, all in the values' order."""
    owners = [np.repeat(_from_planes(o, np.int64), _from_planes(n, np.uint32)) for o, n in zip(pdf["owners"], pdf["counts"], strict=True)]
    values, owned = [], []
    for low, high, seen in zip(pdf["low"], pdf["high"], pdf["seen"], strict=True):
        k = np.frombuffer(low + seen, np.uint32).astype(U)
        if high:
            k |= np.frombuffer(high, np.uint8).astype(U) << U(32)
        values.append(k)
        owned.append(np.arange(len(k)) < len(low) // 4)
    v, has = np.concatenate(values), np.concatenate(owned)
    c = np.zeros(len(v), np.int64)
    c[has] = np.concatenate(owners)
    order = np.argsort(v, kind="stable")
    return v[order], has[order], c[order]


def _packed_grams(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    """N-grams that one document of the chunk holds go on with it; of the others each goes on once, counted for its documents."""

    def sets():
        for batch in batches:
            yield from zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), n), strict=True)

    for v, c in _chunks(sets()):
        starts = np.ones(len(v), bool)
        starts[1:] = v[1:] != v[:-1]
        alone = starts & np.append(starts[1:], True)
        a, b = np.unique(c[~alone], return_counts=True)
        yield _pack(v[alone], c[alone], v[starts & ~alone], bits, GRAM_BITS, a, b)


def _support(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """How many n-grams of one part each document shares with others, packed by buckets of documents."""
    v, has, c = _unpack(pdf)
    same = v[1:] == v[:-1]
    shared = np.append(same, False) | np.append(False, same)
    a, b = (np.frombuffer(b"".join(pdf[x]), np.int64) for x in ("a", "b"))
    ids, count = _summed(np.concatenate([c[shared & has], a]), np.concatenate([np.ones(int((shared & has).sum()), np.int64), b]))
    bucket = (mix(ids.view(U)) >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(ids), np.int32)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    groups = [g for g in np.split(order, cut) if len(g)]
    return pd.DataFrame({"bucket": [int(bucket[g[0]]) for g in groups], "owners": [_planes(ids[g]) for g in groups], "counts": [_planes(count[g].astype(np.uint32)) for g in groups]})


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(ids, return_inverse=True)
    return ids, np.bincount(at, weights=counts, minlength=len(ids)).astype(np.int64)


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of one bucket of documents, added over all parts."""
    ids, shared = _summed(np.concatenate([_from_planes(x, np.int64) for x in pdf["owners"]]), np.concatenate([_from_planes(x, np.uint32) for x in pdf["counts"]]))
    return pd.DataFrame({"doc_id": ids, "shared": shared})


def _packed_keys(batches: Iterator[pa.RecordBatch], percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A key that several documents of the chunk share goes on with the first of them; the others are linked with it here."""

    def keys():
        for batch in batches:
            for doc_id, g in zip(batch.column("doc_id").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                yield doc_id, range_keys(np.frombuffer(g, U), percent)

    for v, c in _chunks(keys()):
        first = np.ones(len(v), bool)
        first[1:] = v[1:] != v[:-1]
        a, b = _stars(c[~first], c[first][np.cumsum(first) - 1][~first])
        yield _pack(v[first], c[first], v[:0], bits, KEY_BITS, a, b)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the documents that share a key of one part, as stars."""
    v, _, c = _unpack(pdf)
    again = np.flatnonzero(v[1:] == v[:-1])
    a, b = (np.frombuffer(b"".join(pdf[x]), np.int64) for x in ("a", "b"))
    a, b = _stars(np.concatenate([c[again], a]), np.concatenate([c[again + 1], b]))
    return pd.DataFrame({"a": a, "b": b})


def _bits(values: int, part_values: int) -> int:
    """Bits of a hash that name its part, for parts of about ``part_values``."""
    return min(24, max(4, int(values // part_values).bit_length()))


# --- the prefix tree -----------------------------------------------------------------------------------


def needed(a, b, percent: int):
    """The least overlap of sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def frequent_first(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as sorted ranks: the elements by falling frequency in these sets, ties by hash.

    Elements that only one set holds are left out; they count in its size alone."""
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    count = np.diff(np.append(start, len(flat)))
    rank = np.full(len(start), -1, np.int64)
    often = np.flatnonzero(count > 1)
    rank[often[np.argsort(-count[often], kind="stable")]] = np.arange(len(often))
    ranks = np.empty(len(flat), np.int64)
    ranks[order] = np.repeat(rank, count)
    row = np.repeat(np.arange(len(sets)), size)
    row, ranks = row[ranks >= 0], ranks[ranks >= 0]
    ranks = ranks[np.lexsort((ranks, row))].astype(np.uint32)
    return np.split(ranks, np.cumsum(np.bincount(row, minlength=len(sets)))[:-1])


class Node:
    """Sets ``lo..hi`` of the lexicographic order, which share their first ``depth`` elements; sizes and lengths below.

    Children are ascending by their first own element; sets that end here are no child's."""

    __slots__ = ("children", "depth", "ends", "heads", "hi", "least", "leasts", "lo", "longest", "longests", "most")

    def __init__(self, lo: int, hi: int, depth: int, least: int, most: int, longest: int):
        self.lo, self.hi, self.depth, self.least, self.most, self.longest = lo, hi, depth, least, most, longest
        self.ends, self.children = hi, []


class Trie:
    """A prefix tree over sorted sets, with whole runs of shared elements in one node."""

    BUCKET = 4

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.size = sets, sizes
        self.length = np.array([len(s) for s in sets], np.int64)
        self.stored = 0
        self.root = self._grow()

    @staticmethod
    def order(sets: list[np.ndarray]) -> list[int]:
        return sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())

    def _grow(self) -> Node:
        top: list[Node] = []
        todo = [(0, len(self.sets), 0, top)]
        while todo:
            lo, hi, depth, into = todo.pop()
            first, last = self.sets[lo], self.sets[hi - 1]
            m = min(len(first), len(last))
            same = first[depth:m] == last[depth:m]
            shared = depth + (int(np.argmin(same)) if not same.all() else len(same))
            node = Node(lo, hi, shared, int(self.size[lo:hi].min()), int(self.size[lo:hi].max()), int(self.length[lo:hi].max()))
            into.append(node)
            self.stored += shared - depth
            if hi - lo <= self.BUCKET:
                self.stored += int((self.length[lo:hi] - shared).sum())
                continue
            node.ends = lo + int((self.length[lo:hi] == shared).sum())
            if node.ends == hi:
                continue
            heads = np.array([s[shared] for s in self.sets[node.ends : hi]], np.uint32)
            cuts = [node.ends, *(node.ends + 1 + np.flatnonzero(heads[1:] != heads[:-1])).tolist(), hi]
            todo += [(a, b, shared, node.children) for a, b in zip(cuts, cuts[1:], strict=False)][::-1]
            node.heads = heads[np.array(cuts[:-1]) - node.ends]
            node.leasts = np.minimum.reduceat(self.size[node.ends : hi], np.array(cuts[:-1]) - node.ends)
            node.longests = np.maximum.reduceat(self.length[node.ends : hi], np.array(cuts[:-1]) - node.ends)
        return top[0]


def links_of(ids: list[int], sets: list[np.ndarray], percent: int, sides: list | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly the sets that a chain of links connects.

    With ``sides`` (a piece per set) only pairs from different pieces are looked at."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ranked = frequent_first(sets)
    # too few elements that any other set holds: no link
    able = [i for i in range(len(sets)) if len(ranked[i]) * 100 >= sizes[i] * percent]
    if len(able) < 2:
        return []
    able = [able[i] for i in Trie.order([ranked[i] for i in able])]
    ids, sets, sizes = [ids[i] for i in able], [ranked[i] for i in able], sizes[able]
    side = None if sides is None else np.unique(np.array([hash(sides[i]) for i in able]), return_inverse=True)[1]
    tree, comp = Trie(sets, sizes), np.arange(len(sets))
    found: list[tuple[int, int]] = []
    turn = np.lexsort((np.arange(len(sets)), sizes))
    place = np.argsort(turn)

    def open_to(i: int, lo: int, hi: int) -> np.ndarray:
        """The sets of ``lo..hi`` that set i may still link with; a pair is looked at once, from its larger set."""
        free = (place[lo:hi] < place[i]) & (comp[lo:hi] != comp[i])
        return free if side is None else free & (side[lo:hi] != side[i])

    for i in turn.tolist():
        x, nx, mx = sets[i], int(sizes[i]), len(sets[i])
        least_size = -(-nx * percent // 100)
        todo = [(tree.root, 0, 0, 0)]
        while todo:
            node, depth, at, overlap = todo.pop()
            if node.least > nx or node.most < least_size or not open_to(i, node.lo, node.hi).any():
                continue
            below = node.depth
            if below > depth:  # the elements that the whole subtree shares
                step = sets[node.lo][depth:below]
                spot = at + np.searchsorted(x[at:], step)
                overlap += int((x[np.minimum(spot, mx - 1)] == step)[spot < mx].sum())
                at += int(np.searchsorted(x[at:], step[-1], side="right"))
            if overlap + min(mx - at, node.longest - below) < needed(nx, max(node.least, least_size), percent):
                continue
            if node.children:
                # what is left of x from a child's first element on, and what is left of the child
                left = mx - at - np.searchsorted(x[at:], node.heads)
                go = np.flatnonzero(overlap + np.minimum(left, node.longests - below) >= needed(nx, np.maximum(node.leasts, least_size), percent))
                todo += [(node.children[c], below, at, overlap) for c in go.tolist()]
                end = node.ends
            else:
                end = node.hi
            for j in (node.lo + np.flatnonzero(open_to(i, node.lo, end))).tolist():
                if comp[j] == comp[i] or sizes[j] < least_size:
                    continue
                rest, want = sets[j][below:], needed(nx, int(sizes[j]), percent) - overlap
                if min(mx - at, len(rest)) < want:
                    continue
                if want > 0:
                    spot = at + np.searchsorted(x[at:], rest)
                    if int((x[np.minimum(spot, mx - 1)] == rest)[spot < mx].sum()) < want:
                        continue
                found.append((ids[i], ids[j]))
                comp[comp == comp[j]] = comp[i]
    return found


def _walk(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    sets = [np.frombuffer(g, dtype=U) for g in pdf["grams"]]
    sides = list(zip(pdf["level"].tolist(), pdf["piece"].tolist(), strict=True))
    return pd.DataFrame(links_of(pdf["doc_id"].tolist(), sets, percent, sides if len(set(sides)) > 1 else None), columns=["a", "b"], dtype="int64")


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column("text"), n)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "grams"])


# --- the join -------------------------------------------------------------------------------------------


def _met(sets: DataFrame, blocks: DataFrame, percent: int, piece_elements: int) -> DataFrame:
    """The sets of each pair of pieces that may link, under ``block, l1, l2, p, q``.

    A block of at most ``piece_elements`` elements is one piece.  A larger one is cut by size level (sets that link are of
    the same or of neighbouring levels) and each level by a hash of doc_id."""
    n = F.octet_length("grams") / 8
    placed = sets.join(blocks, "doc_id")
    # a hair over the ratio, so that rounding never puts linking sizes two levels apart
    level = F.floor(F.log(n) / (math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0)).cast("int")
    by_level = placed.select("block", level.alias("level"), n.alias("n")).groupBy("block", "level").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("block")  # a row per level: at most some hundred
    plan = by_level.withColumn("whole", F.sum("n").over(own) <= piece_elements).withColumn("pieces", F.when(F.col("whole"), 1).otherwise(F.ceil(F.col("n") / piece_elements)).cast("int"))
    at = own.orderBy("level")
    step = lambda f, by: F.when(~F.col("whole") & (f("level").over(at) == F.col("level") + by), f("pieces").over(at)).otherwise(0)
    plan = spool(plan.select("block", "level", "whole", "pieces", step(F.lead, 1).alias("above"), step(F.lag, -1).alias("below")), "pieces")
    placed = placed.withColumn("level", level).join(maybe_broadcast(plan), ["block", "level"])
    placed = placed.withColumn("level", F.when(F.col("whole"), 0).otherwise(F.col("level"))).withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))

    def with_pieces(count: str, make: Callable) -> F.Column:
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), make)

    here = lambda a, b, p, q: F.struct(a.alias("l1"), b.alias("l2"), p.alias("p"), q.alias("q"))
    lv, me = F.col("level"), F.col("piece")
    pairs = F.concat(with_pieces("pieces", lambda j: here(lv, lv, F.least(me, j), F.greatest(me, j))), with_pieces("above", lambda j: here(lv, lv + 1, me, j)), with_pieces("below", lambda j: here(lv - 1, lv, j, me)))
    return placed.select("doc_id", "grams", "block", "level", "piece", F.explode(pairs).alias("met")).select("doc_id", "grams", "block", "level", "piece", "met.*")


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90, piece_elements: int = 500_000, part_values: int = 1_500_000) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # several rows of one doc_id: their texts are compared on their own, their ids are one node
    profile = spool(docs.mapInArrow(functools.partial(_profiles, n=n), "doc_id long, n_shingles long, d1 long, d2 long"), "profiles")
    some = profile.where("n_shingles > 0 and doc_id is not null")
    classes = spool(some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    links = _links(docs, some, classes, n, percent, piece_elements, part_values)
    # a doc_id that stands in several classes ties them; other members follow their representative
    member = some.join(maybe_broadcast(classes.where("rep < last")), ["d1", "d2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep")
    several = some.select("doc_id", "d1", "d2").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = spool(several, "several")
    ties = member.join(maybe_broadcast(several), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = spool(components(links.unionByName(ties)), "components")
    comp = maybe_broadcast(comp.select(F.col("id").alias("rep"), "component"))
    rep = profile.join(maybe_broadcast(classes.where("rep < last").select("d1", "d2", "n_shingles", F.col("rep").alias("_rep"))), ["d1", "d2", "n_shingles"], "left")
    rep = rep.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("_rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    return rep.join(comp, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("doc_id").isNotNull(), F.col("rep"))).alias("component_id"))


def _links(docs: DataFrame, some: DataFrame, classes: DataFrame, n: int, percent: int, piece_elements: int, part_values: int) -> DataFrame:
    """Links between representatives, enough to connect what a chain of links connects."""
    # only representatives take part; followers are the ids that represent no class
    followers = spool(some.select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"), "followers")
    reps = docs.where("doc_id is not null").join(maybe_broadcast(followers), "doc_id", "left_anti")
    bits = _bits(classes.agg(F.sum("n_shingles")).first()[0] or 0, part_values)
    packed = reps.mapInArrow(functools.partial(_packed_grams, n=n, bits=bits), PACKED)
    # a bucket of documents holds at most four parts' worth of counts
    counted = packed.groupBy("part").applyInPandas(lambda pdf: _support(pdf, max(0, bits - 2)), "bucket int, owners binary, counts binary")
    shared = counted.groupBy("bucket").applyInPandas(_totals, "doc_id long, shared long")
    least = some.groupBy("doc_id").agg(F.min("n_shingles").alias("n_shingles"))
    alive = spool(shared.join(least, "doc_id").where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select("doc_id", "n_shingles"), "supported")
    sets = docs.join(maybe_broadcast(alive.select("doc_id")), "doc_id", "left_semi").mapInArrow(functools.partial(_sets, n=n), "doc_id long, grams binary")
    sets = spool(sets.where(F.octet_length("grams") > 0), "sets")
    # a set has about this many keys for each of its elements, over its two levels
    keys = (alive.agg(F.sum("n_shingles")).first()[0] or 0) * 2 * (100 - percent) // percent
    packed = sets.mapInArrow(functools.partial(_packed_keys, percent=percent, bits=_bits(keys, part_values)), PACKED)
    stars = packed.groupBy("part").applyInPandas(_meet, "a long, b long")
    blocks = spool(components(stars).select(F.col("id").alias("doc_id"), F.col("component").alias("block")), "blocks")
    met = _met(sets, maybe_broadcast(blocks), percent, piece_elements)
    return spool(met.groupBy("block", "l1", "l2", "p", "q").applyInPandas(lambda pdf: _walk(pdf, percent), "a long, b long"), "links")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """``docs`` without the documents whose component holds a smaller doc_id; columns as they are."""
    found = ngram_components(docs, n, percent, **options)
    gone = free_name("gone", docs.columns)
    ids = spool(found.where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return docs.join(maybe_broadcast(ids), docs["doc_id"].cast("long") == F.col(gone), "left_anti")
