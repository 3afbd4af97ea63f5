"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt into blocks by position: each goes to its nearest pivot (``PIVOTS`` vectors at most, drawn by a hash),
and a pivot with more than ``block_rows`` vectors is dealt on by a hash.  Each block is indexed once by a cover tree (nested
nets: a node covers its points within its radius, and its children are a net of the points
at half the level's radius) and stored with it.  Query blocks meet candidate blocks, and per pair the two trees are walked together:
for a query node (centre a, radius r) and a candidate node (centre b, radius s) no score exceeds
``a.b + r|b| + s|a| + rs``, so the pair is left when that is under the worst k-th score of the
query node's queries so far (or equals it with no smaller id to win the tie).

First each query block meets the ``SEEDS`` candidate blocks whose centres score highest with its own.  The k-th scores found there go
on: a pair of blocks whose bound is under the query block's worst k-th score is not walked, and the others
start from each query's k-th score.  Each pair of blocks returns k rows a query at most; the k best of all are the result.

The queries are a stated part of the rows, matched with all rows block by block; nothing is approximate.  How much is pruned
depends on the vectors: where they spread evenly in many dimensions, no bound excludes anything and every pair is scored.

Scores are exact integers: as long as they stay below 2**53 in double arithmetic, else in Python's integers.

Defined cases: vectors that are null, empty, hold a null or a non-finite component, or have a null id take no
part; vectors of different lengths don't meet; ties go to the smaller id; rows that repeat an id are candidates
each (a query id is asked once, by its least vector, and its own id's rows never answer it); fewer than k candidates
give all; an empty table gives an empty result; extra columns are ignored.  A score outside 64 bits is clamped, and a
finite component whose product with the factor is not finite leaves its vector out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spool import spool

#: Points of a leaf, of candidates and of queries.
LEAF, QUERY_LEAF = 256, 64
#: Vectors that blocks are dealt by, at most, and candidate blocks that a query block meets first.
PIVOTS, SEEDS = 256, 2
LONG = (-(2**63), 2**63 - 1)


class CoverTree:
    """Nodes over rows ``[lo, hi)`` of the reordered points: centre, radius, centre's norm, least id, children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.nodes: list[list] = []
        order: list[np.ndarray] = []
        x = points.astype(np.float64)
        self._x, self._ids, self._at = x, ids, 0
        todo: list[tuple[np.ndarray, int | None]] = [(np.arange(len(ids)), None)]
        while todo:
            own, parent = todo.pop()
            mean = x[own].mean(0)
            c = own[int(np.argmin(((x[own] - mean) ** 2).sum(1)))]
            dist = np.sqrt(((x[own] - x[c]) ** 2).sum(1))
            radius = float(dist.max())
            me = len(self.nodes)
            self.nodes.append([0, 0, x[c], radius, float(np.sqrt((x[c] ** 2).sum())), int(ids[own].min()), []])
            if parent is not None:
                self.nodes[parent][6].append(me)
            parts = self._net(own, dist, radius) if len(own) > leaf and radius > 0 else []
            if len(parts) > 1:
                todo += [(p, me) for p in reversed(parts)]
            else:
                own = own[np.argsort(ids[own], kind="stable")]
                self.nodes[me][:2] = self._at, self._at + len(own)
                self._at += len(own)
                order.append(own)
        for node in reversed(self.nodes):
            if node[6]:
                node[0], node[1] = min(self.nodes[c][0] for c in node[6]), max(self.nodes[c][1] for c in node[6])
        o = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.points = ids[o], points[o]
        del self._x, self._ids

    def dump(self) -> tuple[bytes, bytes, bytes]:
        """Ids, points, and per node: bounds, parent, least id, radius, norm, centre."""
        parent = np.full(len(self.nodes), -1, np.int64)
        for i, node in enumerate(self.nodes):
            parent[node[6]] = i
        whole = np.array([(n[0], n[1], p, n[5]) for n, p in zip(self.nodes, parent.tolist(), strict=True)], np.int64)
        real = np.array([(n[3], n[4], *n[2]) for n in self.nodes], np.float64)
        return self.ids.tobytes(), self.points.tobytes(), whole.tobytes() + real.tobytes()

    @classmethod
    def load(cls, ids: bytes, points: bytes, nodes: bytes, width: int) -> CoverTree:
        self = cls.__new__(cls)
        self.ids, self.points = np.frombuffer(ids, np.int64), np.frombuffer(points, np.int64).reshape(-1, width)
        n = len(nodes) // (8 * (6 + width))
        whole, real = np.frombuffer(nodes, np.int64, 4 * n).reshape(n, 4).tolist(), np.frombuffer(nodes, np.float64, -1, 32 * n).reshape(n, 2 + width)
        self.nodes = [[lo, hi, real[i, 2:], float(real[i, 0]), float(real[i, 1]), least, []] for i, (lo, hi, _, least) in enumerate(whole)]
        for i, (_, _, parent, _) in enumerate(whole):
            if parent >= 0:
                self.nodes[parent][6].append(i)
        return self

    def _net(self, own: np.ndarray, dist: np.ndarray, radius: float) -> list[np.ndarray]:
        """Points of ``own`` by the nearest of net points that are more than half the radius apart.

        If half the radius leaves nothing together, two far points split the node instead."""
        x = self._x[own]
        near, who, centres = dist.copy(), np.zeros(len(own), np.int64), 1
        while centres < 32:
            far = int(np.argmax(near))
            if near[far] <= radius / 2:
                break
            d = np.sqrt(((x - x[far]) ** 2).sum(1))
            closer = d < near
            near[closer], who[closer] = d[closer], centres
            centres += 1
            if centres == 8 and np.bincount(who).max() < self.leaf // 16:
                break
        return [own[who == k] for k in range(centres) if (who == k).any()]


class Best:
    """The k best (score, id) of each query, by falling score and rising id."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None):
        """``worst``: per query a score that k others reach already, or -inf."""
        self.k, self.scored = k, 0
        self.score: list = [[] for _ in range(n)]
        self.ids: list = [[] for _ in range(n)]
        self.worst = np.full(n, -np.inf) if worst is None else worst.copy()

    def add(self, lo: int, hi: int, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Offer ``score[q - lo]`` of ``ids`` to the queries lo..hi, whose ids are ``own``."""
        self.scored += score.size
        hit = (score >= self.worst[lo:hi, None]) & (ids[None, :] != own[:, None])
        for a in np.flatnonzero(hit.any(1)).tolist():
            s, i, q = score[a][hit[a]], ids[hit[a]], lo + a
            if s.dtype != object and len(s) > 4 * self.k:
                edge = np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[s >= edge], i[s >= edge]
            both = sorted(zip((-s).tolist() + [-x for x in self.score[q]], i.tolist() + self.ids[q], strict=True))[: self.k]
            self.score[q], self.ids[q] = [int(-x) for x, _ in both], [y for _, y in both]
            if len(both) == self.k:
                self.worst[q] = max(self.worst[q], float(self.score[q][-1]))


def bound(qc, qr, qn, cc, cr, cn) -> float:
    """No score of a point of the one ball with one of the other exceeds it."""
    top = float(qc @ cc) + qr * cn + cr * qn + qr * cr
    return top + 1e-9 * abs(top) + 1e-6


def search(queries: CoverTree, candidates: CoverTree, k: int, worst: np.ndarray | None = None) -> Best:
    """Walk both trees; ids equal to the query's don't answer."""
    top = max((int(np.abs(t.points).max()) if t.points.size else 0) for t in (queries, candidates))
    exact = top * top * max(1, queries.points.shape[1]) < 2**53
    best = Best(len(queries.ids), k, worst)
    qf, cf = (queries.points.astype(np.float64), candidates.points.astype(np.float64)) if exact else (queries.points.astype(object), candidates.points.astype(object))
    todo = [(0, 0, np.inf)]
    while todo:
        qi, ci, most = todo.pop()
        ql, qh, qc, qr, qn, _, qk = queries.nodes[qi]
        cl, ch, cc, cr, cn, least, ck = candidates.nodes[ci]
        if most < best.worst[ql:qh].min():
            continue
        if not qk and not ck:
            s = qf[ql:qh] @ cf[cl:ch].T
            best.add(ql, qh, s, candidates.ids[cl:ch], queries.ids[ql:qh])
            continue
        # open the wider node; the most promising pair is walked first
        if ck and (not qk or cr >= qr):
            pairs = [(qi, c) for c in ck]
        else:
            pairs = [(c, ci) for c in qk]
        scored = []
        for a, b in pairs:
            qa, cb = queries.nodes[a], candidates.nodes[b]
            top_score = bound(*qa[2:5], *cb[2:5])
            if top_score >= best.worst[qa[0] : qa[1]].min():
                scored.append((a, b, top_score))
        todo += sorted(scored, key=lambda p: p[2])
    return best


def quantised(vector: Column, factor: int = 1024) -> Column:
    """Integers ``floor(factor * x)``; null where the vector takes no part."""
    v = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(factor)))
    ok = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(v, lambda x: F.floor(x).cast("long")))


BLOCKS = "block int, width int, ids binary, points binary, nodes binary, centre array<double>, radius double, norm double"


def _placed(rows: DataFrame, pivots: list[list[int]], block_rows: int) -> DataFrame:
    """``rows`` and ``block``: the nearest pivot of the same length, dealt on by a hash where it has too many."""
    points = {w: (np.array([p for p in pivots if len(p) == w], np.float64), [i for i, p in enumerate(pivots) if len(p) == w]) for w in {len(p) for p in pivots}}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.zeros(b.num_rows, np.int32)
            width = b.column("width").to_numpy()
            flat, start = b.column("v").values.to_numpy(zero_copy_only=False), b.column("v").offsets.to_numpy()
            for w, (p, index) in points.items():
                own = np.flatnonzero(width == w)
                for some in np.array_split(own, len(own) // 4096 + 1):
                    x = flat[start[some][:, None] + np.arange(w)].astype(np.float64)
                    place[some] = np.array(index)[np.argmin((p * p).sum(1) - 2 * (x @ p.T), axis=1)] if len(some) else 0
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("width"), pa.array(place)], names=["vec_id", "v", "width", "place"])

    placed = spool(rows.mapInArrow(near, "vec_id long, v array<long>, width int, place int"), "placed")
    size = placed.groupBy("place", "width").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("pieces"))
    own = Window.orderBy("place", "width")  # a row per pivot and length
    size = spool(size.withColumn("first", F.sum("pieces").over(own) - F.col("pieces")), "places")
    return placed.join(F.broadcast(size), ["place", "width"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), "pieces")).cast("int"))


def _blocks(rows: DataFrame, pivots: list[list[int]], block_rows: int, what: str, leaf: int = LEAF) -> DataFrame:
    """A row per block: its tree and the ball around it."""

    def index(pdf):
        import pandas as pd

        tree = CoverTree(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"]).astype(np.int64), leaf)
        ids, points, nodes = tree.dump()
        root = tree.nodes[0]
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "width": [pdf["width"].iloc[0]], "ids": [ids], "points": [points], "nodes": [nodes], "centre": [root[2]], "radius": [root[3]], "norm": [root[4]]})

    return spool(_placed(rows, pivots, block_rows).groupBy("block", "width").applyInPandas(index, BLOCKS), what)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id that satisfies ``queries`` (a condition on ``vec_id``)
    its k highest scores among the rows of other ids of ``vectors(vec_id, embedding)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null").withColumn("width", F.size("v"))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
    pivots = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).select("v").collect()]
    few = lambda n, size: pivots[: max(1, -(-n // size))]  # noqa: E731  blocks of about the wanted size
    cand = _blocks(rows, few(rows.count(), block_rows), block_rows, "candidates")
    ask = _blocks(asked, few(asked.count(), query_rows), query_rows, "queries", QUERY_LEAF)

    ball = lambda df, p: df.select("width", *[F.col(c).alias(p + c) for c in ("block", "centre", "radius", "norm")])
    near = F.aggregate(F.zip_with("qcentre", "ccentre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = ball(ask, "q").join(ball(cand, "c"), "width").withColumn("near", near)  # a row per pair of blocks
    most = F.col("near") + F.col("qradius") * F.col("cnorm") + F.col("cradius") * F.col("qnorm") + F.col("qradius") * F.col("cradius")
    turn = F.row_number().over(Window.partitionBy("qblock", "width").orderBy(F.desc("near"), "cblock"))
    pairs = spool(pairs.select("width", "qblock", "cblock", (most + F.abs(most) * 1e-9 + 1e-6).alias("most"), turn.alias("turn")), "pairs")

    first = spool(_walked(pairs.where(F.col("turn") <= SEEDS), ask, cand, k), "first")
    # of each query block the k-th scores so far, in the order of its stored ids
    kth = first.groupBy("qblock", "width", "query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best"))
    kth = kth.groupBy("qblock", "width").agg(F.map_from_entries(F.collect_list(F.struct("query_id", F.get("best", F.lit(k - 1)).alias("kth")))).alias("kth"))
    ids = ask.select(F.col("block").alias("qblock"), "width", "ids").mapInArrow(_unpacked, "qblock int, width int, ids array<long>")
    known = ids.join(kth, ["qblock", "width"], "left").select("qblock", "width", F.transform("ids", lambda i: F.element_at("kth", i)).alias("kth"))
    known = spool(known.withColumn("worst", F.when(~F.exists("kth", lambda x: x.isNull()), F.array_min("kth"))), "kth")
    left = pairs.where(F.col("turn") > SEEDS).join(known, ["qblock", "width"], "left").where("worst is null or most >= worst")
    second = _walked(left, ask, cand, k)
    found = first.unionByName(second).select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = pa.array([np.frombuffer(x, np.int64) for x in b.column("ids").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("qblock"), b.column("width"), ids], names=["qblock", "width", "ids"])


def _walked(pairs: DataFrame, ask: DataFrame, cand: DataFrame, k: int) -> DataFrame:
    """``qblock, width, query_id, vec_id, score``: of each pair of blocks the k best that may count; ``kth``, where given: each query's k-th score so far."""
    start = F.col("kth") if "kth" in pairs.columns else F.lit(None).cast("array<long>")
    side = lambda df, p: df.select("width", *[F.col(c).alias(p + c) for c in ("block", "ids", "points", "nodes")])
    met = pairs.select("width", "qblock", "cblock", start.alias("kth")).join(side(ask, "q"), ["width", "qblock"]).join(side(cand, "c"), ["width", "cblock"])
    # one task a pair of blocks, not one a query block
    met = met.repartition(F.col("qblock"), F.col("cblock"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q, c = (CoverTree.load(r[p + "ids"], r[p + "points"], r[p + "nodes"], r["width"]) for p in "qc")
                worst = None if r["kth"] is None else np.array([-np.inf if x is None else float(x) for x in r["kth"]])
                best = search(q, c, k, worst)
                many = [len(i) for i in best.ids]
                n = sum(many)
                score = [min(max(s, LONG[0]), LONG[1]) for one in best.score for s in one]
                block = (pa.array(np.full(n, r[x], np.int32)) for x in ("qblock", "width"))
                yield pa.RecordBatch.from_arrays([*block, pa.array(np.repeat(q.ids, many)), pa.array([i for one in best.ids for i in one], pa.int64()), pa.array(score, pa.int64())], names=["qblock", "width", "query_id", "vec_id", "score"])

    return met.mapInArrow(walk, "qblock int, width int, query_id long, vec_id long, score long")
