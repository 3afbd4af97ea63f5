"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically over the features, each reading one binned feature, then
over the strongest feature pairs; the trees of a feature add up to one lookup table per feature
(or pair), so a score is a sum of bin look-ups, vectorised over all rows.

Fitting takes a bounded sample: at most about ``sample_rows`` labelled rows (a documented
parameter), drawn by a hash of doc_id at the fraction that the counted labels call for.  Scoring
covers every whole text.

Defined cases: null and empty texts have all-zero features and get a score; a very long text is one row like any other; equal
features get equal scores; with no usable labels
the score is 0.5; with one class only it is that class's smoothed rate; several label rows of one doc_id
count as their mean, 0.5 and more as 1, null labels are left out; repeated documents are scored one by one; extra columns
of the documents are ignored by ``score`` and kept by ``keep_good``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spool import drawn
from .textkit import slices, words

_CLASS = np.full(256, 7, np.uint8)  # 7: bytes beyond ASCII
_CLASS[:128] = 4
_CLASS[65:91] = 0
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASS[[ord("|"), ord("!")]] = 6

NAMES = [
    "log_bytes", "mean_word", "long_word_share", "upper", "digit", "space", "symbol", "stop", "mark", "beyond",
    "upper_line", "digit_line", "symbol_line", "mark_line", "upper_lines", "symbol_lines", "mark_lines",
    "distinct_words", "repeat_1", "repeat_2", "repeat_3", "repeat_line", "log_lines", "line_copies", "mean_line",
]


def features(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    out = []
    for at, end, raw, offsets in slices(column):
        rows = end - at
        x = np.zeros((rows, len(NAMES)), np.float32)
        size = np.diff(offsets).astype(np.float64)
        one = np.maximum(size, 1)
        if len(raw):
            cls = _CLASS[raw]
            full = np.flatnonzero(size)
            at_row = offsets[:-1][full]
            newline = raw == 10
            begins = np.zeros(len(raw), bool)
            begins[1:] = newline[:-1]
            begins[at_row] = True
            line = np.flatnonzero(begins)
            line_row = np.searchsorted(offsets, line, side="right") - 1
            line_len = np.diff(np.append(line, len(raw))).astype(np.float64)
            by_line = {c: np.add.reduceat(cls == c, line, dtype=np.int32) / line_len for c in (0, 1, 2, 3, 4, 5, 6, 7)}
            share = {c: np.bincount(line_row, by_line[c] * line_len, rows) / one for c in by_line}
            worst = {c: np.zeros(rows) for c in (0, 2, 4, 6)}
            some = line_len >= 12
            for c in worst:
                np.maximum.at(worst[c], line_row[some], by_line[c][some])
            odd = lambda m: np.bincount(line_row, np.where(m, line_len, 0), rows) / one
            x[:, 0] = np.log1p(size)
            for k, c in zip(range(3, 10), (0, 2, 3, 4, 5, 6, 7), strict=True):
                x[:, k] = share[c]
            for k, c in zip(range(10, 14), (0, 2, 4, 6), strict=True):
                x[:, k] = worst[c]
            x[:, 14] = odd((by_line[0] > 0.3) & some)
            x[:, 15] = odd((by_line[4] > 0.1) & some)
            x[:, 16] = odd((by_line[6] > 0.03) & some)
            start, stop, h, row = words(raw, offsets)
            n = np.bincount(row, minlength=rows).astype(np.float64)
            nn = np.maximum(n, 1)
            x[:, 1] = np.bincount(row, stop - start, rows) / nn
            x[:, 2] = np.bincount(row, (stop - start) > 18, rows) / nn
            key = np.lexsort((h, row))
            hs, rs = h[key], row[key]
            fresh = np.ones(len(hs), bool)
            fresh[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
            # against the words that a text of this length tends to have, so that length alone is no sign
            x[:, 17] = np.bincount(rs, fresh, rows) / nn**0.85
            in_line = np.searchsorted(line, start, side="right") - 1
            line_words = np.maximum(np.bincount(in_line, minlength=len(line)), 1)
            for d in (1, 2, 3):
                again = np.zeros(len(h), bool)
                again[d:] = (h[d:] == h[:-d]) & (row[d:] == row[:-d])
                x[:, 17 + d] = np.bincount(row, again, rows) / nn
                rate = np.where(line_words >= 8, np.bincount(in_line, again, len(line)) / line_words, 0)
                np.maximum.at(x[:, 21], line_row, rate.astype(np.float32))
            lines = np.bincount(line_row, minlength=rows)
            x[:, 22] = np.log1p(lines)
            with np.errstate(over="ignore"):
                sig = np.zeros(len(line), np.uint64)
                np.add.at(sig, in_line, h * (np.arange(len(h), dtype=np.uint64) - np.searchsorted(start, line[in_line]).astype(np.uint64) + np.uint64(3)))
            key = np.lexsort((sig, line_row))
            copy = np.zeros(len(line), bool)
            copy[1:] = (sig[key][1:] == sig[key][:-1]) & (line_row[key][1:] == line_row[key][:-1]) & (sig[key][1:] != 0)
            x[:, 23] = np.bincount(line_row[key], copy, rows) / np.maximum(lines, 1)
            x[:, 24] = np.log1p(size / np.maximum(lines, 1))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _split_tree(g: np.ndarray, w: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A tree over ordered bins: value per bin.  Splits greedily where the gain is largest."""
    cg, cw = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(w)])
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, wl = cg[m] - cg[a], cw[m] - cw[a]
            gr, wr = cg[b] - cg[m], cw[b] - cw[m]
            gain = gl**2 / (wl + l2) + gr**2 / (wr + l2) - (cg[b] - cg[a]) ** 2 / (cw[b] - cw[a] + l2)
            j = int(np.argmax(gain))
            if gain[j] > best[0]:
                best = (gain[j], k, int(m[j]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    value = np.zeros(len(g))
    for a, b in parts:
        value[a:b] = (cg[b] - cg[a]) / (cw[b] - cw[a] + l2)
    return value


@dataclass
class Gam:
    """Edges per feature, a table per feature, and tables of feature pairs over coarse bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        b = self.bins(x)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return _sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_bins: int = 48, n_coarse: int = 8, n_pairs: int = 8, rate: float = 0.12, l2: float = 2.0) -> Gam:
    """Cyclic boosting: every round visits each feature once, in order."""
    m = Gam()
    if not len(y):
        return m
    p = (y.sum() + 0.5) / (len(y) + 1)
    m.base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return m
    q = np.linspace(0, 1, n_bins + 1)[1:-1]
    m.edges = [np.unique(np.quantile(x[:, j].astype(np.float64), q)).astype(np.float32) for j in range(x.shape[1])]
    b = m.bins(x)
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.base)
    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            pr = _sigmoid(z)
            g = np.bincount(b[:, j], y - pr, len(t))
            w = np.bincount(b[:, j], pr * (1 - pr), len(t))
            step = rate * np.clip(_split_tree(g, w, 4, l2), -4, 4)
            t += step
            z += step[b[:, j]]
    m.coarse = [np.arange(len(e) + 1) * n_coarse // (len(e) + 1) for e in m.edges]
    c = np.stack([m.coarse[j][b[:, j]] for j in range(b.shape[1])], 1)
    pr = _sigmoid(z)
    gain = []
    for i in range(c.shape[1]):
        for j in range(i):
            cell = c[:, i] * n_coarse + c[:, j]
            g, w = np.bincount(cell, y - pr, n_coarse**2), np.bincount(cell, pr * (1 - pr), n_coarse**2)
            gain.append((float((g**2 / (w + l2)).sum()), i, j))
    m.pairs = [(i, j, np.zeros((n_coarse, n_coarse))) for _, i, j in sorted(gain, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in m.pairs:
            pr = _sigmoid(z)
            cell = c[:, i] * n_coarse + c[:, j]
            g = np.bincount(cell, y - pr, n_coarse**2).reshape(n_coarse, n_coarse)
            w = np.bincount(cell, pr * (1 - pr), n_coarse**2).reshape(n_coarse, n_coarse)
            # a tree of depth two: the best cut of the first feature, then one of the second in each half
            rows_ = _split_tree(g.sum(1), w.sum(1), 2, l2)
            step = np.zeros_like(t)
            for half in np.unique(rows_):
                own = rows_ == half
                step[own] = _split_tree(g[own].sum(0), w[own].sum(0), 2, l2)
            step = rate * np.clip(step, -4, 4)
            t += step
            z += step[c[:, i], c[:, j]]
    return m


def _fold(column: str, folds: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], sample_rows: int) -> DataFrame:
    """``(text, y)`` of at most about ``sample_rows`` labelled documents outside the held-out fold.

    ``fold`` is (number of folds, the fold held out)."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("y")).where("_id is not null and y is not null")
    rows = rows.groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    rows = rows.where(_fold("_id", fold[0]) != fold[1])
    total = rows.count()
    if total > sample_rows:
        rows = rows.where(drawn(F.col("_id"), 11, sample_rows, total))
        total = sample_rows
    rows = F.broadcast(rows) if total <= 1_000_000 else rows
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(rows, "_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (5, 0), sample_rows: int = 60_000) -> Gam:
    """Fit on the features of the sample; only those (25 floats a row) come to the driver."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("y")], names=["x", "y"])

    got = labelled(docs, labels, label, fold, sample_rows).mapInArrow(take, "x binary, y int").toArrow()
    x = np.frombuffer(b"".join(v.as_py() for v in got.column("x")), np.float32).reshape(-1, len(NAMES))
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row; ``predicted`` is 1 from the threshold on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, columns as they are, that score at or above the threshold; no shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(names.index("text"))
            yield b.filter(pa.array(model.score(features(text.cast(pa.string()))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
