"""Language identification by error-correcting output codes.

Every learned language gets a binary codeword; one binary classifier per code bit predicts it from
hashed byte n-grams (lengths 1 to 3 and the starts of words).  Decoding sums a logistic loss of each bit's margin against
each codeword, weighted by how well the bit did on the training sample, and picks the
nearest codeword; a small gap to the second marks the text as ambiguous.

Fitting takes a bounded sample (about ``per_language`` documents of each language, drawn by a hash
of doc_id); prediction reads every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn from
every text is ``und``; with one language every text with a letter gets it, with score 1; a very long
text is one profile like any other; of equal losses the first name stands; null languages
are not learned from; repeated documents are predicted one by one; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spool import drawn
from .textkit import slices

#: Size of the hashed n-gram space; a power of two.
SPACE_BITS = 13
_LETTER = regex.compile(r"\p{L}")


def profile(column: pa.Array, bits: int = SPACE_BITS) -> np.ndarray:
    """Per text the square roots of its n-gram shares (unit length by construction)."""
    out = []
    size = 1 << bits
    low = np.arange(256, dtype=np.uint32)
    low[65:91] += 32
    low[:33] = 32
    for at, end, raw, offsets in slices(column):
        x = np.zeros((end - at, size), np.float32)
        if len(raw):
            c = low[raw]
            with np.errstate(over="ignore"):
                one = (c * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
                two = ((c[:-1] * np.uint32(257) + c[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
                tri = ((c[:-2] * np.uint32(66049) + c[1:-1] * np.uint32(257) + c[2:] + np.uint32(1 << 25)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
            for r in range(end - at):
                a, b = int(offsets[r]), int(offsets[r + 1])
                if b > a:
                    n = np.bincount(one[a:b], minlength=size) + np.bincount(two[a : max(a, b - 1)], minlength=size) + np.bincount(tri[a : max(a, b - 2)], minlength=size)
                    x[r] = np.sqrt(n / n.sum())
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, size), np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """``k`` codewords of -1 and 1: all distinct splits for up to five classes, else a random
    code of ``10 log2 k`` bits, the best of many by least distance."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([[1 if c == 0 or (b >> (c - 1)) & 1 else -1 for b in range(2 ** (k - 1) - 1)] for c in range(k)], float)
    rng = np.random.default_rng(seed)
    n = int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1.0
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, n))
        d = (n - m @ m.T) / 2
        d[np.arange(k), np.arange(k)] = n
        if d.min() > apart and (np.abs(m.sum(0)) < k).all():
            best, apart = m, d.min()
    return best if best is not None else rng.choice([-1.0, 1.0], (k, n))


@dataclass
class Ecoc:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray  # n-gram space x bits
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: class, score in 0..1 and the gap of losses to the second class."""
        if len(self.names) < 2:
            z = np.zeros(len(x), int)
            return z, np.ones(len(x)), np.ones(len(x))
        m = np.clip(self.margins(x), -15, 15)
        loss = (np.log1p(np.exp(-m[:, None, :] * self.code[None])) * self.trust).sum(2) / self.trust.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        r = np.arange(len(x))
        gap = loss[r, order[:, 1]] - loss[r, order[:, 0]]
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        return order[:, 0], (p / p.sum(1, keepdims=True))[r, order[:, 0]], gap


def fit(x: np.ndarray, lang: list[str], steps: int = 150, l2: float = 1e-5) -> Ecoc:
    """Logistic regression per bit, all bits at once, classes weighted alike, by Adam."""
    names = sorted(set(lang))
    code = codewords(len(names))
    c = np.array([names.index(v) for v in lang])
    y = code[c] if len(c) else np.zeros((0, code.shape[1]))
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(names) > 1:
        share = (1 / np.bincount(c)[c] / len(names)).astype(np.float32)[:, None]
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, steps + 1):
            g = (-y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * share).astype(np.float32)
            gw, gb = x.T @ g + l2 * w, g.sum(0)
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            lr = 0.3 / (1 + t / 50)
            w -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= lr * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        right = (((x @ w + b) * y > 0) * share).sum(0)
        trust = np.clip(right - 0.5, 0.01, None)
    else:
        trust = np.ones(code.shape[1])
    return Ecoc(names, code, w, b, trust)


def train(docs: DataFrame, fold: tuple[int, int] | None = (4, 2), per_language: int = 800, sample_rows: int = 16_000) -> Ecoc:
    """Learn from documents with a language outside the held-out fold (number of folds, fold).

    About ``per_language`` documents of each language are taken, fewer where languages are so many that ``sample_rows`` (16 KB each) would not hold them."""
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    if fold:
        d = d.where(~F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False)))
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Ecoc([], codewords(0), np.zeros((1 << SPACE_BITS, 1), np.float32), np.zeros(1), np.ones(1))
    each = min(per_language, max(1, sample_rows // len(counts)))
    chosen = F.lit(False)
    for k, n in counts.items():  # a row a language
        chosen = F.when(F.col("lang") == k, drawn(F.coalesce("_id", F.lit(0)), 5, each, n)).otherwise(chosen)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, _ in slices(b.column("text")):
                x = [r.astype(np.float16).tobytes() for r in profile(b.column("text").slice(lo, hi - lo))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column("lang").slice(lo, hi - lo)], names=["x", "lang"])

    got = d.where(chosen).select("text", "lang").mapInArrow(take, "x binary, lang string").toArrow()
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("x").to_pylist(), strict=True))
    x = np.frombuffer(b"".join(v for _, v in rows), np.float16).astype(np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 1 << SPACE_BITS), np.float32)
    return fit(x, [k for k, _ in rows])


def predict(docs: DataFrame, model: Ecoc, unsure: float = 0.2) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            names, scores, doubts = [], [], []
            at = 0
            for lo, hi, _, _ in slices(text):
                part = text.slice(lo, hi - lo)
                letter = np.array([t is not None and _LETTER.search(t) is not None for t in part.to_pylist()])
                if not model.names:
                    letter[:] = False
                c, s, gap = model.decode(profile(part)) if letter.any() else (np.zeros(hi - lo, int), np.zeros(hi - lo), np.zeros(hi - lo))
                names += [model.names[k] if ok else "und" for k, ok in zip(c, letter, strict=True)]
                scores += np.where(letter, s, 0.0).tolist()
                doubts += (~letter | (gap < unsure)).tolist()
                at = hi
            assert at == len(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
