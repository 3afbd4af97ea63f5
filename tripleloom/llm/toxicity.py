"""Toxicity scoring after noisy-channel deobfuscation.

1. *Character language model.*  Trigram counts over the letters of every document (summed per task, then over
   tasks): what is gathered grows with the corpus, the model does not.
2. *Channel.*  What looks tampered with becomes a lattice: tokens with signs for letters, with letters repeated three times
   and more or with separators between letters, and chains of three and more letters and signs (one letter at least) set apart
   by any separators.  Each sign may stand for the letters that it imitates (so do look-alikes of other scripts beside Latin letters), separators and repetitions may be noise; one or two
   asterisks in a token may also stand for any letters, and then both readings are scored.  Viterbi finds the likeliest letters under the language model, and they stand
   if they cost less than the unchanged signs; neither a token's length nor its share of letters keeps it out.
3. *Scoring.*  Logistic regression over word units (whole words and word starts of 3 to 6 letters) of the
   restored text.  Units are chosen by their G2 against the labels.

The classifier is fitted on a bounded sample: about ``sample_rows`` labelled documents of each class, drawn by a
hash of doc_id.  Every whole text is scored.

Defined cases: a null or empty text has no unit and gets the score of the intercept; a very long text is read whole, its spans in
stretches of ``STRETCH`` characters; of readings of equal cost the first found stands; with labels of one class
only the score is that class's smoothed rate, with none 0; several labels of a doc_id count as their mean, 0.5 and more as 1; repeated documents are scored one by one; extra columns are ignored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_gam import labelled
from .textkit import U, mix

_STEP = 1 << 20
_TOP = 0x180
#: Letter number per character below _TOP: 0 no letter, else 1 and up by lower-case letter.
_LETTERS = sorted({chr(c).lower() for c in range(_TOP) if chr(c).isalpha() and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < _TOP})
_NUMBER = {c: i + 1 for i, c in enumerate(_LETTERS)}
SIZE = len(_LETTERS) + 1
_ID = np.zeros(_TOP, np.int64)
for _c in range(_TOP):
    _ID[_c] = _NUMBER.get(chr(_c).lower(), 0)
_LOW = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x250)], np.uint32)
_ALPHA = np.array([chr(c).isalpha() for c in range(0x10000)])

# Signs and the letters that they imitate.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Letters of other scripts that look like Latin ones; they count as such beside Latin letters only.
LOOKS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_LATIN_END = 0x250
_SEPARATORS = " .-_*~"
#: Fee of a sign that is read as a letter, and of one that stays a sign (none for punctuation at the ends).
IMITATES, STAYS = 0.7, 3.0
#: Characters after which the readings of a span are cut back to what they differ in.
STRETCH = 128
_PARTS = re.compile(f"[{re.escape(_SEPARATORS)}]+|[^{re.escape(_SEPARATORS)}]+")
#: Fee of separators as noise, in a chain and in a token, and as a word boundary, in a chain and in a token.
NOISE, PART = (0.3, 2.0), (2.0, 1.0)
#: Letters behind asterisks, and the fee of each.
_ANY, MASKED = "abcdefghijklmnopqrstuvwxyz", 0.7
_SIGN = np.zeros(0x10000, bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_LOUD = np.zeros(0x10000, bool)
_LOUD_SIGNS = "!|+("
_LOUD[[ord(c) for c in _LOUD_SIGNS]] = True
_LOOK = np.zeros(0x10000, bool)
_LOOK[[ord(x) for c in LOOKS for x in (c, c.upper())]] = True
_SEP = np.zeros(0x10000, bool)
_SEP[[ord(c) for c in _SEPARATORS]] = True
_BLANK = np.zeros(0x10000, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after the other, each with a newline behind it; and their bounds."""
    data = "\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, "<u4"), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def _table(t: np.ndarray, c: np.ndarray, other):
    out = t[np.minimum(c, len(t) - 1)]
    return np.where(c < len(t), out, other)


def trigrams(texts: list[str], into: np.ndarray) -> None:
    """Add the letter trigrams of the texts (0: between words)."""
    c, _ = codes(texts)
    i = _table(_ID, c, 0)
    into += np.bincount((i[:-2] * SIZE + i[1:-1]) * SIZE + i[2:], minlength=SIZE**3) if len(i) > 2 else 0


@dataclass
class CharModel:
    """Interpolated letter trigrams; ``cost[a, b, c]`` is minus the log probability of c after a, b."""

    cost: np.ndarray

    @classmethod
    def of(cls, count: np.ndarray) -> CharModel:
        n = count.reshape(SIZE, SIZE, SIZE).astype(np.float64)
        uni = n.sum((0, 1)) + 0.5
        uni /= uni.sum()
        b = n.sum(0)
        bi = (b + 5 * uni) / (b.sum(1, keepdims=True) + 5)
        tri = (n + 10 * bi[None]) / (n.sum(2, keepdims=True) + 10)
        return cls((-np.log(tri)).astype(np.float32))

    def restore(self, span: str) -> str:
        """The likeliest reading of a tampered span; what it has no letters for stays as it is."""
        low = span.lower()
        signs = (False, True) if any(c in SIGNS for c in low) else (False,)
        best = [min(self._read(low, as_is, masked) for as_is in signs)[1].strip() for masked in ((False, True) if "*" in low else (False,))]
        return " ".join(dict.fromkeys(best))  # asterisks can be noise or letters: both readings count

    def _read(self, low: str, as_is: bool, masked: bool) -> tuple[float, str]:
        """Cost and letters of the best reading, ``as_is`` with every sign left a sign."""
        beams = {(0, 0): (0.0, "")}
        done: list[str] = []
        prev = ""
        inner = range(len(low) - len(low.lstrip("(")), len(low.rstrip(_LOUD_SIGNS)))
        drawn = any(x == y == z for x, y, z in zip(low, low[1:], low[2:], strict=False))  # stretched words repeat at will
        latin = any(c < chr(_LATIN_END) and c.isalpha() for c in low)
        for n, (at, ch, fee) in enumerate(_steps(low, masked)):
            if n and n % STRETCH == 0:
                beams = _settled(beams, done)
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            options: list[tuple[str, float]] = []
            if ch in _NUMBER:
                options.append((ch, 0.0))
            if latin and ch in LOOKS:
                options.append((LOOKS[ch], 0.0))
            if ch in SIGNS and not as_is:
                options += [(s, IMITATES) for s in SIGNS[ch]]
            if ch in SIGNS and (as_is or at not in inner):
                options.append((ch, STAYS if at in inner else 0.0))
            if drawn and ch == prev:
                options.append(("", 0.4))
            if fee is not None:
                options += [("", fee), (ch, PART[NOISE.index(fee)])]
            elif ch == "*":
                options += [(ch, PART[1]), *((x, MASKED) for x in _ANY)]
            if not options:
                options = [(ch, 0.0)]
            for (a, b), (cost, out) in beams.items():
                for letter, fee in options:
                    if not letter:
                        key, total, text = (a, b), cost + fee, out
                    else:
                        k = _NUMBER.get(letter, 0)
                        if b == 0 and k == 0 and (letter[0] in _SEPARATORS or at not in inner):
                            key, total, text = (a, b), cost + fee, out + letter
                        else:
                            key, total, text = (b, k), cost + fee + float(self.cost[a, b, k]), out + letter
                    if key not in nxt or total < nxt[key][0]:
                        nxt[key] = (total, text)
            beams, prev = nxt, ch
        cost, out = min((cost + (float(self.cost[a, b, 0]) if b else 0.0), out) for (a, b), (cost, out) in beams.items())
        return cost, "".join(done) + out


def _steps(low: str, masked: bool) -> Iterator[tuple[int, str, float | None]]:
    """Place and text of each character or run of separators, and for these the fee of being noise: little within a chain.
    ``masked``: asterisks outside of chains stand for letters."""
    parts, at = _PARTS.findall(low), 0
    one = [len(p) == 1 and p not in _SEPARATORS for p in parts]
    linked = [i > 0 and i + 1 < len(parts) and one[i - 1] and one[i + 1] for i in range(len(parts))]
    least = min((len(p) for p, x in zip(parts, linked, strict=True) if x), default=0)  # longer runs rather part words
    for i, p in enumerate(parts):
        if p[0] not in _SEPARATORS:
            yield from ((at + k, ch, None) for k, ch in enumerate(p))
        else:
            chain = linked[i] and (i > 1 and linked[i - 2] or i + 2 < len(parts) and linked[i + 2])
            if masked and not chain and p in ("*", "**"):
                yield from ((at + k, ch, None) for k, ch in enumerate(p))
            else:
                yield at, p, NOISE[0] if chain and len(p) == least else NOISE[1]
        at += len(p)


def _settled(beams: dict, done: list[str]) -> dict:
    """``beams`` without their common beginning, which goes to ``done``; far apart, only the best is left."""
    same = commonprefix([out for _, out in beams.values()])
    if max(len(out) for _, out in beams.values()) - len(same) > 2 * STRETCH:
        beams = dict([min(beams.items(), key=lambda x: x[1])])
        same = next(iter(beams.values()))[1]
    done.append(same)
    return {k: (cost, out[len(same) :]) for k, (cost, out) in beams.items()}


def tampered(texts: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Spans (start, end) per text that look tampered with."""
    c, bounds = codes(texts)
    n = len(c)
    if n < 4:
        return {}
    letter = _table(_ALPHA, c, False)
    sign, loud, sep, blank = (_table(t, c, False) for t in (_SIGN, _LOUD, _SEP, _BLANK))
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    hit = sign & ((before | after) & ~loud | before & after)
    low = _table(_LOW, c, 0)
    latin = letter & (c < _LATIN_END)
    look = _table(_LOOK, c, False)
    hit[1:] |= look[1:] & latin[:-1]
    hit[:-1] |= look[:-1] & latin[1:]
    hit[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] > 0)
    # letters with nothing but separators between them
    member, seps = letter | sign & ~(loud & (before | after)), np.concatenate([[0], np.cumsum(sep & ~blank)])
    at = np.flatnonzero(letter)
    gap = at[1:] - at[:-1] - 1
    hit[at[:-1][(gap > 0) & (seps[at[1:]] - seps[at[:-1] + 1] == gap)]] = True
    single = member.copy()
    single[1:] &= ~member[:-1]
    single[:-1] &= ~member[1:]
    out: dict[int, list[tuple[int, int]]] = {}
    edge = np.flatnonzero(~(letter | sign | sep) | blank)
    at = np.flatnonzero(hit)
    for tok in np.unique(np.searchsorted(edge, at)).tolist() if len(at) else ():
        a, b = (int(edge[tok - 1]) + 1 if tok else 0), int(edge[tok])
        core = np.flatnonzero(letter[a:b] | sign[a:b])  # without the punctuation around it
        a, b = a + int(core[0]), a + int(core[-1]) + 1
        r = int(np.searchsorted(bounds, a, side="right")) - 1
        out.setdefault(r, []).append((a - int(bounds[r]), b - int(bounds[r])))
    # chains: letters and signs that stand alone, with nothing but separators between them
    lone, seps = np.flatnonzero(single), np.concatenate([[0], np.cumsum(sep)])
    if len(lone) > 2:
        linked = seps[lone[1:]] - seps[lone[:-1] + 1] == lone[1:] - lone[:-1] - 1
        first = np.flatnonzero(np.concatenate([[True], ~linked]))
        end = np.append(first[1:], len(lone))
        letters = np.add.reduceat(letter[lone].astype(np.int64), first)
        for x, y in zip(first[(end - first > 2) & (letters > 0)].tolist(), end[(end - first > 2) & (letters > 0)].tolist(), strict=True):
            a, b = int(lone[x]), int(lone[y - 1]) + 1
            r = int(np.searchsorted(bounds, a, side="right")) - 1
            out.setdefault(r, []).append((a - int(bounds[r]), b - int(bounds[r])))
    return {r: _merged(spans) for r, spans in out.items()}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def restored(texts: list[str], model: CharModel) -> list[str]:
    """The texts with tampered spans read as the letters behind them."""
    out = list(texts)
    known: dict[str, str] = {}
    for r, spans in tampered(texts).items():
        t, parts, at = texts[r], [], 0
        for a, b in spans:
            if (span := t[a:b]) not in known:
                known[span] = model.restore(span)
            parts += [t[at:a], known[span]]
            at = b
        out[r] = "".join([*parts, t[at:]])
    return out


_BASE = 0x9E3779B97F4A7C15
_PW: list[tuple[np.ndarray, np.ndarray]] = []


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, unit hash)`` of all words and word starts, repeats included."""
    c, bounds = codes(texts)
    letter = _table(_ALPHA, c, False)
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, U)
    if not _PW or len(_PW[0][0]) <= len(c):
        _PW[:] = [tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(len(c) + 1, x, U), dtype=U)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))]
    up, down = _PW[0]
    with np.errstate(over="ignore"):
        low = np.where(c < len(_LOW), _LOW[np.minimum(c, len(_LOW) - 1)], c).astype(U)
        p = np.concatenate([np.zeros(1, U), np.cumsum(mix(low + U(99)) * up[: len(c)], dtype=U)])
        cut = lambda x, y: (p[y] - p[x]) * down[x]
        row = np.searchsorted(bounds, a, side="right") - 1
        rows, out = [row], [mix(cut(a, b) + U(1))]
        for k in (3, 4, 5, 6):
            ok = b - a >= k
            rows.append(row[ok])
            out.append(mix(cut(a[ok], a[ok] + k) + U(1 + k)))
    return np.concatenate(rows), np.concatenate(out)


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    some, size = [], 0
    for t in column.to_pylist():
        some.append(t or "")
        size += len(some[-1])
        if size >= _STEP:
            yield some
            some, size = [], 0
    if some:
        yield some


def char_model(docs: DataFrame) -> CharModel:
    """Counts over every text; each task sends its non-zero trigrams once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for some in _chunks(b.column("text")):
                trigrams(some, total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # SIZE ** 3 rows at most
    n = np.zeros(SIZE**3, np.int64)
    n[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return CharModel.of(n)


@dataclass
class Toxic:
    chars: CharModel
    lexicon: np.ndarray  # sorted unit hashes
    weights: np.ndarray
    bias: float

    def presence(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.lexicon)), bool)
        if len(self.lexicon):
            row, unit = units(restored(texts, self.chars))
            at = np.minimum(np.searchsorted(self.lexicon, unit), len(self.lexicon) - 1)
            ok = self.lexicon[at] == unit
            x[row[ok], at[ok]] = True
        return x

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.presence(texts) @ self.weights + self.bias if len(self.lexicon) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _g2(t: np.ndarray, c: np.ndarray, nt: int, nc: int) -> np.ndarray:
    """G2 of a unit's presence against the class."""
    out = np.zeros(len(t))
    n = nt + nc
    for x, m in ((t, nt), (c, nc), (nt - t, nt), (nc - c, nc)):
        row = (t + c) if x is t or x is c else n - t - c
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(x > 0, 2 * x * np.log(x * n / (m * row)), 0)
    return out


def _regress(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam; the intercept is not shrunk."""
    x = np.concatenate([x.astype(np.float32), np.ones((len(x), 1), np.float32)], 1)
    w = np.zeros(x.shape[1], np.float32)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    pull = np.full(len(w), l2 / len(y), np.float32)
    pull[-1] = 0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) / len(y)).astype(np.float32) + pull * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1].astype(np.float64), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = (4, 2), sample_rows: int = 6_000, lexicon: int = 600, least: int = 4) -> Toxic:
    """The character model over all documents, then the classifier on the sample.

    ``lexicon`` bounds the units, ``least`` the sampled documents of one class that a unit must be in."""
    chars = char_model(docs)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = [labelled(docs, y.where(f"y = {k}"), "y", fold, sample_rows).select("text", "y") for k in (1, 0)]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in _chunks(b.column("text")):
                row, unit = units(restored(some, chars))
                u, n = np.unique(np.unique(np.stack([row.astype(U), unit], 1), axis=0)[:, 1] if len(unit) else unit, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([len(some)] * len(u), pa.int64())], names=["unit", "n", "docs"])

    schema = "unit long, n long, docs long"
    counted = [s.mapInArrow(seen, schema).groupBy("unit").agg(F.sum("n").alias("n")) for s in sample]
    # units of the toxic sample in enough documents; the sample bounds their number
    t = counted[0].where(F.col("n") >= least)
    both = t.withColumnRenamed("n", "t").join(counted[1].withColumnRenamed("n", "c"), "unit", "left").select("unit", "t", F.coalesce("c", F.lit(0)).alias("c")).toArrow()
    size = {r["y"]: r["n"] for r in sample[0].unionByName(sample[1]).groupBy("y").agg(F.count("*").alias("n")).collect()}
    nt, nc = size.get(1, 0), size.get(0, 0)
    if not nt or not nc:
        rate = (nt + 0.5) / (nt + nc + 1) if nt + nc else 1e-9
        return Toxic(chars, np.zeros(0, U), np.zeros(0), math.log(rate / (1 - rate)))
    unit, tc, cc = both.column("unit").to_numpy().view(U), both.column("t").to_numpy().astype(float), both.column("c").to_numpy().astype(float)
    worth = np.where(tc * nc > 2 * cc * nt, _g2(tc, cc, nt, nc), 0)
    best = np.lexsort((unit, -worth))[:lexicon]
    best = best[worth[best] > 12]
    model = Toxic(chars, np.sort(unit[best]), np.zeros(len(best)), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(x).tobytes() for some in _chunks(b.column("text")) for x in model.presence(some)]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), b.column("y")], names=["x", "y"])

    if len(best):
        got = sample[0].unionByName(sample[1]).mapInArrow(rows, "x binary, y int").toArrow()
        pairs = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True))
        x = np.unpackbits(np.frombuffer(b"".join(p[0] for p in pairs), np.uint8).reshape(len(pairs), -1), axis=1)[:, : len(best)]
        model.weights, model.bias = _regress(x, np.array([p[1] for p in pairs], float))
    else:
        model.bias = math.log((nt + 0.5) / (nc + 0.5))
    return model


def score(docs: DataFrame, model: Toxic, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([model.score(some) for some in _chunks(b.column("text"))]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
