"""Suffix dedup, filter audit and spelling variants against brute force, and their defined edge cases."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import filter_audit, queries, repeats, spelling

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "no id here at all " * 9), (None, "no id here at all " * 9), (5, "été " * 60), (6, "word " * 30_000), (4, "another text under one id " * 8)]
SCHEMA = "doc_id long, text string, source string, bits string, copy string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 2 else "s", "clash", "clash") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def left_by_hand(rows, length):
    """Every window in order; ``rows`` are (order key, bytes), equal rows once."""
    seen, out = set(), {}
    for key, b in sorted(set(rows)):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out[key, b] = gone
    return out


def checked(docs, length, **more):
    rows = [(repeats.LAST if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    tag = lambda b: int(hashlib.md5(b).hexdigest()[:15], 16)
    want = collections.Counter()
    by = left_by_hand([((i, tag(b)), b) for i, b in rows], length)
    for i, b in rows:
        gone = by[(i, tag(b)), b]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
        want[i, len(b), str(edges), bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    got = collections.Counter()
    for r in repeats.repeated(docs, length, **more).collect():
        got[repeats.LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], str([[s["start"], s["stop"]] for s in r["spans"]]), bytes(r["kept"])] += 1
    assert got == want
    return want


def test_difference_covers():
    for v, cover in repeats.COVERS.items():
        assert sorted((a - b) % v for a in cover for b in cover if a != b) == list(range(1, v))


def test_suffix_dedup_of_whole_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    found = checked(d, 100)
    assert sum(k[2] != "[]" for k in found) > 5
    by_id = {r["doc_id"]: r for r in queries.op11_suffix_dedup(spark, SF).collect()}
    for (i, n, spans, kept), _ in found.items():
        r = by_id[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), spans.count("[") - 1, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_in_small_buckets_and_slices(spark, monkeypatch):
    """Passages that start and end anywhere, overlap and repeat within a text; short strings, many buckets and blocks."""
    rng = np.random.default_rng(3)
    base = "".join(chr(97 + x) for x in rng.integers(0, 4, 3000))
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            a = int(rng.integers(0, 2900))
            parts.append(base[a : a + int(rng.integers(5, 90))] if rng.integers(0, 2) else "".join(chr(97 + x) for x in rng.integers(0, 4, 30)))
        texts.append("".join(parts))
    texts += [texts[0], texts[1], "ab" * 200, "x" * 500, "x" * 499]
    d = spark.createDataFrame([(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)], "doc_id long, text string").repartition(5)
    for length in (13, 37):
        checked(d, length, blocks=3, bucket=50)


def test_suffix_dedup_odd_rows(spark, odd):
    checked(odd, 100)
    assert repeats.repeated(odd.where("1 = 0")).count() == 0
    with pytest.raises(ValueError):
        repeats.cover_of(9)


def audit_by_hand(docs, labels):
    said = collections.defaultdict(lambda: [False, False])
    for r in labels:
        if r["doc_id"] is not None:
            said[r["doc_id"]][0] |= r["quality"] == 1
            said[r["doc_id"]][1] |= r["toxic"] == 1
    least = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    rows = []
    for r in docs:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {k for k, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), r["doc_id"] is not None and least[t] < r["doc_id"]), strict=True) if x}
        rows.append((r["source"] or "", fails, *(said[r["doc_id"]] if r["doc_id"] is not None else (False, False))))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, odd, labels, monkeypatch):
    for docs, marks in ((spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")), (odd, labels)):
        got = filter_audit.audit(docs, marks).collect()
        assert {tuple(r) for r in got} == audit_by_hand(docs.collect(), marks.collect()) and len(got) == len(set(got))
    assert filter_audit.audit(odd.where("1 = 0"), labels).count() == 0
    assert filter_audit.first_failures().shape == (32, 120)


def test_filter_audit_long_texts_in_pieces(monkeypatch):
    text = b"a bb  ccc\n" * 50
    whole = filter_audit.word_counts(text)
    monkeypatch.setattr(filter_audit, "_STEP", 7)
    assert filter_audit.word_counts(text) == whole == (150, 3)


def spelling_by_hand(docs, every=199, least=6, occurrences=5, ratio=5):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}
    letters = sorted({c for w in n for c in w})
    form, out = {}, {}
    for w in n:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = [x for x in near if x in n and x != w]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = (len(near), n[form[w]] if form[w] else None)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], *out[w]))
    return rows


def test_spelling_of_whole_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_spelling_variants(spark, SF).collect()
    assert {tuple(r) for r in got} == spelling_by_hand(docs) and len(got) == len(set(got))


def test_spelling_chains_ties_and_odd_rows(spark, odd, monkeypatch):
    words = {"abcdef": 400, "abcdeg": 60, "abcdegg": 8, "abcdeggh": 1, "zzzzzz": 30, "zzzzzzz": 30, "zzzzzy": 5, "Ünïcode": 40, "ünïcode": 3, "Ünicode": 2, "aaaaaab": 9, "aaaaab": 9}
    docs = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())] + [(None, "ABCDEF1abcdef_abcdeg"), (3, None), (99, "x" * 3000), (99, "x" * 3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for every in (199, 3):
        want = spelling_by_hand(docs, every, occurrences=1)
        for piece in (1 << 20, 5):
            monkeypatch.setattr(spelling, "_STEP", piece)
            assert {tuple(r) for r in spelling.variants(d, every, occurrences=1).collect()} == want
    assert {tuple(r) for r in spelling.variants(odd).collect()} == spelling_by_hand(ODD)
    assert spelling.variants(odd.where("1 = 0")).count() == 0
